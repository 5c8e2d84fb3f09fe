"""License scans by ordered signature rules.

A text is reduced to its words (runs of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased) joined by single spaces, so punctuation and line breaks do not matter and spans are
counted in words. One pass of a keyword automaton tells which rules can match at all; only their
expressions run. Of two detections of which one span contains the other, the one of higher
priority stays, at equal priority the longer one, then the earlier rule; partial overlaps both
stay. Base phrases are found apart from the rules and are never suppressed.

Defined results: a null or empty text has no words and no detections; repeated rows and null ids
come out as they come in; an empty table gives no rows; further columns are ignored. Memory is
one text and its words; every expression is bounded, so a very long text costs its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tapeweave.llm.common import field_sql, text_or_empty

#: Label of every phrase whose places are always reported.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_TO = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Rule:
    label: str
    name: str
    pattern: str
    keyword: str
    priority: int


#: Two spellings of a name, each as (expression, keyword).
SPELLINGS = {
    "{cc}": (("creative commons", "creative commons"), ("cc", " cc ")),
    "{cc0}": (("creative commons (?:zero|0)", "creative commons"), ("cc0", "cc0")),
}

#: label: (names as expressions over words, identifiers, words of addresses, keyword of the names)
FAMILIES = {
    "apache": (r"apache (?:software )?licen[cs]e", ["apache"], "apache org licenses", "apache"),
    "mit": (r"(?:mit|expat|x11) licen[cs]e", ["mit", "x11"], "opensource org licenses mit", "licen"),
    "bsd": (r"(?:new |modified |simplified |revised )?bsd(?: [234] clause)?(?: style)? licen[cs]e", ["bsd 2 clause", "bsd 3 clause", "0bsd"], "opensource org licenses bsd", "bsd"),
    "gpl": (r"(?:gnu )?(?<!lesser )(?<!affero )(?<!library )general public licen[cs]e", ["gpl", "gpl 2 0", "gpl 3 0"], "gnu org licenses gpl", "general public licen"),
    "lgpl": (r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ["lgpl", "lgpl 2 1", "lgpl 3 0"], "gnu org licenses lgpl", "general public licen"),
    "agpl": (r"(?:gnu )?affero general public licen[cs]e", ["agpl", "agpl 3 0"], "gnu org licenses agpl", "affero"),
    "fdl": (r"(?:gnu )?free documentation licen[cs]e", ["gfdl", "gfdl 1 3"], "gnu org licenses fdl", "free documentation"),
    "mpl": (r"mozilla public licen[cs]e", ["mpl 1 1", "mpl 2 0"], "mozilla org mpl", "mozilla"),
    "epl": (r"eclipse public licen[cs]e", ["epl 1 0", "epl 2 0"], "eclipse org legal epl", "eclipse"),
    "cddl": (r"common development and distribution licen[cs]e", ["cddl 1 0", "cddl 1 1"], "opensource org licenses cddl", "common development"),
    "eupl": (r"european union public licen[cs]e", ["eupl 1 1", "eupl 1 2"], "joinup ec europa eu eupl", "european union"),
    "isc": (r"isc licen[cs]e", ["isc"], "opensource org licenses isc", "isc"),
    "zlib": (r"zlib(?: libpng)? licen[cs]e", ["zlib"], "zlib net zlib license", "zlib"),
    "boost": (r"boost software licen[cs]e", ["bsl 1 0"], "boost org license", "boost"),
    "artistic": (r"artistic licen[cs]e", ["artistic 1 0", "artistic 2 0"], "opensource org licenses artistic", "artistic"),
    "psf": (r"python software foundation licen[cs]e", ["psf 2 0", "python 2 0"], "python org psf license", "python software"),
    "unlicense": (r"the unlicen[cs]e", ["unlicense"], "unlicense org", "unlicen"),
    "wtfpl": (r"do what the f\w{1,8} you want to public licen[cs]e", ["wtfpl"], "wtfpl net", "you want to public"),
    "ofl": (r"(?:sil )?open font licen[cs]e", ["ofl 1 1"], "scripts sil org ofl", "open font"),
    "odbl": (r"open (?:data commons open )?database licen[cs]e", ["odbl 1 0"], "opendatacommons org licenses odbl", "database licen"),
    "pddl": (r"public domain dedication and licen[cs]e", ["pddl 1 0"], "opendatacommons org licenses pddl", "public domain dedication"),
    "odc-by": (r"open data commons attribution licen[cs]e", ["odc by 1 0"], "opendatacommons org licenses by", "open data commons"),
    "ogl": (r"open government licen[cs]e", ["ogl uk 3 0"], "nationalarchives gov uk doc open government licence", "open government"),
    "cc0": (r"{cc0}(?: universal)?(?: public domain dedication)?", ["cc0 1 0"], "creativecommons org publicdomain zero", "{cc0}"),
    "cc-by": (r"{cc} (?:attribution|by)(?! (?:sa|nc|nd|share|non|no))", ["cc by 3 0", "cc by 4 0"], "creativecommons org licenses by", "{cc}"),
    "cc-by-sa": (r"{cc} (?:attribution|by) (?:sa|share ?alike)", ["cc by sa 3 0", "cc by sa 4 0"], "creativecommons org licenses by sa", "{cc}"),
    "cc-by-nc": (r"{cc} (?:attribution|by) (?:nc|non ?commercial)(?! (?:sa|nd|share|no))", ["cc by nc 4 0"], "creativecommons org licenses by nc", "{cc}"),
    "cc-by-nd": (r"{cc} (?:attribution|by) (?:nd|no ?deriv\w{0,8})", ["cc by nd 4 0"], "creativecommons org licenses by nd", "{cc}"),
    "cc-by-nc-sa": (r"{cc} (?:attribution|by) (?:nc|non ?commercial) (?:sa|share ?alike)", ["cc by nc sa 4 0"], "creativecommons org licenses by nc sa", "{cc}"),
    "cc-by-nc-nd": (r"{cc} (?:attribution|by) (?:nc|non ?commercial) (?:nd|no ?deriv\w{0,8})", ["cc by nc nd 4 0"], "creativecommons org licenses by nc nd", "{cc}"),
    "ms-pl": (r"microsoft public licen[cs]e", ["ms pl"], "opensource org licenses ms pl", "microsoft"),
    "ms-rl": (r"microsoft reciprocal licen[cs]e", ["ms rl"], "opensource org licenses ms rl", "microsoft"),
    "osl": (r"open software licen[cs]e", ["osl 3 0"], "opensource org licenses osl", "open software"),
    "afl": (r"academic free licen[cs]e", ["afl 3 0"], "opensource org licenses afl", "academic free"),
    "cecill": (r"cecill(?: [abc2])? (?:free software )?licen[cs]e", ["cecill 2 1", "cecill b", "cecill c"], "cecill info licences", "cecill"),
    "upl": (r"universal permissive licen[cs]e", ["upl 1 0"], "opensource org licenses upl", "universal permissive"),
    "ncsa": (r"(?:university of illinois )?ncsa open source licen[cs]e", ["ncsa"], "opensource org licenses ncsa", "ncsa"),
    "postgresql": (r"postgresql licen[cs]e", ["postgresql"], "opensource org licenses postgresql", "postgresql"),
    "openssl": (r"openssl licen[cs]e", ["openssl"], "openssl org source license", "openssl"),
    "php": (r"php licen[cs]e", ["php 3 01"], "php net license", "php"),
    "ruby": (r"ruby licen[cs]e", ["ruby"], "ruby lang org license", "ruby"),
    "vim": (r"vim licen[cs]e", ["vim"], "vim org license", "vim"),
    "sspl": (r"server side public licen[cs]e", ["sspl 1 0"], "mongodb com licensing server side public license", "server side"),
    "busl": (r"business source licen[cs]e", ["busl 1 1"], "mariadb com bsl11", "business source"),
    "elastic": (r"elastic licen[cs]e", ["elastic 2 0"], "elastic co licensing elastic license", "elastic"),
    "llama": (r"llama (?:\d )?community licen[cs]e", ["llama2", "llama3"], "llama meta com license", "llama"),
    "openrail": (r"(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[cs]e)?", ["openrail", "openrail m"], "bigscience huggingface co rail", "rail"),
}

#: Turns of phrase that grant a named license, strongest first, with the priority of the pair.
GRANTS = (
    (r"(?:is |are |be )?(?:dual )?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?", 90),
    (r"(?:distributed|released|published|made available|available) under (?:the )?(?:terms of )?(?:the )?", 80),
    (r"(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?", 70),
)
_VERSION = r"(?:(?: as published by the free software foundation)?(?: (?:either )?(?:version|v))? ?\d{1,2}(?: \d{1,2})?(?: or (?:any )?later(?: version)?)?)?"

#: Notices without a family: (label, expression, keyword, priority).
NOTICES = (
    ("reserved", r"all rights reserved", "all rights reserved", 40),
    ("reserved", r"no rights? (?:is|are) granted", "granted", 45),
    ("reserved", r"may not be (?:reproduced|copied|redistributed|republished)(?: \w{1,20}){0,12} without (?:\w{1,20} ){0,3}permission", "may not be", 60),
    ("reserved", r"unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: \w{1,20}){0,6} prohibited", "unauthori", 60),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", "copyright", 30),
    ("copyright", r"copyright (?:holders?|owners?)", "copyright", 20),
    ("public-domain", r"(?:placed|dedicated|released) (?:in|into|to) the public domain", "public domain", 65),
    ("public-domain", r"(?:is|are) in the public domain", "public domain", 60),
    ("proprietary", r"proprietary and confidential", "proprietary", 60),
    ("proprietary", r"trade secrets? of", "trade secret", 50),
    ("permissive", r"permission is hereby granted free of charge to any person", "permission is hereby", 85),
    ("permissive", r"permission to use copy modify and(?: or)? distribute this software", "permission to use", 85),
    ("permissive", r"redistribution and use in source and binary forms", "redistribution and use", 85),
    ("as-is", r"provided as is without warrant(?:y|ies)", "as is", 35),
)

#: "licensed under the", "released under", "made available to you under the terms of the"
_UNDER = (
    r"(?:(?:dual |tri )?(?:re)?licen[cs]ed|released|distributed|published|available|provided|offered|shared|open ?sourced)"
    r" (?:\w{1,12} ){0,2}?under (?:the )?(?:terms of (?:the )?)?(?:an? )?"
)
_OR_LATER = r"(?: only| or (?:any )?(?:later|newer|greater|above)(?: versions?)?)?"

#: Short forms that people write instead of a license's name: (label, expression, keyword, priority).
SHORT = (
    ("gpl", rf"{_UNDER}(?:gnu )?gpl(?: ?v ?\d| ver(?:sion)? \d| \d)?(?: 0)?{_OR_LATER}", "gpl", 78),
    ("gpl", rf"(?:gnu )?gpl(?: ?v ?[123]| ver(?:sion)? [123]| [123])(?: 0)?{_OR_LATER}", "gpl", 48),
    ("gpl", r"gnu gpl", "gnu gpl", 44),
    ("gpl", r"gpl licen[cs]ed?", "gpl licen", 44),
    ("lgpl", rf"{_UNDER}(?:gnu )?lgpl(?: ?v ?\d| ver(?:sion)? \d| \d)?(?: [01])?{_OR_LATER}", "lgpl", 78),
    ("lgpl", rf"(?:gnu )?lgpl(?: ?v ?[23]| ver(?:sion)? [23]| [23])(?: [01])?{_OR_LATER}", "lgpl", 48),
    ("lgpl", r"gnu lgpl", "gnu lgpl", 44),
    ("agpl", rf"{_UNDER}(?:gnu )?agpl(?: ?v ?3| version 3| 3)?(?: 0)?{_OR_LATER}", "agpl", 78),
    ("agpl", rf"(?:gnu )?agpl(?: ?v ?[13]| version [13]| [13])(?: 0)?{_OR_LATER}", "agpl", 48),
    ("fdl", rf"(?:gnu fdl|gfdl)(?: ?v? ?1 [0123])?{_OR_LATER}", "fdl", 46),
    ("mit", rf"{_UNDER}mit(?: x11| expat)?", " mit ", 76),
    ("mit", r"mit licen[cs]ed", "mit licen", 48),
    ("apache", rf"{_UNDER}apache(?: ?v? ?2)?(?: 0)?(?: licen[cs]e)?", "apache", 77),
    ("apache", r"apache (?:v ?|version )?2 0(?: licen[cs]ed?)?(?! (?:web |http |httpd )?server)", "apache", 46),
    ("apache", r"apache ?v2(?: 0)?(?: licen[cs]ed?)?", "apache", 46),
    ("apache", r"apache licen[cs]ed", "apache licen", 46),
    ("apache", r"asl ?v?2 0", " asl", 42),
    ("bsd", rf"{_UNDER}(?:new |modified |simplified |revised |(?:[0234]|two|three|four) clause )?bsd(?: [0234] clause)?", "bsd", 76),
    ("bsd", r"bsd [0234] clause", "bsd", 48),
    ("bsd", r"(?:[0234]|two|three|four) clause bsd", "clause bsd", 48),
    ("bsd", r"bsd licen[cs]ed", "bsd licen", 46),
    ("bsd", r"0bsd", "0bsd", 46),
    ("mpl", rf"{_UNDER}mpl(?: ?v? ?[12])?(?: [01])?", "mpl", 76),
    ("mpl", r"mpl (?:v ?|version )?(?:1 [01]|2 0)", "mpl", 46),
    ("mpl", r"mplv[12](?: [01])?", "mplv", 46),
    ("epl", rf"{_UNDER}epl(?: ?v? ?[12])?(?: 0)?", " epl", 72),
    ("epl", r"epl ?v[12](?: 0)?", " epl", 44),
    ("cddl", r"cddl(?: ?v? ?1(?: [01])?)?", "cddl", 44),
    ("eupl", r"eupl(?: ?v? ?1 [012])?", "eupl", 44),
    ("isc", rf"{_UNDER}isc", " isc ", 74),
    ("zlib", rf"{_UNDER}zlib(?: libpng)?", "zlib", 74),
    ("boost", rf"{_UNDER}boost(?: 1 0)?", "boost", 72),
    ("busl", r"bsl ?v?1 1", " bsl", 42),
    ("busl", r"busl ?v?1 1", "busl", 46),
    ("artistic", r"artistic (?:v ?|version )?2 0", "artistic", 44),
    ("artistic", r"under the same terms as perl(?: itself| 5)?", "same terms as perl", 72),
    ("ruby", r"under the same terms as ruby(?: itself)?", "same terms as ruby", 72),
    ("psf", r"psf licen[cs]e", "psf licen", 46),
    ("unlicense", rf"{_UNDER}unlicen[cs]e", "unlicen", 76),
    ("wtfpl", r"wtfpl(?: ?v? ?[12])?", "wtfpl", 46),
    ("ofl", r"(?:sil )?ofl(?: ?v? ?1 [01])", " ofl", 46),
    ("ofl", r"sil ofl", "sil ofl", 44),
    ("odbl", r"odbl(?: ?v? ?1 0)?", "odbl", 44),
    ("pddl", r"pddl(?: ?v? ?1 0)?", "pddl", 44),
    ("ogl", r"ogl(?: uk)? v ?[123](?: 0)?", " ogl", 44),
    ("cecill", r"cecill (?:[abc]|[12](?: [01])?)", "cecill", 44),
    ("ms-pl", rf"{_UNDER}ms pl", "ms pl", 74),
    ("sspl", r"sspl(?: ?v? ?1)?(?: 0)?", "sspl", 44),
    ("lppl", r"latex project public licen[cs]e(?: version)?(?: 1 [123]\w?)?", "latex project", 50),
    ("lppl", r"lppl(?: ?v? ?1 [123]\w?)?", "lppl", 44),
    ("cc0", rf"{_UNDER}cc0(?: 1 0)?", "cc0", 78),
)

#: Sentences that files carry instead of a license's name: (label, expression, keyword, priority).
_FREE = r"(?:this \w{1,20}|it) is free software you can redistribute it and or modify it under the terms of the gnu"
HEADERS = (
    ("gpl", rf"{_FREE} general public licen[cs]e", "redistribute it and or modify it", 92),
    ("lgpl", rf"{_FREE} (?:lesser|library) general public licen[cs]e", "redistribute it and or modify it", 92),
    ("agpl", rf"{_FREE} affero general public licen[cs]e", "redistribute it and or modify it", 92),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", "should have received a copy", 72),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "should have received a copy", 72),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e", "should have received a copy", 72),
    ("apache", r"you may not use this file except in compliance with the licen[cs]e", "except in compliance with", 86),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", "required by applicable law", 62),
    ("mpl", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form", 92),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "this permission notice", 84),
    ("mit", r"use of this source code is governed by an mit style licen[cs]e", "mit style", 88),
    ("bsd", r"use of this source code is governed by a bsd style licen[cs]e", "bsd style", 88),
    ("bsd", r"neither the names? of (?:\w{1,30} ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse", "contributors may be used to endorse", 84),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source code", 82),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form", 82),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "with or without fee", 87),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors", 84),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 90),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "accompanying materials", 92),
    ("cc0", r"to the extent possible under law(?: \w{1,30}){1,12}? (?:has|have) waived all copyright and related", "waived all copyright", 88),
    ("reserved", r"no part of this (?:publication|work|book|document|website|article|report) may be", "no part of this", 62),
    ("reserved", r"all rights not expressly granted(?: \w{1,20}){0,6} (?:is|are) reserved", "not expressly granted", 62),
)


def rules() -> list[Rule]:
    """All signatures in order: per family its identifiers, addresses, grants and names, then notices, short forms and headers."""
    out = []
    for label, (name, ids, address, keyword) in FAMILIES.items():
        for i in ids:
            out.append(Rule(label, f"identifier {i}", rf"spdx license identifier {i}(?: only| or later)?", "spdx license", 100))
        out.append(Rule(label, "address", rf"(?:https? )?(?:www )?{address}(?: \d(?: \d)?)?", address, 95))
        for spelled, key in SPELLINGS.get(keyword, (("", keyword),)):
            full = name.replace(keyword, spelled, 1) if keyword in SPELLINGS else name
            for n, (grant, priority) in enumerate(GRANTS):
                out.append(Rule(label, f"grant {n} of {key.strip()}", f"{grant}(?:a |an )?{full}{_VERSION}", key, priority))
            out.append(Rule(label, f"name {key.strip()}", f"{full}{_VERSION}", key, 50))
    for kind, listed in (("notice", NOTICES), ("short form", SHORT), ("header", HEADERS)):
        out += [Rule(label, f"{kind} {n}", pattern, keyword, priority) for n, (label, pattern, keyword, priority) in enumerate(listed)]
    return out


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.patterns = [re.compile(rf"(?<= ){r.pattern}(?= )") for r in self.rules]
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            by_keyword.setdefault(r.keyword, []).append(i)
        self.gates = ahocorasick.Automaton()
        for keyword, which in by_keyword.items():
            self.gates.add_word(keyword, tuple(which))
        self.gates.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple], list[tuple]]:
        """Number of words, base places (label, word) and detections (label, rule, first, last, priority)."""
        words = text.encode("utf-8", "surrogatepass").translate(_TO).split()
        if not words:
            return 0, [], []
        flat = f" {b' '.join(words).decode('utf-8', 'replace')} "
        gates = {which for _, which in self.gates.iter(flat)}
        base = []
        for phrase, label in BASE.items():
            at = flat.find(f" {phrase} ")
            while at >= 0:
                base.append((label, at))
                at = flat.find(f" {phrase} ", at + 1)
        found = []
        for i in sorted({i for which in gates for i in which}):
            found += [(m.start(), m.end(), i) for m in self.patterns[i].finditer(flat)]
        if not base and not found:
            return len(words), [], []
        place = _word_of(flat, [a for _, a in base] + [a - 1 for a, _, _ in found] + [b - 1 for _, b, _ in found])
        spans = [(place[a - 1], place[b - 1], i) for a, b, i in found]
        kept = self.resolved(spans)
        return (
            len(words),
            sorted(((label, place[a]) for label, a in base), key=lambda x: x[::-1]),
            [(self.rules[i].label, self.rules[i].name, a, b, self.rules[i].priority) for a, b, i in kept],
        )

    def resolved(self, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that no stronger one contains, and that contain no stronger one, by place."""
        out, group, end = [], [], -1
        for span in [*sorted(spans), None]:
            if span is None or span[0] > end:
                out += self._resolved_group(group)
                group, end = [], -1
            if span is not None:
                group.append(span)
                end = max(end, span[1])
        return out

    def _resolved_group(self, group):
        kept = []
        for a, b, i in sorted(group, key=lambda s: (-self.rules[s[2]].priority, s[0] - s[1], s[2], s[0])):
            if not any(c <= a and b <= d or a <= c and d <= b for c, d, _ in kept):
                kept.append((a, b, i))
        return sorted(kept)


def _word_of(flat: str, at: list[int]) -> dict[int, int]:
    """Position in ``flat`` -> index of the word that it lies in, or that follows a space there."""
    out, done, n = {}, 0, -1
    for p in sorted(set(at)):
        n += flat.count(" ", done, p + 1)
        done = p + 1
        out[p] = n
    return out


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, base (label, word), found (label, rule, first, last, priority); places count words from 0."""
    base = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
    hit = T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("rule", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("first", "last", "priority")]
    )
    schema = T.StructType(
        [field_sql(docs, id_col, "doc_id"), T.StructField("n_words", T.LongType()),
         T.StructField("base", T.ArrayType(base)), T.StructField("found", T.ArrayType(hit))]
    )

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, scanner = to_arrow_schema(schema), _scanner()
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], type=pa.int64())]
                + [pa.array([[dict(zip(kind.names, x)) for x in r[k]] for r in rows], type=arrow.field(1 + k).type)
                   for k, kind in ((1, base), (2, hit))],
                schema=pa.schema([pa.field("doc_id", batch.column(0).type), *list(arrow)[1:]]),
            )

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, places, labels and a score: the highest priority among detections as a share."""
    words = "transform(base, b -> b.word)"
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr(f"array_min({words})").alias("first_word"), F.expr(f"array_max({words})").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(base.label, found.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(found.priority), 0) / 100D").alias("score"),
    )
