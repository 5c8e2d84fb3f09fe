import random
import re

from tapeweave.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_base(text):
    words = WORD.findall(lowered(text))
    return len(words), sorted(
        (label, i) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    )


def brute_found(text):
    """Every rule over every text, then containment by comparing all pairs in order of strength."""
    words = WORD.findall(lowered(text))
    flat = f" {' '.join(words)} "
    spans = []
    for i, rule in enumerate(licenses.rules()):
        for m in re.finditer(rf"(?<= ){rule.pattern}(?= )", flat):
            spans.append((flat[: m.start()].count(" ") - 1, flat[: m.end()].count(" ") - 1, i))
    kept = []
    for a, b, i in sorted(spans, key=lambda s: (-licenses.rules()[s[2]].priority, s[0] - s[1], s[2], s[0])):
        if not any(c <= a and b <= d or a <= c and d <= b for c, d, _ in kept):
            kept.append((a, b, i))
    return [(licenses.rules()[i].label, licenses.rules()[i].name, a, b, licenses.rules()[i].priority) for a, b, i in sorted(kept)]


LINES = [
    "This work is licensed under the GNU General Public License, version 3 or later.", "All rights reserved.",
    "CC BY-SA 4.0", "cc-by", "Cc By cc by Cc BY", "SPDX-License-Identifier: Apache-2.0", "released under the MIT licence",
    "https://creativecommons.org/licenses/by-nc-nd/4.0/", "Copyright (c) 2019-2021 Someone", "is licensed under the Creative Commons Attribution ShareAlike 4.0",
    "GNU Lesser General Public License v2.1", "GNU Affero General Public License", "mit der Zeit", "All Rights RESERVED all rights reserved",
    "Permission is hereby granted, free of charge, to any person", "may not be reproduced in any form without prior written permission",
    "licensed under the GPL v3", "released under MIT", "LGPL-2.1", "Apache 2.0", "BSD-3-Clause", "GPLv3+", "GNU GPL version 2 or later",
    "available to you under the terms of the MPL 2.0", "(dual-)licensed under the same terms as Perl itself", "LPPL 1.3c", "BSL 1.1", "WTFPL",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "you may not use this file except in compliance with the License", "neither the name of the University nor the names of its contributors may be used to endorse",
    "Mozilla Public License 2.0 and the Apache License, Version 2.0", "é all rights réserved", "Unauthorised copying of this file is strictly prohibited",
]


def texts():
    rng = random.Random(4)
    out = LINES + ["", " .,; ", "_cc_by_", "CC\tBY\n", "xcc by", "cc byx", "日本 cc by 語", "İ cc by K"]
    for _ in range(60):
        out.append(rng.choice([" ", ". ", "\n"]).join(rng.choice(LINES + ["filler words here", "la eau"]) for _ in range(rng.randrange(1, 30))))
    return out + ["word " * 30_000 + "all rights reserved " * 500]


def test_hundreds_of_signatures_with_keywords_that_cover_them():
    rules = licenses.rules()
    assert len(rules) > 250 and len({(r.label, r.name) for r in rules}) == len(rules)
    scanner = licenses.Scanner()
    for text in texts()[:-1]:
        assert scanner.scan(text)[2] == brute_found(text), text


def test_base_places_match_brute_force():
    scanner = licenses.Scanner()
    for text in texts():
        n, base, _ = scanner.scan(text)
        assert (n, sorted(base)) == brute_base(text), text[:200]


def test_priority_and_containment():
    scanner = licenses.Scanner()
    label, rule, first, last, priority = scanner.scan("x This is licensed under the Apache License, version 2.0 y")[2][0]
    assert (label, first, last, priority) == ("apache", 2, 10, 90)  # the grant takes in the name
    assert [f[0] for f in scanner.scan("GNU Lesser General Public License")[2]] == ["lgpl"]
    assert [f[0] for f in scanner.scan("CC BY-NC-SA 4.0")[2]] == ["cc-by-nc-sa"]
    assert scanner.scan("mit der Zeit, apache war da")[2] == []


def test_short_forms_versions_and_headers():
    scanner = licenses.Scanner()
    found = lambda text: [f[0] for f in scanner.scan(text)[2]]
    cases = {
        "licensed under the GPL v3": "gpl", "released under MIT": "mit", "LGPL-2.1": "lgpl", "Apache 2.0": "apache", "BSD-3-Clause": "bsd",
        "GPLv3": "gpl", "GNU GPL version 2 or later": "gpl", "three-clause BSD": "bsd", "AGPLv3 only": "agpl", "made available under the MPL": "mpl",
        "You should have received a copy of the GNU Affero General Public License": "agpl", "BUSL-1.1": "busl", "OFL 1.1": "ofl",
        "This is free and unencumbered software released into the public domain.": "unlicense", "under the same terms as Ruby": "ruby",
        "Use of this source code is governed by a BSD-style license": "bsd", "Licensed under CC0 1.0": "cc0", "released under BSL 1.1": "busl",
    }
    for text, label in cases.items():
        assert found(text) == [label], text
        assert found(f"before, {text}; after") == [label], text
    # one span, one detection: the tag is stronger than the form in it, the grant takes in the version
    assert [f[4] for f in scanner.scan("SPDX-License-Identifier: BSD-3-Clause")[2]] == [100]
    assert scanner.scan("x is licensed under the GPL v3 or later")[2][0][2:4] == (2, 8)
    for text in ("EPL 2-0 in London", "Zeit mit X11 Kabeln", "the Apache 2 web server", "Apache 2.0 server", "a mit b", "CC 2.0", "gpl", "2 0", "MPL", "provided under oath"):
        assert found(text) == [], text


def test_query_columns(spark):
    rows = [(1, "CC BY, then all rights reserved."), (2, None), (3, ""), (None, "cc by"), (1, "CC BY, then all rights reserved."), (4, "MIT license")]
    docs = spark.createDataFrame([(k, t, "clash", "x") for k, t in rows], "doc_id long, text string, labels string, base string")
    out = sorted((tuple(r) for r in licenses.digest(licenses.scan(docs)).collect()), key=str)
    one = (1, 6, 2, 0, 3, "cc-by,reserved", "cc-by,reserved", 0.5)
    assert out == sorted([one, one, (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
                          (None, 2, 1, 0, 0, "cc-by", "cc-by", 0.5), (4, 2, 0, None, None, "", "mit", 0.5)], key=str)
    assert licenses.scan(docs.where("false")).collect() == []
