"""Gradient-boosted trees grown leaf by leaf on histograms, many models in one pass.

Features are cut into bins once per model. A round of growth is one aggregate over all training rows: sums of gradients
and curvatures per (model, leaf, feature, bin). Tasks add up their own rows, one shuffle by (model, feature) brings the sums
together, and the task that has all of a leaf and feature finds its best split. Models differ by a key (a split, a class, or
both), which is just another column of that aggregate, so the number of jobs depends on trees and depth, not on the number of models.

* Best first. A tree splits the leaf of the largest gain until it has ``leaves`` leaves. Rounds look ahead: they cover every
  leaf that the order could still reach with what is known, so a tree takes as many rounds as it is deep.
* Subtraction. Of two siblings the smaller one is summed; the other is its parent less that.
* Exact sums. Gradients are added up as 64-bit fixed-point numbers whose scale follows from the rows of a model and their
  largest value. So results are the same bits under any partitioning, and subtraction loses nothing.
* Regularised leaves. With G and H a leaf's sums, its value is -S(G) / (H + l2), where S moves G towards zero by ``alpha``;
  the gain of a split is the growth of S(G)^2 / (H + l2).

Losses: squared, and logistic with a Newton step. Rows may have weights. A model starts at the weighted mean (its log-odds).
Borders between bins are values of the training rows: every distinct one, or the ``bins``-quantiles if there are more, of at
most about ``SAMPLE`` rows a model, picked by a hash of their features. A row goes left where its value is at most the border.

The driver holds the trees and one row per open leaf. Training rows are rewritten with their current score every ``REFRESH``
trees; what came since travels with the tasks. Features must be finite, targets and weights too, or the job fails.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tapeweave.session import cut_lineage
from tapeweave.sources.schema import finite

SAMPLE = 200_000
REFRESH = 10
HEADROOM = 4  # bits for gradients that outgrow those of the start
SLICE = 1 << 10  # leaves and features whose splits are sought at a time
CELL = np.dtype([("b", np.uint8), ("ghn", np.int64, 3)])
SUMS = "m int, leaf int, f int, cells binary"


@dataclass(frozen=True)
class Trees:
    """What to fit; ``depth`` None means that ``leaves`` alone limits a tree."""

    n: int = 100
    rate: float = 0.05
    leaves: int = 15
    depth: int | None = 5
    least_rows: int = 10
    alpha: float = 0.0
    l2: float = 1.0
    bins: int = 255
    logistic: bool = False


@dataclass
class Tree:
    """Inner nodes in the order of their creation; a negative child c stands for the leaf -1 - c."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    border: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def leaf(self, x: np.ndarray, cuts: list) -> np.ndarray:
        """The leaf of each row of ``x``, split where a feature is at most its cut."""
        at = np.zeros(len(x), np.int64) if self.feature else np.full(len(x), -1, np.int64)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            left = x[open_, np.array(self.feature)[node]] <= np.array(cuts)[node]
            at[open_] = np.where(left, np.array(self.left)[node], np.array(self.right)[node])
        return -1 - at

    def scores(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return np.array(self.value)[self.leaf(x, self.bin if binned else self.border)]


@dataclass(frozen=True)
class Ensemble:
    """Fitted trees per model; ``keys`` are the columns that name a model, ``models`` their values in order."""

    features: tuple[str, ...]
    keys: tuple[str, ...]
    models: tuple[tuple, ...]
    base: tuple[float, ...]
    trees: tuple[tuple[Tree, ...], ...]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Ensemble:
        d = json.loads(text)
        return Ensemble(
            tuple(d["features"]), tuple(d["keys"]), tuple(map(tuple, d["models"])), tuple(d["base"]),
            tuple(tuple(Tree(**t) for t in trees) for trees in d["trees"]),
        )


def numbered(rows: DataFrame, keys, models) -> DataFrame:
    """``rows`` with ``__m``, the place of their model; the few models are broadcast. Rows of no model get null."""
    if not keys:
        return rows.withColumn("__m", F.lit(0))
    fields = [T.StructField(f"__k{i}", rows.schema[k].dataType) for i, k in enumerate(keys)] + [T.StructField("__m", T.IntegerType())]
    table = rows.sparkSession.createDataFrame([(*m, i) for i, m in enumerate(models)], T.StructType(fields))
    same = [rows[k] == table[f"__k{i}"] for i, k in enumerate(keys)]
    return rows.join(F.broadcast(table), same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def _borders(rows: DataFrame, n_features: int, sizes: list[int], bins: int) -> dict[tuple[int, int], np.ndarray]:
    """Per (model, feature) the rising borders: rows are (m, x)."""
    share = F.coalesce(F.element_at(F.array(*[F.lit(min(1.0, SAMPLE / max(n, 1))) for n in sizes]), F.col("m") + 1), F.lit(0.0))
    picked = rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < share * (1 << 30))
    values = picked.select("m", F.posexplode("x").alias("f", "v")).groupBy("m", "f", "v").agg(F.count(F.lit(1)).alias("n"))

    def cut(table: pa.Table) -> pa.Table:
        v, n = table.column("v").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(v)
        v, upto = v[order], np.cumsum(n[order])
        if len(v) > bins:
            wanted = -(-upto[-1] * np.arange(1, bins) // bins)  # the i-th of bins quantiles: the value at that place
            chosen = np.unique(v[np.searchsorted(upto, wanted)])
        else:
            chosen = v
        chosen = chosen[chosen < v[-1]]
        return pa.table({"m": table.column("m")[:1], "f": table.column("f")[:1], "b": pa.array([chosen], pa.list_(pa.float64()))})

    found = values.groupBy("m", "f").applyInArrow(cut, "m int, f int, b array<double>").collect()
    out = {(m, f): np.empty(0) for m in range(len(sizes)) for f in range(n_features)}
    return out | {(r["m"], r["f"]): np.array(r["b"]) for r in found}


def _binned(rows: DataFrame, borders, base) -> DataFrame:
    """(m, bins, y, w, s): one byte a feature, and the score so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            codes = np.zeros(x.shape, np.uint8)
            for i in np.unique(m):
                mine = m == i
                for f in range(x.shape[1]):
                    codes[mine, f] = np.searchsorted(borders[(int(i), f)], x[mine, f])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(m), [None, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), packed.cast(pa.binary()), batch.column(2), batch.column(3), pa.array(np.array(base)[m])], ["m", "bins", "y", "w", "s"]
            )

    return rows.mapInArrow(run, "m int, bins binary, y double, w double, s double")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _rescored(rows: DataFrame, trees: list[list[Tree]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            m, x, s = batch.column(0).to_numpy(), _codes(batch.column(1)), batch.column(4).to_numpy().copy()
            _add_trees(s, m, x, trees)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(s)], ["m", "bins", "y", "w", "s"])

    return rows.mapInArrow(run, rows.schema)


def _add_trees(s: np.ndarray, m: np.ndarray, x: np.ndarray, trees: list[list[Tree]]) -> None:
    for i in np.unique(m):
        mine = np.flatnonzero(m == i)
        for tree in trees[i]:
            s[mine] += tree.scores(x[mine], binned=True)


def _gradients(y, w, s, logistic: bool):
    if not logistic:
        return w * (s - y), w
    p = 1 / (1 + np.exp(-s))
    return w * (p - y), w * p * (1 - p)


def _sums(rows: DataFrame, trees: list[list[Tree]], grown: list[Tree], wanted: dict[int, dict[int, int]], scale, logistic: bool, bins: int) -> DataFrame:
    """(m, leaf, f, cells) of the ``wanted`` leaves, per task: per model, leaf of the growing tree to the leaf's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            m, x = batch.column(0).to_numpy(), _codes(batch.column(1))
            y, w, s = (batch.column(i).to_numpy().copy() for i in (2, 3, 4))
            _add_trees(s, m, x, trees)
            g, h = _gradients(y, w, s, logistic)
            for i in np.unique(m).tolist():
                mine = np.flatnonzero(m == i)
                leaf = grown[i].leaf(x[mine], grown[i].bin)
                for at, name in wanted.get(i, {}).items():
                    here = mine[leaf == at]
                    sums = total.setdefault((i, name), np.zeros((x.shape[1], bins, 3), np.int64))
                    gs, hs = np.rint(np.ldexp(g[here], scale[i][0])), np.rint(np.ldexp(h[here], scale[i][1]))
                    if here.size and max(np.abs(gs).max(), hs.max()) >= scale[i][2]:
                        raise OverflowError("Gradients grew beyond those of the start; lower the learning rate.")
                    for f in range(x.shape[1]):
                        np.add.at(sums[f, :, 0], x[here, f], gs.astype(np.int64))
                        np.add.at(sums[f, :, 1], x[here, f], hs.astype(np.int64))
                        sums[f, :, 2] += np.bincount(x[here, f], minlength=bins)
        for (i, name), sums in total.items():
            found = [(f, _cells(sums[f])) for f in range(len(sums)) if sums[f, :, 2].any()]
            columns = [np.full(len(found), k, np.int32) for k in (i, name)] + [np.array([f for f, _ in found], np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([c for _, c in found], pa.binary())], ["m", "leaf", "f", "cells"])

    return rows.mapInArrow(run, SUMS)


def _cells(sums: np.ndarray) -> bytes:
    """The bins that hold rows, as bytes."""
    b = np.flatnonzero(sums[:, 2])
    out = np.empty(len(b), CELL)
    out["b"], out["ghn"] = b, sums[b]
    return out.tobytes()


def _added_up(parts: DataFrame, pairs: list[tuple[int, int, int, int]], scale, how: Trees) -> DataFrame:
    """All sums of a leaf and feature with its best split: largest gain, then lowest border.

    ``pairs`` are (m, parent, small, big): the big sibling is the parent, among the ``parts``, less the small one.
    """
    heirs = {(m, parent): (small, big) for m, parent, small, big in pairs}

    def worth(g, h):
        moved = np.sign(g) * np.maximum(np.abs(g) - how.alpha, 0.0)
        return np.where(h + how.l2 == 0, 0.0, moved * moved / (h + how.l2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for m, leaf, f, cells in zip(*[c.to_pylist() for c in batch.columns]):
                cells = np.frombuffer(cells, CELL)
                sums = held.setdefault((m, leaf, f), np.zeros((how.bins, 3), np.int64))
                sums[cells["b"]] += cells["ghn"]
        for m, leaf, f in [key for key in held if key[:2] in heirs]:
            small, big = heirs[(m, leaf)]
            held[(m, big, f)] = held.pop((m, leaf, f)) - held.get((m, small, f), 0)
        keys = list(held)
        for at in range(0, len(keys), SLICE):
            some = keys[at : at + SLICE]
            sums = np.stack([held.pop(key) for key in some])
            upto = sums.cumsum(axis=1)
            whole = upto[:, -1:]
            one = np.array([[math.ldexp(1.0, -scale[m][0]), math.ldexp(1.0, -scale[m][1])] for m, _, _ in some])[:, :, None]
            with np.errstate(all="ignore"):
                (gl, hl), (gr, hr), (g, h) = ((v[:, :, 0] * one[:, 0], v[:, :, 1] * one[:, 1]) for v in (upto, whole - upto, whole))
                gain = worth(gl, hl) + worth(gr, hr) - worth(g, h)
            able = (upto[:, :, 2] >= how.least_rows) & (whole[:, :, 2] - upto[:, :, 2] >= how.least_rows)
            gain = np.where(able, gain, -np.inf)
            each, b = np.arange(len(some)), gain.argmax(axis=1)  # not a number, from sums beyond doubles, counts as largest
            best = gain[each, b]
            numbers = [np.array(some, np.int32)[:, k] for k in range(3)] + [whole[:, 0, k] for k in range(3)]
            columns = [pa.array(best, mask=best <= 0), pa.array(b.astype(np.int32)), *[pa.array(upto[each, b, k]) for k in range(3)]]
            cells = pa.array([_cells(s) for s in sums], pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), *columns, cells], ["m", "leaf", "f", "g", "h", "n", "gain", "b", "gl", "hl", "nl", "cells"])

    schema = "m int, leaf int, f int, g long, h long, n long, gain double, b int, gl long, hl long, nl long, cells binary"
    return parts.repartition("m", "f").mapInArrow(run, schema)


def _best(sums: DataFrame) -> list:
    """Per (m, leaf) its totals and the best split: largest gain, then first feature, then lowest border."""
    split = "IF(gain IS NULL, NULL, struct(gain, -f AS f, -b AS b, gl, hl, nl)) AS split"
    firsts = [F.first(c).alias(c) for c in "ghn"]
    return sums.selectExpr("m", "leaf", "g", "h", "n", split).groupBy("m", "leaf").agg(*firsts, F.max("split").alias("split")).collect()


class Growth:
    """The tree of one model while it grows: nodes by heap path (root 1), as far as rounds have covered them."""

    def __init__(self, how: Trees):
        self.how = how
        self.stats: dict[int, tuple] = {}  # path -> (g, h, n)
        self.split: dict[int, tuple | None] = {}  # path -> (gain, feature, bin, left stats) once known
        self.name: dict[int, int] = {}

    def asks(self, path: int) -> bool:
        """Whether a round must look at the node: it may split and isn't known yet."""
        deep = self.how.depth is not None and path.bit_length() - 1 >= self.how.depth
        if path not in self.split and (deep or (path > 1 and self.stats[path][2] < 2 * self.how.least_rows)):
            self.split[path] = None
        return path not in self.split

    def order(self) -> tuple[list[int], list[int]]:
        """Splits in order of gain within the number of leaves, and the nodes whose split isn't known but may come."""
        heap, done, open_ = [], [], []

        def push(path):
            if self.asks(path):
                open_.append(path)
            elif self.split[path]:
                heapq.heappush(heap, (-self.split[path][0], path))

        push(1)
        while heap and len(done) < self.how.leaves - 1:
            _, path = heapq.heappop(heap)
            done.append(path)
            g, h, n = self.stats[path]
            gl, hl, nl = self.split[path][3]
            self.stats[2 * path], self.stats[2 * path + 1] = (gl, hl, nl), (g - gl, h - hl, n - nl)
            if len(done) < self.how.leaves - 1:
                push(2 * path)
                push(2 * path + 1)
        return done, open_

    def tree(self, done: list[int], borders, scale) -> tuple[Tree, dict[int, int]]:
        """The tree of these splits, and the leaf number of every node that it ends in."""
        place = {path: i for i, path in enumerate(done)}
        out, leaf = Tree(), {}

        def child(path):
            if path in place:
                return place[path]
            leaf[path] = len(leaf)
            return -1 - leaf[path]

        if not done:
            child(1)
        for path in done:
            _, f, b, _ = self.split[path]
            out.feature.append(f)
            out.bin.append(b)
            out.border.append(float(borders[f][b]))
            out.left.append(child(2 * path))
            out.right.append(child(2 * path + 1))
        for path in leaf:
            g, h = (math.ldexp(v, -s) for v, s in zip(self.stats.get(path, (0, 0, 0))[:2], scale))
            moved = math.copysign(max(abs(g) - self.how.alpha, 0.0), g)
            out.value.append(-self.how.rate * moved / (h + self.how.l2) if h + self.how.l2 > 0 else 0.0)
        return out, leaf


def _grow(rows: DataFrame, trees, borders, scale, how: Trees) -> list[Tree]:
    """The next tree of every model."""
    growth = [Growth(how) for _ in borders]
    known: list[tuple[set[int], DataFrame]] = []  # the leaves that a round covered, and their sums
    names = 0
    while True:
        orders = [g.order() for g in growth]
        made = [g.tree(done, b, s) for g, (done, _), b, s in zip(growth, orders, borders, scale)]
        wanted: dict[int, dict[int, int]] = {}
        pairs = set()
        for m, (g, (_, open_)) in enumerate(zip(growth, orders)):
            for path in open_:
                if path in g.name:
                    continue
                other = path ^ 1
                ask = [path] if path == 1 or g.stats[path][2] <= g.stats[other][2] else [other]
                for p in {path, *ask}:
                    if p not in g.name:
                        g.name[p], names = names, names + 1
                wanted.setdefault(m, {})[made[m][1][ask[0]]] = g.name[ask[0]]
                if ask[0] != path or other in open_:
                    big = path if ask[0] != path else other
                    if big not in g.name:
                        g.name[big], names = names, names + 1
                    pairs.add((m, g.name[path >> 1], g.name[ask[0]], g.name[big]))
        if not wanted:
            for _, sums in known:
                sums.unpersist()
            return [tree for tree, _ in made]
        parts = _sums(rows, trees, [t for t, _ in made], wanted, scale, how.logistic, how.bins)
        parents = {p for _, p, _, _ in pairs}
        for covered, sums in known:
            if held := sorted(covered & parents):
                parts = parts.unionByName(sums.where(f"array_contains(array({', '.join(map(str, held))}), leaf)").select("m", "leaf", "f", "cells"))
        fresh = _added_up(parts, sorted(pairs), scale, how).persist()
        known.append(({name for leaves in wanted.values() for name in leaves.values()} | {big for _, _, _, big in pairs}, fresh))
        path_of = [{name: path for path, name in g.name.items()} for g in growth]
        for r in _best(fresh):
            g, path = growth[r["m"]], path_of[r["m"]][r["leaf"]]
            g.stats[path] = (r["g"], r["h"], r["n"])
            s = r["split"]
            g.split[path] = None if s is None else (s["gain"], -s["f"], -s["b"], (s["gl"], s["hl"], s["nl"]))


def fit(rows: DataFrame, features, how: Trees, target: str = "target", weight: str | None = None, keys=()) -> Ensemble:
    """One model per value of ``keys``, all grown at once. Rows with a null key are left out."""
    features, keys = tuple(features), tuple(keys)
    cell = lambda c: F.when(finite(c), F.col(c).cast("double")).otherwise(
        F.raise_error(F.lit(f"{c} is null, infinite or not a number.")).cast("double")
    )
    w = cell(weight) if weight else F.lit(1.0)
    source = rows.where(F.lit(True) if not keys else ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)))
    picked = source.select(*keys, F.array(*[cell(f) for f in features]).alias("x"), cell(target).alias("y"), w.alias("w"))
    facts = picked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("y").alias("low"), F.max("y").alias("high"), F.max("w").alias("most")
    ).collect()
    facts = sorted((r for r in facts if r["rows"]), key=lambda r: tuple(r[k] for k in keys))
    if not facts:
        raise ValueError("There are no rows to fit.")
    models = tuple(tuple(r[k] for k in keys) for r in facts)
    table = numbered(picked, keys, models).select(F.col("__m").alias("m"), "x", "y", "w")
    # exact means: sums of fixed-point numbers
    spare = [62 - max(r["rows"], 1).bit_length() for r in facts]
    largest = [max(abs(r["low"]), abs(r["high"]), 1e-300) * max(r["most"], 1e-300) for r in facts]
    fixed = [(s - math.frexp(v)[1], s - math.frexp(max(r["most"], 1e-300))[1]) for r, s, v in zip(facts, spare, largest)]
    times = lambda k: F.element_at(F.array(*[F.lit(2.0 ** min(f[k], 1000)) for f in fixed]), F.col("m") + 1)
    sums = table.groupBy("m").agg(
        F.sum(F.rint(F.col("y") * F.col("w") * times(0)).cast("long")).alias("wy"), F.sum(F.rint(F.col("w") * times(1)).cast("long")).alias("w")
    )
    means = {r["m"]: math.ldexp(r["wy"], -min(fixed[r["m"]][0], 1000)) / math.ldexp(r["w"], -min(fixed[r["m"]][1], 1000)) for r in sums.collect()}
    base, scale = [], []
    for m, (r, s) in enumerate(zip(facts, spare)):
        p = means[m]
        if how.logistic and not 0 < p < 1:
            raise ValueError("A logistic model needs rows of both classes.")
        base.append(math.log(p / (1 - p)) if how.logistic else p)
        reach = r["most"] * (1.0 if how.logistic else max(abs(r["low"] - p), abs(r["high"] - p), 1e-300))
        bits = s - HEADROOM
        scale.append((bits - math.frexp(reach)[1], bits - math.frexp(max(r["most"], 1e-300))[1], float(1 << s)))
    cuts = _borders(table, len(features), [r["rows"] for r in facts], how.bins)
    borders = [[cuts[(m, f)] for f in range(len(features))] for m in range(len(models))]
    data = cut_lineage(_binned(table, cuts, base))
    trees: list[list[Tree]] = [[] for _ in models]
    recent: list[list[Tree]] = [[] for _ in models]
    for t in range(how.n):
        for m, tree in enumerate(_grow(data, recent, borders, scale, how)):
            recent[m].append(tree)
            trees[m].append(tree)
        if len(recent[0]) == REFRESH and t + 1 < how.n:
            data, recent = cut_lineage(_rescored(data, recent)), [[] for _ in models]
    return Ensemble(features, keys, models, tuple(base), tuple(map(tuple, trees)))


def predict(model: Ensemble, rows: DataFrame, output: str = "score") -> DataFrame:
    """Add the models' sum of trees; rows of no model get null. Features must be finite."""
    held = numbered(rows.drop(output), model.keys, model.models)
    cells = [
        F.when(finite(f), F.col(f).cast("double")).otherwise(
            F.raise_error(F.lit("A model feature is null, infinite or not a number.")).cast("double")
        )
        for f in model.features
    ]
    schema = T.StructType([*rows.drop(output).schema.fields, T.StructField(output, T.DoubleType())])
    base, trees = model.base, model.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 2
            m = batch.column(n).to_numpy(zero_copy_only=False)
            x, out = _matrix(batch.column(n + 1)), np.zeros(batch.num_rows)
            none = np.isnan(m.astype(float))
            for i in np.unique(m[~none]).astype(int).tolist():
                mine = np.flatnonzero(m == i)
                out[mine] = base[i]
                for tree in trees[i]:
                    out[mine] += tree.scores(x[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, mask=none)], schema.names)

    return held.select(*[c for c in rows.columns if c != output], "__m", F.array(*cells).alias("__x")).mapInArrow(run, schema)
