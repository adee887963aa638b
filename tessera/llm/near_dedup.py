"""Near-duplicates by MinHash and a multi-index Hamming join.

A text is the set of its distinct shingles.  Its signature has chunks x width
MinHash values of b = 16 bits.  Two signatures that differ in at most
``chunks * (errors + 1) - 1`` values have, by the pigeonhole principle, some chunk
with at most ``errors`` differing values; such a pair meets because every chunk is
indexed once for each way of leaving out ``errors`` of its values.  With 7 chunks
of 5 values and one error, 13 of 35 values may differ; two sets of Jaccard
similarity 0.85 miss all chunks with probability 4e-6.  Links are confirmed on
full sets.

Equal sets are first folded into one node.  In an index bucket, members are
compared with a few members only (the first, the last and two by a hash that all
buckets share), which links a group of n copies by a few pairs each; then buckets
whose members still lie in different components are compared across components.
So no link between components is lost and no bucket is expanded into all pairs of
what is known to be connected.  Before texts are fetched, pairs must pass an exact
bound: each node has the parities of its shingles over 1024 bits, and two sets differ
in at least as many shingles as their parities differ in bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._marks import among
from ._pack import pack, unpack
from ._spark import cut, release
from ._words import WHITE, Words, chunks, grams, mix

_U = np.uint64
_LANES = 16


@dataclass(frozen=True)
class Plan:
    """Shingle length, least similarity as a whole percentage, and the index."""

    shingle: int = 3
    percent: int = 85
    chunks: int = 7
    width: int = 5
    errors: int = 1
    seed: int = 11

    @property
    def values(self) -> int:
        return self.chunks * self.width

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 2**64, self.values, dtype=_U), rng.integers(0, 2**64, self.values, dtype=_U) | _U(1)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the chunk's documents: hashes, each document's sorted, a second,
    independent hash of each, and the bounds of the documents.

    Fewer than k words are one shingle, no words none."""
    h, h2 = words.hashes(), words.hashes(1)
    g, g2 = grams(h, k), grams(h2, k)
    first = words.first.tolist()
    out, more, size = [np.zeros(0, _U)], [np.zeros(0, _U)], np.zeros(len(first) - 1, np.int64)
    for i in range(len(size)):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            s, at = np.unique(g[a : b - k + 1], return_index=True)
            t = g2[a : b - k + 1][at]
        elif b > a:
            s, t = grams(h[a:b], b - a, salt=1), grams(h2[a:b], b - a, salt=1)
        else:
            continue
        out.append(s)
        more.append(t)
        size[i] = len(s)
    return np.concatenate(out), np.concatenate(more), np.concatenate(([0], np.cumsum(size)))


def _signatures(sets: np.ndarray, bounds: np.ndarray, plan: Plan) -> np.ndarray:
    """b-bit signatures (rows: documents with shingles, in order)."""
    start = bounds[:-1][np.diff(bounds) > 0]
    flip, times = plan.permutations()
    out = np.empty((len(start), plan.values), "<u2")
    for i in range(plan.values):
        out[:, i] = np.minimum.reduceat((sets ^ flip[i]) * times[i], start) & _U(0xFFFF)
    return out


def _parities(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each document (n shingles each), 64 * _LANES parities: how often a bit is hit, modulo 2."""
    width = 64 * _LANES
    doc = np.repeat(np.arange(len(n)), n)
    count = np.bincount(doc * width + (sets >> _U(20)).astype(np.int64) % width, minlength=len(n) * width)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64).reshape(len(n), _LANES)


def _parities_allow(plan: Plan):
    """Sets of n and m shingles, similar enough, differ in few shingles, so in few parities (odd, odd2)."""
    bits = " + ".join(f"bit_count(odd[{i}] ^ odd2[{i}])" for i in range(_LANES))
    return F.expr(f"({bits}) * {100 + plan.percent} <= (n + m) * {100 - plan.percent}")


def _sketch(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, sign, parity = [], [], [], [], []
            for words in chunks(batch.column(1), WHITE, lower=True):
                sets, second, bounds = shingle_sets(words, plan.shingle)
                n = np.diff(bounds)
                has = n > 0
                a, b = np.zeros(len(n), _U), np.zeros(len(n), _U)
                signs: list[bytes | None] = [None] * len(n)
                odd = np.zeros((len(n), _LANES), np.int64)
                if has.any():
                    start = bounds[:-1][has]
                    a[has] = np.add.reduceat(mix(sets), start)
                    b[has] = np.add.reduceat(mix(second), start)
                    odd = _parities(sets, n)
                    for i, s in zip(np.flatnonzero(has).tolist(), _signatures(sets, bounds, plan), strict=True):
                        signs[i] = s.tobytes()
                size.append(n)
                one.append(a.view(np.int64))
                two.append(b.view(np.int64))
                sign += signs
                parity.append(odd)
            if not size:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    *(pa.array(np.concatenate(x)) for x in (size, one, two)),
                    pa.array(sign, pa.binary()),
                    pa.FixedSizeListArray.from_arrays(np.concatenate(parity).ravel(), _LANES).cast(pa.list_(pa.int64())),
                ],
                ["id", "mark", "n", "s1", "s2", "sign", "odd"],
            )

    return run


def _texts(plan: Plan):
    """(s1, s2, packed text) of each document that has shingles, given id, text and mark."""
    sketch = _sketch(Plan(plan.shingle, plan.percent, 1, 1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in sketch(iter([batch])):
                out = pa.RecordBatch.from_arrays([row.column(3), row.column(4), pack(batch.column(1))], ["s1", "s2", "z"])
                yield out.filter(pa.array(np.asarray(row.column(2)) > 0))

    return run


def _confirm(plan: Plan):
    """The links (a, b) whose full sets are similar enough."""

    def sets_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for words in chunks(unpack(column), WHITE, lower=True):
            sets, second, bounds = shingle_sets(words, plan.shingle)
            out += [(sets[a:b], second[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ok = []
                for (x, x2), (y, y2) in zip(sets_of(batch.column(2)), sets_of(batch.column(3)), strict=True):
                    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                    both = int((x2[i] == y2[j]).sum())
                    ok.append(100 * both >= plan.percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def _index(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(key, nid, n): every chunk of a signature with each choice of ``errors`` values left out."""
    keys = []
    for c in range(plan.chunks):
        for gone in combinations(range(plan.width), plan.errors):
            kept = [j for j in range(plan.width) if j not in gone]
            parts = [F.substring("sign", 2 * (c * plan.width + j) + 1, 2) for j in kept]
            keys.append(F.xxhash64(F.lit(len(keys)), F.concat(*parts)))
    return nodes.select("nid", "n", F.explode(F.array(*keys)).alias("key"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    distinct shingles.  component_id is the smallest id that links reach, kept says
    whether it is the row's own.  Null, empty and white texts have no shingles, are
    linked with nothing and keep their own id.  Null ids are never the smallest
    (a component of null ids only has a null component_id and is kept).  Rows that
    repeat id and text repeat the result.  Texts of any length are read whole; a task's
    memory follows its longest text.  An empty table gives an empty result.  Other columns
    are ignored, whatever their names.  A dozen jobs run before this returns.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    kind = source.schema["id"].dataType.simpleString()
    sketch = cut(source.mapInArrow(_sketch(plan), f"id {kind}, mark long, n long, s1 long, s2 long, sign binary, odd array<long>"))
    nodes = cut(
        sketch.where("n > 0")
        .groupBy("s1", "s2", "n")
        .agg(F.min("id").alias("least"), F.min("sign").alias("sign"), F.first("odd").alias("odd"), F.first("mark").alias("mark"))
        .withColumn("nid", F.monotonically_increasing_id())
    )
    index = _index(nodes, plan)
    by_hash = [F.min_by("nid", F.xxhash64("nid", F.lit(r))) for r in (1, 2)]
    heads = index.groupBy("key").agg(
        F.array_distinct(F.array(F.min("nid"), F.max("nid"), *by_hash)).alias("heads"), F.count(F.lit(1)).alias("size")
    ).where("size > 1")
    met = index.join(heads.select("key", "heads"), "key").select("nid", F.explode("heads").alias("head")).where("nid <> head")
    met = met.select(F.least("nid", "head").alias("a"), F.greatest("nid", "head").alias("b")).distinct()
    sketches = nodes.select(F.col("nid").alias("a"), "n", "odd")
    others = nodes.select(F.col("nid").alias("b"), F.col("n").alias("m"), F.col("odd").alias("odd2"))
    pairs = met.join(sketches, "a").join(others, "b").where(_sizes_allow(plan)).where(_parities_allow(plan)).select("a", "b")
    links = _confirmed(cut(pairs), nodes, source, plan)
    roots = cut(components(links))
    release(spark)

    placed = cut(
        index.join(heads.select("key"), "key")
        .join(roots, F.col("nid") == F.col("node"), "left")
        .select("key", "nid", "n", F.coalesce("root", "nid").alias("root"))
    )
    open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = placed.join(open_, "key").join(nodes.select("nid", "odd"), "nid")
    right = left.select("key", *(F.col(c).alias(d) for c, d in (("nid", "nid2"), ("n", "m"), ("root", "root2"), ("odd", "odd2"))))
    across = (
        left.join(right, "key")
        .where(F.col("root") < F.col("root2"))
        .where(_sizes_allow(plan))
        .where(_parities_allow(plan))
        .select(F.col("nid").alias("a"), F.col("nid2").alias("b"))
        .distinct()
    )
    more = _confirmed(cut(across), nodes, source, plan)
    root_of = roots.select("node", "root")
    for end in ("a", "b"):
        more = more.join(root_of, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("root", end)).drop("node", "root")
    upper = cut(components(more)).select(F.col("node").alias("lower"), F.col("root").alias("upper"))
    release(spark)

    of_node = (
        nodes.join(roots, F.col("nid") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "nid"))
        .join(upper, F.col("root") == F.col("lower"), "left")
        .select("s1", "s2", "n", "least", F.coalesce("upper", "root").alias("root"))
    )
    smallest = of_node.groupBy("root").agg(F.min("least").alias("smallest"))
    of_set = of_node.join(smallest, "root").select("s1", "s2", "n", "smallest")
    filled = sketch.where("n > 0").join(of_set, ["s1", "s2", "n"])
    empty = sketch.where("n = 0").withColumn("smallest", F.col("id"))
    out = filled.select("id", "n", "smallest").unionByName(empty.select("id", "n", "smallest"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("smallest").alias("component_id"),
        F.col("id").eqNullSafe(F.col("smallest")).alias("kept"),
    )


def _sizes_allow(plan: Plan):
    """Sets of n and m shingles can only be similar enough if neither is much larger."""
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * plan.percent


def _confirmed(pairs: DataFrame, nodes: DataFrame, source: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose full sets pass, as a written table (a, b); only their texts are fetched."""
    if pairs.isEmpty():
        return pairs
    asked = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    wanted = cut(nodes.select("nid", "s1", "s2", "mark").join(asked, "nid"))
    picked = among(source, F.col("mark"), wanted, F.col("mark"))
    texts = picked.mapInArrow(_texts(plan), "s1 long, s2 long, z binary").groupBy("s1", "s2").agg(F.first("z").alias("z"))
    texts = cut(wanted.join(texts, ["s1", "s2"]).select("nid", "z"))
    near = pairs
    for end in ("a", "b"):
        near = near.join(texts.select(F.col("nid").alias(end), F.col("z").alias(f"z{end}")), end)
    found = cut(near.select("a", "b", "za", "zb").mapInArrow(_confirm(plan), "a long, b long"))
    release(source.sparkSession)
    return found
