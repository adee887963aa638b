"""Removal of repeated word windows, through a log-structured fingerprint index.

Two equal windows of 35 words select the same 12-word gram: the one with the least
hash in the window (winnowing).  So the index holds about one fingerprint for 12
words, and still meets every repeated window.  Fingerprints arrive in batches; each
batch becomes a sorted immutable run, is merge-joined with the runs of earlier
batches, and runs of one level are compacted into one of the next.

A fingerprint that occurs at two places only nominates the windows around it.
They are verified by two hashes (64 and 31 bits) of all 35 words, which come from
independent hashes of each word, counted over all nominated
windows of all documents, old and new.

Documents of one word sequence are folded first: each of their windows repeats, so
they lose all words, and stand in for their copies in one row.  Texts are shuffled
once, compressed; later phases meet them where they lie.

An index in a folder also keeps each batch's compressed texts and the places of its
fingerprints.  A further batch reads them through filters of fixed size: only rows that
share a fingerprint with the batch are shuffled, and only texts that do are opened.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._marks import among
from ._pack import pack, unpack
from ._spark import cut, release
from ._words import WHITE, Words, chunks, grams, string_buffers, within

_U = np.uint64
_POS = _U((1 << 24) - 1)
_EMPTY = hashlib.sha256(b"").hexdigest()


class FingerprintIndex:
    """Sorted runs (fp, n) of fingerprint counts; ``fanout`` runs of a level merge into one of the next.

    With a ``folder`` the runs are Parquet tables in it, and a log of its versions says which
    runs and batches are in force, so that a later session opens the index as it was after the
    last batch.  A batch whose writing breaks off leaves tables that no version names.  Of two
    writers that started from one version, the second fails."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 2):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.version = 0
        self.batches: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str, fanout: int = 2) -> FingerprintIndex:
        """The index that was saved in ``folder``."""
        index = cls(spark, folder, fanout)
        log = spark.read.parquet(f"{folder}/log")
        rows = log.join(log.agg(F.max("version").alias("version")), "version").orderBy("level", "place").collect()
        for r in rows:  # one row for each run, as many as levels times fanout, and one for each batch
            index.version = r["version"]
            if r["level"] < 0:
                index.batches.append(r["name"])
                continue
            index._place(r["name"], spark.read.parquet(f"{folder}/{r['name']}"), r["level"])
        return index

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def ingest(self, fingerprints: DataFrame) -> DataFrame:
        """Add a batch (column fp); the fingerprints (fp) of it that are repeated so far, written.

        The new run is merge-joined with every earlier run before it is added."""
        name, run = self._written(fingerprints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
        seen = [run.where("n > 1").select("fp")]
        seen += [run.select("fp").join(self._near(old, run, "fp").select("fp").hint("merge"), "fp", "left_semi") for old in self.runs()]
        found = cut(reduce(DataFrame.unionByName, seen).distinct())
        self._place(name, run, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._written(_merged([run for _, run in self.levels[level]]))
            self.levels[level] = []
            level += 1
            self._place(*merged, level)
        self._log()
        return found

    def _near(self, stored: DataFrame, asked: DataFrame, key: str) -> DataFrame:
        """The rows of a stored table whose key ``asked`` may have, found without a shuffle."""
        return stored if self.folder is None else among(stored, F.col(key), asked, F.col(key))

    def keep(self, texts: DataFrame, places: DataFrame) -> tuple[str, DataFrame]:
        """Write a batch's texts (k1, k2, z, copies) and places (fp, k1, k2); its name, and the places as written."""
        name = f"batch-{uuid.uuid4().hex}"
        texts.write.parquet(f"{self.folder}/{name}-texts")
        places.write.parquet(f"{self.folder}/{name}-places")
        return name, self.spark.read.parquet(f"{self.folder}/{name}-places")

    def documents(self, names: list[str], fingerprints: DataFrame) -> DataFrame | None:
        """The texts (k1, k2, z, copies) of the named batches that have one of the fingerprints, one row a batch and text."""
        keys = [
            self._near(self.spark.read.parquet(f"{self.folder}/{n}-places"), fingerprints, "fp").join(fingerprints, "fp", "left_semi").select("k1", "k2")
            for n in names
        ]
        if not keys:
            return None
        wanted = cut(reduce(DataFrame.unionByName, keys).distinct())
        texts = [self._near(self.spark.read.parquet(f"{self.folder}/{n}-texts"), wanted, "k1") for n in names]
        return reduce(DataFrame.unionByName, texts).join(wanted, ["k1", "k2"], "left_semi")

    def _place(self, name: str, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, run))

    def _written(self, run: DataFrame) -> tuple[str, DataFrame]:
        run, name = run.sortWithinPartitions("fp"), f"run-{uuid.uuid4().hex}"
        if self.folder is None:
            return name, cut(run)
        run.write.parquet(f"{self.folder}/{name}")
        return name, self.spark.read.parquet(f"{self.folder}/{name}")

    def _log(self) -> None:
        if self.folder is not None:
            self.version += 1
            rows = [(self.version, k, i, name) for k, level in enumerate(self.levels) for i, (name, _) in enumerate(level)]
            rows += [(self.version, -1, i, name) for i, name in enumerate(self.batches)]
            claim = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/claims/{self.version}")
            if not claim.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(claim):
                raise RuntimeError(f"version {self.version} of the index in {self.folder} was written by another writer")
            log = self.spark.createDataFrame(rows, "version int, level int, place int, name string")
            log.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def repeated(self) -> DataFrame:
        """All fingerprints (fp) that occur at two places or more."""
        return _merged(self.runs()).where("n > 1").select("fp")


def _merged(runs: list[DataFrame]) -> DataFrame:
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("fp", F.col("n").alias("m")).hint("merge")
        return a.join(b, "fp", "full_outer").select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

    return reduce(two, runs)


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def _selected(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, gram hashes, and for each window of the chunk: whether it lies in one
    document, and which gram it selects (the first of least hash)."""
    h = words.hashes()
    g = grams(h, gram)
    n = len(h) - window + 1
    if n <= 0:
        return h, g, np.zeros(0, bool), np.zeros(0, np.int64)
    at = np.arange(len(g), dtype=_U)
    least = _sliding_min((g & ~_POS) | (at & _POS), window - gram + 1) & _POS
    start = at[:n]
    chosen = (start + ((least - start) & _POS)).astype(np.int64)
    return h, g, within(words.first, window, n), chosen


def _window_hashes(words: Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes (64 and 31 bits) of each window, from the two hashes of its words."""
    one = grams(h, window, salt=3)
    two = grams(words.hashes(1), window, salt=5)
    return one.view(np.int64), (two >> _U(33)).astype(np.int32)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n_words, key (k1, k2) of the word sequence and its SHA-256."""
    for batch in batches:
        count, sha, k1, k2 = _keys(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), k1, k2, pa.array(sha, pa.binary())], ["id", "n", "k1", "k2", "sha"]
        )


def _keys(column: pa.Array) -> tuple[list[int], list[bytes], pa.Array, pa.Array]:
    data, off = string_buffers(column)
    raw = data.tobytes()
    count, sha = [], []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        words = raw[a:b].split()  # splits bytes at exactly 0x20 and 0x09-0x0D
        count.append(len(words))
        sha.append(hashlib.sha256(b" ".join(words)).digest())
    digest = np.frombuffer(b"".join(sha), ">i8").reshape(-1, 4)
    return count, sha, pa.array(digest[:, 0].astype(np.int64)), pa.array((digest[:, 1] >> 32).astype(np.int32))


def _texts(window: int):
    """k1, k2 and packed text of each document with at least one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, _, k1, k2 = _keys(batch.column(0))
            rows = pa.RecordBatch.from_arrays([k1, k2, pack(batch.column(0))], ["k1", "k2", "z"])
            yield rows.filter(pa.array(np.asarray(count) >= window))

    return run


def _fingerprints(window: int, gram: int):
    """fp, k1, k2 of every selected gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(i)) for i in (0, 1))
            for words in chunks(unpack(batch.column(2)), WHITE):
                _, g, ok, chosen = _selected(words, window, gram)
                at = np.unique(chosen[ok])
                doc = words.lo + np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[at].view(np.int64)), pa.array(k1[doc]), pa.array(k2[doc])], ["fp", "k1", "k2"]
                )

    return run


def _windows(window: int, gram: int):
    """h1, h2, copies, k1, k2, start of every window that a repeated fingerprint nominates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                k1, k2, copies = (np.asarray(batch.column(i)) for i in (0, 1, 2))
                nominated = batch.column(4).to_pylist()
                for words in chunks(unpack(batch.column(3)), WHITE):
                    h, g, ok, chosen = _selected(words, window, gram)
                    if not ok.any():
                        continue
                    for i in range(words.hi - words.lo):
                        a, b = int(words.first[i]), int(words.first[i + 1]) - window + 1
                        if b > a:
                            ok[a:b] &= np.isin(g[chosen[a:b]].view(np.int64), np.array(nominated[words.lo + i], np.int64))
                    one, two = _window_hashes(words, h, window)
                    at = np.flatnonzero(ok)
                    local = np.searchsorted(words.first, at, "right") - 1
                    doc = words.lo + local
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (one[at], two[at], copies[doc], k1[doc], k2[doc], (at - words.first[local]).astype(np.int32))],
                        ["h1", "h2", "copies", "k1", "k2", "start"],
                    )

    return run


def _remaining(window: int):
    """k1, k2, n_removed and SHA-256 of what is left, given the repeated windows' starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for raw, starts in zip(unpack(batch.column(2)).to_pylist(), batch.column(3), strict=True):
                words = raw.encode().split()
                mark = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.asarray(starts.values))
                mark[at] += 1
                mark[at + window] -= 1
                gone = np.cumsum(mark[:-1]) > 0
                left = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                ["k1", "k2", "gone", "left"],
            )

    return run


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    gram: int = 12,
    batches: int = 2,
    index: FingerprintIndex | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256.

    Words are separated by [\\x20\\x09-\\x0D].  A word goes if some window of ``window``
    words that covers it occurs at another place, in another document or the same,
    all judged on the input; the rest is joined by single spaces.  Null, empty and
    shorter texts have no window and keep all words.  Rows that repeat a text,
    whatever their ids, are other places to each other.  Other columns are ignored.

    Without an ``index`` the documents are ingested in ``batches`` parts into a new one.
    With one, they are a further batch, and windows are verified against the documents of
    the earlier ones: an index in a folder has kept them and looks at no ``history``, for
    others ``history`` has them (text_col).  Earlier documents get no result.  An index that
    neither has kept its documents nor is given them is refused.

    Texts of any length are read whole; a task's memory follows its longest text.  An
    empty table gives an empty result.  A dozen jobs run before this returns.
    """
    spark = docs.sparkSession
    kept = index is not None and index.folder is not None
    if index is not None and index.runs() and not index.batches and (kept or history is None):
        raise ValueError("an index of earlier batches needs their documents: a folder that has kept them, or history")
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    every = cut(source.mapInArrow(_documents, f"id {kind}, n long, k1 long, k2 int, sha binary"))
    packed = source.select("text").mapInArrow(_texts(window), "k1 long, k2 int, z binary").withColumn("fresh", F.lit(True))
    if history is not None and not kept:
        old = history.select(history[text_col].cast("string").alias("text")).mapInArrow(_texts(window), "k1 long, k2 int, z binary")
        packed = packed.unionByName(old.withColumn("fresh", F.lit(False)))
    texts = cut(
        packed.groupBy("k1", "k2").agg(F.first("z").alias("z"), F.count(F.lit(1)).alias("copies"), F.max("fresh").alias("fresh")),
        dealt=True,
    )
    release(spark)

    if index is None:
        index, parts = FingerprintIndex(spark), [texts.where(F.pmod("k1", F.lit(batches)) == b) for b in range(batches)]
    else:
        parts = [texts.where("fresh")]
    prints = [p.select("k1", "k2", "z").mapInArrow(_fingerprints(window, gram), "fp long, k1 long, k2 int") for p in parts]
    earlier = []
    if kept:
        earlier = list(index.batches)
        name, prints[0] = index.keep(texts.select("k1", "k2", "z", "copies"), prints[0])
        index.batches.append(name)
    prints = [p.select("fp") for p in prints]
    # written, so that both sides of the join below are plain shuffles and a common fingerprint can be split
    repeats = cut(reduce(DataFrame.unionByName, [index.ingest(p) for p in prints]).distinct())
    old = index.documents(earlier, repeats) if earlier else None
    if old is not None:
        both = texts.unionByName(old.withColumn("fresh", F.lit(False)))
        texts = cut(both.groupBy("k1", "k2").agg(F.first("z").alias("z"), F.sum("copies").alias("copies"), F.max("fresh").alias("fresh")), dealt=True)
    places = texts.select("k1", "k2", "z").mapInArrow(_fingerprints(window, gram), "fp long, k1 long, k2 int")
    nominated = cut(
        places.join(repeats, "fp").groupBy("k1", "k2").agg(F.collect_set("fp").alias("fps"))
    )
    release(spark)

    windows = (
        texts.join(nominated, ["k1", "k2"])
        .select("k1", "k2", "copies", "z", "fps")
        .mapInArrow(_windows(window, gram), "h1 long, h2 int, copies long, k1 long, k2 int, start int")
    )
    # written, so that both sides of the join below are plain shuffles and a common window can be split
    repeated = cut(windows.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).where("n > 1").select("h1", "h2"))
    release(spark)
    starts = (
        windows.where("copies = 1")
        .select("h1", "h2", "k1", "k2", "start")
        .join(repeated, ["h1", "h2"])
        .groupBy("k1", "k2")
        .agg(F.collect_list("start").alias("starts"))
    )
    changed = cut(
        texts.join(starts, ["k1", "k2"])
        .select("k1", "k2", "z", "starts")
        .mapInArrow(_remaining(window), "k1 long, k2 int, gone long, left string")
    )
    release(spark)

    copied = texts.where("copies > 1").select("k1", "k2", F.lit(-1).cast("long").alias("gone"), F.lit(_EMPTY).alias("left"))
    result = every.join(changed.unionByName(copied), ["k1", "k2"], "left")
    return result.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(F.col("gone") == -1, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.coalesce("left", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
