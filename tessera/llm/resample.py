"""Importance resampling towards a target distribution, without replacement.

A document's weight is the mean log-ratio of its hashed words and word pairs between
the target texts and the whole corpus.  The log-ratios of all buckets are one array of
fixed size, so scoring is an array lookup for each feature.  Noise that depends on the
document's id alone turns weights into scores; the highest scores are a draw without
replacement by weight (the Gumbel top-k rule).

Ranking needs no global sort: scores are integers, so their histogram is small.  Its
suffix sums, taken in two levels, give the number of documents above each score; the
cutoff score is read off, and only documents at or above it are numbered, each within
its own score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut
from ._words import Words, chunks

#: Bytes that end a word: everything of ASCII but digits and letters (which are lower-cased before).
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Words of more bytes are hashed one by one.
_LONG = 64
#: Scores that share a block of the histogram: 2 ** BLOCK.
BLOCK = 8


def _crc_table() -> np.ndarray:
    """The step of the reflected CRC-32 polynomial for each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _crc_table()


def _crc(start: np.ndarray, w: Words, at: np.ndarray) -> np.ndarray:
    """CRC-32 of the words ``at``, each continued from the CRC ``start`` of what stands before it."""
    state, lo = ~start, w.start[at]
    size = w.end[at] - lo
    more, done = np.flatnonzero(size <= _LONG), 0
    while len(more):
        state[more] = _TABLE[(state[more] ^ w.data[lo[more] + done]) & 255] ^ (state[more] >> np.uint32(8))
        done += 1
        more = more[size[more] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        state[i] = ~np.uint32(zlib.crc32(w.data[lo[i] : lo[i] + size[i]].tobytes(), int(start[i])))
    return ~state


def _features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of each word, and of each pair of neighbours within a document with the place of its second word."""
    one = _crc(np.zeros(len(w.start), np.uint32), w, np.arange(len(w.start)))
    inner = np.ones(len(w.start), bool)
    inner[w.first[:-1][w.first[:-1] < len(w.start)]] = False
    second = np.flatnonzero(inner)
    state = ~one[second - 1]
    spaced = ~(_TABLE[(state ^ np.uint32(0x20)) & 255] ^ (state >> np.uint32(8)))
    return one, _crc(spaced, w, second), second


def feature_counts(df: DataFrame, text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how often the features of all texts fall into each bucket; one row a bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for w in chunks(batch.column(0), NOT_WORD, lower=True):
                one, two, _ = _features(w)
                for crc in (one, two):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = df.select(df[text_col].alias("text")).mapInArrow(count, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket; ``buckets`` integers, whatever the input."""
    spark = source.sparkSession
    s, t = (x.select("bucket", F.col("n").alias(name)) for x, name in ((source, "s"), (target, "t")))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    rows = {r["bucket"]: (r["s"], r["t"]) for r in both.collect()}
    s, t = (np.array([rows[i][k] for i in range(buckets)], np.float64) for k in (0, 1))
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of each text's features."""
    buckets = np.uint32(len(gain))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for w in chunks(batch.column(1), NOT_WORD, lower=True):
                one, two, second = _features(w)
                value = gain[one % buckets]
                value[second] += gain[two % buckets]
                upto = np.concatenate(([0], np.cumsum(value)))[w.first]
                n_words = np.diff(w.first)
                n = np.maximum(2 * n_words - 1, 0)
                mean = np.diff(upto) // np.maximum(n, 1)
                ids = batch.column(0).slice(lo, len(n))
                lo += len(n)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n_words, n, mean))], names)

    names = ["id", "n_words", "n_features", "weight"]
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def noise(ident: Column, salt: str = "7") -> Column:
    """floor(1000 g) of a Gumbel variate g that the id and the salt fix; null ids count as empty text."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score_offsets(scores: DataFrame) -> DataFrame:
    """(score, n, above): how many rows have each score, and how many a higher one.

    Blocks of neighbouring scores are summed first; the windows run over the blocks and over
    the scores of one block, so no task sees more than the number of distinct blocks."""
    each = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.shiftright("score", BLOCK))
    blocks = each.groupBy("block").agg(F.sum("n").alias("in_block"))
    down = Window.orderBy(F.desc("block"))
    blocks = blocks.select("block", (F.sum("in_block").over(down) - F.col("in_block")).alias("before"))
    inside = Window.partitionBy("block").orderBy(F.desc("score"))
    each = each.withColumn("above", F.sum("n").over(inside) - F.col("n"))
    return each.join(blocks, "block").select("score", "n", (F.col("above") + F.col("before")).alias("above"))


def ranked(rows: DataFrame, quota: int, offsets: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` whose score some of the ``quota`` first have, with their rank by (score descending, id), null beyond it."""
    alive = offsets.where(F.col("above") < quota).select("score", "above")
    within = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last())
    rank = F.col("above") + F.row_number().over(within)
    return rows.join(alive, "score").withColumn("rank", F.when(rank <= quota, rank)).drop("above")


def importance_resample(
    df: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    salt: str = "7",
    buckets: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_words, n_features, weight, score, rank.

    ``percent`` of the documents with at least ``least_words`` words are drawn; the others
    and the undrawn have a null rank.  Runs three jobs before it returns: the two feature
    counts, the scores (kept in the shared folder), the histogram's cutoff.

    * Null and empty texts have no features, weight 0, and are never drawn; a target without
      words makes every gain follow the corpus alone.
    * Very long texts are read whole; a task's memory follows its longest text.
    * Equal scores rank by smaller id, null ids last.  Rows of one id share their noise; where
      their scores agree too, any of them may come first.
    * Repeated rows count as often as they stand there, in the counts and in the draw.
    * An empty table gives an empty result.  Other columns are ignored, whatever their names.
    * Rows of one score meet in one sorted window (it spills).  Noise of distinct ids spreads
      them over some thousand scores; a third of all rows with one id and one text do not spread.
    """
    gain = gains(feature_counts(df, text_col, buckets), feature_counts(target, target_text_col, buckets), buckets)
    rows = weighed(df, gain, id_col, text_col)
    rows = cut(rows.withColumn("score", (F.col("weight") + noise(F.col("id"), salt)).cast("long")))
    able = F.col("n_words") >= least_words
    offsets = score_offsets(rows.where(able).select("score"))
    total = rows.where(able).count()
    quota = percent * total // 100
    lowest = offsets.where(F.col("above") < quota).agg(F.min("score").alias("s")).first()["s"] if quota else None
    out = rows.withColumn("rank", F.lit(None).cast("long"))
    if lowest is not None:
        near = able & (F.col("score") >= lowest)
        out = out.where(~near).unionByName(ranked(rows.where(near), quota, offsets))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
