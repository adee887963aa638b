"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition sorts its digests into a run that holds one entry per
distinct text: the smallest identifier and the number of rows.  Runs then meet
in binomial rounds: in round r the runs whose numbers agree above bit
``r * bits`` exchange entries and are merged (a multiway merge of 2**bits runs),
keeping the smallest identifier and adding the counts, until one tree remains.
Each round is dealt by (run, digest), so a text that a third of the rows share
is one entry of each run and at most 2**bits entries of each merge.  The winners
travel down the same tree to the rows, which again meets no hot key.

Entries are equal only when SHA-256, byte length and an independent 64-bit hash
of the normalised text agree; that verifies an entry at every level without
moving texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: the white space that texts are normalised over
WHITE = "[\\x20\\x09-\\x0D]+"
_KEY = ["digest", "octets", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    * A null text counts as empty; all empty texts are one group.
    * The smallest id of a group stays.  Null ids order last.  If that id stands
      on several rows of the group, only the first of them in input order is
      kept, so exactly one row of each group has ``kept``.
    * Other columns are ignored; an empty table gives an empty result.
    """
    text = normalised(df[text_col])
    rows = cut(
        df.select(
            df[id_col].alias("id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).alias("octets"),
            F.xxhash64(text).alias("check"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    last = rows.agg(F.max("run").alias("last")).first()["last"] or 0
    ident = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    levels = [rows.groupBy("run", *_KEY).agg(F.min(ident).alias("best"), F.count(F.lit(1)).alias("n"))]
    while last:
        last >>= bits
        up = F.shiftright("run", bits).alias("run")
        levels.append(levels[-1].groupBy(up, *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n")))
    won = levels[-1]
    for level in reversed(levels[:-1]):
        won = _pass_down(level.select("run", *_KEY), won, F.shiftright("run", bits))
    out = _pass_down(rows, won, F.col("run"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _pass_down(lower: DataFrame, upper: DataFrame, parent: Column) -> DataFrame:
    """The entries of ``lower`` with what the run above decided for them."""
    upper = upper.select(F.col("run").alias("up"), *(F.col(k).alias(f"up_{k}") for k in _KEY), "best", "n")
    meets = parent == F.col("up")
    for k in _KEY:
        meets &= F.col(k) == F.col(f"up_{k}")
    return lower.join(upper, meets).drop("up", *(f"up_{k}" for k in _KEY))
