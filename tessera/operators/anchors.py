"""One-to-one joins on keys that are unique on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import THRESHOLDS as T


def unique_index(rows: DataFrame, key: str, value: str = "id") -> DataFrame:
    """(key, value) of the keys that stand on exactly one row; null keys never do."""
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(value))
    return one.where("__n = 1").drop("__n")


def one_to_one(source: DataFrame, target: DataFrame, key: str, method: str, confidence: float) -> DataFrame:
    """(source_id, target_id, method, confidence) of rows whose key is unique on both sides."""
    s = unique_index(source, key).withColumnRenamed("id", "source_id")
    t = unique_index(target, key).withColumnRenamed("id", "target_id")
    pairs = s.join(t, key).select("source_id", "target_id")
    return pairs.withColumns({"method": F.lit(method), "confidence": F.lit(confidence)})


def unclaimed(pairs: DataFrame, claimed: DataFrame) -> DataFrame:
    """Pairs neither end of which is claimed already."""
    return pairs.join(claimed.select("source_id"), "source_id", "left_anti").join(
        claimed.select("target_id"), "target_id", "left_anti"
    )


def agreed(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where all rows of a key name one value; disagreement gives no row."""
    one = pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__hi"))
    return one.where(F.col(value) == F.col("__hi")).drop("__hi")


def by_literals(source: DataFrame, target: DataFrame, confidence: float = 0.90) -> DataFrame:
    """Pairs that share literals (id, literal) unique on each side, all of which agree both ways.

    Whether the sizes of a pair may belong together is judged afterwards (``voting.plausible_only``)."""
    s = unique_index(source, "literal").withColumnRenamed("id", "source_id")
    t = unique_index(target, "literal").withColumnRenamed("id", "target_id")
    links = s.join(t, "literal").select("source_id", "target_id")
    forth = agreed(links, "source_id", "target_id")
    back = agreed(links, "target_id", "source_id")
    pairs = forth.join(back, ["source_id", "target_id"])
    return pairs.withColumns({"method": F.lit("literal"), "confidence": F.lit(confidence)})


def anchors(source: DataFrame, target: DataFrame) -> DataFrame:
    """Name, body and literal anchors in this order, each on what is still unclaimed.

    Entities have id, name, hash, size; uniqueness is judged over all of them."""
    out = one_to_one(source, target, "name", "name", 1.0)
    large = [side.where(F.col("size") >= T.distinctive_size) for side in (source, target)]
    return out.unionByName(unclaimed(one_to_one(*large, "hash", "exact-body", 0.97), out))


def twins(source: DataFrame, target: DataFrame, signature: Sequence[str]) -> DataFrame:
    """Pairs of equal signature: one to one, or else by names unique on both sides of the group."""
    keys = list(signature)
    s, t = (side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(f"{name}_id")) for side, name in ((source, "source"), (target, "target")))
    counts = s.withColumnRenamed("n", "ns").join(t.withColumnRenamed("n", "nt"), keys)
    single = counts.where("ns = 1 and nt = 1").select("source_id", "target_id", F.lit("single").alias("how"))
    open_ = counts.where("not (ns = 1 and nt = 1)").select(*keys)

    def named(side: DataFrame, name: str) -> DataFrame:
        one = side.join(open_, keys, "left_semi").groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(f"{name}_id"))
        return one.where("n = 1").drop("n")

    by_name = named(source, "source").join(named(target, "target"), [*keys, "name"])
    return single.unionByName(by_name.select("source_id", "target_id", F.lit("name").alias("how")))
