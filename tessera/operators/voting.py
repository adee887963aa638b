"""Votes for pairs, and which pairs a round accepts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prints
from ..schema import THRESHOLDS as T
from .anchors import unclaimed
from .sequence import common_subsequence, filled

#: columns of a fingerprint
PRINT = ("hash", "shape", "size", "calls", "data")

#: decimals to which summed weights are compared, since float sums depend on their order
EXACT = 9


def tally(votes: DataFrame) -> DataFrame:
    """(source_id, target_id, weight, votes) of votes (source_id, target_id, weight)."""
    return votes.groupBy("source_id", "target_id").agg(
        F.round(F.sum("weight"), EXACT).alias("weight"), F.count(F.lit(1)).alias("votes")
    )


def described(tallied: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Tallied pairs that are plausible, with their ``similarity`` and whether a body makes them ``distinct``.

    source, target: fingerprints (id, hash, shape, size, calls, data), one row an entity."""
    rows = tallied
    for side, prints_ in (("source", source), ("target", target)):
        named = prints_.select(F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"__{side}_{c}") for c in PRINT))
        rows = rows.join(named, f"{side}_id")
    both = {c: (F.col(f"__source_{c}"), F.col(f"__target_{c}")) for c in PRINT}
    rows = rows.where(prints.plausible(*both["size"]))
    same = {c: a == b for c, (a, b) in both.items()}
    alike = prints.similarity(same["hash"], same["shape"], both["size"], both["calls"], both["data"])
    distinct = prints.distinctive(*both["hash"], *both["size"])
    return rows.withColumns({"similarity": F.round(alike, 6), "distinct": distinct}).select(*tallied.columns, "similarity", "distinct")


def plausible_only(votes: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Votes of pairs whose sizes (id, size) may belong together."""
    rows = votes
    for side, sizes in (("source", source), ("target", target)):
        rows = rows.join(sizes.select(F.col("id").alias(f"{side}_id"), F.col("size").alias(f"__{side}")), f"{side}_id")
    return rows.where(prints.plausible(F.col("__source"), F.col("__target"))).select(*votes.columns)


def mutual_best(tallied: DataFrame) -> DataFrame:
    """Pairs that are each other's best without a tie, with the margin over the runners-up.

    margin = 1 - larger runner-up / weight; a pair without rivals has margin 1."""
    rows = tallied
    for side, other in (("source_id", "target_id"), ("target_id", "source_id")):
        line = Window.partitionBy(side).orderBy(F.col("weight").desc(), other)
        rows = rows.withColumns({f"__{side}": F.row_number().over(line), f"__next_{side}": F.coalesce(F.lead("weight").over(line), F.lit(0.0))})
    runner_up = F.greatest("__next_source_id", "__next_target_id")
    rows = rows.where((F.col("__source_id") == 1) & (F.col("__target_id") == 1) & (runner_up < F.col("weight")))
    return rows.withColumn("margin", F.round(1 - runner_up / F.col("weight"), 6)).select(*tallied.columns, "margin")


def accepted(tallied: DataFrame, least: float = T.least_confidence) -> DataFrame:
    """Mutual best pairs with a confidence, from ``least`` up.

    tallied has ``similarity`` and ``distinct`` (see ``described``)."""
    return confident(mutual_best(tallied), least)


def confident(best: DataFrame, least: float = T.least_confidence) -> DataFrame:
    """Described best pairs with a confidence, from ``least`` up."""
    corroboration = F.least(F.lit(1.0), F.col("votes") / T.full_votes)
    confidence = prints.match_confidence(F.col("distinct"), F.col("similarity"), corroboration, F.col("margin"))
    return best.withColumn("confidence", F.round(confidence, 6)).where(F.col("confidence") >= least)


def sole_caller_votes(matches: DataFrame, calls: DataFrame, factor: float = 0.5) -> DataFrame:
    """Votes of matched callees for their callers, where each side has exactly one unmatched caller.

    calls: (side 's' or 't', caller, callee); matches: (source_id, target_id, confidence)."""
    known = matches.select(F.lit("s").alias("side"), F.col("source_id").alias("known")).unionByName(
        matches.select(F.lit("t").alias("side"), F.col("target_id").alias("known"))
    )
    asked = calls.select("side", "caller", "callee").join(known.withColumnRenamed("known", "callee"), ["side", "callee"], "left_semi")
    open_ = asked.join(known.withColumnRenamed("known", "caller"), ["side", "caller"], "left_anti")
    least = F.min("caller").alias("caller")  # repeated calls count once, and so do callers that are null
    sole = open_.groupBy("side", "callee").agg(least, F.max("caller").alias("most"), F.count_if(F.col("caller").isNull()).alias("nulls"))
    sole = sole.where("caller <=> most and (nulls = 0 or caller is null)")
    s = sole.where("side = 's'").select(F.col("callee").alias("source_id"), F.col("caller").alias("source"))
    t = sole.where("side = 't'").select(F.col("callee").alias("target_id"), F.col("caller").alias("target"))
    hit = matches.join(s, "source_id").join(t, "target_id")
    return hit.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), (factor * F.col("confidence")).alias("weight"))


def call_site_votes(matches: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Votes of matched pairs for callees at corresponding places of their call sequences.

    source, target: (owner, ord, callee).  Callees that are matched already are fixed points; between
    them, and before the first and behind the last, calls correspond one by one where both
    sides have equally many.  A vote weighs the confidence of the pair that gives it."""
    known = matches.select(F.col("source_id").alias("callee"), F.col("target_id").alias("seen"))
    one = F.struct("ord", "callee", "seen")
    asked = source.join(matches.select(F.col("source_id").alias("owner")), "owner", "left_semi")
    s = asked.join(known, "callee", "left").groupBy(F.col("owner").alias("source_id")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    t = target.groupBy(F.col("owner").alias("target_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "callee"))).alias("y"))
    pairs = matches.select("source_id", "target_id", "confidence").join(s, "source_id").join(t, "target_id")
    lists = pairs.select("confidence", F.col("x.callee").alias("a"), F.col("x.seen").alias("seen"), F.col("y.callee").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for weight, a, seen, b in zip(batch["confidence"], batch["a"], batch["seen"], batch["b"], strict=True):
                fixed = common_subsequence([None if pd.isna(x) else int(x) for x in seen], [int(x) for x in b])
                out += [(int(a[i]), int(b[j]), weight) for i, j in filled(fixed, len(a), len(b))]
            yield pd.DataFrame(out, columns=["source_id", "target_id", "weight"])

    votes = lists.mapInPandas(run, "source_id long, target_id long, weight double")
    return unclaimed(votes, matches)


def layout_votes(matches: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], weight: float = 0.5) -> DataFrame:
    """Votes for rows inside equal gaps between consecutive anchors of one group.

    source and target: (keys, id, pos) with positions counted from 1 in a group; two
    anchors that follow each other in the source must advance in the target."""
    at = matches.join(source.withColumnRenamed("id", "source_id").withColumnRenamed("pos", "sp"), "source_id").join(
        target.withColumnRenamed("id", "target_id").withColumnRenamed("pos", "tp"), ["target_id", *keys]
    )
    line = Window.partitionBy(*keys).orderBy("sp")
    gaps = at.select(*keys, "sp", "tp", F.lead("sp").over(line).alias("sq"), F.lead("tp").over(line).alias("tq"))
    gaps = gaps.where("sq - sp = tq - tp and sq - sp > 1")
    steps = gaps.select(*keys, "sp", "tp", F.explode(F.sequence(F.lit(1), (F.col("sq") - F.col("sp") - 1).cast("int"))).alias("__step"))
    steps = steps.select(*keys, (F.col("sp") + F.col("__step")).alias("sp"), (F.col("tp") + F.col("__step")).alias("tp"))
    s = source.select(*keys, F.col("id").alias("source_id"), F.col("pos").alias("sp"))
    t = target.select(*keys, F.col("id").alias("target_id"), F.col("pos").alias("tp"))
    return steps.join(s, [*keys, "sp"]).join(t, [*keys, "tp"]).select("source_id", "target_id", F.lit(weight).alias("weight"))


def positional_pairs(pairs: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Zip of the ordered references of paired owners.

    refs: (owner, ord, ref, kind), ord numbering an owner's.  A pair of owners counts only if both have as
    many references and all kinds agree; kept are (source_ref, target_ref) unique both ways.  An
    owner's references travel as one list, and only the lists of pairs that count are opened."""

    def lists(refs: DataFrame, side: str, as_: str) -> DataFrame:
        return refs.groupBy(F.col("owner").alias(f"{side}_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "ref"))).alias(as_))

    both = pairs.select("source_id", "target_id").join(lists(source, "source", "s"), "source_id").join(lists(target, "target", "t"), "target_id")
    same = lambda a, b: F.coalesce((a["ord"] == b["ord"]) & (a["kind"] == b["kind"]), F.lit(False))
    both = both.where((F.size("s") == F.size("t")) & F.forall(F.zip_with("s", "t", same), lambda ok: ok))
    links = both.select(F.explode(F.zip_with("s", "t", lambda a, b: F.struct(a["ref"].alias("source_ref"), b["ref"].alias("target_ref")))).alias("x")).select("x.*").distinct()
    once = [links.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(c) for c in ("source_ref", "target_ref")]
    return links.join(once[0], "source_ref", "left_semi").join(once[1], "target_ref", "left_semi").select("source_ref", "target_ref")
