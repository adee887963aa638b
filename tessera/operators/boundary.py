"""Boundaries of a unit between two placed neighbours, from an ordered alignment of its members.

A source unit between two neighbours that the target places is looked for in the gap
between them: its matches form edges, the best chain of edges is the alignment, and the
best other chain tells how unique it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import THRESHOLDS as T
from .graph import written
from .intervals import overlapping
from .sequence import best_chain

def _chain(i: pd.Series, j: pd.Series, w: pd.Series) -> pd.DataFrame:
    found = [best_chain(list(zip(*(x.tolist() for x in row), strict=True))) for row in zip(i, j, w, strict=True)]
    return pd.DataFrame(found, columns=["picked", "score", "second"])


def aligned(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``edges`` (keys, i, j, w, primary, ...) of each group's best chain, with its score and the runner-up's.

    The edges of one group are one row for the search, E log E in their number; of edges at one
    place primary ones come first."""
    rest = [c for c in edges.columns if c not in (*keys, "i", "j", "primary", "w")]
    edge = F.struct("i", "j", (~F.col("primary")).alias("other"), "w", *rest)
    groups = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    groups = groups.withColumn("chain", F.pandas_udf(_chain, "picked array<int>, score double, second double")("edges.i", "edges.j", "edges.w"))
    picked = F.explode(F.transform("chain.picked", lambda k: F.get("edges", k)))
    rows = groups.select(*keys, picked.alias("edge"), "chain.score", "chain.second")
    return rows.select(*keys, "edge.*", "score", "second").withColumn("primary", ~F.col("other")).drop("other")


def gaps(source_ranges: DataFrame, target_ranges: DataFrame) -> DataFrame:
    """(section, unit, previous, next, source_bytes, start, end): what the placed neighbours of a source unit leave for it.

    ranges: (section, unit, start, end, auto).  A unit and its two neighbours in source order are
    explicit and different; each neighbour has one explicit target range, and the first ends before
    the second begins."""
    line = Window.partitionBy("section").orderBy("start", "end", "unit")
    near = {f"{n}_{c}": f(c).over(line) for n, f in (("previous", F.lag), ("next", F.lead)) for c in ("unit", "auto")}
    rows = source_ranges.withColumns(near).where(
        "not auto and not previous_auto and not next_auto and previous_unit <> unit and unit <> next_unit and previous_unit <> next_unit"
    )
    rows = rows.select("section", "unit", F.col("previous_unit").alias("previous"), F.col("next_unit").alias("next"), F.greatest(F.col("end") - F.col("start"), F.lit(0)).alias("source_bytes"))
    one = target_ranges.groupBy("section", "unit").agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("s"), F.max("end").alias("e"), F.max("auto").alias("auto"))
    one = one.where("n = 1 and not auto")
    left = one.select("section", F.col("unit").alias("previous"), F.col("e").alias("start"))
    right = one.select("section", F.col("unit").alias("next"), F.col("s").alias("end"))
    return rows.join(left, ["section", "previous"]).join(right, ["section", "next"]).where("start < end")


def sequence_edges(found: DataFrame, source: DataFrame, target: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges of each gap: matches of the unit's members into it, and their reported runner-ups.

    source: (id, unit, pos); target: (id, section, pos, start, end); matches: (source_id, target_id,
    confidence, tier, runner_up, share), the runner-up being another source of the same target."""
    first = matches.select("source_id", "target_id", F.col("confidence"), "tier", F.lit(True).alias("primary"))
    other = matches.where("runner_up is not null").select(
        F.col("runner_up").alias("source_id"), "target_id", F.col("confidence") * F.col("share"), F.lit("alternative"), F.lit(False)
    )
    members = source.select(F.col("id").alias("source_id"), "unit", F.col("pos").alias("i"))
    places = target.select(F.col("id").alias("target_id"), "section", F.col("pos").alias("j"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    rows = first.union(other).join(members, "source_id").join(places, "target_id")
    rows = rows.join(found.select("section", "unit", "start", "end"), ["section", "unit"]).where("start <= t_start and t_end <= end")
    size = F.col("t_end") - F.col("t_start")
    return rows.select("section", "unit", "source_id", "target_id", "i", "j", (F.col("confidence") * size).cast("double").alias("w"), size.alias("size"), "tier", "confidence", "primary")


def layout_support(found: DataFrame, layouts: DataFrame) -> DataFrame:
    """(section, unit, layout_group): the group of layout anchors that alone supports a gap's boundary.

    layouts: (section, unit, layout_group, source_start, start, end, size, changed, group_functions,
    group_bytes, group_changed).  All of the group's anchors lie in the gap, in one order on both
    sides, and make up the functions, bytes and changed accesses that the group claims."""
    inside = layouts.join(found.select("section", "unit", F.col("start").alias("lo"), F.col("end").alias("hi")), ["section", "unit"]).where("lo <= start and end <= hi")
    keys = ["section", "unit", "layout_group"]
    line = Window.partitionBy(*keys).orderBy("source_start", "start")
    rises = F.coalesce((F.lag("source_start").over(line) < F.col("source_start")) & (F.lag("end").over(line) <= F.col("start")), F.lit(True))
    claims = ("group_functions", "group_bytes", "group_changed")
    groups = inside.withColumn("rises", rises).groupBy(*keys).agg(
        F.bool_and("rises").alias("rises"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum("changed").alias("changed"),
        *(f(c).alias(f"{name}_{c}") for name, f in (("lo", F.min), ("hi", F.max)) for c in claims),
    )
    same = reduce(Column.__and__, (F.col(f"lo_{c}") == F.col(f"hi_{c}") for c in claims))
    made = (F.col("hi_group_functions") == F.col("n")) & (F.col("hi_group_bytes") == F.col("bytes")) & (F.col("hi_group_changed") == F.col("changed"))
    enough = (F.col("n") >= T.layout_functions) & (F.col("bytes") >= T.layout_bytes) & (F.col("changed") >= T.layout_changed)
    best = F.max_by("layout_group", F.struct("bytes", "n", "changed", "layout_group")).alias("layout_group")
    return groups.where(F.col("rises") & same & made & enough).groupBy("section", "unit").agg(best)


def boundary_sequences(
    source_ranges: DataFrame,
    target_ranges: DataFrame,
    source: DataFrame,
    target: DataFrame,
    matches: DataFrame,
    anchors: DataFrame,
    layouts: DataFrame | None = None,
    align: int = 4,
) -> DataFrame:
    """One row per gap: its measures, the method that accepts it, whether it is eligible, and else the reasons.

    anchors: (unit, section, start, end, size) are independent pairs of equal bodies; they count if
    they lie in the gap.  A gap is accepted by its matched sequence or by layout support; reasons
    against the gap itself (size, other owners, alignment) refuse it either way.  Gaps and edges
    are written to the shared folder before this returns."""
    keys = ["section", "unit"]
    found = written(gaps(source_ranges, target_ranges))
    edges = written(sequence_edges(found, source, target, matches))
    chain = aligned(edges, keys)
    strong = F.col("primary") & (F.col("tier") != "candidate")
    chosen = chain.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aligned"), F.sum("size").alias("aligned_bytes"), F.count_if(strong).alias("strong"),
        F.count_if("primary").alias("picked_primary"), F.max("score").alias("score"), F.max("second").alias("second"),
    )
    primary = edges.groupBy(*keys).agg(F.count_if("primary").alias("primary_in_gap"))
    members = source.groupBy("unit").agg(F.count(F.lit(1)).alias("source_functions"))
    bounds = found.select(*keys, F.col("start").alias("lo"), F.col("end").alias("hi"))
    direct = anchors.where(F.col("size") >= T.sequence_anchor).join(bounds, keys).where("lo <= start and end <= hi")
    direct = direct.groupBy(*keys).agg(F.count(F.lit(1)).alias("direct_anchors"))
    wide = found.select("section", "unit", F.col("start").alias("start2"), F.col("end").alias("end2"))
    inside = overlapping(target.select("section", "id", "start", "end"), wide, ["section"]).where("start2 <= start and end <= end2")
    inside = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("target_functions"))
    owners = target_ranges.where("not auto").select("section", F.col("unit").alias("owner"), "start", "end")
    strangers = overlapping(owners, wide, ["section"]).where("owner <> unit").select(*keys, F.lit(True).alias("strangers")).distinct()

    rows = found.join(members, "unit")
    for part in (chosen, primary, direct, inside, strangers):
        rows = rows.join(part, keys, "left")
    support = layout_support(found, layouts) if layouts is not None else None
    rows = rows.join(support, keys, "left") if support is not None else rows.withColumn("layout_group", F.lit(None).cast("string"))
    counts = ("aligned", "aligned_bytes", "strong", "picked_primary", "primary_in_gap", "direct_anchors", "target_functions")
    rows = rows.fillna(0, list(counts)).fillna(0.0, ["score", "second"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({
        "target_bytes": F.col("end") - F.col("start"),
        "match_ratio": F.col("aligned") / F.col("source_functions"),
        "order_ratio": ratio(F.col("picked_primary"), F.col("primary_in_gap")),
        "target_coverage": F.col("aligned_bytes") / (F.col("end") - F.col("start")),
        "margin": F.when(F.col("score") > 0, 1 - F.col("second") / F.col("score")).otherwise(0.0),
    })
    source_bytes, target_bytes = F.col("source_bytes"), F.col("target_bytes")
    tested = {
        "few_functions": F.col("aligned") < T.sequence_functions,
        "few_matched": F.col("match_ratio") < T.sequence_match,
        "out_of_order": F.col("order_ratio") < T.sequence_order,
        "few_bytes": F.col("aligned_bytes") < T.sequence_bytes,
        "thin_cover": F.col("target_coverage") < T.sequence_cover,
        "few_strong": F.col("strong") < T.sequence_strong,
        "few_anchors": F.col("direct_anchors") < T.sequence_anchors,
        "close_alternative": F.col("margin") < T.sequence_margin,
        "needs_alternative": F.col("picked_primary") < F.col("aligned"),
    }
    placed = {
        "size": (2 * target_bytes < source_bytes) | (target_bytes > F.floor(source_bytes * 3 / 2)),
        "other_owner": F.coalesce("strangers", F.lit(False)),
        "unaligned": (F.col("start") % align != 0) | (F.col("end") % align != 0),
    }
    told = lambda named: F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))
    rows = rows.withColumns({"__sequence": told(tested), "__placed": told(placed)})
    base = F.greatest("source_bytes", "target_bytes")
    shape = (F.abs(source_bytes - target_bytes) <= T.layout_size * base) & (F.abs(F.col("source_functions") - F.col("target_functions")) <= T.layout_count)
    rows = rows.withColumn("layout_group", F.when(shape, F.col("layout_group")))
    by_sequence, by_layout = F.size("__sequence") == 0, F.col("layout_group").isNotNull()
    rows = rows.withColumns({
        "method": F.when(by_sequence, "matched-sequence").when(by_layout, "layout-corroborated-boundary").otherwise("none"),
        "eligible": (by_sequence | by_layout) & (F.size("__placed") == 0),
    })
    reasons = F.when(F.col("eligible"), F.array().cast("array<string>")).otherwise(F.concat("__sequence", "__placed"))
    names = ["match_ratio", "order_ratio", "target_coverage", "score", "second", "margin"]
    rounded = [F.round(c, 3).alias(c) for c in names]
    plain = ["section", "unit", "previous", "next", "start", "end", "source_functions", "target_functions", "aligned", "aligned_bytes", "strong", "direct_anchors"]
    return rows.select(*plain, *rounded, "layout_group", "method", "eligible", reasons.alias("reasons"))
