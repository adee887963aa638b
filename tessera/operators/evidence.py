"""Evidence about units in an address order: edges, helpers, sequences, support, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import THRESHOLDS as T
from .intervals import owners_at


def judged_edges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both edges of each run of a unit, and whether each is supported.

    rows: (keys, start, end, unit, independent).  An edge is supported if the member
    inside it is independent and what lies outside is an independent member of another
    unit or nothing."""
    line = Window.partitionBy(*keys).orderBy("start", "end")
    out = []
    for side, move in (("left", F.lag), ("right", F.lead)):
        other, sure = move("unit").over(line), move("independent").over(line)
        at = F.col("start") if side == "left" else F.col("end")
        part = rows.select(*keys, "unit", F.lit(side).alias("side"), at.alias("address"), "independent", other.alias("outside"), sure.alias("sure"))
        part = part.where("unit is not null and not (unit <=> outside)")
        outer = F.when(F.col("outside").isNull() & F.col("sure").isNull(), True).otherwise(F.coalesce(F.col("outside").isNotNull() & F.col("sure"), F.lit(False)))
        out.append(part.select(*keys, "unit", "side", "address", "outside", (F.col("independent") & outer).alias("supported")))
    return out[0].unionByName(out[1])


def placed_helpers(rows: DataFrame, keys: Sequence[str], padding: int = T.padding) -> DataFrame:
    """Rows without a unit and the units whose interior, head or tail their neighbours make them.

    rows: (keys, start, end, unit, independent, ambiguous, source, first, last); ``source`` is the
    place of the matched source row, first and last say whether it is its unit's outermost.
    A neighbour within the padding and not ambiguous is a member of its unit; it bounds other
    units if it is independent and outermost on the side that faces the helper, as the end of the
    group does.  Interior: both neighbours are members, in source order.  Head or tail: one is a
    member and outermost on that side, and the other bounds."""
    line = Window.partitionBy(*keys).orderBy("start", "end")
    beside = {}
    for side, move in (("before", F.lag), ("after", F.lead)):
        gap = F.col("start") - F.lag("end").over(line) if side == "before" else F.lead("start").over(line) - F.col("end")
        beside |= {f"{side}_{c}": move(c).over(line) for c in ("unit", "independent", "ambiguous", "source")}
        beside[f"{side}_outer"] = move("last" if side == "before" else "first").over(line)
        beside[f"{side}_end"] = move("start").over(line).isNull()
        beside[f"{side}_near"] = F.coalesce(gap <= padding, F.lit(False))
    rows = rows.withColumns(beside).where("unit is null")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    member = {s: F.col(f"{s}_unit").isNotNull() & F.col(f"{s}_near") & ~flag(f"{s}_ambiguous") for s in ("before", "after")}
    bounds = {s: F.col(f"{s}_end") | (member[s] & flag(f"{s}_independent") & flag(f"{s}_outer")) for s in ("before", "after")}
    differ = ~F.col("before_unit").eqNullSafe(F.col("after_unit"))
    inside = member["before"] & member["after"] & (F.col("before_unit") == F.col("after_unit")) & (F.col("before_source") < F.col("after_source"))
    tail = member["before"] & flag("before_outer") & bounds["after"] & differ
    head = member["after"] & flag("after_outer") & bounds["before"] & differ
    one = lambda when, name, unit: F.when(when, F.struct(F.lit(name).alias("placement"), F.col(unit).alias("owner")))
    found = F.array_compact(F.array(one(inside, "interior", "before_unit"), one(tail, "tail", "before_unit"), one(head, "head", "after_unit")))
    return rows.select(*keys, "start", "end", F.explode(found).alias("x")).select(*keys, "start", "end", "x.placement", "x.owner")


def complete_sequences(matches: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(unit, members, complete): whether a unit's source members map, in order and without
    gaps or strangers, onto one contiguous run of target members.

    source: (id, unit, pos); target: (id, pos); matches: (source_id, target_id).  Places are joined to
    the matches first: members without a match have no key that would bring them all to one task."""
    placed = matches.join(target.select(F.col("id").alias("target_id"), F.col("pos").alias("target_pos")), "target_id", "left")
    hit = source.join(placed.select(F.col("source_id").alias("id"), "target_pos"), "id", "left")
    line = Window.partitionBy("unit").orderBy("pos")
    step = (F.col("target_pos") - F.lag("target_pos").over(line) == 1) & (F.col("pos") - F.lag("pos").over(line) == 1)
    good = F.when(F.row_number().over(line) == 1, F.col("target_pos").isNotNull()).otherwise(F.coalesce(step, F.lit(False)))
    return hit.withColumn("good", good).groupBy("unit").agg(F.count(F.lit(1)).alias("members"), F.bool_and("good").alias("complete"))


def identified(rows: DataFrame) -> DataFrame:
    """Per unit: members, matched, independent and contested ones, and a confidence.

    rows: (unit, matched, independent, contested)."""
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    out = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("members"), count("matched"), count("independent"), count("contested"))
    return out.withColumn(
        "confidence",
        F.when(F.col("matched") == 0, "absent").when(F.col("contested") > 0, "ambiguous").when(F.col("independent") >= 2, "corroborated").otherwise("tentative"),
    )


def name_support(ranges: DataFrame, names: DataFrame, strong: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per unit: its strong functions, those named inside its ranges, all names there, and whether that permits a claim.

    ranges: (keys, unit, start, end), disjoint; names: (keys, id, at, named) with the unit whose
    strong function it is; strong: (unit, strong).  Permitted: two members or more, at least
    half of the unit's strong functions, and at most twice as many names as it has of them."""
    at = owners_at(names, ranges, keys).where("owner is not null").select(F.col("owner").alias("unit"), "named")
    counts = at.groupBy("unit").agg(F.count(F.lit(1)).alias("span"), F.sum((F.col("named") == F.col("unit")).cast("long")).alias("members"))
    out = strong.join(counts, "unit", "left").select("unit", "strong", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("members", "span")))
    return out.withColumn("permits", F.expr("members >= 2 and 2 * members >= strong and span <= 2 * strong"))


def shifted(ranges: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source ranges moved by the shift of the anchors around them, where both agree.

    anchors: (keys, source, target).  A range takes the last anchor at or before its start
    and the first at or behind its end, by one sweep over both in order."""
    spots = anchors.select(*keys, F.col("source").alias("at"), F.lit(1).alias("order"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), (F.col("target") - F.col("source")).alias("delta"))
    none = F.lit(None).cast("long")
    starts = ranges.select(*keys, F.col("start").alias("at"), F.lit(2).alias("order"), "start", "end", none.alias("delta"))
    ends = ranges.select(*keys, F.col("end").alias("at"), F.lit(0).alias("order"), "start", "end", none.alias("delta"))
    rows = spots.unionByName(starts).unionByName(ends)
    line = Window.partitionBy(*keys).orderBy("at", "order")
    rows = rows.withColumn("before", F.last("delta", True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.first("delta", True).over(line.rowsBetween(0, Window.unboundedFollowing)))
    left = rows.where("order = 2").select(*keys, "start", "end", "before").distinct()
    right = rows.where("order = 0").select(*keys, "start", "end", "after").distinct()
    return left.join(right, [*keys, "start", "end"]).where("before = after").select(
        *keys, "start", "end", (F.col("start") + F.col("before")).alias("target_start"), (F.col("end") + F.col("before")).alias("target_end")
    )


def last_outcomes(events: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per unit its final outcome over the stages in order: the last acceptance, or else the last event."""
    at = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    rank = F.struct((F.col("outcome") == "accepted").alias("ok"), at.alias("at"), "ordinal")
    return events.groupBy("unit").agg(F.max_by(F.struct("stage", "outcome"), rank).alias("x")).select("unit", "x.stage", "x.outcome")


def truncated(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each unit's ranges without its last one in a group: a mask that hides a tail."""
    line = Window.partitionBy(*keys, "unit").orderBy("start", "end")
    return ranges.withColumn("__next", F.lead("start").over(line)).where("__next is not null").drop("__next")


def misplaced(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ranges in which a unit's last range of a stretch goes to the unit that follows it."""
    line = Window.partitionBy(*keys).orderBy("start", "end")
    follows = F.lead("unit").over(line)
    return ranges.withColumn("unit", F.when(follows.isNotNull() & (follows != F.col("unit")), follows).otherwise(F.col("unit")))


def chosen_alternatives(rows: DataFrame, key: str, scores: Sequence[str], k: int) -> DataFrame:
    """The k best candidates of each key by each of several scores, without repeats."""
    names = [f"__{score}" for score in scores]
    lines = [Window.partitionBy(key).orderBy(F.col(score).desc(), "candidate") for score in scores]
    ranked = rows.withColumns({n: F.row_number().over(line) for n, line in zip(names, lines, strict=True)})
    return ranked.where(F.least(*names) <= k).drop(*names).distinct()


def regressed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(unit, was, now) of units whose measure fell."""
    return before.withColumnRenamed("value", "was").join(after.withColumnRenamed("value", "now"), "unit").where("now < was")


def section_coverage(source: DataFrame, target: DataFrame, code: Sequence[str]) -> DataFrame:
    """Per unit: ranges, whether it has code only, and whether the target has all its other sections."""
    need = source.groupBy("unit").agg(
        F.count(F.lit(1)).alias("ranges"), F.bool_and(F.col("section").isin(*code)).alias("code_only"), F.collect_set("section").alias("need")
    )
    have = target.groupBy("unit").agg(F.collect_set("section").alias("have"))
    fixed = F.array(*map(F.lit, code))
    missing = F.array_except(F.array_except("need", fixed), F.coalesce("have", F.array().cast("array<string>")))
    return need.join(have, "unit", "left").select("unit", "ranges", "code_only", (F.size(missing) == 0).alias("covered"))


def emitted_owners(definitions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(body, unit, occurrence): bodies with two definitions or more, one a unit, and as many
    occurrences, paired by equal neighbours before and after where those pairs are one to one.

    definitions: (body, unit, before, after); occurrences: (body, id, before, after)."""
    d = definitions.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("unit").alias("units")).where("n >= 2 and n = units")
    o = occurrences.groupBy("body").agg(F.count(F.lit(1)).alias("n"))
    even = d.join(o, ["body", "n"]).select("body", "n")
    pairs = definitions.join(occurrences, ["body", "before", "after"]).join(even, "body").select("body", "n", "unit", F.col("id").alias("occurrence"))
    whole = pairs.groupBy("body").agg(F.count(F.lit(1)).alias("p"), F.count_distinct("unit").alias("u"), F.count_distinct("occurrence").alias("o"), F.max("n").alias("n"))
    return pairs.join(whole.where("p = n and u = n and o = n").select("body"), "body", "left_semi").select("body", "unit", "occurrence")
