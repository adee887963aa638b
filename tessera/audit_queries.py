"""Registered queries of audits and scores; importing the module adds them to ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import prints
from .operators import anchors, audit, intervals, score, sequence
from .queries import _LEDGER, _MERGE, _OUTCOME, _R, _VOTES, ORACLE_SQL, accepted_votes, ledger_of, ownership_ledger, ownership_transfers, query, ranges, table, version
from .schema import THRESHOLDS as T

_EVEN = _R.replace("from events)", "from events where event_id % 2 = 0)")
_SOME = "(user_id % 2 = 1 or unit in ('click', 'view')) and (user_id % 5 <> 1 or unit = 'view')"
_CHOSEN = _R.replace("from events)", f"from events where {_SOME.replace('unit', 'event_type')})")
_FRESH = _LEDGER.replace("extract(day from ts) <= 15", "false")


@query(f"""with {_CHOSEN}, {_FRESH} select user_id, attributed, newly_wrong, inexact, case when attributed + wrong_after + changed = 0 then 'no-change' when inexact = 0 then 'exact'
  when newly_wrong > 0 then 'incorrect' when attributed > 0 then 'partial' else 'unknown' end as quality from m""")
def selection_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's later claims judged as a replacement of nothing."""
    book = ledger_of(ranges(spark, folder).where(_SOME), before=False)
    return book.select("user_id", "attributed", "newly_wrong", "inexact", score.selection_quality().alias("quality"))


_STATES = """
st as (select user_id, event_id as id, s, e, case
   when exists (select 1 from r o where o.user_id = p.user_id and o.unit = 'click' and o.s = p.s and o.e = p.e) then 'exact'
   when exists (select 1 from r o where o.user_id = p.user_id and o.unit = 'view' and o.s < p.e and p.s < o.e) then 'incorrect'
   when exists (select 1 from r o where o.user_id = p.user_id and o.unit = 'click' and o.s < p.e and p.s < o.e) then 'partial' else 'unknown' end as state
  from r p where unit not in ('click', 'view'))"""


@query(f"""with {_R}, {_STATES} select user_id, id, s as start, e as "end", state from st""")
def range_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranges(spark, folder)
    asked = rows.where("unit not in ('click', 'view')").withColumnRenamed("event_id", "id")
    return audit.range_states(asked, rows.where("unit = 'click'"), rows.where("unit = 'view'"), ["user_id"])


_HELD_OUT = "substr(sha256(cast(user_id as varchar)), 1, 1) < '8'"


@query(f"""with {_R}, {_LEDGER}, {_STATES},
o as (select *, {_OUTCOME} as outcome, {_HELD_OUT} as held_out from m),
a as (select held_out, count(*) as units, count(*) filter (outcome = 'exact') as boundaries_exact, count(*) filter (outcome = 'partial') as boundaries_partial, count(*) filter (outcome = 'incorrect') as boundaries_incorrect,
        count(*) filter (outcome = 'unowned') as boundaries_unowned, count(*) filter (outcome = 'abstained') as abstained, sum(retained) as retained_bytes, sum(attributed) as attributed_bytes, sum(missed) as missed_bytes, sum(wrong_after) as wrong_bytes from o group by 1),
b as (select {_HELD_OUT} as held_out, count(*) as ranges, count(*) filter (state = 'exact') as ranges_exact, count(*) filter (state = 'partial') as ranges_partial, count(*) filter (state = 'incorrect') as ranges_incorrect, count(*) filter (state = 'unknown') as ranges_unknown from st group by 1)
select * from a left join b using (held_out)""")
def calibration_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of verdicts, bytes and range states in the tuned and the held-out half."""
    half = score.held_out(F.col("user_id").cast("string")).alias("held_out")
    tell = lambda c, *names: [F.count_if(F.col(c) == n).alias(a) for n, a in names]
    book = ownership_ledger(spark, folder).groupBy(half).agg(
        F.count(F.lit(1)).alias("units"),
        *tell("outcome", *((n, f"boundaries_{n}") for n in ("exact", "partial", "incorrect", "unowned")), ("abstained", "abstained")),
        *(F.sum(c).alias(f"{n}_bytes") for c, n in (("retained", "retained"), ("attributed", "attributed"), ("missed", "missed"), ("wrong_after", "wrong"))),
    )
    states = range_states(spark, folder).groupBy(half).agg(
        F.count(F.lit(1)).alias("ranges"), *tell("state", *((n, f"ranges_{n}") for n in ("exact", "partial", "incorrect", "unknown")))
    )
    return book.join(states, "held_out", "left")


@query(f"""with {_R}, {_LEDGER}, {_STATES},
o as (select *, {_OUTCOME} as outcome from m), w as (select distinct user_id from st where state = 'incorrect'),
k as (select user_id, concat_ws(',', case when outcome = 'incorrect' then 'ownership' end, case when user_id in (select user_id from w) then 'alternative' end,
        case when lost > 0 then 'neighbour-lost' end, case when newly_wrong > 40 then 'neighbour-wrong' end) as kinds from o)
select * from k where kinds <> ''""")
def scenario_faults(spark: SparkSession, folder: str) -> DataFrame:
    wrong = range_states(spark, folder).where("state = 'incorrect'").select("user_id").distinct().withColumn("wrong", F.lit(True))
    rows = ownership_ledger(spark, folder).join(wrong, "user_id", "left")
    kinds = score.faults(
        ownership=F.col("outcome") == "incorrect", alternative=F.coalesce("wrong", F.lit(False)), neighbour_lost=F.col("lost") > 0, neighbour_wrong=F.col("newly_wrong") > 40
    )
    return rows.select("user_id", kinds.alias("kinds")).where("kinds is not null")


_SCOPES = ("gained", "lost", "newly_wrong", "wrong_after", "missed", "unknown", "attributed", "inexact", "inexact_before")
_POPULATIONS = {
    "recall/full": ("user_id % 5 <> 0", "full"), "recall/code": ("user_id % 5 <> 0", "code"), "recall-changed/full": ("user_id % 5 <> 0 and user_id % 3 = 0", "full"),
    "recall-changed-code/code": ("user_id % 5 <> 0 and user_id % 6 = 0", "code"), "source-linked/full": ("user_id % 4 = 0", "full"), "control/full": ("user_id % 4 = 0 and user_id % 3 <> 0", "full"),
}
_PICK = " union all ".join(
    f"select '{name}' as population, b.regressed, b.lost_exactness, {scope}.* from b join \"{scope}\" on {scope}.user_id = b.user_id where b.{where.replace(' user_id', ' b.user_id')}"
    for name, (where, scope) in _POPULATIONS.items()
)


@query(f"""with "full" as (with {_R}, {_LEDGER} select *, {_OUTCOME} as outcome from m), code as (with {_EVEN}, {_LEDGER} select *, {_OUTCOME} as outcome from m),
b as (select f.user_id, f.lost > 0 or f.newly_wrong > 0 as regressed, f.inexact_before = 0 and f.inexact > 0 as lost_exactness from "full" f join code c using (user_id)),
x as ({_PICK.replace('full.', '"full".')})
select population, count(*) as units, count(*) filter (outcome = 'exact') as exact, count(*) filter (outcome = 'partial') as partial, count(*) filter (outcome = 'incorrect') as wrong,
 count(*) filter (outcome = 'unowned') as unowned, count(*) filter (outcome = 'abstained') as unchanged, count(*) filter (attributed > 0) as proposal_recall, count(*) filter (inexact = 0) as selected_exact,
 count(*) filter (attributed > 0 and inexact > 0) as ranking_failures, count(*) filter (regressed) as regressed, count(*) filter (lost_exactness) as lost_exactness,
 sum(gained) as gained_bytes, sum(lost) as lost_bytes, sum(newly_wrong) as newly_wrong_bytes, sum(wrong_after) as wrong_after_bytes, sum(missed) as missed_bytes, sum(unknown) as unknown_bytes
from x group by 1""")
def score_populations(spark: SparkSession, folder: str) -> DataFrame:
    """Six overlapping populations of users; events of even number stand for code."""
    rows = ranges(spark, folder)

    def scope(part: DataFrame, name: str) -> DataFrame:
        book = ledger_of(part).withColumn("outcome", score.outcome()).withColumns({"proposed": F.col("attributed") > 0, "selected": F.col("inexact") == 0})
        return book.select("user_id", F.struct("outcome", "proposed", "selected", *_SCOPES).alias(name))

    both = scope(rows, "full").join(scope(rows.where("event_id % 2 = 0"), "code"), "user_id")
    both = both.withColumns({"regressed": F.expr("full.lost > 0 or full.newly_wrong > 0"), "lost_exactness": F.expr("full.inexact_before = 0 and full.inexact > 0")})
    return score.populations(both, {name: (F.expr(where), s) for name, (where, s) in _POPULATIONS.items()})


@query(f"""with t as ({ORACLE_SQL['ownership_transfers']}),
m as (select user_id, to_unit as unit, "end" - start as gained, 0 as lost from t where to_unit is not null union all select user_id, from_unit, 0, "end" - start from t where from_unit is not null),
n as (select user_id, sum(case when from_unit is null then "end" - start when to_unit is null then start - "end" else 0 end) as net from t group by 1)
select user_id, unit, sum(gained) as gained_bytes, sum(lost) as lost_bytes, max(net) as net_bytes from m join n using (user_id) group by 1, 2""")
def transaction_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that each unit gains and loses by a user's transfers, and the change of all owned bytes."""
    moved = ownership_transfers(spark, folder).withColumn("size", F.col("end") - F.col("start"))
    zero = F.lit(0).cast("long")
    gained = moved.where("to_unit is not null").select("user_id", F.col("to_unit").alias("unit"), F.col("size").alias("gained"), zero.alias("lost"))
    lost = moved.where("from_unit is not null").select("user_id", F.col("from_unit").alias("unit"), zero.alias("gained"), F.col("size").alias("lost"))
    each = gained.unionByName(lost).groupBy("user_id", "unit").agg(F.sum("gained").alias("gained_bytes"), F.sum("lost").alias("lost_bytes"))
    sign = F.when(F.col("from_unit").isNull(), F.col("size")).when(F.col("to_unit").isNull(), -F.col("size")).otherwise(0)
    return each.join(moved.groupBy("user_id").agg(F.sum(sign).alias("net_bytes")), "user_id")


@query(f"""with {_R}, q as (select *, s // 60 as g from r),
x as (select user_id, g, min(s) as s, max(e) as e from q where unit in ('click', 'purchase') group by 1, 2),
h as (select user_id, g, count(*) as n, min(s) as hs, max(e) as he from q where unit = 'click' group by 1, 2)
select x.user_id, x.g as slot, s as start, e as "end", case when n = 1 and hs = s and he = e then 'unchanged'
  when exists (select 1 from q where q.user_id = x.user_id and q.g = x.g and q.unit = 'view' and q.s < x.e and x.s < q.e) then 'blocked' else 'merged' end as verdict from x left join h using (user_id, g)""")
def merged_spans(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranges(spark, folder).withColumn("slot", F.floor(F.col("start") / 60))
    parts = [rows.where(f"unit = '{u}'") for u in ("purchase", "click", "view")]
    return audit.merged_spans(*parts, ["user_id", "slot"])


@query(f"""with {_R}, q as (select user_id as k, s, e from r where unit in ('click', 'view')), m as (select * from {_MERGE.format('q')})
select user_id, event_id as id, s as start, e as "end", exists (select 1 from m where m.k = r.user_id and m.s <= r.s and r.e <= m.e) as covered from r where unit = 'purchase'""")
def interval_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranges(spark, folder)
    return audit.covered(rows.where("unit = 'purchase'").withColumnRenamed("event_id", "id"), rows.where("unit in ('click', 'view')"), ["user_id"])


@query(f"""with {_R}, d(section, least) as (values ('click', 4), ('view', 1), ('purchase', 8), ('signup', 2), ('login', 2), ('logout', 2)),
m as (select min(s) as s, max(e) as e, k as user_id, unit from (select user_id as k, unit, s, s + 4 * (1 + event_id % 3) as e from r where s % 16 = 0 or event_id % 50 = 0) group by k, unit, s),
o as (select *, user_id || '/' || unit || '/' || s as id from m),
c as (select o.*, not exists (select 1 from o x where x.user_id = o.user_id and x.id <> o.id and x.s < o.e and o.s < x.e) as clear from o),
y as (select user_id, s as at, 1 << (event_id % 4)::int as align from r where unit <> 'view')
select user_id, id, s as start, e as "end", greatest(coalesce((select max(align) from y where y.user_id = c.user_id and y.at >= c.s and y.at < c.e), least), least) as align,
 s % greatest(coalesce((select max(align) from y where y.user_id = c.user_id and y.at >= c.s and y.at < c.e), least), least) = 0
 and e % greatest(coalesce((select max(align) from y where y.user_id = c.user_id and y.at >= c.s and y.at < c.e), least), least) = 0 as aligned
from c join d on d.section = c.unit where clear""")
def aligned_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranges(spark, folder)
    size = F.col("start") + 4 * (1 + F.col("event_id") % 3)
    spans = rows.where("start % 16 = 0 or event_id % 50 = 0").withColumn("end", size).groupBy("user_id", "unit", "start").agg(F.max("end").alias("end"))
    spans = spans.select("user_id", "unit", F.concat_ws("/", "user_id", "unit", "start").alias("id"), "start", "end")
    clear = intervals.disjoint_only(spans, ["user_id"]).withColumnRenamed("unit", "section")
    symbols = rows.where("unit <> 'view'").select("user_id", F.col("event_id").alias("id"), F.col("start").alias("at"), F.expr("shiftleft(1, cast(event_id % 4 as int))").alias("align"))
    least = [("click", 4), ("view", 1), ("purchase", 8), ("signup", 2), ("login", 2), ("logout", 2)]
    return audit.aligned(clear, symbols, spark.createDataFrame(least, "section string, least int"), ["user_id"])


@query("""
with a as (select l_orderkey as o, l_partkey % 500 as ref, l_returnflag as kind, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ord from lineitem),
p as (select x.o, x.ref as source, y.ref as target, x.l_quantity = y.l_quantity as eq from a x join a y on y.o = x.o + 1 and x.o % 2 = 0 and x.ord = y.ord and x.kind = y.kind)
select target, source, count(*) as references, count(distinct o) as functions, case when bool_or(eq) or count(*) >= 2 and count(distinct o) >= 2 then 'confident' else 'probable' end as tier from p group by 1, 2""")
def relocation_tiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.select("l_orderkey", (F.col("l_partkey") % 500).alias("ref"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("q"), F.row_number().over(line).alias("ord"))
    s = version(rows, "l_orderkey", 0).select((F.col("l_orderkey") + 1).alias("l_orderkey"), F.col("ref").alias("source"), "kind", F.col("q").alias("sq"), "ord")
    t = version(rows, "l_orderkey", 1).select("l_orderkey", F.col("ref").alias("target"), "kind", F.col("q").alias("tq"), "ord")
    pairs = s.join(t, ["l_orderkey", "ord", "kind"])
    return audit.relocation_tiers(pairs.select("target", "source", F.col("l_orderkey").alias("function"), (F.col("sq") == F.col("tq")).alias("equal")))


@query("""
with a as (select p_name as old, p_brand as new, cast(p_size as varchar) as unit from part where p_partkey % 4 = 0),
j as (select p_type || p_partkey as old, p_name as new from part where p_partkey % 3 = 0 union all select p_brand || p_partkey, p_name from part where p_partkey % 5 = 0),
f as (select new, string_agg(old, ',' order by old) as frees from j group by 1)
select a.old, a.new, a.unit, coalesce(frees, '') as frees from a left join f on f.new = a.old""")
def name_corrections(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    method = F.when(F.col("p_partkey") % 4 == 0, "misplaced-name").otherwise("call-site")
    accepted = part.select(F.col("p_name").alias("old"), F.col("p_brand").alias("new"), F.col("p_size").cast("string").alias("unit"), method.alias("method"))
    blocked = [part.where(f"p_partkey % {k} = 0").select(F.concat(c, F.col("p_partkey")).alias("old"), F.col("p_name").alias("new")) for k, c in ((3, "p_type"), (5, "p_brand"))]
    reason = F.when(F.col("old").isNotNull(), "name already taken")
    return audit.corrections(accepted, blocked[0].unionByName(blocked[1]).withColumn("reason", reason))


@query("""
with x as (select c_nationkey * 100 + c_custkey // 2 % 90 as module, c_mktsegment as unit, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_custkey else 0 end as code_bytes, c_custkey % 2 as v from customer)
select module, count(distinct unit) as units, sum(code_bytes) as code_bytes from x where v = 0 and module not in (select module from x where v = 1) group by 1""")
def unsplit_modules(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select(
        "c_custkey", (F.col("c_nationkey") * 100 + F.floor(F.col("c_custkey") / 2) % 90).alias("module"), F.col("c_mktsegment").alias("unit"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_custkey")).otherwise(0).alias("code_bytes"),
    )
    return audit.unsplit_modules(version(rows, "c_custkey", 0), version(rows, "c_custkey", 1))


@query("""select c_nationkey * 100 + c_custkey % 60 as unit, count(*) as ranges from customer group by 1 having not bool_or(c_mktsegment in ('BUILDING', 'MACHINERY'))""")
def data_only_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select((F.col("c_nationkey") * 100 + F.col("c_custkey") % 60).alias("unit"), F.col("c_mktsegment").alias("section"))
    return audit.data_only(rows, ["BUILDING", "MACHINERY"])


_KINDS = ("unit", "unit-data", "unit-link", "code-dependency", "data-dependency", "symbol", "jump-table-seam")


@query("""
with k(i, kind) as (values (0, 'unit'), (1, 'unit-data'), (2, 'unit-link'), (3, 'code-dependency'), (4, 'data-dependency'), (5, 'symbol'), (6, 'jump-table-seam')),
x as (select o_orderkey as id, kind, o_custkey % 400 as name, o_orderstatus from orders join k on i = o_orderkey % 7), r as (select distinct kind, name from x where o_orderstatus = 'P')
select id, kind, name, exists (select 1 from r where r.name = x.name and (r.kind = x.kind or x.kind = 'unit' and r.kind in ('code-dependency', 'unit-link')
  or x.kind = 'unit-data' and r.kind in ('data-dependency', 'unit-link'))) as conflict from x where o_orderstatus <> 'P'""")
def scope_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind"), (F.col("o_custkey") % 400).alias("name"), "o_orderstatus")
    return audit.scope_conflicts(rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus = 'P'"))


@query("""
with p as (select p_partkey as id, p_partkey % 2 as v, case when p_partkey % 3 > 0 then p_brand || '/' || (p_partkey // 6) end as name, p_type || '/' || (p_partkey // 8) as hash, p_size as size from part),
un as (select v, name, min(id) as id from p where name is not null group by 1, 2 having count(*) = 1), uh as (select v, hash, min(id) as id from p where size >= 4 group by 1, 2 having count(*) = 1),
n as (select s.id as source_id, t.id as target_id from un s join un t on s.name = t.name and s.v = 0 and t.v = 1),
b as (select s.id as source_id, t.id as target_id from uh s join uh t on s.hash = t.hash and s.v = 0 and t.v = 1)
select source_id, target_id, 'name' as method, 1.0::double as confidence from n
union all select source_id, target_id, 'exact-body', 0.97::double from b where source_id not in (select source_id from n) and target_id not in (select target_id from n)""")
def anchor_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors by name, and by body among what names leave open."""
    key = F.col("p_partkey")
    name = F.when(key % 3 > 0, F.concat_ws("/", "p_brand", F.floor(key / 6)))
    rows = table(spark, folder, "part").select(key.alias("id"), name.alias("name"), F.concat_ws("/", "p_type", F.floor(key / 8)).alias("hash"), F.col("p_size").alias("size"))
    return anchors.anchors(version(rows, "id", 0), version(rows, "id", 1))


@query(f"""with {_VOTES}, c as (select *, round(case when "distinct" then 0.98 else least(0.95, 0.45 + 0.2 * similarity + 0.2 * least(1.0, votes / 3) + 0.15 * margin) end, 6) as confidence from best)
select source_id, target_id, confidence, case when margin < 0.15 then 'candidate' when "distinct" then 'confident' when votes >= 2 then 'probable' else 'candidate' end as tier from c where confidence >= 0.5""")
def match_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of evidence of each accepted pair, whatever its confidence."""
    tier = prints.tier(F.lit("vote"), F.col("votes"), F.col("distinct"), F.col("margin") < T.contested_margin)
    return accepted_votes(spark, folder).select("source_id", "target_id", "confidence", tier.alias("tier"))


@query("""
with n as (select p_partkey, case p_partkey % 6 when 0 then 'lbl_' || p_partkey when 1 then p_name || '_8000ABCD' when 2 then '0x0x' || p_partkey when 3 then 'src/' || p_partkey || '/file.v2.cpp' when 4 then '_8000ABCD' else p_name end as name from part)
select p_partkey, name, regexp_matches(name, '^(lbl_|fn_|data_|gap_|func_)') as placeholder, regexp_matches(name, '._[0-9A-F]{8}$') as derived, regexp_replace(name, '^(0x)+', '') as bare, regexp_replace(name, '[.][^./]*$', '') as unit from n""")
def name_predicates(spark: SparkSession, folder: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    kinds = [F.concat(F.lit("lbl_"), key), F.concat(name, F.lit("_8000ABCD")), F.concat(F.lit("0x0x"), key), F.concat(F.lit("src/"), key, F.lit("/file.v2.cpp")), F.lit("_8000ABCD"), name]
    rows = table(spark, folder, "part").select("p_partkey", F.element_at(F.array(*kinds), (key % 6 + 1).cast("int")).alias("name"))
    n = F.col("name")
    return rows.select(
        "p_partkey", "name", prints.placeholder_name(n).alias("placeholder"), prints.address_derived(n).alias("derived"),
        prints.without_hex_prefix(n).alias("bare"), prints.unit_key(n).alias("unit"),
    )


@query("""with recursive l as (select l_orderkey, l_linenumber as k, l_partkey % 10 as part, l_quantity as w from lineitem),
e as (select a.l_orderkey as pair, a.k as i, b.k as j, max(a.w + b.w) as w from l a join l b on b.l_orderkey = a.l_orderkey + 1 and a.part = b.part where a.l_orderkey % 2 = 0 group by 1, 2, 3),
c as (select pair, i, j, 1 as n, w, [(i, j)] as path from e union all
      select e.pair, e.i, e.j, n + 1, c.w + e.w, list_append(path, (e.i, e.j)) from c join e on e.pair = c.pair and e.i > c.i and e.j > c.j),
r as (select *, row_number() over (partition by pair order by n desc, w desc, path[-1] desc, list_reverse(path[:-2])) as k, max(n) over (partition by pair) as longest from c),
s as (select pair, max(w) as second from r where k > 1 and n = longest group by 1)
select r.pair, (select count(*) from e where e.pair = r.pair) as edges, array_to_string(list_transform(path, lambda x: x[1] || ':' || x[2]), ',') as chain, w as weight, coalesce(second, 0) as second
from r left join s on s.pair = r.pair where k = 1""")
def chain_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """The longest chain of equal parts, of equal length the heaviest, in both orders' own order, of each order and the next key."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 10).alias("part"), F.col("l_quantity").cast("double").alias("w"))
    a = version(rows, "l_orderkey", 0).select(F.col("l_orderkey").alias("pair"), F.col("k").alias("i"), "part", F.col("w").alias("wa"))
    b = version(rows, "l_orderkey", 1).select((F.col("l_orderkey") - 1).alias("pair"), F.col("k").alias("j"), "part", F.col("w").alias("wb"))
    edges = a.join(b, ["pair", "part"]).groupBy("pair", "i", "j").agg(F.max(F.col("wa") + F.col("wb")).alias("w"))
    return sequence.chains(edges, "pair")
