"""Registered queries on composed claims: the layouts of boundary_queries with up to four drafts for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boundary_queries import _LAID, laid
from .operators import compose
from .queries import query

_DRAFTS = f"""{_LAID},
fn as (select ta.*, so.start as source_start, l.part, case when l.tax <= 0.05 then case when l.part % 29 = 1 then lag(ta.unit) over w when l.part % 29 <> 0 then ta.unit end end as owner,
         row_number() over u as k, count(*) over (partition by ta.unit) as n
       from ta join l using (id) join so using (id) window w as (partition by ta.section order by ta.pos), u as (partition by ta.unit order by ta.pos)),
ex as (select unit, section, min(start) as s, max("end") as e, max("end") filter (k = 1) as e1, max(start) filter (k = n) as sn, max(start) filter (k = 2) as s2, max(n) as n from fn group by 1, 2),
dr as (select unit, section, 1 as draft, 'head' as family, s as start, sn as "end" from ex where n >= 3
       union all select unit, section, 2, 'tail', e1, e from ex where n >= 3
       union all select unit, section, 3, 'full', s, e from ex where unit % 4 = 0
       union all select unit, section, 4, 'wide', s2, e from ex where n >= 3 and unit % 6 = 1),
me as (select dr.unit, dr.section, draft, fn.start as target_start, fn."end" as target_end, source_start + case when draft = 2 and part % 31 = 0 then 1000 else 0 end as source_start
       from dr join fn on fn.unit = dr.unit where owner = dr.unit and fn.start >= dr.start and fn."end" <= dr."end"),
hr as (select unit, section, start, "end" from tr where not auto and unit % 5 <> 0),
ed as (select distinct unit, section, 'left' as side, start as address from dr union select distinct unit, section, 'right', "end" from dr),
ne as (select ed.*, (select max(pos) from fn where fn.section = ed.section and fn.start < address) as b, (select min(pos) from fn where fn.section = ed.section and fn.start >= address) as a from ed),
jd as (select ne.unit, ne.section, side, address,
         coalesce(fb."end" <= address, true) and coalesce((case when side = 'left' then fa.owner else fb.owner end) = ne.unit, false)
           and case when side = 'left' then fb.pos is null or coalesce(fb.owner <> ne.unit, false) else fa.pos is null or coalesce(fa.owner <> ne.unit, false) end as supported
       from ne left join fn fb on fb.section = ne.section and fb.pos = b left join fn fa on fa.section = ne.section and fa.pos = a)"""


def drafted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Drafts, their members, the target's functions with owners, and what units hold."""
    rows = laid(spark, folder)
    line, own = Window.partitionBy("section").orderBy("pos"), Window.partitionBy("unit").orderBy("pos")
    part = F.col("part")
    owner = F.when(F.col("tax") <= 0.05, F.when(part % 29 == 1, F.lag("unit").over(line)).when(part % 29 != 0, F.col("unit")))
    fn = rows["target"].withColumns({"owner": owner, "k": F.row_number().over(own), "n": F.count(F.lit(1)).over(Window.partitionBy("unit"))})
    pick = lambda c, when: F.max(F.when(when, F.col(c)))
    ex = fn.groupBy("unit", "section").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), pick("end", F.col("k") == 1).alias("e1"), pick("start", F.col("k") == F.col("n")).alias("sn"),
        pick("start", F.col("k") == 2).alias("s2"), F.max("n").alias("n"),
    )
    long_, unit = F.col("n") >= 3, F.col("unit")
    kinds = [(1, "head", "s", "sn", long_), (2, "tail", "e1", "e", long_), (3, "full", "s", "e", unit % 4 == 0), (4, "wide", "s2", "e", long_ & (unit % 6 == 1))]
    made = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(d).alias("draft"), F.lit(f).alias("family"), F.col(a).alias("start"), F.col(b).alias("end"))) for d, f, a, b, c in kinds)))
    drafts = ex.select("unit", "section", F.inline(made))
    held = fn.where(F.col("owner") == F.col("unit")).select("unit", F.col("start").alias("target_start"), F.col("end").alias("target_end"), "source_start", "part")
    members = drafts.join(held, "unit").where("target_start >= start and target_end <= end")
    moved = F.col("source_start") + F.when((F.col("draft") == 2) & (part % 31 == 0), 1000).otherwise(0)
    members = members.select("unit", "section", "draft", "target_start", "target_end", moved.alias("source_start"))
    ranges = rows["target_ranges"].where("not auto and unit % 5 <> 0").select("unit", "section", "start", "end")
    return drafts, members, fn.select("section", "start", "end", "owner"), ranges


@query(f"""with {_DRAFTS}
select unit, section, side, address, supported,
  coalesce((select string_agg(o.address, ',' order by o.address) from jd o where o.unit = jd.unit and o.section = jd.section and o.side = jd.side and o.supported and o.address <> jd.address), '') as competing from jd""")
def competing_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that drafts propose, whether evidence supports each, and which supported ones rival it."""
    drafts, _, functions, _ = drafted(spark, folder)
    edges = compose.competing(compose.judged(compose.edges_of(drafts), functions))
    return edges.withColumn("competing", F.array_join(F.col("competing").cast("array<string>"), ","))


@query(f"""with {_DRAFTS},
o as (select unit, section, min(address) filter (side = 'left') as start, min(address) filter (side = 'right') as "end" from jd where supported group by 1, 2
      having count(*) filter (side = 'left') = 1 and count(*) filter (side = 'right') = 1),
c as (select * from o where start < "end" and not exists (select 1 from dr where dr.unit = o.unit and dr.section = o.section and dr.start = o.start and dr."end" = o."end")
        and not exists (select 1 from hr where hr.section = o.section and hr.unit <> o.unit and hr.start < hr."end" and hr.start < o."end" and o.start < hr."end")),
t as (select c.unit, c.section, c.start, c."end", fn.start as fs, fn."end" as fe, fn.start - coalesce(lag(fn."end") over (partition by c.unit, c.section order by fn.start), c.start) as gap
      from c join fn on fn.section = c.section and fn.start < c."end" and c.start < fn."end"),
g as (select unit, section, start, "end" from t group by 1, 2, 3, 4 having bool_and(fs >= start and fe <= "end" and gap <= 31) and "end" - max(fe) <= 31),
f as (select g.*, (select min(draft) from dr where dr.unit = g.unit and dr.start = g.start) as d1, (select min(draft) from dr where dr.unit = g.unit and dr."end" = g."end") as d2,
        (select string_agg(family, '+' order by draft) from dr where dr.unit = g.unit and dr.start = g.start) as left_families,
        (select string_agg(family, '+' order by draft) from dr where dr.unit = g.unit and dr."end" = g."end") as right_families from g),
m as (select f.unit, f.section, f.start, f."end", target_start, max(target_end) as target_end, min(source_start) as s1, max(source_start) as s2
      from f join me on me.unit = f.unit and me.section = f.section and me.draft in (d1, d2) group by 1, 2, 3, 4, 5),
w as (select *, coalesce(lag(s1) over (partition by unit, section order by target_start) < s1, true) as rises from m),
k as (select unit, section, count(*) as members from w group by 1, 2 having bool_and(rises and s1 = s2 and target_start >= start and target_end <= "end"))
select f.unit, f.section, start, "end", left_families, right_families, members from f join k using (unit, section)""")
def compositions(spark: SparkSession, folder: str) -> DataFrame:
    """Claims between the one supported left and the one supported right edge of different drafts."""
    return compose.compositions(*drafted(spark, folder))
