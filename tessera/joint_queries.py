"""Registered queries on runs of neighbouring units: the layouts of boundary_queries, divided window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .boundary_queries import _LAID, laid
from .operators import joint
from .queries import query

_WINDOWS = f"""{_LAID},
rg as (select section, unit, start, "end" from tr where not auto),
fx as (select ta.section, ta.pos - 1 as idx, ta.start, ta."end", case when l.tax <= 0.05 and l.part % 29 <> 0 then ta.unit end as owner,
         list_filter([case when l.tax > 0.05 and l.tax <= 0.07 then ta.unit end, case when l.discount >= 0.075 then lead(ta.unit) over (partition by ta.section order by ta.pos) end], lambda x: x is not null) as hints
       from ta join l using (id)),
ft as (select fx.section, idx, fx.start, fx."end", owner, hints, coalesce(bool_or(r.start <= fx.start and fx.start < r."end" and fx."end" <= r."end"), false) as inside, coalesce(bool_or(r.start <= fx.start and fx.start < r."end"), false) as begun
       from fx left join rg r on r.section = fx.section and r.unit = fx.owner group by all),
oq as (select section, unit, auto, row_number() over (partition by section order by start, unit) - 1 as pos
       from (select *, unit % 23 = 0 as auto, unit is distinct from lag(unit) over (partition by section order by start, unit) as fresh from so) where fresh),
nd as (select *, not exists (select 1 from rg where rg.section = oq.section and rg.unit = oq.unit) or exists (select 1 from ft where ft.section = oq.section and owner = oq.unit and not inside)
         or exists (select 1 from ft join rg on rg.section = ft.section where ft.section = oq.section and rg.unit = oq.unit and owner <> oq.unit and rg.start <= ft.start and ft.start < rg."end") as needed from oq),
il as (select *, sum((not needed)::int) over (partition by section order by pos rows unbounded preceding) as island, max(pos) over (partition by section) as end_of from nd),
ck as (select section, island, pos, end_of, (row_number() over (partition by section, island order by pos) - 1) // 6 as chunk from il where needed),
cw as (select section, min(pos) as f, max(pos) as l, max(end_of) as e from ck group by section, island, chunk),
wn as (select distinct section, case when f = l and l >= e and f > 0 then f - 1 else f end as first, case when f = l and l < e then l + 1 else l end as last from cw),
ow as (select section, owner as unit, min(idx) as low, max(idx) as high from ft where owner is not null group by 1, 2),
mb as (select w.section, first, last, o.pos, o.unit, o.auto, low, high, lag(high) over (partition by w.section, first, last order by o.pos) as after
       from wn w join nd o on o.section = w.section and o.pos between first and last left join ow on ow.section = o.section and ow.unit = o.unit where first < last),
bw as (select section, first, last, list(unit order by pos) as units, min(low) as low, max(high) as high from mb group by 1, 2, 3 having bool_and(not auto and low is not null and coalesce(after < low, true))),
bx as (select *, (select max(idx) from ft where ft.section = bw.section and idx < low and owner is not null) as before, (select min(idx) from ft where ft.section = bw.section and idx > high and owner is not null) as behind,
         (select max(idx) from ft where ft.section = bw.section) as top from bw),
by_ as (select *, greatest(low - 3, coalesce(before, -1) + 1, 0) as lft, least(high + 3, coalesce(behind, top + 1) - 1, top) + 1 as rgt from bx),
bz as (select row_number() over (order by section, first) as w, * from by_ where (lft = 0 or coalesce(before = lft - 1, false)) and (rgt > top or coalesce(behind = rgt, false))),
pc as (select w, units, ft.*, idx - lft as k, rgt - lft as m, lead(ft.start) over (partition by w order by idx) as next_start,
         (select start from ft x where x.section = bz.section and x.idx = rgt) as closed, (select "end" from ft x where x.section = bz.section and x.idx = lft - 1) as opened
       from bz join ft on ft.section = bz.section and idx >= lft and idx < rgt where rgt - lft <= 40),
gd as (select w, max(closed) as closed from pc group by w
       having not bool_or(owner is not null and not list_contains(units, owner)) and not bool_and(begun)
         and coalesce(min(start) - max(opened), 0) <= 31 and coalesce(max(closed) - max("end"), 0) <= 31),
pg as (select pc.*, coalesce(next_start, pc.closed, "end") - "end" as gap from pc join gd using (w)),
un as (select distinct w, m, unnest(units) as unit, unnest(range(len(units))) as u, len(units) as n from pg),
sg as (select un.w, un.u, n, un.m, un.unit, a.k as p, b.k + 1 as q, count(*) filter (c.owner is null) as opened, min(c.k) filter (c.owner = un.unit) as o1, max(c.k) filter (c.owner = un.unit) as o2,
         min(c.k) filter (c.owner is null and not list_contains(c.hints, un.unit)) as h1, max(c.k) filter (c.owner is null and not list_contains(c.hints, un.unit)) as h2, sum(c.gap) as padding
       from un join pg a on a.w = un.w join pg b on b.w = un.w and b.k >= a.k join pg c on c.w = un.w and c.k between a.k and b.k
       group by un.w, un.u, n, un.m, un.unit, a.k, b.k having bool_and(c.owner is null or c.owner = un.unit) and bool_and(c.gap between 0 and 31)),
sv as (select sg.*, (select start from pg where pg.w = sg.w and pg.k = p) as s0, coalesce((select start from pg where pg.w = sg.w and pg.k = q), (select coalesce(max(closed), max("end")) from pg where pg.w = sg.w)) as s1
       from sg where o1 is not null and (h1 is null or (h1 > o1 and h2 < o2))),
wy as (select w, 1 as u, n, m, q, (opened = 0)::int as complete, padding, [unit || ':' || s0 || '-' || s1] as path from sv where u = 0 and p = 0
       union all
       select wy.w, wy.u + 1, wy.n, wy.m, sv.q, complete + (opened = 0)::int, wy.padding + sv.padding, list_append(path, unit || ':' || s0 || '-' || s1) from wy join sv on sv.w = wy.w and sv.u = wy.u and sv.p = wy.q),
en as (select *, rank() over (partition by w order by complete desc, padding) as k from wy where u = n and q = m),
ed as (select w, count(*) as ways, min(path) as path from en where k = 1 group by w),
jr as (select section, array_to_string(units, '|') as units, rgt - lft as functions, case when ways is null then 'incomplete' when ways = 1 then 'decisive' else 'ambiguous' end as status,
         case when ways = 1 then array_to_string(path, '|') else '' end as placements from bz join gd using (w) left join ed using (w)
       union all select section, array_to_string(units, '|'), rgt - lft, 'function-limit-reached', '' from bz where rgt - lft > 40),
cf as (select section, split_part(p, ':', 1) as unit from (select section, unnest(string_split(placements, '|')) as p from jr where status = 'decisive') group by 1, 2 having count(distinct p) > 1)"""


@query(f"""with recursive {_WINDOWS}
select *, status = 'decisive' and exists (select 1 from cf where cf.section = jr.section and list_contains(string_split(jr.units, '|'), cf.unit)) as conflict from jr""")
def joint_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each window of neighbouring orders and the one division of its lines, if there is one."""
    rows = laid(spark, folder)
    source = rows["source"].select("section", "unit", "start", (F.col("unit") % 23 == 0).alias("auto"))
    following = F.lead("unit").over(Window.partitionBy("section").orderBy("pos"))
    named = F.when((F.col("tax") > 0.05) & (F.col("tax") <= 0.07), F.col("unit"))
    functions = rows["target"].select(
        "section", (F.col("pos") - 1).alias("index"), "start", "end", F.when((F.col("tax") <= 0.05) & (F.col("part") % 29 != 0), F.col("unit")).alias("owner"),
        F.array_compact(F.array(named, F.when(F.col("discount") >= 0.075, following))).alias("hints"),
    )
    ranges = rows["target_ranges"].where("not auto").drop("auto")
    return joint.contested(joint.joint_runs(source, functions, ranges))
