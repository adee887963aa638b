"""Registered queries: the operators on the driver's tables, each with its SQL.

Mapping: documents are entities of two versions (doc_id modulo 2), lineitem rows the
ordered references of orders, events the ranges [floor(value), floor(value) + 5) of
users, labels the ground truth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import prints
from .operators import anchors, evidence, fuzzy, graph, intervals, islands, resolve, score, sequence, transactions, voting
from .plans import fixpoint
from .schema import THRESHOLDS as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def version(df: DataFrame, key: str, which: int) -> DataFrame:
    return df.where(F.pmod(F.col(key), F.lit(2)) == which)


# --- anchors -----------------------------------------------------------------

_BODY = "regexp_replace(text, '[0-9]+', '0', 'g')"


def entities(spark: SparkSession, folder: str) -> list[DataFrame]:
    docs = table(spark, folder, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), prints.digest(prints.masked(docs["text"])).alias("hash"), F.col("n_chars").alias("size"))
    return [version(rows, "id", v) for v in (0, 1)]


_BODY_ANCHOR = f"""
e as (select doc_id as id, sha256({_BODY}) as hash, n_chars as size from documents),
u as (select id % 2 as v, hash, min(id) as id from e where size >= 4 group by 1, 2 having count(*) = 1),
body as (select s.id as source_id, t.id as target_id from u s join u t on s.hash = t.hash and s.v = 0 and t.v = 1)"""


@query(f"with {_BODY_ANCHOR} select source_id, target_id, 'exact-body' as method, cast(0.97 as double) as confidence from body")
def unique_body_anchor(spark: SparkSession, folder: str) -> DataFrame:
    source, target = (e.where(F.col("size") >= T.distinctive_size) for e in entities(spark, folder))
    return anchors.one_to_one(source, target, "hash", "exact-body", 0.97)


_WORDS = """
w as (select distinct doc_id as id, unnest(regexp_extract_all(text, '[^ \\n]+')) as word from documents),
ok as (select id, word from w where length(word) between 6 and 128),
u as (select id % 2 as v, word, min(id) as id from ok group by 1, 2 having count(*) = 1),
l as (select s.id as source_id, t.id as target_id from u s join u t on s.word = t.word and s.v = 0 and t.v = 1),
f as (select source_id, min(target_id) as target_id from l group by 1 having min(target_id) = max(target_id)),
b as (select min(source_id) as source_id, target_id from l group by 2 having min(source_id) = max(source_id)),
p as (select f.source_id, f.target_id from f join b using (source_id, target_id) join documents x on x.doc_id = f.source_id join documents y on y.doc_id = f.target_id
      where greatest(x.n_chars, y.n_chars) <= greatest(2 * least(x.n_chars, y.n_chars), least(x.n_chars, y.n_chars) + 8))"""


@query(f"with {_WORDS} select source_id, target_id, 'literal' as method, cast(0.9 as double) as confidence from p")
def unique_literal_anchor(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    words = docs.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0))).alias("literal"))
    words = words.distinct().where(F.length("literal").between(T.literal_least, T.literal_most))
    sizes = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return voting.plausible_only(anchors.by_literals(version(words, "id", 0), version(words, "id", 1)), sizes, sizes)


@query("""
with u as (select p_partkey % 2 as v, p_name || '/' || p_brand || '/' || p_size as name, min(p_partkey) as id from part group by 1, 2 having count(*) = 1)
select s.id as source_id, t.id as target_id, 'name' as method, cast(1.0 as double) as confidence
from u s join u t on s.name = t.name and s.v = 0 and t.v = 1""")
def name_anchor(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_brand", "p_size").alias("name"))
    return anchors.one_to_one(version(part, "id", 0), version(part, "id", 1), "name", "name", 1.0)


@query("""
with p as (select p_partkey as id, p_partkey % 2 as v, p_name as name, p_brand || '/' || p_size as sig from part),
g as (select sig, v, count(*) as n, min(id) as id from p group by 1, 2),
one as (select s.sig, s.id as source_id, t.id as target_id from g s join g t using (sig) where s.v = 0 and t.v = 1 and s.n = 1 and t.n = 1)
select source_id, target_id, 'single' as how from one
union all
select s.id, t.id, 'name' from
 (select sig, name, min(id) as id from p where v = 0 group by 1, 2 having count(*) = 1) s
 join (select sig, name, min(id) as id from p where v = 1 group by 1, 2 having count(*) = 1) t using (sig, name)
 where sig not in (select sig from one)""")
def twin_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_size").alias("sig"))
    return anchors.twins(version(rows, "id", 0), version(rows, "id", 1), ["sig"])


@query(f"""
with e as (select doc_id, sha256({_BODY}) as hash, source from documents)
select hash, count(*) filter (doc_id % 2 = 0) as source_members, count(*) filter (doc_id % 2 = 1) as target_members,
       count(distinct source) as units, string_agg(distinct source, ',' order by source) as unit_names,
       count(*) filter (doc_id % 2 = 0) = 1 and count(*) filter (doc_id % 2 = 1) = 1 as one_to_one
from e group by hash having count(*) > 1""")
def body_families(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", "source", prints.digest(prints.masked(docs["text"])).alias("hash"))
    even, odd = (F.count_if(F.pmod("doc_id", F.lit(2)) == v) for v in (0, 1))
    out = rows.groupBy("hash").agg(
        even.alias("source_members"), odd.alias("target_members"), F.count_distinct("source").alias("units"),
        F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("unit_names"), F.count(F.lit(1)).alias("n"),
    )
    out = out.where("n > 1").drop("n")
    return out.withColumn("one_to_one", F.expr("source_members = 1 and target_members = 1"))


# --- votes -------------------------------------------------------------------


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Orders call parts: ordered by line number and then the other keys."""
    rows = table(spark, folder, "lineitem")
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return rows.select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("callee"), F.col("l_suppkey").alias("ref"), F.col("l_returnflag").alias("kind"), F.row_number().over(line).alias("ord"))


#: SQL for the fingerprint of each order, and for whether those of x and y are plausible, distinct and how similar
_PRINTS = """
fp as (select l_orderkey as id, sha256(string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey, l_suppkey)) as hash,
              string_agg(l_returnflag, ',' order by l_linenumber, l_partkey, l_suppkey) as shape, count(*) as size,
              count(distinct l_partkey % 10) as calls, count(distinct l_suppkey) as data from lineitem group by 1)"""


def _ratio(c: str) -> str:
    return f"case when x.{c} = y.{c} then 1.0::double else least(x.{c}, y.{c})::double / greatest(x.{c}, y.{c}) end"


_ALIKE = f"""case when x.hash = y.hash then 1.0::double else least(1.0::double, case when x.shape = y.shape then 0.5::double else 0.0::double end
  + 0.2::double * {_ratio('size')} + 0.15::double * {_ratio('calls')} + 0.15::double * {_ratio('data')}) end"""
_PLAUSIBLE = "greatest(x.size, y.size) <= greatest(2 * least(x.size, y.size), least(x.size, y.size) + 8)"
_VOTES = f"""{_PRINTS},
u as (select a.l_orderkey as source_id, b.l_orderkey as target_id, count(*) as votes,
             round(sum(case when a.l_returnflag = b.l_returnflag then 1.0::double else 0.5::double end), 9) as weight
      from lineitem a join lineitem b on a.l_partkey = b.l_partkey and a.l_linenumber = b.l_linenumber
           and a.l_orderkey % 2 = 0 and b.l_orderkey % 2 = 1 group by 1, 2),
v as (select u.*, round({_ALIKE}, 6) as similarity, x.hash = y.hash and least(x.size, y.size) >= 4 as "distinct"
      from u join fp x on x.id = source_id join fp y on y.id = target_id where {_PLAUSIBLE}),
k as (select *, row_number() over s as sk, row_number() over t as tk, coalesce(lead(weight) over s, 0.0) as sn, coalesce(lead(weight) over t, 0.0) as tn
      from v window s as (partition by source_id order by weight desc, target_id), t as (partition by target_id order by weight desc, source_id)),
best as (select source_id, target_id, weight, votes, similarity, "distinct", round(1 - greatest(sn, tn) / weight, 6) as margin
         from k where sk = 1 and tk = 1 and sn < weight and tn < weight)"""


def order_prints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of orders: parts as the body, flags as its shape."""
    lists = calls(spark, folder).groupBy(F.col("owner").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "callee", "kind"))).alias("x"), F.count(F.lit(1)).alias("size"),
        F.count_distinct(F.col("callee") % 10).alias("calls"), F.count_distinct("ref").alias("data"),
    )
    hash_ = F.sha2(F.array_join(F.col("x.callee").cast("array<string>"), ","), 256)
    return lists.select("id", hash_.alias("hash"), F.array_join("x.kind", ",").alias("shape"), "size", "calls", "data")


def line_votes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    s = version(rows, "l_orderkey", 0).select(F.col("l_orderkey").alias("source_id"), "l_partkey", "l_linenumber", F.col("l_returnflag").alias("a"))
    t = version(rows, "l_orderkey", 1).select(F.col("l_orderkey").alias("target_id"), "l_partkey", "l_linenumber", F.col("l_returnflag").alias("b"))
    votes = s.join(t, ["l_partkey", "l_linenumber"])
    return votes.select("source_id", "target_id", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.5).alias("weight"))


def best_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Mutual best pairs; sizes alone decide which pairs may be, so fingerprints are joined to the best only."""
    sizes = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    prints_ = order_prints(spark, folder)
    even, odd = ([version(x, "id", v) for x in (sizes, prints_)] for v in (0, 1))
    best = voting.mutual_best(voting.plausible_only(voting.tally(line_votes(spark, folder)), even[0], odd[0]))
    return voting.described(best, even[1], odd[1])


@query(f"with {_VOTES} select * from best")
def reference_vote_best(spark: SparkSession, folder: str) -> DataFrame:
    return best_lines(spark, folder).select("source_id", "target_id", "weight", "votes", "similarity", "distinct", "margin")


@query(f"""with {_VOTES}, c as (select *, round(case when "distinct" then 0.98 else least(0.95, 0.45 + 0.2 * similarity + 0.2 * least(1.0, votes / 3) + 0.15 * margin) end, 6) as confidence from best)
select * from c where confidence >= 0.5""")
def accepted_votes(spark: SparkSession, folder: str) -> DataFrame:
    return voting.confident(reference_vote_best(spark, folder))


@query("""
with m as (select o_orderkey as source_id, o_orderkey + 1 as target_id, 0.9::double as confidence from orders
           where o_orderkey % 2 = 0 and o_orderkey + 1 in (select o_orderkey from orders)),
c as (select distinct case when l_suppkey % 2 = 0 then 's' else 't' end as side, 1000000 + l_suppkey as caller,
             case when l_suppkey % 2 = 0 then l_orderkey - l_orderkey % 2 else l_orderkey - l_orderkey % 2 + 1 end as callee from lineitem),
o as (select side, callee, min(caller) as caller from c
      where not (side = 's' and caller in (select source_id from m)) and not (side = 't' and caller in (select target_id from m))
      group by 1, 2 having count(*) = 1),
z as (select 1000000 + l_suppkey as id, count(*) as size from lineitem group by 1)
select s.caller as source_id, t.caller as target_id, 0.5 * confidence as weight
from m join o s on s.side = 's' and s.callee = m.source_id join o t on t.side = 't' and t.callee = m.target_id join z x on x.id = s.caller join z y on y.id = t.caller
where greatest(x.size, y.size) <= greatest(2 * least(x.size, y.size), least(x.size, y.size) + 8)""")
def sole_caller_vote(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey")
    m = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") + 1).alias("target_id"))
    m = m.join(orders.select(F.col("o_orderkey").alias("target_id")), "target_id", "left_semi").withColumn("confidence", F.lit(0.9))
    even = F.col("l_suppkey") % 2 == 0
    base = F.col("l_orderkey") - F.col("l_orderkey") % 2
    c = table(spark, folder, "lineitem").select(F.when(even, "s").otherwise("t").alias("side"), (F.col("l_suppkey") + 1000000).alias("caller"), F.when(even, base).otherwise(base + 1).alias("callee"))
    sizes = c.groupBy(F.col("caller").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    return voting.plausible_only(voting.sole_caller_votes(m, c), sizes, sizes)


@query("""
with p as (select event_id as id, user_id, event_id % 2 as v, event_type || '/' || cast(floor(value / 5) as bigint) as name,
             row_number() over (partition by user_id, event_id % 2 order by ts, event_id) as pos from events),
u as (select v, user_id, name, min(id) as id from p group by 1, 2, 3 having count(*) = 1),
m as (select s.id as source_id, t.id as target_id from u s join u t on s.v = 0 and t.v = 1 and s.user_id = t.user_id and s.name = t.name),
a as (select s.user_id, s.pos as sp, t.pos as tp from m join p s on s.id = source_id join p t on t.id = target_id),
g as (select user_id, sp, tp, lead(sp) over w as sq, lead(tp) over w as tq from a window w as (partition by user_id order by sp)),
k as (select user_id, sp, tp, unnest(range(1, sq - sp)) as d from g where sq - sp = tq - tp and sq - sp > 1)
select s.id as source_id, t.id as target_id, 0.5::double as weight
from k join p s on s.v = 0 and s.user_id = k.user_id and s.pos = sp + d join p t on t.v = 1 and t.user_id = k.user_id and t.pos = tp + d
join events x on x.event_id = s.id join events y on y.event_id = t.id
where greatest(floor(x.value), floor(y.value)) <= greatest(2 * least(floor(x.value), floor(y.value)), least(floor(x.value), floor(y.value)) + 8)""")
def equal_gap_layout_vote(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_entities(spark, folder)
    source, target = (version(rows, "id", v) for v in (0, 1))
    matches = anchors.one_to_one(source, target, "name", "name", 1.0).select("source_id", "target_id")
    votes = voting.layout_votes(matches, source.select("user_id", "id", "pos"), target.select("user_id", "id", "pos"), ["user_id"])
    return voting.plausible_only(votes, source, target)


def event_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Events as entities of two versions: named by user, type and rough value, placed by time."""
    line = Window.partitionBy("user_id", F.pmod("event_id", F.lit(2))).orderBy("ts", "event_id")
    name = F.concat_ws("/", "user_id", "event_type", F.floor(F.col("value") / 5).cast("long"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", "event_type", F.floor("value").cast("long").alias("size"), name.alias("name"), F.row_number().over(line).cast("long").alias("pos")
    )


def event_calls(rows: DataFrame) -> DataFrame:
    """An event calls the two that follow it: (owner, ord, callee)."""
    line = Window.partitionBy("user_id").orderBy("pos")
    both = rows.select(F.col("id").alias("owner"), F.array(F.lead("id", 1).over(line), F.lead("id", 2).over(line)).alias("next"))
    ahead = both.select("owner", F.posexplode("next").alias("ord", "callee"))
    return ahead.where("callee is not null")


@query()
def propagate_fixpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Events matched by name, then by votes of calls, of sole callers and of equal gaps until nothing is added."""
    rows = event_entities(spark, folder).withColumns({"second": F.pmod("id", F.lit(2)), "shape": F.col("event_type")})
    return fixpoint.propagate_within(rows, "user_id")


@query("""
with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ord from lineitem),
m as (select o_orderkey as s, o_orderkey + 1 as t, round(0.5 + o_orderkey % 40 / 100.0, 2)::double as confidence from orders where o_orderkey % 4 = 0 and o_orderkey + 1 in (select o_orderkey from orders)),
n as (select l_orderkey as k, count(*) as n from r group by 1),
e as (select s, t, confidence from m join n a on a.k = s join n b on b.k = t where a.n = b.n)
select x.l_partkey * 2 as source_id, y.l_partkey * 2 + 1 as target_id, confidence as weight
from e join r x on x.l_orderkey = s join r y on y.l_orderkey = t and y.ord = x.ord""")
def call_site_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Votes for callees by place where no callee is matched yet; fixed points are tested by brute force."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    m = orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") + 1).alias("target_id"))
    m = m.join(orders.select(F.col("o_orderkey").alias("target_id")), "target_id", "left_semi")
    m = m.withColumn("confidence", F.round(0.5 + F.col("source_id") % 40 / 100, 2))
    rows = calls(spark, folder)
    source = rows.select((F.col("owner")).alias("owner"), "ord", (F.col("callee") * 2).alias("callee"))
    target = rows.select("owner", "ord", (F.col("callee") * 2 + 1).alias("callee"))
    # callees are parts, pairs are orders: their numbers are kept apart, so that no callee is matched
    apart = 1 << 40
    far = lambda df, *cs: df.select(*(F.col(c) + apart if c in cs else F.col(c) for c in df.columns)).toDF(*df.columns)
    return voting.call_site_votes(far(m, "source_id", "target_id"), far(source, "owner"), far(target, "owner"))


@query("""
with r as (select l_orderkey as owner, l_suppkey as ref, l_returnflag as kind,
                  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ord from lineitem),
o as (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k, o_custkey from orders),
p as (select a.o_orderkey as s, b.o_orderkey as t from o a join o b on a.o_custkey = b.o_custkey and b.k = a.k + 1),
l as (select s, t, r.* from p join r on r.owner = s), m as (select s, t, r.* from p join r on r.owner = t),
z as (select coalesce(l.s, m.s) as s, coalesce(l.t, m.t) as t, l.ref as a, m.ref as b, coalesce(l.kind = m.kind, false) as ok
      from l full join m on l.s = m.s and l.t = m.t and l.ord = m.ord),
g as (select s, t from z group by 1, 2 having bool_and(ok)),
d as (select distinct a, b from z join g using (s, t))
select a as source_ref, b as target_ref from d
where a in (select a from d group by a having count(*) = 1) and b in (select b from d group by b having count(*) = 1)""")
def positional_data_pairs(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = orders.select(F.col("o_orderkey").alias("source_id"), F.lead("o_orderkey").over(line).alias("target_id")).where("target_id is not null")
    refs = calls(spark, folder)
    return voting.positional_pairs(pairs, refs, refs)


# --- similarity ----------------------------------------------------------------

_SIZES = r"""
e as (select doc_id, lang, n_chars as size, length(text) - length(replace(text, ' ', '')) as calls, length(text) - length(replace(text, chr(10), '')) as data,
             sha256(text) as hash, sha256(regexp_replace(text, '[^ \n]+', 'w', 'g')) as shape from documents where n_chars > 0),
r as (select x.doc_id as a_id, y.doc_id as b_id, x.shape = y.shape as same_shape, {alike} as s
  from e x join e y on x.lang = y.lang and x.doc_id <> y.doc_id and x.doc_id % 50 = 0 where {plausible})""".format(alike=_ALIKE, plausible=_PLAUSIBLE)


@query(f"with {_SIZES} select a_id, b_id, same_shape, round(s, 6) as similarity from r")
def plausible_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Each 50th document against all of its language whose sizes may belong together.

    Shape is the layout of the whole text: every word reduced to one letter.  Sizes that are
    plausible differ by at most one in the binary logarithm of size + 8, which is joined on."""
    count = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c)))
    docs = table(spark, folder, "documents").where("n_chars > 0").select(
        "doc_id", "lang", F.col("n_chars").alias("size"), count(" ").alias("calls"), count("\n").alias("data"), F.sha2("text", 256).alias("hash"),
        F.sha2(F.regexp_replace("text", "[^ \n]+", "w"), 256).alias("shape"), F.floor(F.log2(F.col("n_chars") + 8)).alias("bin"),
    )
    a = docs.where("doc_id % 50 = 0").withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    b = docs.select("lang", "bin", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "size", "calls", "data", "hash", "shape")))
    pairs = a.join(b, ["lang", "bin"]).where("doc_id <> doc_id_b").where(prints.plausible(F.col("size"), F.col("size_b")))
    same = lambda c: (F.col(c), F.col(f"{c}_b"))
    alike = F.col("shape") == F.col("shape_b")
    s = prints.similarity(F.col("hash") == F.col("hash_b"), alike, same("size"), same("calls"), same("data"))
    return pairs.select(F.col("doc_id").alias("a_id"), F.col("doc_id_b").alias("b_id"), alike.alias("same_shape"), F.round(s, 6).alias("similarity"))


_SHINGLES = """
t as (select doc_id % 2 as k, doc_id as id, regexp_extract_all(text, '[^ \\n]+') as w from documents),
s as (select distinct k, id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) as shingle, len(w) as l from t where len(w) >= 8),
n as (select k, id, count(*) as n, max(l) as l from s group by 1, 2),
c as (select a.id as a_id, b.id as b_id, count(*) as common from s a join s b on a.k = 0 and b.k = 1 and a.shingle = b.shingle group by 1, 2),
j as (select a_id, b_id, common, x.n as a_n, y.n as b_n, x.l as a_length, y.l as b_length, round(common / (x.n + y.n - common), 6) as similarity
      from c join n x on x.k = 0 and x.id = a_id join n y on y.k = 1 and y.id = b_id where x.l / y.l between 0.6 and 1.6)"""


def shingle_rows(df: DataFrame, key: str) -> DataFrame:
    """(id, shingle, length): 64-bit hashes of the shingles, and the length of the token list."""
    words = F.regexp_extract_all("text", F.lit("[^ \\n]+"), F.lit(0))
    lists = df.select(F.col(key).alias("id"), words.alias("words"))
    grams = F.transform(prints.shingles(F.col("words")), lambda x: F.xxhash64(x))
    return lists.select("id", F.explode(grams).alias("shingle"), F.size("words").alias("length"))


def shingle_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """Shingles of both versions, and a number of blocks that gives each about 2,000 documents of a version."""
    docs = table(spark, folder, "documents")
    rows = shingle_rows(docs, "doc_id")
    return version(rows, "id", 0), version(rows, "id", 1), 1 + docs.count() // 4000


@query(f"with {_SHINGLES} select * from j")
def shingle_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy.scored(fuzzy.shared_shingles(*shingle_sides(spark, folder)))


@query(f"""with {_SHINGLES},
r as (select a_id, b_id, similarity, row_number() over w as k, coalesce(lead(similarity) over w, 0.0) as runner_up,
             count(*) over (partition by b_id) as field from j window w as (partition by b_id order by similarity desc, a_id)),
b as (select a_id, b_id, similarity, runner_up, field, round(similarity - runner_up, 6) as margin from r where k = 1)
select * from b where similarity >= 0.6 and margin >= 0.1
  and a_id in (select a_id from b where similarity >= 0.6 and margin >= 0.1 group by 1 having count(*) = 1)""")
def shingle_margin(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy.leading(graph.stored(fuzzy.best_sources(*shingle_sides(spark, folder))))


_COSINE = """
v as (select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as len from embeddings),
p as (select a.vec_id as a_id, b.vec_id as b_id,
        round(100 * list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)) / (a.len * b.len), 4) as percent
      from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and a.vec_id % 50 = 0),
r as (select a_id, b_id, percent, row_number() over w as k, coalesce(lead(percent) over w, 0.0) as runner_up,
             count(*) over (partition by a_id) as field, sum(case when percent >= 99 then 1 else 0 end) over (partition by a_id) as exact
      from p window w as (partition by a_id order by percent desc, b_id))"""


@query(f"""with {_COSINE}
select a_id, b_id, percent, runner_up, field, exact, round(percent - runner_up, 6) as margin,
  case when percent >= 99 and exact = 1 then 'sole-exact' when percent >= 80 and round(percent - runner_up, 6) >= 30 then 'confident'
       when percent >= 70 and round(percent - runner_up, 6) >= 15 then 'probable' else 'undecided' end as verdict from r where k = 1""")
def ranked_margin_decision(spark: SparkSession, folder: str) -> DataFrame:
    """The best partner of each 50th vector among those of its label, and whether it is decided."""
    rows = table(spark, folder, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    n = rows.count()
    return fuzzy.decided(fuzzy.best_partners(rows.where("id % 50 = 0"), rows, 1 + n // 200_000, 1 + n // 20_000))


@query("""
select a.s_suppkey as a_id, b.s_suppkey as b_id, a.s_acctbal as a_size, b.s_acctbal as b_size, a.s_nationkey as "group"
from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey % 2 = 0 and b.s_suppkey % 2 = 1 and a.s_acctbal > 0 and b.s_acctbal > 0
 and greatest(a.s_acctbal, b.s_acctbal) <= 2.5 * least(a.s_acctbal, b.s_acctbal)""")
def size_compatible_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("size"))
    return fuzzy.size_compatible(version(rows, "id", 0), version(rows, "id", 1))


# --- intervals -----------------------------------------------------------------

_R = """
r as (select user_id, event_type as unit, ts, event_id, cast(floor(value) as bigint) as s, cast(floor(value) as bigint) + 5 as e from events)"""
#: SQL for the merged ranges of a relation (k, s, e)
_MERGE = """(select k, min(s) as s, max(e) as e from (
  select *, sum(o) over (partition by k order by s, e rows unbounded preceding) as g from (
    select *, case when s <= max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as o
    from {0})) group by k, g)"""


def ranges(spark: SparkSession, folder: str) -> DataFrame:
    low = F.floor("value").cast("long")
    return table(spark, folder, "events").select(
        "user_id", F.col("event_type").alias("unit"), "ts", "event_id", low.alias("start"), (low + 5).alias("end")
    )


_A = "(select user_id as k, s, e from r where unit in ('click', 'view'))"
_B = "(select user_id as k, s, e from r where unit not in ('click', 'view'))"


def two_sets(spark: SparkSession, folder: str) -> list[DataFrame]:
    rows = ranges(spark, folder)
    first = F.col("unit").isin("click", "view")
    return [rows.where(c).select("user_id", "start", "end") for c in (first, ~first)]


@query(f"""with {_R} select k as user_id, s as start, e as "end" from {_MERGE.format('(select user_id as k, s, e from r)')}""")
def interval_merge(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.merged(ranges(spark, folder), ["user_id"])


@query(f"""with {_R}, a as (select * from {_MERGE.format(_A)}), b as (select * from {_MERGE.format(_B)}),
x as (select a.k, greatest(a.s, b.s) as s, least(a.e, b.e) as e from a join b on a.k = b.k and a.s < b.e and b.s < a.e)
select k as user_id, s as start, e as "end" from {_MERGE.format('x')}""")
def interval_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.intersect(*two_sets(spark, folder), ["user_id"])


_DIFFERENCE = f"""a as (select * from {_MERGE.format(_A)}), b as (select * from {_MERGE.format(_B)}),
c as (select k, s as p from a union select k, e from a union select k, s from b union select k, e from b),
seg as (select k, p as s, lead(p) over (partition by k order by p) as e from c),
d as (select * from seg where e is not null and exists (select 1 from a where a.k = seg.k and a.s <= seg.s and seg.e <= a.e)
      and not exists (select 1 from b where b.k = seg.k and b.s <= seg.s and seg.e <= b.e))"""


@query(f"""with {_R}, {_DIFFERENCE} select k as user_id, s as start, e as "end" from {_MERGE.format('d')}""")
def interval_difference(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.difference(*two_sets(spark, folder), ["user_id"])


@query(f"""with {_R}, a as (select * from {_MERGE.format(_A)}), b as (select * from {_MERGE.format(_B)}),
k as (select k from a union select k from b)
select k as user_id, not exists (select 1 from (select s, e from a where a.k = k.k except select s, e from b where b.k = k.k))
  and not exists (select 1 from (select s, e from b where b.k = k.k except select s, e from a where a.k = k.k)) as same from k""")
def interval_same_ground(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.same_ground(*two_sets(spark, folder), ["user_id"])


@query(f"""with {_R}, p as (select user_id, event_id, s + 2 as pos from r),
h as (select p.user_id, p.event_id, p.pos, min(unit) as lo, max(unit) as hi from p join r on r.user_id = p.user_id and r.s <= p.pos and p.pos < r.e group by 1, 2, 3)
select user_id, event_id as id, pos as "at", case when lo = hi then lo end as owner from h""")
def owner_at_point(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranges(spark, folder)
    points = rows.select("user_id", F.col("event_id").alias("id"), (F.col("start") + 2).alias("at"))
    return intervals.owners_at(points, rows, ["user_id"])


_HALVES = """
h as (select user_id, unit, s, e, extract(day from ts) <= 15 as early from r),
o as (select *, max(e) over (partition by user_id, early order by s, e, unit rows between unbounded preceding and 1 preceding) as pe,
             min(s) over (partition by user_id, early order by s, e, unit rows between 1 following and unbounded following) as ns from h),
c as (select user_id, unit, s, e, early from o where coalesce(pe <= s, true) and coalesce(ns >= e, true)),
cut as (select user_id, s as p from c union select user_id, e from c),
seg as (select user_id, p as s, lead(p) over (partition by user_id order by p) as e from cut)"""


def halves(spark: SparkSession, folder: str) -> list[DataFrame]:
    rows = ranges(spark, folder).withColumn("early", F.dayofmonth("ts") <= 15)
    clear = intervals.disjoint_only(rows, ["user_id", "early"])
    return [clear.where(c).select("user_id", "unit", "start", "end") for c in ("early", "not early")]


@query(f"""with {_R}, {_HALVES},
t as (select seg.user_id, seg.s, seg.e, b.unit as f, a.unit as t from seg
      left join c b on b.user_id = seg.user_id and b.early and b.s <= seg.s and seg.e <= b.e
      left join c a on a.user_id = seg.user_id and not a.early and a.s <= seg.s and seg.e <= a.e
      where seg.e is not null and a.unit is distinct from b.unit),
m as (select *, case when s = lag(e) over w then 0 else 1 end as o from t window w as (partition by user_id, f, t order by s)),
g as (select *, sum(o) over (partition by user_id, f, t order by s rows unbounded preceding) as g from m)
select user_id, min(s) as start, max(e) as "end", f as from_unit, t as to_unit from g group by user_id, f, t, g""")
def ownership_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.transfers(*halves(spark, folder), ["user_id"])


@query(f"""with {_R}, m as (select * from r where unit = 'purchase')
select distinct r.user_id, r.unit, r.s as start, r.e as "end" from r join m on m.user_id = r.user_id and r.unit <> 'purchase' and r.s <= m.e and m.s <= r.e""")
def neighbour_read_set(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranges(spark, folder).select("user_id", "unit", "start", "end")
    return intervals.neighbours(rows.where("unit = 'purchase'"), rows, ["user_id"])


@query(f"""with {_R}, q as (select user_id as k, case unit when 'click' then '.text' when 'view' then '.init' when 'purchase' then '.data' else '.bss' end as section, s, e from r),
d as (select k, section, s, e, row_number() over (partition by k, section order by e - s desc, s desc) as n from
  (select k, section, min(s) as s, max(e) as e from (
    select *, sum(o) over (partition by k, section order by s, e rows unbounded preceding) as g from (
      select *, case when s <= max(e) over (partition by k, section order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as o from q))
   group by k, section, g) where s % 4 <> 3)
select k as user_id, section, s as start, e as "end" from d where n = 1 or section not in ('.text', '.init')""")
def dominant_range(spark: SparkSession, folder: str) -> DataFrame:
    section = F.when(F.col("unit") == "click", ".text").when(F.col("unit") == "view", ".init").when(F.col("unit") == "purchase", ".data").otherwise(".bss")
    merged = intervals.merged(ranges(spark, folder).withColumn("section", section), ["user_id", "section"])
    rows = merged.withColumns({"misaligned": F.col("start") % 4 == 3, "ord": F.col("start")})
    return islands.dominant(rows, ["user_id"]).select("user_id", "section", "start", "end")


@query(f"""with {_R}, g as (select *, s - lag(e) over (partition by user_id order by s, e) as gap from r)
select user_id, bool_and(coalesce(gap between 0 and 31, true)) as tiled, min(s) as start, max(e) as "end" from g group by 1""")
def range_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return islands.tiling(ranges(spark, folder), ["user_id"])


# --- runs ------------------------------------------------------------------------

_RUNS = """
n as (select user_id, event_id, ts, event_type as unit, cast(floor(value) as bigint) as size,
             case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as o
      from events window w as (partition by user_id order by ts, event_id)),
q as (select *, sum(o) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from n)"""


def ordered_events(spark: SparkSession, folder: str, unknown: str | None = None) -> DataFrame:
    rows = table(spark, folder, "events")
    unit = F.col("event_type") if unknown is None else F.nullif(F.col("event_type"), F.lit(unknown))
    return rows.select("user_id", "event_id", "ts", F.col("event_id").alias("at"), unit.alias("unit"), F.floor("value").cast("long").alias("size"))


_KEYS, _ORDER = ["user_id"], ["ts", "event_id"]


@query(f"""with {_RUNS} select user_id, run, unit, count(*) as members, min(event_id) as start, max(event_id) as "end" from q group by 1, 2, 3""")
def unit_runs(spark: SparkSession, folder: str) -> DataFrame:
    return islands.unit_runs(ordered_events(spark, folder), _KEYS, _ORDER)


_OPEN_RUNS = _RUNS.replace("event_type as unit", "nullif(event_type, 'view') as unit").replace(
    "event_type is distinct from lag(event_type)", "nullif(event_type, 'view') is distinct from lag(nullif(event_type, 'view'))"
)


@query(f"""with {_OPEN_RUNS},
w as (select *, size * 10 as bytes, case when unit is null and event_id % 4 = 0 then 'click' when unit is null and event_id % 11 = 0 then 'purchase' end as candidate, event_id % 13 = 0 as claimed from q),
x as (select *, count(candidate) over (partition by user_id, run order by ts, event_id rows unbounded preceding) as part from w),
y as (select user_id, run, unit, part, count(*) as members, sum(bytes) as bytes, sum(case when candidate is null then bytes else 0 end) as blind, min(candidate) as candidate,
             bool_or(candidate is null and claimed) as claimed, min(event_id) as s, max(event_id) as e from x group by 1, 2, 3, 4),
a as (select user_id, run, unit, sum(members) as members, sum(bytes) as bytes, max(blind) as blind, min(candidate) as lo, max(candidate) as hi, bool_or(claimed) as claimed, min(s) as s, max(e) as e from y group by 1, 2, 3),
b as (select *, lag(unit) over w as lu, unit is null and coalesce(lag(unit) over w = lead(unit) over w, false) and (lo is null or (lo = lag(unit) over w and hi = lag(unit) over w))
             and not claimed and blind <= 512 as br from a window w as (partition by user_id order by run)),
c as (select *, case when br then lu else unit end as owner, case when br then bytes else 0 end as bb from b),
d as (select *, case when owner is distinct from lag(owner) over w or row_number() over w = 1 then 1 else 0 end as o from c window w as (partition by user_id order by run)),
f as (select *, sum(o) over (partition by user_id order by run rows unbounded preceding) as r2 from d)
select user_id, r2 as run, owner as unit, sum(members) as members, sum(bb) as bridged, min(s) as start, max(e) as "end" from f where owner is not null group by 1, 2, 3""")
def bridged_runs(spark: SparkSession, folder: str) -> DataFrame:
    none = F.col("unit").isNull()
    candidate = F.when(none & (F.col("event_id") % 4 == 0), "click").when(none & (F.col("event_id") % 11 == 0), "purchase")
    rows = ordered_events(spark, folder, "view").withColumns({"size": F.col("size") * 10, "candidate": candidate, "claimed": F.col("event_id") % 13 == 0})
    return islands.bridged_runs(rows, _KEYS, _ORDER)


@query(f"""with {_RUNS}, a as (select user_id, run, unit, count(*) as members, min(event_id) as s, max(event_id) as e from q group by 1, 2, 3)
select user_id, run, unit, members, s as start, e as "end", lag(unit) over w as left_unit, lead(unit) over w as right_unit, count(*) over (partition by user_id, unit) as fragments,
 case when count(*) over (partition by user_id, unit) > 1 then 'candidate' when members >= 2 then 'confident' else 'probable' end as tier
from a window w as (partition by user_id order by run)""")
def run_edges(spark: SparkSession, folder: str) -> DataFrame:
    return islands.edges(unit_runs(spark, folder), _KEYS)


@query(f"""with {_OPEN_RUNS}, a as (select user_id, run, unit, count(*) as members, min(event_id) as s, max(event_id) as e from q group by 1, 2, 3),
b as (select *, lag(unit) over w as lu, lead(unit) over w as ru from a window w as (partition by user_id order by run))
select user_id, members, s as start, e as "end", lu as left_unit, ru as right_unit from b where unit is null and members >= 2 and lu <> ru""")
def orphan_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return islands.orphan_clusters(ordered_events(spark, folder, "view"), _KEYS, _ORDER)


@query("""
with e as (select user_id, event_id, event_type as unit, cast(floor(value / 50) as bigint) as size, ts from events),
n as (select *, lag(unit) over w as lu, lead(unit) over w as ru, lag(size) over w as ls, lead(size) over w as rs from e window w as (partition by user_id order by ts, event_id))
select user_id, event_id, unit, size, lu as left_unit, ru as right_unit from n where lu = ru and unit <> lu and (size = ls or size = rs)""")
def competing_slot_veto(spark: SparkSession, folder: str) -> DataFrame:
    size = F.floor(F.col("value") / 50).cast("long")
    rows = table(spark, folder, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("unit"), size.alias("size"))
    return islands.competing_slots(rows, _KEYS, _ORDER).select("user_id", "event_id", "unit", "size", "left_unit", "right_unit")


@query(f"""with {_RUNS}, k as (select user_id, unit as before, lead(unit) over (partition by user_id order by ts, event_id) as after from q)
select before, after, count(*) as times from k where before <> after group by 1, 2""")
def adjacency_edges(spark: SparkSession, folder: str) -> DataFrame:
    return islands.adjacency(ordered_events(spark, folder), _KEYS, _ORDER)


@query(f"""with {_RUNS} select s.scenario, user_id, event_id, run,
 case s.scenario when 'nothing' then false when 'everything' then true when 'isolated' then run % 2 = 0 else run % 5 in (2, 3, 4) end as hidden
from q cross join (values ('nothing'), ('everything'), ('isolated'), ('consecutive')) s(scenario)""")
def mask_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = islands.number_runs(ordered_events(spark, folder), _KEYS, _ORDER)
    return islands.all_masks(rows).select("scenario", "user_id", "event_id", "run", "hidden")


# --- graphs and transactions --------------------------------------------------------


@query("""
with recursive n as (select distinct event_type as before, lead(event_type) over (partition by user_id order by ts, event_id) as after from events),
e as (select before as a, after as b from n where before <> after),
p as (select a, b from e union select p.a, e.b from p join e on p.b = e.a)
select x.a as unit, least(x.a, min(x.b)) as component from p x join p y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a""")
def order_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Event types on cycles of the order in which users' events follow each other."""
    rows = ordered_events(spark, folder)
    return graph.cyclic(islands.adjacency(rows, _KEYS, _ORDER))


@query("""
with recursive f as (select s_suppkey as id, s_nationkey as section, cast(floor(s_acctbal) as bigint) as s, cast(floor(s_acctbal) as bigint) + 60 as e, s_suppkey % 37 as unit from supplier),
l as (select a.id as a, b.id as b from f a join f b on a.id <> b.id and (a.unit = b.unit and a.section = b.section or a.section = b.section and a.s <= b.e and b.s <= a.e)),
r as (select id, id as root from f union select l.b, r.root from r join l on l.a = r.id)
select id as node, min(root) as component from r group by 1""")
def footprint_components(spark: SparkSession, folder: str) -> DataFrame:
    low = F.floor("s_acctbal").cast("long")
    unit = F.concat_ws("/", F.col("s_nationkey"), F.col("s_suppkey") % 37)
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("section"), low.alias("start"), (low + 60).alias("end"), unit.alias("unit"))
    return graph.components(graph.footprint_links(rows, ["section"]), rows.select(F.col("id").alias("node")).distinct())


def changes(spark: SparkSession, folder: str) -> list[DataFrame]:
    """A world of suppliers' ranges, and transactions that move each nation's first supplier; of seven,
    one expects another world, one leaves an empty range and one gives overlapping ranges."""
    low = F.floor(F.col("s_acctbal") + 1000).cast("long")
    world = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("unit"), F.col("s_nationkey").alias("section"), low.alias("start"), (low + 20).alias("end"))
    first = world.withColumn("k", F.row_number().over(Window.partitionBy("section").orderBy("start", "unit"))).where("k = 1").drop("k")
    before = first.select(F.col("section").alias("txn"), "unit", F.lit("before").alias("phase"), "section", "start", "end")
    stale = F.when(F.col("txn") % 7 == 0, F.col("start") + 1).otherwise(F.col("start"))
    moved = F.when(F.col("txn") % 7 == 1, F.col("start") + 5).otherwise(F.col("end") + 5)
    after = before.withColumn("phase", F.lit("after")).withColumn("end", moved).withColumn("start", F.col("start") + 5)
    twice = after.where("txn % 7 = 2").withColumns({"start": F.col("start") + 1, "end": F.col("end") + 1})
    return [world, before.withColumn("start", stale).unionByName(after).unionByName(twice)]


@query("""
with w as (select s_suppkey, s_nationkey as section, cast(floor(s_acctbal + 1000) as bigint) as s from supplier),
f as (select distinct section from w)
select section as txn, case section % 7 when 0 then 'world differs' when 1 then 'empty range' else 'overlap' end as reason from f where section % 7 < 3""")
def transaction_refusals(spark: SparkSession, folder: str) -> DataFrame:
    return transactions.refused(*changes(spark, folder))


@query("""
select cast(s_suppkey as varchar) as unit, s_nationkey as section, cast(floor(s_acctbal + 1000) as bigint) as start, cast(floor(s_acctbal + 1000) as bigint) + 20 as "end" from supplier""")
def transaction_apply_undo(spark: SparkSession, folder: str) -> DataFrame:
    """Good transactions applied and undone: the world as it was."""
    world, moves = changes(spark, folder)
    good = moves.join(transactions.refused(world, moves).select("txn"), "txn", "left_anti")
    return transactions.undone(transactions.applied(world, good), good)


@query("""
with w as (select s_suppkey, s_nationkey as section, cast(floor(s_acctbal + 1000) as bigint) as s, row_number() over (partition by s_nationkey order by cast(floor(s_acctbal + 1000) as bigint), cast(s_suppkey as varchar)) as k from supplier)
select cast(s_suppkey as varchar) as unit, section, s + case when k = 1 and section % 7 > 2 then 5 else 0 end as start, s + 20 + case when k = 1 and section % 7 > 2 then 5 else 0 end as "end" from w""")
def transaction_apply(spark: SparkSession, folder: str) -> DataFrame:
    world, moves = changes(spark, folder)
    good = moves.join(transactions.refused(world, moves).select("txn"), "txn", "left_anti")
    return transactions.applied(world, good)


# --- resolution, renames, audits ---------------------------------------------------------


@query("""
with q as (select *, p_name || ' ' || (p_partkey // 2) as old from part),
p as (select old, p_brand || '/' || (p_partkey // 3 % 40) as new, cast(p_size as varchar) as unit, case when p_partkey % 3 = 0 then 1 else 2 end as strength from q),
ex as (select old as name, min(p_partkey) as place from q where p_partkey % 5 <> 0 group by 1
       union all select p_brand || '/' || (p_partkey // 3 % 40), min(p_partkey) from part where p_brand in ('Brand#11', 'Brand#12') group by 1),
de as (select p_brand || '/' || (p_partkey // 3 % 40) as name, cast(p_size as varchar) as unit from part where p_partkey % 4 = 0),
ow as (select p_partkey as place, cast(p_size as varchar) as unit from part where p_partkey % 3 <> 1),
t as (select *, max(strength) over (partition by old) as top from p),
o as (select old, min(new) as new, max(new) as hi from t where strength = top group by 1),
j as (select o.*, a.place, b.place as other, ow.unit as here from o left join ex a on a.name = old left join ex b on b.name = new left join ow on ow.place = a.place),
f as (select *, case when new <> hi then 'units disagree' when place is null then 'not in symbols file' when other <> place then 'name already taken'
   when here is not null and new in (select name from de) and not exists (select 1 from de where de.name = j.new and de.unit = j.here) then 'name defined by another unit''s source' end as first from j)
select old, case when new = hi then new end as new,
  coalesce(first, case when sum(case when first is null then 1 else 0 end) over (partition by new) > 1 then 'name claimed by several symbols' else 'resolved' end) as status from f""")
def proposal_resolution(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    unit, place = F.col("p_size").cast("string"), F.col("p_partkey").alias("place")
    old = F.concat_ws(" ", "p_name", F.floor(F.col("p_partkey") / 2))
    new = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 3) % 40)
    proposals = part.select(old.alias("old"), new.alias("new"), unit.alias("unit"), F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(2).alias("strength"))
    brands = part.where(F.col("p_brand").isin("Brand#11", "Brand#12")).select(new.alias("name"), place)
    existing = part.where("p_partkey % 5 <> 0").select(old.alias("name"), place).unionByName(brands)
    defined = part.where("p_partkey % 4 = 0").select(new.alias("name"), unit.alias("unit"))
    owners = part.where("p_partkey % 3 <> 1").select(place, unit.alias("unit"))
    return resolve.resolved(proposals, existing, defined, owners)


@query("""
with o as (select s_nationkey * 100 + s_suppkey % 100 as place, case when s_suppkey % 4 = 1 then s_name || '_80000000' else s_name end as name from supplier),
n as (select place, case when place % 3 = 1 then name when place % 5 = 0 then 'renamed ' || (place % 40) else 'new ' || place || name end as name from o),
a as (select place, min(name) as old from o group by 1 having count(*) = 1), b as (select place, min(name) as new from n group by 1 having count(*) = 1),
r as (select old, new from a join b using (place) where old <> new),
g as (select case when place % 7 = 2 then 'new ' || place || name when place % 7 = 3 then 'gone ' || name else name end as name from o union all select name from o where place % 11 = 0),
h as (select name, count(*) as c from g group by 1)
select r.old, r.new, case when regexp_matches(r.old, '._[0-9A-F]{8}$') then 'address-derived' when count(*) over (partition by r.new) > 1 then 'duplicate new name'
  when x.c is null and y.c is not null then 'already applied' when x.c is null then 'not in target' when x.c > 1 then 'ambiguous in target' else 'apply' end as status
from r left join h x on x.name = r.old left join h y on y.name = r.new""")
def rename_sync(spark: SparkSession, folder: str) -> DataFrame:
    name = F.when(F.col("s_suppkey") % 4 == 1, F.concat("s_name", F.lit("_80000000"))).otherwise(F.col("s_name"))
    old = table(spark, folder, "supplier").select((F.col("s_nationkey") * 100 + F.col("s_suppkey") % 100).alias("place"), name.alias("name"))
    place, fresh = F.col("place"), F.concat(F.lit("new "), "place", "name")
    new = F.when(place % 3 == 1, F.col("name")).when(place % 5 == 0, F.concat(F.lit("renamed "), place % 40)).otherwise(fresh)
    found = resolve.renames_between(old, old.select("place", new.alias("name")))
    held = F.when(place % 7 == 2, fresh).when(place % 7 == 3, F.concat(F.lit("gone "), "name")).otherwise(F.col("name"))
    target = old.select(held.alias("name")).unionByName(old.where("place % 11 = 0").select("name"))
    return resolve.rename_plan(found.select("old", "new"), target)


@query("""
with s as (select c_nationkey * 10 + c_custkey // 2 % 10 as unit, sum(c_acctbal) as source_bytes from customer where c_custkey % 2 = 0 group by 1),
t as (select c_nationkey * 10 + c_custkey // 2 % 10 as unit, sum(c_acctbal) as target_bytes from customer where c_custkey % 2 = 1 group by 1)
select unit, round(source_bytes, 2) as source_bytes, round(target_bytes, 2) as target_bytes from s join t using (unit) where target_bytes < 0.5 * source_bytes""")
def stunted_units(spark: SparkSession, folder: str) -> DataFrame:
    unit = F.col("c_nationkey") * 10 + F.floor(F.col("c_custkey") / 2) % 10
    rows = table(spark, folder, "customer").select("c_custkey", unit.alias("unit"), F.col("c_acctbal").alias("bytes"))
    out = resolve.stunted(version(rows, "c_custkey", 0), version(rows, "c_custkey", 1))
    return out.select("unit", F.round("source_bytes", 2).alias("source_bytes"), F.round("target_bytes", 2).alias("target_bytes"))


@query("""
with s as (select c_nationkey * 100 + c_custkey // 2 % 20 as unit, min(c_mktsegment) as source_module from customer where c_custkey % 2 = 0 group by 1),
t as (select c_nationkey * 100 + c_custkey // 2 % 20 as unit, min(c_mktsegment) as target_module from customer where c_custkey % 2 = 1 group by 1)
select * from s join t using (unit) where source_module <> target_module""")
def relocated_units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", (F.col("c_nationkey") * 100 + F.floor(F.col("c_custkey") / 2) % 20).alias("unit"), F.col("c_mktsegment").alias("module"))
    return resolve.relocated(version(rows, "c_custkey", 0), version(rows, "c_custkey", 1))


# --- scores -----------------------------------------------------------------------------------

_LEDGER = f"""
cutall as (select user_id, s as p from r union select user_id, e from r),
sg as (select user_id, p as s, lead(p) over (partition by user_id order by p) as e from cutall),
z as (select sg.*, exists (select 1 from r where r.user_id = sg.user_id and unit in ('click', 'view') and r.s <= sg.s and sg.e <= r.e) as t,
  exists (select 1 from r where r.user_id = sg.user_id and unit in ('click', 'purchase') and extract(day from ts) <= 15 and r.s <= sg.s and sg.e <= r.e) as b,
  exists (select 1 from r where r.user_id = sg.user_id and unit in ('click', 'purchase') and extract(day from ts) > 10 and r.s <= sg.s and sg.e <= r.e) as a,
  exists (select 1 from r where r.user_id = sg.user_id and unit not in ('click', 'view') and r.s <= sg.s and sg.e <= r.e) as f,
  exists (select 1 from r where r.user_id = sg.user_id and unit <> 'signup' and r.s <= sg.s and sg.e <= r.e) as c from sg where sg.e is not null),
m as (select user_id, sum(case when t and b then e - s else 0 end) as retained, sum(case when t and a then e - s else 0 end) as attributed,
  sum(case when t and a and not b then e - s else 0 end) as gained, sum(case when t and b and not a then e - s else 0 end) as lost,
  sum(case when t and not a then e - s else 0 end) as missed, sum(case when f and b then e - s else 0 end) as wrong_before,
  sum(case when f and a then e - s else 0 end) as wrong_after, sum(case when f and a and not b then e - s else 0 end) as newly_wrong,
  sum(case when a and not c then e - s else 0 end) as unknown, sum(case when a <> b then e - s else 0 end) as changed,
  sum(case when a <> t then e - s else 0 end) as inexact, sum(case when b <> t then e - s else 0 end) as inexact_before from z group by 1)"""
_OUTCOME = """case when changed = 0 then 'abstained' when newly_wrong > 0 then 'incorrect' when inexact = 0 then 'exact' when attributed > 0 then 'partial' else 'unowned' end"""


@query(f"with {_R}, {_LEDGER} select *, {_OUTCOME} as outcome from m")
def ownership_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return ledger_of(ranges(spark, folder))


def ledger_of(rows: DataFrame, before: bool = True) -> DataFrame:
    """Each user's ledger, with claims of the first and of the last days of the month as before and after."""
    day, unit = F.dayofmonth("ts"), F.col("unit")
    held = unit.isin("click", "purchase")
    truth, foreign = rows.where(unit.isin("click", "view")), rows.where(~unit.isin("click", "view"))
    book = score.ledger(truth, rows.where(held & (day <= 15) & F.lit(before)), rows.where(held & (day > 10)), foreign, rows.where("unit <> 'signup'"), ["user_id"])
    return book.withColumn("outcome", score.outcome())


@query(f"""with {_R}, {_LEDGER}
select {_OUTCOME} as outcome, substr(sha256(cast(user_id as varchar)), 1, 1) < '8' as held_out, count(*) as users, sum(attributed) as attributed, sum(newly_wrong) as newly_wrong from m group by 1, 2""")
def outcome_populations(spark: SparkSession, folder: str) -> DataFrame:
    rows = ownership_ledger(spark, folder).withColumn("held_out", score.held_out(F.col("user_id").cast("string")))
    return rows.groupBy("outcome", "held_out").agg(F.count(F.lit(1)).alias("users"), F.sum("attributed").alias("attributed"), F.sum("newly_wrong").alias("newly_wrong"))


@query("""
select substr(sha256(cast(doc_id as varchar)), 1, 1) < '8' as held_out, count(*) as total, sum(quality) as good, sum(toxic) as toxic from labels group by 1""")
def heldout_partition_measures(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").withColumn("held_out", score.held_out(F.col("doc_id").cast("string")))
    return rows.groupBy("held_out").agg(F.count(F.lit(1)).alias("total"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


@query("""
with x as (select d.source as tier, l.doc_id is not null as checked, coalesce(l.quality = 1, false) as correct, l.doc_id is null and d.n_chars > 2000 as missed
  from documents d left join labels l using (doc_id)),
a as (select tier, count(*) as total, sum(checked::int) as checked, sum(correct::int) as correct, sum(missed::int) as missed from x group by 1)
select *, round(case when checked > 0 then correct / checked else 0.0 end, 6) as precision, round(case when checked + missed > 0 then correct / (checked + missed) else 0.0 end, 6) as recall from a""")
def tier_precision_recall(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.col("source").alias("tier"), F.col("quality").isNotNull().alias("checked"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("correct"),
        (F.col("quality").isNull() & (F.col("n_chars") > 2000)).alias("missed"),
    )
    return score.precision_recall(rows, "tier")


#: Phrases of a message and the kind that they tell; the first that occurs wins.
REFUSALS = [
    ("timed out after", "timeout"),
    ("retail dol bytes differ", "retail-mismatch"),
    ("checksum mismatch", "retail-mismatch"),
    ("checksum failed", "retail-mismatch"),
    ("computed checksum(s) did not match", "retail-mismatch"),
    ("sha1 mismatch", "retail-mismatch"),
    ("hash mismatch", "retail-mismatch"),
    ("link-order cycle", "link-order-cycle"),
    ("cyclic dependency", "link-order-cycle"),
    ("stale precondition", "stale-precondition"),
    ("which this run does not permit", "dependency-not-permitted"),
    ("would overlap", "conflicting-attribution"),
    ("overlaps another", "conflicting-attribution"),
    ("conflicting attribution", "conflicting-attribution"),
    ("invalid alignment", "split-alignment"),
    ("split alignment", "split-alignment"),
    ("transaction refused", "illegal-split"),
    ("illegal split", "illegal-split"),
    ("multiply defined", "duplicate-symbol"),
    ("multiply-defined", "duplicate-symbol"),
    ("duplicate symbol", "duplicate-symbol"),
    ("undefined:", "undefined-symbol"),
    ("undefined symbol", "undefined-symbol"),
    ("compiled source object was enabled", "source-linkage-violation"),
    ("extracted target object is not", "source-linkage-violation"),
    ("regresses an existing unit", "measured-regression"),
    ("reduces source-linked code", "measured-regression"),
    ("cannot open", "unavailable-input"),
    ("no such file", "unavailable-input"),
    ("file not found", "unavailable-input"),
    ("fatal error", "source-compile-error"),
    ("error:", "source-compile-error"),
    ("error #", "source-compile-error"),
]
#: What the messages of the query say, by order.
_SAID = [
    "Job timed out after 30 s", "SHA1 mismatch in image", "found a cyclic dependency", "stale precondition: state changed", "needs one which this run does not permit",
    "the range would overlap", "invalid alignment of a part", "Transaction refused by the gate", "symbol Multiply-Defined here", "undefined: name",
    "compiled source object was enabled", "this regresses an existing unit", "No such file: part", "Error #12 in line", "nothing to report", "error: undefined symbol x",
]
_SAY = "case " + " ".join(f"when o_orderkey % 16 = {i} then '{t}'" for i, t in enumerate(_SAID)) + " end"
_KIND = "case " + " ".join(f"when contains(low, '{w}') then '{k}'" for w, k in REFUSALS) + " else 'unknown' end"


@query(f"""
with m as (select o_orderkey, o_orderpriority, lower(o_orderpriority || ' ' || {_SAY}) as low from orders),
k as (select *, {_KIND} as kind from m)
select kind, count(*) as messages, count(distinct o_orderpriority) as priorities, min(o_orderkey) as first from k group by 1""")
def refusal_classification(spark: SparkSession, folder: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("o_orderkey") % 16 + 1).cast("int"))
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", F.concat_ws(" ", "o_orderpriority", said).alias("text"))
    rows = rows.withColumn("kind", prints.first_rule(F.col("text"), REFUSALS, "unknown"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("o_orderpriority").alias("priorities"), F.min("o_orderkey").alias("first"))


# --- sequences --------------------------------------------------------------------------------------


@query()
def lcs_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Call sequences of each order and the next one of its customer, aligned; pair is the key of the earlier order."""
    orders = table(spark, folder, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    orders = orders.select(F.col("o_orderkey").alias("pair"), after.alias("next")).where("next is not null")
    items = calls(spark, folder).select("owner", F.struct("ord", F.concat_ws("/", "kind", F.col("callee") % 10).alias("v")).alias("x"))
    lists = items.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("v"))
    a = lists.select(F.col("owner").alias("pair"), F.col("v").alias("a"))
    b = lists.select(F.col("owner").alias("next"), F.col("v").alias("b"))
    return sequence.align_lists(orders.join(a, "pair").join(b, "next").select("pair", "a", "b"))


@query()
def order_spine(spark: SparkSession, folder: str) -> DataFrame:
    """Of each customer's orders by date, those on a longest run of rising order keys."""
    rows = table(spark, folder, "orders").select("o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderkey")
    return sequence.spine(rows, "o_custkey", "at", "o_orderkey")


@query("""
with o as (select l_orderkey % 500 as k, l_linenumber::bigint as source, min(l_quantity)::bigint as target, max(l_quantity)::bigint as hi from lineitem group by 1, 2),
d as (select *, target - source as delta, lag(target - source) over w as pd, lag(target) over w as pt from o window w as (partition by k order by source)),
a as (select k, count(*) as points, sum(case when pd is null or delta <> pd then 1 else 0 end) as shifts, bool_and(target = hi) as f, bool_and(coalesce(target > pt, true)) as r, bool_and(delta = 0) as z from d group by 1)
select k, points, shifts, f and r and shifts <= 2 and not z as accepted from a""")
def offset_transform(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") % 500).alias("k"), F.col("l_linenumber").cast("long").alias("source"), F.col("l_quantity").cast("long").alias("target"))
    return sequence.offset_transforms(rows, "k")


def divided(pieces: list[sequence.Piece], units: list[str]) -> sequence.Division:
    """Pieces divided among units; a segment of more than 12 pieces without owner has no worth."""
    total = {u: sum(p.owner == u for p in pieces) for u in units}

    def worth(unit: str, start: int, end: int) -> sequence.Worth | None:
        inside = [p for p in pieces if start <= p.start and p.end <= end]
        own = sum(p.owner == unit for p in inside)
        gaps = end - start - sum(p.end - p.start for p in inside)
        return None if len(inside) - own > 12 else sequence.Worth(own, own == total[unit], len(inside) - own, gaps)

    return sequence.divide(pieces, pieces[-1].end, units, worth)


@query()
def joint_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's lines, laid out by quantity, divided among the units of two lines each.

    Two lines of seven have no owner; the units are those that the order's lines could have."""
    rows = table(spark, folder, "lineitem")
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    size = F.col("l_quantity").cast("long")
    rows = rows.select("l_orderkey", "l_partkey", size.alias("size"), F.row_number().over(line).alias("k"), F.sum(size + F.col("l_suppkey") % 2).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    owner = F.when(F.col("l_partkey") % 7 > 1, F.concat(F.lit("u"), F.floor((F.col("k") - 1) / 2)))
    pieces = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("stop") - F.col("size")).alias("start"), "stop", owner.alias("owner")))).alias("x"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for order, x in zip(batch["l_orderkey"], batch["x"], strict=True):
                listed = [sequence.Piece(int(p["start"]), int(p["stop"]), p["owner"]) for p in x]
                found = divided(listed, [f"u{i}" for i in range((len(listed) + 1) // 2)])
                show = lambda way: ",".join(f"{u}:{a}-{b}" for u, a, b in way)
                out.append((order, found.status, show(found.best), show(found.competing), len(found.shared)))
            yield pd.DataFrame(out, columns=["l_orderkey", "status", "best", "competing", "shared"])

    return pieces.mapInPandas(run, "l_orderkey long, status string, best string, competing string, shared long")


# --- evidence -----------------------------------------------------------------------------------


_PARTS = """
q as (select user_id, event_id, nullif(event_type, 'view') as unit, event_id % 3 <> 0 as independent,
             sum(cast(floor(value) as bigint) + 1) over w as e0, cast(floor(value) as bigint) as size from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
p as (select user_id, event_id, unit, independent, e0 - size - 1 as s, e0 - 1 as e from q)"""


def laid_out(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events one behind the other, a byte apart, as long as their value; views have no unit."""
    size = F.floor("value").cast("long")
    line = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, folder, "events").withColumn("end", F.sum(size + 1).over(line) - 1).withColumn("start", F.col("end") - size)
    return rows.select("user_id", "event_id", F.nullif("event_type", F.lit("view")).alias("unit"), (F.col("event_id") % 3 != 0).alias("independent"), "start", "end")


@query(f"""with {_PARTS},
n as (select *, lag(unit) over w as lu, lag(independent) over w as li, lead(unit) over w as ru, lead(independent) over w as ri from p window w as (partition by user_id order by s, e))
select user_id, unit, 'left' as side, s as address, lu as outside, independent and case when lu is null and li is null then true else coalesce(lu is not null and li, false) end as supported
from n where unit is not null and unit is distinct from lu
union all
select user_id, unit, 'right', e, ru, independent and case when ru is null and ri is null then true else coalesce(ru is not null and ri, false) end
from n where unit is not null and unit is distinct from ru""")
def edge_support(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.judged_edges(laid_out(spark, folder).drop("event_id"), ["user_id"])


_PLACED = f"""{_PARTS},
m as (select *, event_id % 17 = 0 as amb, case when unit is not null then event_id * 7 % 1009 * 1000 + event_id % 1000 end as src from p),
o as (select *, src = min(src) over (partition by user_id, unit) and unit is not null as fst, src = max(src) over (partition by user_id, unit) and unit is not null as lst from m)"""


@query(f"""with {_PLACED},
n as (select *, lag(unit) over w as b, lead(unit) over w as a, coalesce(lag(independent) over w, false) as bi, coalesce(lead(independent) over w, false) as ai,
      coalesce(lag(lst) over w, false) as bo, coalesce(lead(fst) over w, false) as ao, lag(src) over w as bs, lead(src) over w as sa,
      lag(s) over w is null as f, lead(s) over w is null as l,
      coalesce(lag(unit) over w is not null and s - lag(e) over w <= 31 and not lag(amb) over w, false) as bm,
      coalesce(lead(unit) over w is not null and lead(s) over w - e <= 31 and not lead(amb) over w, false) as am
      from o window w as (partition by user_id order by s, e)),
c as (select *, f or (bm and bi and bo) as bb, l or (am and ai and ao) as ab from n where unit is null)
select user_id, s as start, e as "end", 'interior' as placement, b as owner from c where bm and am and a = b and bs < sa
union all select user_id, s, e, 'tail', b from c where bm and bo and ab and a is distinct from b
union all select user_id, s, e, 'head', a from c where am and ao and bb and a is distinct from b""")
def helper_placement(spark: SparkSession, folder: str) -> DataFrame:
    known = F.col("unit").isNotNull()
    source = F.when(known, F.col("event_id") * 7 % 1009 * 1000 + F.col("event_id") % 1000)
    rows = laid_out(spark, folder).withColumns({"ambiguous": F.col("event_id") % 17 == 0, "source": source})
    unit = Window.partitionBy("user_id", "unit")
    rows = rows.withColumns({"first": known & (F.col("source") == F.min("source").over(unit)), "last": known & (F.col("source") == F.max("source").over(unit))})
    return evidence.placed_helpers(rows.drop("event_id"), ["user_id"])


@query("""
with l as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos from lineitem),
s as (select l_orderkey * 100 + pos as id, l_orderkey as unit, l_orderkey * 100 + pos as pos, l_partkey from l where l_orderkey % 2 = 0),
t as (select l_orderkey * 100 + pos as id, l_orderkey * 100 + pos as pos, l_partkey from l where l_orderkey % 2 = 1),
us as (select l_partkey, min(id) as a from s group by 1 having count(*) = 1), ut as (select l_partkey, min(id) as b from t group by 1 having count(*) = 1),
m as (select a, b from us join ut using (l_partkey)),
h as (select unit, s.pos, m.b as tp, row_number() over (partition by unit order by s.pos) as k, lag(m.b) over (partition by unit order by s.pos) as pb, lag(s.pos) over (partition by unit order by s.pos) as pp
      from s left join m on m.a = s.id)
select unit, count(*) as members, bool_and(case when k = 1 then tp is not null else coalesce(tp - pb = 1 and pos - pp = 1, false) end) as complete from h group by 1""")
def complete_sequence(spark: SparkSession, folder: str) -> DataFrame:
    rows = calls(spark, folder).select((F.col("owner") * 100 + F.col("ord")).alias("id"), F.col("owner").alias("unit"), F.col("callee").alias("name"))
    rows = rows.withColumn("pos", F.col("id"))
    source, target = version(rows, "unit", 0), version(rows, "unit", 1)
    matches = anchors.one_to_one(source, target, "name", "name", 1.0).select("source_id", "target_id")
    return evidence.complete_sequences(matches, source.select("id", "unit", "pos"), target.select("id", "pos"))


@query(f"""with {_BODY_ANCHOR}, d as (select doc_id, source, lang from documents where doc_id % 2 = 0),
f as (select doc_id, source, b.source_id is not null as matched, b.source_id is not null and n_chars >= 500 as independent, b.source_id is not null and n_chars < 100 as contested
      from documents left join body b on b.source_id = doc_id where doc_id % 2 = 0),
g as (select source as unit, count(*) as members, sum(matched::int) as matched, sum(independent::int) as independent, sum(contested::int) as contested from f group by 1)
select *, case when matched = 0 then 'absent' when contested > 0 then 'ambiguous' when independent >= 2 then 'corroborated' else 'tentative' end as confidence from g""")
def unit_identification(spark: SparkSession, folder: str) -> DataFrame:
    docs = version(table(spark, folder, "documents"), "doc_id", 0)
    hit = unique_body_anchor(spark, folder).select(F.col("source_id").alias("doc_id"), F.lit(True).alias("hit"))
    matched = F.coalesce("hit", F.lit(False))
    rows = docs.join(hit, "doc_id", "left").select(
        F.col("source").alias("unit"), matched.alias("matched"), (matched & (F.col("n_chars") >= 500)).alias("independent"), (matched & (F.col("n_chars") < 100)).alias("contested")
    )
    return evidence.identified(rows)


@query(f"""with {_R}, q as (select user_id as k, s, e from r where unit = 'click'), m as (select * from {_MERGE.format('q')}),
a as (select m.k, r.unit, r.event_id from m join r on r.user_id = m.k and m.s <= r.s and r.s < m.e),
g as (select user_id as k, count(*) as strong from r where unit in ('click', 'purchase') or event_id % 3 = 0 group by 1),
c as (select k, count(*) as span, count(*) filter (unit in ('click', 'purchase')) as members from a group by 1)
select g.k as unit, strong, coalesce(members, 0) as members, coalesce(span, 0) as span,
 coalesce(members, 0) >= 2 and 2 * coalesce(members, 0) >= strong and coalesce(span, 0) <= 2 * strong as permits from g left join c using (k)""")
def name_support(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranges(spark, folder)
    held = intervals.merged(rows.where("unit = 'click'"), ["user_id"]).withColumn("unit", F.col("user_id"))
    own = F.col("unit").isin("click", "purchase")
    names = rows.select("user_id", F.col("event_id").alias("id"), F.col("start").alias("at"), F.when(own, F.col("user_id")).alias("named"))
    strong = rows.where(own | (F.col("event_id") % 3 == 0)).groupBy(F.col("user_id").alias("unit")).agg(F.count(F.lit(1)).alias("strong"))
    return evidence.name_support(held, names, strong, ["user_id"])


@query(f"""with {_R}, a as (select user_id, s as source, min(s + case when user_id % 2 = 0 or s > 60 then 7 else 9 end) as target from r where unit = 'click' group by 1, 2),
g as (select distinct user_id, s, e from r where unit = 'purchase'),
x as (select g.*, (select arg_max(target - source, source) from a where a.user_id = g.user_id and a.source <= g.s) as b,
                  (select arg_min(target - source, source) from a where a.user_id = g.user_id and a.source >= g.e) as f from g)
select user_id, s as start, e as "end", s + b as target_start, e + b as target_end from x where b = f""")
def uniform_shift(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranges(spark, folder)
    move = F.when((F.col("user_id") % 2 == 0) | (F.col("start") > 60), 7).otherwise(9)
    spots = rows.where("unit = 'click'").groupBy("user_id", F.col("start").alias("source")).agg(F.min(F.col("start") + move).alias("target"))
    return evidence.shifted(rows.where("unit = 'purchase'").select("user_id", "start", "end").distinct(), spots, ["user_id"])


@query("""
with e as (select o_custkey as unit, case o_orderpriority when '1-URGENT' then 'derive' when '2-HIGH' then 'coverage' when '3-MEDIUM' then 'discover' else 'verify' end as stage,
   case when o_orderstatus = 'F' then 'accepted' when o_orderstatus = 'O' then 'refused' else 'superseded' end as outcome, o_orderkey as ordinal from orders),
r as (select *, row_number() over (partition by unit order by outcome = 'accepted' desc, case stage when 'derive' then 1 when 'coverage' then 2 when 'discover' then 3 else 4 end desc, ordinal desc) as k from e)
select unit, stage, outcome from r where k = 1""")
def stage_trace(spark: SparkSession, folder: str) -> DataFrame:
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", "derive").when(F.col("o_orderpriority") == "2-HIGH", "coverage").when(F.col("o_orderpriority") == "3-MEDIUM", "discover").otherwise("verify")
    outcome = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "refused").otherwise("superseded")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("unit"), stage.alias("stage"), outcome.alias("outcome"), F.col("o_orderkey").alias("ordinal"))
    return evidence.last_outcomes(rows, ["derive", "coverage", "discover", "verify"])


@query(f"""with {_PARTS}, n as (select *, lead(s) over (partition by user_id, unit order by s, e) as nx, lead(unit) over (partition by user_id order by s, e) as nu from p where unit is not null)
select 'truncated' as mask, user_id, unit, s as start from n where nx is not null
union all select 'misplaced', user_id, case when nu is not null and nu <> unit then nu else unit end, s from n""")
def mask_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    rows = laid_out(spark, folder).where("unit is not null")
    parts = [(n, f(rows, ["user_id"])) for n, f in (("truncated", evidence.truncated), ("misplaced", evidence.misplaced))]
    out = [p.select(F.lit(n).alias("mask"), "user_id", "unit", "start") for n, p in parts]
    return out[0].unionByName(out[1])


@query("""
with r as (select l_orderkey as unit, l_partkey as candidate, max(l_quantity) as percent, max(l_extendedprice) as weight from lineitem group by 1, 2),
k as (select *, row_number() over (partition by unit order by percent desc, candidate) as a, row_number() over (partition by unit order by weight desc, candidate) as b from r)
select unit, candidate, percent, weight from k where a <= 2 or b <= 2""")
def two_channel_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The two best parts of each order by quantity and by price; a task holds about 500,000 lines, however many there are."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("candidate"), "l_quantity", "l_extendedprice")
    lines = lines.repartition(1 + lines.count() // 500_000, "unit")
    rows = lines.groupBy("unit", "candidate").agg(F.max("l_quantity").alias("percent"), F.max("l_extendedprice").alias("weight"))
    return evidence.chosen_alternatives(rows, "unit", ["percent", "weight"], 2)


@query("""
with b as (select l_partkey as unit, max(l_quantity) as was from lineitem where l_linenumber <= 3 group by 1), a as (select l_partkey as unit, max(l_quantity) as now from lineitem where l_linenumber > 3 group by 1)
select unit, was, now from b join a using (unit) where now < was""")
def regressions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    best = lambda c: rows.where(c).groupBy(F.col("l_partkey").alias("unit")).agg(F.max("l_quantity").alias("value"))
    return evidence.regressed(best("l_linenumber <= 3"), best("l_linenumber > 3"))


@query("""
with s as (select c_nationkey as unit, c_mktsegment as section from customer where c_custkey % 2 = 0), t as (select distinct c_nationkey as unit, c_mktsegment as section from customer where c_custkey % 2 = 1 and c_acctbal > 5000)
select unit, count(*) as ranges, bool_and(section in ('BUILDING', 'MACHINERY')) as code_only,
  count(*) filter (section not in ('BUILDING', 'MACHINERY') and not exists (select 1 from t where t.unit = s.unit and t.section = s.section)) = 0 as covered from s group by 1""")
def section_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("section"), F.col("c_acctbal").alias("bal"))
    return evidence.section_coverage(version(rows, "c_custkey", 0), version(rows, "c_custkey", 1).where("bal > 5000"), ["BUILDING", "MACHINERY"])


@query("""
with r as (select p_partkey, p_partkey // 2 as j, p_type || '/' || p_partkey // 2 // 6 as body from part),
d as (select body, j as unit, j % 2 as before, j // 3 % 2 as after from r where p_partkey % 2 = 0),
o as (select body, p_partkey as id, j % 2 as before, j // 3 % 2 as after from r where p_partkey % 2 = 1),
g as (select body, count(*) as n from d group by 1 having count(*) >= 2 and count(*) = count(distinct unit)),
e as (select g.body, g.n from g join (select body, count(*) as n from o group by 1) h on h.body = g.body and h.n = g.n),
p as (select d.body, e.n, unit, id from d join o on d.body = o.body and d.before = o.before and d.after = o.after join e on e.body = d.body),
w as (select body from p group by 1 having count(*) = max(n) and count(distinct unit) = max(n) and count(distinct id) = max(n))
select body, unit, id as occurrence from p join w using (body)""")
def emitted_owners(spark: SparkSession, folder: str) -> DataFrame:
    j = F.floor(F.col("p_partkey") / 2)
    body = F.concat_ws("/", "p_type", F.floor(j / 6))
    rows = table(spark, folder, "part").select("p_partkey", body.alias("body"), j.alias("unit"), (j % 2).alias("before"), (F.floor(j / 3) % 2).alias("after"))
    occurrences = version(rows, "p_partkey", 1).select("body", F.col("p_partkey").alias("id"), "before", "after")
    return evidence.emitted_owners(version(rows, "p_partkey", 0).drop("p_partkey"), occurrences)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return unique_body_anchor(spark, folder)
