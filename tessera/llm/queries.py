"""The queries of this subpackage and, where SQL can state them, their SQL.

Each query applies its operator with production parameters to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontaminate import contained_items, contaminated
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .line_dedup import removed_lines
from .near_dedup import near_dedup
from .packing import pack_documents
from .quality import judge_quality
from .resample import importance_resample
from .secrets import scan_secrets
from .substring_dedup import substring_dedup
from .toxicity import score_toxicity
from .url_filter import Rule, filter_urls

#: The rules of the URL query: action, host, path.
URL_RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Hosts that are blocked, with their subdomains, where no rule fits.
BLOCKED_HOSTS = (
    "adult-x.example.com",
    "ads-track.example.com",
    "casino-win.example.net",
    "cheap-pills.example.net",
    "free-bets.example.net",
    "spam-farm.example.org",
)
TOXIC_AT = 0.7


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup(table(spark, folder, "documents"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = removed_lines(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
    )


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))

    def count(kind: str) -> F.Column:
        return F.regexp_count("secret_base", F.lit(f"(^|,){kind}:")).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex")),
        F.sha2("secret_base", 256).alias("base_sha256"),
        F.col("secret_spans").alias("spans"),
    )


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"), URL_RULES, BLOCKED_HOSTS)


def not_held_out(rows: DataFrame) -> DataFrame:
    """The rows that a model may learn labels from."""
    return rows.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = not_held_out(table(spark, folder, "labels"))
    scored = score_toxicity(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select(
        "doc_id",
        held.alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= TOXIC_AT, 1).otherwise(0).alias("predicted"),
    )


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup(table(spark, folder, "documents"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_quality(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_best_fit_packing,
        op3_decontamination,
        op4_line_dedup,
        op5_exact_dedup,
        op6_html_extraction,
        op7_secret_scan,
        op8_url_filter,
        op9_toxicity,
        op10_near_dedup,
        op11_importance_resampling,
        op12_quality_rules,
        op13_phrase_mining,
    )
}

_SQL_EXACT = r"""
with d as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
), n as (
  select doc_id, t, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
         row_number() over (partition by t order by doc_id nulls last) as k
  from d
)
select doc_id, keep_id, group_size, k = 1 as kept, sha256(t) as text_sha256 from n
"""

_SQL_URL = r"""
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), h as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u
), r(action, rhost, rpath) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit as (
  select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule,
         max_by(action, length(rhost || rpath)) as action
  from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id
), bad(bhost) as (
  values ('adult-x.example.com'), ('ads-track.example.com'), ('casino-win.example.net'),
         ('cheap-pills.example.net'), ('free-bets.example.net'), ('spam-farm.example.org')
)
select h.page_id, host, path, rule,
       coalesce(action, case when exists (select 1 from bad where host = bhost or ends_with(host, '.' || bhost))
                             then 'block' else 'allow' end) as verdict
from h left join fit using (page_id)
"""

_SQL_CONTAINED = r"""
with t as (
  select 'd' as side, doc_id as id, text from documents
  union all select 'i', item_id, text from benchmark
), w as (
  select side, id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from t
), s as (
  select distinct side, id, unnest(case
           when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
           when len(w) > 0 then ['=' || array_to_string(w, ' ')] else [] end) as g
  from w
), i as (select id as item, g, count(*) over (partition by id) as q from s where side = 'i'
), hit as (
  select s.id, item, any_value(q) as q, count(*) as n from s join i on s.g = i.g where side = 'd'
  group by s.id, item having 100 * count(*) >= 80 * any_value(q)
), best as (
  select id, count(*) as n_items, string_agg(item::varchar, ',' order by item) as item_ids,
         arg_min(item, (-(n / q), item)) as best_item_id, round(max(n / q), 6) as best_share
  from hit group by id
)
select doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items,
       coalesce(item_ids, '') as item_ids, best_item_id, best_share
from documents left join best on doc_id = id
"""

_SQL_NEAR = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct doc_id, unnest(case
           when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
           when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
  from w
), z as (select doc_id, count(*) as n from s group by doc_id
), c as (
  select a.doc_id as a, b.doc_id as b, count(*) as k
  from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from c join z x on x.doc_id = a join z y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)
), e as (select a, b from l union all select b, a from l
), r as (
  select doc_id, doc_id as root from documents
  union select e.b, r.root from r join e on e.a = r.doc_id
), m as (select doc_id, min(root) as component_id from r group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from m left join z using (doc_id)
"""

_SQL_SUBSTRING = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, unnest(range(1, len(w) - 33)) as i, w from d where len(w) >= 35
), g as (
  select doc_id, i, count(*) over (partition by array_to_string(w[i:i+34], ' ')) as n from s
), c as (
  select distinct doc_id, unnest(range(i, i + 35)) as j from g where n > 1
), k as (select doc_id, list(j) as gone from c group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone is null or not list_contains(gone, i)), ' '), ''))
         as kept_sha256
from d left join k using (doc_id)
"""

_SQL_LINES = r"""
with d as (
  select doc_id, string_split(text, chr(10)) as ls from documents where text is not null
), l as (
  select doc_id, unnest(range(0, len(ls))) as i, unnest(ls) as raw from d
), w as (
  select doc_id, i, list_sort(list_distinct(regexp_extract_all(raw, '[^\x20\x09-\x0D]+'))) as ws from l
), k as (
  select array_to_string(ws, ' ') as s, any_value(ws) as ws, min((doc_id, i)) as first, any_value(len(ws)) as n
  from w where len(ws) >= 1 group by 1
), t as (
  select s, first, n, unnest(ws) as x from k
), p as (
  select a.s, count(*) as c, any_value(a.n) as n, any_value(b.n) as m
  from t a join t b on a.x = b.x and b.first < a.first and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.s, b.s having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), g as (select distinct s from p
), r as (
  select doc_id, i from w join k on k.s = array_to_string(w.ws, ' ')
  where len(w.ws) >= 1 and ((doc_id, i) <> first or exists (select 1 from g where g.s = k.s))
), a as (
  select doc_id, count(*) as n_removed, string_agg(i::varchar, ',' order by i) as removed_lines from r group by doc_id
)
select doc_id, len(ls) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed_lines, '') as removed_lines
from d left join a using (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 by its polynomial: a table of 256 steps, folded over the bytes of each distinct feature.
_SQL_RESAMPLE = rf"""
with recursive step(b, c, k) as (
  select b, b::bigint, 0 from range(256) r(b)
  union all
  select b, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from step where k < 8
), crc(t) as (select list(c order by b) from step where k = 8
), w as (
  select false as target, doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from documents
  union all
  select true, item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') from benchmark
), f as (
  select target, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w
), n as (select target, doc_id, f, count(*) as n from f group by all
), u as (select distinct f from n
), h as (select f, hex(encode(f)) as x from u
), b as (
  select f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)),
           lambda c, v: xor(c // 256, t[xor(c % 256, v) + 1])), 4294967295) % 10000 as bucket
  from h, crc
), s as (select bucket, sum(n) filter (not target) as s, sum(n) filter (target) as t from n join b using (f) group by 1
), z as (select sum(s) as s0, sum(t) as t0 from s
), g as (
  select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (s0 + 10000)::double) / ((coalesce(s, 0) + 1)::double * (t0 + 10000)::double)))::bigint as gain
  from s, z
), v as (select doc_id, sum(n)::bigint as n, floor(sum(n * gain) / sum(n))::bigint as weight from n join b using (f) join g using (bucket) where not target group by 1
), d as (
  select w.doc_id, len(w.w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || w.doc_id), 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from w left join v on v.doc_id = w.doc_id where not target
), r as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () * 25 // 100 as quota from d where n_words >= 20
)
select doc_id, n_features::bigint as n_features, weight, score, case when rank <= quota then rank end as rank from d left join r using (doc_id)
"""

_SQL_QUALITY = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), p as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, w from d where len(w) > 3
), g as (
  select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from p
), c as (
  select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from g where n > 1) group by 1
), m as (
  select doc_id, t, w, len(ls) as n_lines, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
         coalesce(c.n, 0) as n_repeat_words
  from d left join c using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words
            or 100 * n_symbols > 10 * n_words
            or word_chars < 2 * n_words or word_chars > 15 * n_words
            or 100 * n_dup_lines > 50 * n_lines
            or 100 * len(regexp_extract_all(t, '!')) > 50 * n_words
            or 100 * len(regexp_extract_all(t, '\p{Lu}\p{Lu}+')) > 50 * n_words
            or 100 * len(regexp_extract_all(t, '(\.\.\.|…)[\x20\x09\x0D]*(\n|\z)')) > 30 * n_lines
            or 100 * len(regexp_extract_all(t, '(\A|\n)[\x20\x09]*[-*•‣◦][\x20\x09]')) > 90 * n_lines
            or 100 * len(list_filter(w, lambda x: not regexp_matches(x, '\p{L}'))) > 50 * n_words) as kept
from m
"""

_SQL_PHRASES = rf"""
with d as (
  select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents
), p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from d
), o as (
  select lang, unnest(w) as phrase, 1 as size from p
  union all
  select lang, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))), 2 from p
  union all
  select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))), 3 from p
), f as (select lang, phrase, size, count(*) as f from o group by all
), n as (select lang, sum(f) as n from f where size = 1 group by 1
), c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= 10
), x as (
  select c.lang, c.phrase, size, a, k, array_to_string(w[:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
  from c, lateral (select unnest(range(1, size)) as k)
), s as (
  select x.lang, x.phrase, x.size, a, k, l.f as l, r.f as r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) as score
  from x join f l on l.lang || ':' || l.phrase = x.lang || ':' || head join f r on r.lang || ':' || r.phrase = x.lang || ':' || tail
), b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1
), long as (
  select lang, array_to_string(w[j:j + 1], ' ') as phrase, max(a) as covered from (select lang, a, w, unnest([1, 2]) as j from c where size = 3) group by 1, 2
), k as (
  select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from b left join long using (lang, phrase) where covered is null or 100 * covered < 50 * a
)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from k join n using (lang) where rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op11_importance_resampling": _SQL_RESAMPLE,
    "op12_quality_rules": _SQL_QUALITY,
    "op13_phrase_mining": _SQL_PHRASES,
    "op4_line_dedup": _SQL_LINES,
    "op1_substring_dedup": _SQL_SUBSTRING,
    "op3_decontamination": _SQL_CONTAINED,
    "op10_near_dedup": _SQL_NEAR,
    "op5_exact_dedup": _SQL_EXACT,
    "op8_url_filter": _SQL_URL,
}
