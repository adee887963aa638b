"""Quality rules as a short-circuit cascade, in DataFrame expressions alone.

A rule is a condition that rejects a text.  The rules' costs (seconds over a sample)
and their joint selectivity (which rules reject each sampled text) order them: next
comes the rule that rejects most of what the rules before it leave, per second of its
cost.  The ordered rules become one CASE expression, whose branches Spark evaluates
only for texts that every earlier rule has let pass.  Order never changes the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: Words are maximal runs of other characters than these.
WHITE = "\\x20\\x09-\\x0D"
SYMBOLS = "[#*$%&|<>]"
#: Texts that the costs and selectivities are estimated on.
SAMPLE = 2_000


@dataclass(frozen=True)
class Rule:
    """A name and a condition on the columns of ``measured``; true rejects the text, null lets it pass."""

    name: str
    rejects: Callable[[], Column]


def _per(count: Column, share: int, of: Column) -> Column:
    """count / of > share percent, in integers."""
    return count * 100 > of * share


def _matches(pattern: str) -> Column:
    return F.regexp_count("__text", F.lit(pattern))


#: What the base contract rejects: short texts, and texts that repeat themselves.
BASE = (
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repetitive", lambda: _per(F.col("n_repeat_words"), 50, F.col("n_words"))),
)
#: The cascade behind it; shares are in percent of the words or of the lines that have words.
RULES = (
    Rule("symbols", lambda: _per(F.col("n_symbols"), 10, F.col("n_words"))),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", lambda: F.col("word_chars") > 15 * F.col("n_words")),
    Rule("repeated_lines", lambda: _per(F.col("n_dup_lines"), 50, F.size("__lines"))),
    Rule("shouting", lambda: _per(_matches("!"), 50, F.col("n_words"))),
    Rule("capitals", lambda: _per(_matches("\\p{Lu}\\p{Lu}+"), 50, F.col("n_words"))),
    Rule("open_lines", lambda: _per(_matches("(\\.\\.\\.|…)[\\x20\\x09\\x0D]*(\\n|\\z)"), 30, F.size("__lines"))),
    Rule("bullets", lambda: _per(_matches("(\\A|\\n)[\\x20\\x09]*[-*•‣◦][\\x20\\x09]"), 90, F.size("__lines"))),
    Rule("no_letters", lambda: _per(F.size(F.filter("__words", lambda x: ~x.rlike("\\p{L}"))), 50, F.col("n_words"))),
)


def _with_repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words, from the arrays of words.

    A window's key holds a hash of its three words above, its place below; sorted keys put
    windows of one hash side by side.  Those are then compared by their words, and the
    distance from each repeated window to the next counts the words that it covers anew.
    Every array is a column of its own, used more than once, so Spark computes it once."""
    w, p = F.col("__words"), F.col("__bits")
    hashed = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(-p).bitwiseOR(i))
    df = df.withColumn("__bits", F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(w), F.lit(1)))))).cast("long"))
    df = df.withColumn("__keys", F.sort_array(hashed))

    def beside(rows: Column, i: Column, same: Callable[[Column], Column]) -> Column:
        return F.coalesce(same(F.get(rows, i - 1)), F.lit(False)) | F.coalesce(same(F.get(rows, i + 1)), F.lit(False))

    k = F.col("__keys")
    near = F.filter(k, lambda x, i: beside(k, i, lambda y: x.bitwiseXOR(y).bitwiseAND(-p) == 0))
    place = F.transform(near, lambda x: x.bitwiseAND(p - 1).cast("int"))
    df = df.withColumn("__near", F.sort_array(F.transform(place, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("s"), i.alias("i")))))
    n = F.col("__near")
    again = F.filter(n, lambda x, i: beside(n, i, lambda y: x["s"] == y["s"]))
    df = df.withColumn("__again", F.sort_array(F.transform(again, lambda x: x["i"])))
    a = F.col("__again")
    fresh = F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - x, F.lit(3))))
    df = df.withColumn("n_repeat_words", F.aggregate(fresh, F.lit(0), lambda s, x: s + x).cast("long"))
    return df.drop("__bits", "__keys", "__near", "__again")


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the arrays __words and __lines.

    The text itself is also there as __text, null as empty."""
    taken = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = df.withColumn("__text", F.coalesce(df[text_col], F.lit(""))).drop(*(c for c in taken if c in df.columns))
    df = df.withColumn("__words", F.array_remove(F.split("__text", f"[{WHITE}]+"), ""))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{WHITE}]")))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": _matches(SYMBOLS).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        }
    )
    return _with_repeats(df)


def plan(df: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """The rules in the order to ask them, each with its seconds over the sample and what it rejects of the rest.

    The sample is a Bernoulli one of about ``sample`` texts, measured and kept in the shared
    folder; each rule is timed alone over it, and one aggregation counts which rules reject
    together (at most 2 ** rules rows come back)."""
    if len(rules) < 2:
        return [(r, 0.0, 0.0) for r in rules]
    n = df.select(F.lit(1)).count()
    taken = cut(measured(df.select(df[text_col].alias("text")).sample(min(1.0, sample / max(n, 1)), seed=1)))
    fails = [F.coalesce(r.rejects(), F.lit(False)) for r in rules]

    def seconds(f: Column) -> float:
        began = time.perf_counter()
        taken.agg(F.count_if(f)).collect()
        return time.perf_counter() - began

    idle = min(seconds(F.lit(False)) for _ in range(2))
    cost = [max(min(seconds(f) for _ in range(2)) - idle, 1e-3) for f in fails]
    groups = [(r["f"], r["n"]) for r in taken.groupBy(F.array(*fails).alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()]
    total, out, left = max(sum(k for _, k in groups), 1), [], list(range(len(rules)))
    while left:
        gone = {i: sum(k for f, k in groups if f[i]) for i in left}
        best = max(left, key=lambda i: (gone[i] / cost[i], -cost[i], -i))
        out.append((rules[best], cost[best], gone[best] / total))
        groups = [(f, k) for f, k in groups if not f[best]]
        left.remove(best)
    return out


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = None
    for r in rules:
        out = F.when(r.rejects(), r.name) if out is None else out.when(r.rejects(), r.name)
    return F.lit(None).cast("string") if out is None else out


def judge_quality(df: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``df`` with the five measures, base_failed, kept, and rejected_by (the first rule met that rejects).

    The base rules come first, in the order given; the others follow in the order of ``plan``,
    which runs some short jobs over a sample before this returns.  kept does not depend on the
    sample; rejected_by names one of the rules that reject, which may vary with the order.

    * Null and empty texts have no words and fail the base rules.
    * Words have no length limit; a text is one row, so a task's memory follows its longest
      text (some 150 bytes a word while its windows are sorted).
    * Repeated rows are judged alike, each by itself; an empty table gives an empty result.
    * Columns named like a result are replaced; others pass through, except names with a leading ``__``.
    """
    ordered = [r for r, _, _ in plan(df, rules, text_col, sample)]
    rows = measured(df, text_col)
    failed = F.lit(False)
    for r in base:
        failed = failed | F.coalesce(r.rejects(), F.lit(False))
    rows = rows.withColumn("base_failed", failed).withColumn("rejected_by", cascade([*base, *ordered]))
    return rows.withColumn("kept", F.col("rejected_by").isNull()).drop("__text", "__words", "__lines")
