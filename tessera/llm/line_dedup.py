"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its distinct words.  Words are ordered from rare to common by
a count sketch of fixed size over all words of all documents.  Two sets of Jaccard
similarity t or more share a word among the first ``n - ceil(t n) + 1`` of each
(prefix filter), have sizes within t of each other (length filter), enough words
left behind the shared one (positional filter) and few differing bits among the
parities of their words.  What passes is verified on the words themselves.

Lines of the same characters are first folded into one, by their MD5, at the place
of the first.  The sets that share a prefix word are its group.  Groups of at most
``Settings.common`` sets are joined with themselves.  In larger ones every set is
first compared with the earliest set and with its two predecessors, which settles
groups of copies by a few pairs a member; sets that this leaves unsettled are then
joined with all earlier sets of their groups.
So no match is lost, and no group is expanded into all its pairs.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._marks import FILTER_BITS, among, dense
from ._spark import cut, release

WHITE = "[\\x20\\x09-\\x0D]+"
_GRAM = ("nid", "n", "i", "bits")
#: the rarity class of a word stands in the top byte of its number, its hash below
_CLASS_AT = 56


@dataclass(frozen=True)
class Settings:
    """Least similarity in percent; sketch cells (a power of two); sets beyond which a word's
    group is not joined with itself at once; how many such words are broadcast at most;
    occurrences for each part that the group of a very common word is salted into; bits of the
    filter that picks lines to verify."""

    percent: int = 80
    cells: int = 1 << 20
    common: int = 512
    held: int = 100_000
    hot: int = 100_000
    filter_bits: int = FILTER_BITS


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, WHITE), "")


def _long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _class(count: Column) -> Column:
    """Rarity class: four times the binary logarithm of a count."""
    return F.floor(4 * F.log2(count + 1))


def _rarity(source: DataFrame, settings: Settings) -> DataFrame:
    """One row, one array: the class of each sketch cell, already in its place of a word's number."""
    cell = F.xxhash64("word").bitwiseAND(settings.cells - 1)
    words = source.select(F.explode(F.split("text", WHITE)).alias("word"))
    counts = words.groupBy(cell.alias("id")).agg(F.count(F.lit(1)).alias("n"))
    shifted = F.shiftleft(_class(F.col("n")).cast("long"), _CLASS_AT)
    return dense(source.sparkSession, counts.select("id", shifted.alias("value")), settings.cells)


def _lines(source: DataFrame) -> DataFrame:
    """id, mark (a hash of the text), line number and line of each text."""
    return source.select("id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))


def _digest() -> Column:
    return F.unhex(F.md5("raw"))


def _numbers(ranks: Column, marks: list[Column], settings: Settings) -> Column:
    """The distinct words of a line as numbers (rarity class, then hash), sorted together with ``marks``."""

    def number(h: Column) -> Column:
        rank = F.get(ranks, h.bitwiseAND(settings.cells - 1).cast("int"))
        return rank.bitwiseOR(F.shiftrightunsigned(h, 64 - _CLASS_AT))

    hashes = F.array_distinct(F.transform(words_of(F.col("raw")), lambda w: F.xxhash64(w)))
    return F.sort_array(F.concat(F.transform(hashes, number), F.array(*marks)))


def _parity(words: Column) -> Column:
    """64 bits, each the parity of the words that hash to it.

    Words that two sets share cancel, so their parities differ in at most as many bits
    as the sets differ in words."""

    def flip(a: Column, x: Column) -> Column:
        return a.bitwiseXOR(F.call_function("shiftleft", _long(1), x.bitwiseAND(63).cast("int")))

    return F.aggregate(words, _long(0), flip)


def _quarters(ranks: DataFrame) -> list[int]:
    """Numbers that cut the words of a line, on average, into four parts, from rare to common."""
    total = F.sum(F.pow(F.lit(2.0), F.col("class") / 4))
    rows = ranks.select(F.explode(F.transform("values", lambda v: F.shiftrightunsigned(v, _CLASS_AT))).alias("class")).groupBy("class").agg(total.alias("n")).collect()
    below, cuts, whole = 0.0, [], sum(r["n"] for r in rows)
    for r in sorted(rows, key=lambda r: r["class"]):
        below += r["n"]
        while len(cuts) < 3 and below >= whole * (len(cuts) + 1) / 4:
            cuts.append((r["class"] + 1) << _CLASS_AT)
    return list(dict.fromkeys(cuts))


def _need(percent: int, n: str) -> str:
    """SQL for the least overlap that a set of n words has with any similar one."""
    return f"int(({n} * {percent} + 99) div 100)"


def _may_match(s: Settings) -> Column:
    """Length, positional and parity filter for sets (n, i, bits) and (n_2, i_2, bits_2) that share
    the word at places i and i_2 of their orders.

    The positional filter is that of the first word that two sets share: all others lie
    behind it in both.  A later shared word may fail it, the first does not."""
    p = s.percent
    return F.expr(
        f"100 * least(n, n_2) >= {p} * greatest(n, n_2)"
        f" and least(n - i, n_2 - i_2) >= {_overlap(p)}"
        f" and bit_count(bits ^ bits_2) <= n + n_2 - 2 * {_overlap(p)}"
    )


def _overlap(percent: int) -> str:
    """SQL for the least overlap of similar sets of n and n_2 words."""
    return f"int(({percent} * (n + n_2) + {99 + percent}) div {100 + percent})"


def _place() -> Column:
    """Order of lines: by id, null ids last, then by a hash of the text and by line number."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "mark", "line")


def _folded(source: DataFrame, settings: Settings) -> DataFrame:
    """One row for each different line that has words: nid, digest, place of the first, copies, n, lanes, prefix, bits.

    ``lanes`` are the parities of the rarest quarter of words, the next, and so on; ``bits`` is their sum."""
    ranks = _rarity(source, settings)
    marks = [F.lit(c).cast("long") for c in _quarters(ranks)]
    k = len(marks)
    lines = _lines(source).withColumn("ranks", ranks.scalar())  # one value, inlined into what follows
    lines = lines.select(_place().alias("place"), _digest().alias("digest"), _numbers(F.col("ranks"), marks, settings).alias("t"))
    # in steps, for Spark would compute an array again for each use in one step
    lines = lines.select("*", *(F.array_position("t", m).cast("int").alias(f"p{i}") for i, m in enumerate(marks)))
    ends = [F.lit(0), *(F.col(f"p{i}") for i in range(k)), F.size("t") + 1]
    parts = [F.slice("t", x + 1, y - x - 1).alias(f"a{i}") for i, (x, y) in enumerate(zip(ends, ends[1:], strict=False))]
    lines = lines.select("place", "digest", (F.size("t") - k).alias("n"), *parts)
    every = [f"a{i}" for i in range(k + 1)]
    least = F.expr(f"n - {_need(settings.percent, 'n')} + 1")
    prefix = F.slice(F.concat(*every), F.lit(1), F.when(F.col("n") > 0, least).otherwise(0))
    lines = lines.select("place", "digest", "n", F.array(*map(_parity, every)).alias("lanes"), prefix.alias("prefix"))
    # equal lines have equal n, lanes and prefix, so any of them will do
    folded = lines.groupBy("digest").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("n", "lanes", "prefix")).alias("s")
    )
    bits = F.aggregate("lanes", _long(0), lambda a, x: a.bitwiseXOR(x)).alias("bits")
    folded = folded.select("digest", "place", "copies", "s.*").where("n > 0")
    return cut(folded.select(F.monotonically_increasing_id().alias("nid"), "*", bits))


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row per distinct (id, text): id, mark, n_lines, removed (line numbers from 0).

    Lines are separated by \\n.  A line is removed if an earlier one, by (id, line
    number), has a similar enough set of words, whether that one is removed or not.
    Lines without words stay; null texts have no lines.
    Null ids come last; documents that share an id are ordered by a hash of their
    text.  Rows that repeat id and text count as one document and get one result.
    ``mark`` is that hash, to find the document again.  Texts of any length are read
    whole, and lines of any length; an empty table gives an empty result.  Other columns
    are ignored, whatever their names.  A dozen jobs run before this returns.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    sets = _folded(source, settings)
    release(spark)

    grams = sets.select("nid", "n", "bits", F.posexplode("prefix").alias("i", "word"))
    # a word that the sketch counts once is in no other line
    grams = grams.where(F.shiftrightunsigned("word", _CLASS_AT) > _class(_long(1)))
    large = _large(grams, settings)
    few = cut(_among_small(grams.join(large, "word", "left_anti"), settings))
    release(spark)
    common = grams.join(large, "word", "left_semi").join(sets.select("nid", "place"), "nid")
    few = cut(few.unionByName(_headed(common, settings)).groupBy("nid", "nid_2").agg(F.sum("shared").alias("shared")))
    release(spark)
    gone = _verified(few, sets, source, settings)
    rest = cut(_with_earlier(common, gone, settings))
    release(spark)
    gone = gone.unionByName(_verified(rest, sets, source, settings)).distinct().withColumn("gone", F.lit(True))

    twice = sets.where("copies > 1").select("nid", "digest", "place")
    hit = sets.join(gone, "nid").select("nid", "digest", "place", "gone")
    known = cut(
        twice.join(hit.select("nid"), "nid", "left_anti").withColumn("gone", F.lit(False)).unionByName(hit).select("digest", "place", "gone")
    )
    own = _lines(source).select("id", "mark", "line", _place().alias("own"), _digest().alias("digest"))
    out = (
        own.join(known, "digest")
        .where(F.col("gone") | (F.col("own") != F.col("place")))
        .groupBy("id", "mark")
        .agg(F.sort_array(F.collect_set("line")).alias("removed"))
    )
    counts = source.where("text is not null").select("id", F.xxhash64("text").alias("mark"), F.size(F.split("text", "\n")).alias("n_lines")).distinct()
    out = out.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "removed")
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2"))
    none = F.array().cast("array<int>")
    return counts.join(out, same, "left").select(
        F.col("id").alias(id_col), "mark", "n_lines", F.coalesce("removed", none).alias("removed")
    )


def _second(grams: DataFrame, *more: str) -> DataFrame:
    return grams.select("word", *(F.col(c).alias(f"{c}_2") for c in (*_GRAM, *more)))


def _large(grams: DataFrame, settings: Settings) -> DataFrame:
    """The words of more than ``settings.common`` sets, counted where the sketch does not rule it out.

    Broadcast while they are few, else joined."""
    asked = grams.where(F.shiftrightunsigned("word", _CLASS_AT) >= _class(_long(settings.common)))
    words = cut(asked.groupBy("word").count().where(F.col("count") > settings.common).select("word"))
    return F.broadcast(words) if words.count() <= settings.held else words


def _among_small(grams: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (nid, nid_2) of sets that share a word and may match, and how many such words."""
    dealt = grams.repartition("word")  # one shuffle for both sides
    pairs = dealt.join(_second(dealt), "word").where("nid_2 < nid").where(_may_match(settings))
    return _counted(pairs)


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("nid", "nid_2").agg(F.count(F.lit(1)).alias("shared"))


def _headed(grams: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of each set and the earliest of a word's group, and the two just before it, that may match it.

    A group of a very common word is split by a salt, each part with its own earliest set."""
    parts = F.expr(f"cast(ceil(pow(2D, shiftrightunsigned(word, {_CLASS_AT}) / 4D) / {settings.hot}D) as long)")
    salted = grams.withColumn("salt", F.pmod(F.xxhash64("nid"), F.greatest(_long(1), parts)))
    line = Window.partitionBy("word", "salt").orderBy("place")
    one = F.struct(*_GRAM)
    first = F.first(one).over(line.rowsBetween(Window.unboundedPreceding, 0))
    asked = F.array(first, *(F.lag(one, k).over(line) for k in (1, 2)))
    rows = salted.withColumn("asked", asked).withColumn("other", F.explode(F.array_distinct("asked"))).where("other is not null and other.nid <> nid")
    pairs = rows.select("*", *(F.col(f"other.{c}").alias(f"{c}_2") for c in _GRAM)).where(_may_match(settings))
    return _counted(pairs.select(F.greatest("nid", "nid_2").alias("nid"), F.least("nid", "nid_2").alias("nid_2")))


def _with_earlier(grams: DataFrame, gone: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of each unsettled set and every earlier set of its groups that may match it."""
    pairs = grams.join(gone, "nid", "left_anti").join(_second(grams, "place"), "word").where("place_2 < place").where(_may_match(settings))
    return _counted(pairs)


def _picked(wanted: DataFrame, source: DataFrame, settings: Settings) -> DataFrame:
    """``wanted`` (nid, place) with the distinct words of the lines, by one pass over the texts."""
    asked = F.xxhash64("place.mark", "place.line")
    lines = among(_lines(source), F.xxhash64("mark", "line"), wanted, asked, settings.filter_bits)
    lines = lines.select(F.col("id").alias("lid"), F.col("mark").alias("lmark"), F.col("line").alias("lline"), "raw")
    hit = F.col("lid").eqNullSafe(F.col("place.id")) & (F.col("lmark") == F.col("place.mark")) & (F.col("lline") == F.col("place.line"))
    found = cut(lines.join(wanted, hit).select("nid", F.array_distinct(words_of(F.col("raw"))).alias("words")))
    if found.count() > wanted.count():  # rows that repeat id and text
        found = cut(found.dropDuplicates(["nid"]))
    return found


def _verified(pairs: DataFrame, sets: DataFrame, source: DataFrame, settings: Settings) -> DataFrame:
    """The sets (nid) that are similar enough to an earlier one of their pairs, by their words.

    Each set is first held against the one that shares most words of the prefixes with it,
    which settles most; then the others against all of theirs."""
    if pairs.isEmpty():
        return pairs.select("nid")
    asked = pairs.select("nid").unionByName(pairs.select(F.col("nid_2").alias("nid"))).distinct()
    wanted = cut(asked.join(sets.select("nid", "place", "n", "lanes"), "nid"))
    others = wanted.select(*(F.col(c).alias(f"{c}_2") for c in wanted.columns))
    differ = F.aggregate(F.zip_with("lanes", "lanes_2", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    later = F.col("place_2") < F.col("place")
    ends = [F.when(later, F.col(x)).otherwise(F.col(y)) for x, y in (("nid", "nid_2"), ("nid_2", "nid"))]
    placed = pairs.join(wanted, "nid").join(others, "nid_2").where(differ <= F.expr(f"n + n_2 - 2 * {_overlap(settings.percent)}"))
    placed = cut(placed.select(ends[0].alias("nid"), ends[1].alias("nid_2"), "shared"))
    left = placed.select("nid").unionByName(placed.select(F.col("nid_2").alias("nid"))).distinct()
    words = _picked(cut(wanted.join(left, "nid").select("nid", "place")), source, settings)
    best = placed.groupBy("nid").agg(F.max(F.struct("shared", "nid_2")).alias("m")).select("nid", "m.nid_2")
    gone = _similar(best, words, settings)
    gone = gone.unionByName(_similar(placed.join(gone, "nid", "left_anti").select("nid", "nid_2"), words, settings))
    release(source.sparkSession)
    return gone


def _similar(pairs: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """The sets nid of the pairs whose words are similar enough to those of nid_2."""
    others = words.select(F.col("nid").alias("nid_2"), F.col("words").alias("words_2"))
    both = pairs.join(words, "nid").join(others, "nid_2").withColumn("k", F.size(F.array_intersect("words", "words_2")))
    ok = both.where(f"100 * k >= {settings.percent} * (size(words) + size(words_2) - k)")
    return cut(ok.select("nid").distinct())


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; nothing else changes.

    A text that loses all its lines becomes empty."""
    known = removed.where(F.size("removed") > 0).select(F.col(id_col).alias("__id"), F.col("mark").alias("__mark"), F.col("removed").alias("__removed"))
    hit = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__mark"))
    left = F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains(F.col("__removed"), i))
    text = F.when(F.col("__removed").isNull(), docs[text_col]).otherwise(F.array_join(left, "\n"))
    return docs.join(known, hit, "left").withColumn("__text", text).select(
        *(F.col("__text").alias(c) if c == text_col else docs[c] for c in docs.columns)
    )
