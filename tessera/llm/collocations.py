"""Collocations by contiguous pattern growth over dealt occurrence pointers.

A pointer is an occurrence of a two-word prefix together with the word that follows it in
the piece, if one does.  Tasks read texts, leave out pointers whose prefix has a word that
is not frequent, count equal ones, and send them to the task of their prefix.  There,
pointers sorted by their words are grown to the right: sorting lays the projection of each
prefix side by side, in depth-first order; a frequent prefix passes its pointers on to be
split by the next word, and an infrequent one ends with all that it would lead to.

A prefix of two very frequent words may have more pointers than a task should hold.  Its
pointers are dealt by the third word too; the partial counts of such prefixes are added
after the tasks, everything else is final there.  Two filters of fixed size tell tasks
which words are frequent, and which very frequent; as all tasks share them, a false
positive costs time and nothing else.

Words stand for themselves as 64-bit hashes of word and language.  The whole vocabulary
is checked for words that share a hash; if any do, another hash is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut
from ._words import chunks, mix

#: Bytes that end a piece, and those that end a word.
BREAK = np.zeros(256, bool)
BREAK[[*range(0x0A, 0x0E), *b".,;:!?"]] = True
NOT_WORD = BREAK.copy()
NOT_WORD[[0x20, 0x09]] = True
#: Pointers that are counted together in a reading task; three codes of so many words fit into 63 bits.
BITS = 21
BLOCK = (1 << BITS) - 8
#: Pointers of an average task of prefixes; prefixes that may have four times as many are spread over tasks.
TASK_POINTERS = 1 << 20
#: Bits of each filter.
FILTER_BITS = 1 << 23
#: Ranked lists merge in so many parts before the last merge.
PARTS = 64
_U = np.uint64
_MASK = (1 << BITS) - 1
_SHIFTS = (2 * BITS, BITS, 0)


@dataclass
class Slab:
    """Consecutive words of some documents: their hashes, bytes, documents, and whether the next one is in the same piece."""

    h: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    linked: np.ndarray
    langs: list[str]


def _slabs(batches: Iterator[pa.RecordBatch], salt: int, words: int = BLOCK, strings: bool = True) -> Iterator[Slab]:
    """The words of batches (text, lang, hash of lang), about ``words`` at a time, whole documents each.

    Without ``strings`` a slab has hashes and links only."""
    none, no_bytes = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    held: list[Slab] = []
    for batch in batches:
        langs, marks = batch.column(1).to_pylist(), np.asarray(batch.column(2)).view(_U)
        for w in chunks(batch.column(0), NOT_WORD, lower=True):
            doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.first))
            h = mix(w.hashes() ^ mix(marks[w.lo : w.hi] + _U(salt))[doc], 1)
            piece = np.cumsum(BREAK[w.data], dtype=np.int64)[w.start]
            linked = np.zeros(len(h), bool)
            linked[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
            h = np.maximum(h, _U(1))
            held.append(Slab(h, w.data, w.start, w.end, doc, linked, langs[w.lo : w.hi]) if strings else Slab(h, no_bytes, none, none, none, linked, []))
            if sum(len(s.h) for s in held) >= words:
                full, held = _joined(held), []  # the parts go before the whole is used
                yield full
                del full
    if held:
        full, held = _joined(held), []
        yield full


def _joined(held: list[Slab]) -> Slab:
    byte = np.cumsum([0, *(len(s.data) for s in held)])
    docs = np.cumsum([0, *(len(s.langs) for s in held)])

    def placed(name: str, by: np.ndarray) -> np.ndarray:
        return np.concatenate([getattr(s, name) + k for s, k in zip(held, by, strict=False)])

    h, data, linked = (np.concatenate([getattr(s, x) for s in held]) for x in ("h", "data", "linked"))
    return Slab(h, data, placed("start", byte), placed("end", byte), placed("doc", docs), linked, [x for s in held for x in s.langs])


def _strings(s: Slab, at: np.ndarray) -> pa.Array:
    """The words ``at`` as an Arrow column, gathered in one pass."""
    lo, size = s.start[at], s.end[at] - s.start[at]
    off = np.concatenate(([0], np.cumsum(size)))
    body = s.data[np.arange(off[-1]) + np.repeat(lo - off[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(body)).cast(pa.string())


def _texts(df: DataFrame, text_col: str, lang_col: str, unknown: str) -> DataFrame:
    lang = F.coalesce(df[lang_col].cast("string"), F.lit(unknown))
    return df.select(df[text_col].alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("mark"))


def vocabulary(texts: DataFrame, salt: int) -> DataFrame:
    """(h, lang, word, n): every word of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slabs(batches, salt):
            h, at, n = np.unique(s.h, return_index=True, return_counts=True)
            langs = pa.array([s.langs[d] for d in s.doc[at].tolist()], pa.string())
            columns = [pa.array(h.view(np.int64)), langs, _strings(s, at), pa.array(n.astype(np.int64))]
            for lo in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 1 << 16) for c in columns], ["h", "lang", "word", "n"])

    rows = texts.mapInArrow(count, "h long, lang string, word string, n long")
    return rows.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def _filter(words: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of fixed size over the hashes ``h`` of ``words``, as bytes; when it is full it lets every word pass."""
    at = F.col("h").bitwiseAND(bits - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    lanes = words.groupBy(F.shiftright(at, 6).cast("int").alias("lane")).agg(F.bit_or(bit).alias("v")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[np.asarray(lanes["lane"])] = np.asarray(lanes["v"])
    return out.view(_U)


def _passes(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & _U(len(held) * 64 - 1)
    return (held[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) != 0


def _packed(u: np.ndarray, key: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Pointers as a dictionary of hashes, codes of the smallest width, and counts."""
    codes = [(key >> s) & _MASK for s in _SHIFTS]
    used, at = np.unique(np.concatenate(codes), return_inverse=True)
    wide = np.uint16 if len(used) < 1 << 16 else np.uint32
    many = np.uint8 if n.max() < 256 else np.int64
    return [u[used].tobytes(), at.astype(wide).tobytes(), n.astype(many).tobytes()]


def _unpacked(words: bytes, codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = np.frombuffer(words, _U)
    at = np.frombuffer(codes, np.uint16 if len(u) < 1 << 16 else np.uint32)
    n = len(at) // 3
    return u, at.reshape(3, n), np.frombuffer(counts, np.uint8 if len(counts) == n else np.int64)


def pointers(texts: DataFrame, salt: int, frequent: np.ndarray, hot: np.ndarray, parts: int) -> DataFrame:
    """(part, words, codes, counts): counted pointers, packed for each part and block of a reading task.

    A part has all pointers of a prefix, and of a spread prefix all that continue with one word."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slabs(batches, salt, strings=False):
            often = _passes(frequent, s.h)
            able = np.zeros(len(s.h) + 2, bool)
            able[: len(often)][:-1] = s.linked[:-1] & often[:-1] & often[1:]
            for lo in range(0, len(s.h), BLOCK):
                i = lo + np.flatnonzero(able[lo : min(lo + BLOCK, len(s.h))])
                if not len(i):
                    continue
                u, code = np.unique(s.h[lo : lo + BLOCK + 2], return_inverse=True)
                u, code = np.concatenate(([_U(0)], u)), code + 1
                third = np.where(able[i + 1], code[np.minimum(i + 2 - lo, len(code) - 1)], 0)
                key, n = np.unique((code[i - lo] << _SHIFTS[0]) | (code[i + 1 - lo] << _SHIFTS[1]) | third, return_counts=True)
                a, b, c = (u[(key >> x) & _MASK] for x in _SHIFTS)
                spread = _passes(hot, a) & _passes(hot, b)
                part = (mix(mix(a) + b + np.where(spread, mix(c, 1), _U(0))) % _U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                key, n, part = key[order], n[order], part[order]
                cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
                rows = [(int(part[x]), *_packed(u, key[x:y], n[x:y])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("words", "codes", "counts"))])
    return texts.mapInArrow(deal, "part int, words binary, codes binary, counts binary")


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The pointers of a part, sorted by their words and counted: three columns of hashes, and counts."""
    rows = [_unpacked(*x) for x in zip(*(table[c].to_pylist() for c in ("words", "codes", "counts")), strict=True)]
    u = np.unique(np.concatenate([r[0] for r in rows]))
    a, b, c = np.concatenate([np.searchsorted(u, r[0])[r[1]] for r in rows], axis=1)
    n = np.concatenate([r[2].astype(np.int64) for r in rows])
    if len(u) <= _MASK:
        key = (a << _SHIFTS[0]) | (b << _SHIFTS[1]) | c
        order = np.argsort(key)
    else:
        order = np.lexsort((c, b, a))
    return [u[x[order]] for x in (a, b, c)], n[order]


def _grown(columns: list[np.ndarray], n: np.ndarray, least: int, spread: np.ndarray, depth: int = 2) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Phrases of ``depth`` words and more with their counts, and whether these are partial.

    Pointers are sorted, so each prefix of ``depth`` words is a run.  A run goes on to the next
    word if its count is frequent (or partial, when nothing is known yet)."""
    if not len(n):
        return
    head = columns[:depth]
    start = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in head], axis=0))))
    total = np.add.reduceat(n, start)
    partial = spread[start] if depth == 2 else np.zeros(len(start), bool)
    ok = (total >= least) | partial
    yield [c[start[ok]] for c in head], total[ok], partial[ok]
    if depth < len(columns):
        alive = np.repeat(ok, np.diff(start, append=len(n))) & (columns[depth] != 0)
        yield from _grown([c[alive] for c in columns], n[alive], least, spread[alive], depth + 1)


def grow(dealt: DataFrame, least: int, hot: np.ndarray) -> DataFrame:
    """(a, b, c, n, partial): frequent phrases, c = 0 in those of two words."""

    def task(table: pa.Table) -> pa.Table:
        columns, n = _merged(table)
        spread = _passes(hot, columns[0]) & _passes(hot, columns[1])
        found = []
        for head, count, partial in _grown(columns, n, least, spread):
            third = head[2] if len(head) > 2 else np.zeros(len(count), _U)
            found.append(pa.table([*(pa.array(x.view(np.int64)) for x in (*head[:2], third)), pa.array(count), pa.array(partial)], names=names))
        return pa.concat_tables(found)

    names = ["a", "b", "c", "n", "partial"]
    rows = dealt.groupBy("part").applyInArrow(task, "a long, b long, c long, n long, partial boolean")
    added = rows.where("partial").groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return rows.where("not partial").select("a", "b", "c", "n").unionByName(added)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts below 10^16."""
    a, left, right = (x.cast("decimal(18,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def phrases(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (h, lang, word, n), frequent phrases (a, b, c, n), and the words of each language (lang, n)."""
    for salt in range(16):
        words = cut(vocabulary(texts, salt))
        if words.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            break
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least)
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = _filter(words.where(F.col("n") >= 4 * TASK_POINTERS))
    dealt = pointers(texts, salt, _filter(often), hot, max(1, -(-total // TASK_POINTERS)))
    return often, cut(grow(dealt, least, hot)), totals


def collocations(
    df: DataFrame,
    least: int = 10,
    top: int = 2_000,
    percent: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    unknown: str = "und",
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the two parts of its lowest-scoring cut (of equal scores the
    first), n all words of the language.  A phrase inside a longer one that is also frequent
    and has ``percent`` of its count is left out.  The jobs up to the frequent phrases run
    before this returns; their results are kept in the shared folder.

    * Null and empty texts have no words; a null language is ``unknown``.
    * Very long texts are read whole; a task's memory follows its longest text.
    * Repeated rows count as often as they stand there.
    * Ties order by count and then by the phrase's bytes, so ranks are unique.
    * An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    words, found, totals = phrases(_texts(df, text_col, lang_col, unknown), least)

    def named(rows: DataFrame, key: str, suffix: str) -> DataFrame:
        w = words.select(F.col("h").alias(key), F.col("word").alias(f"w{suffix}"), F.col("n").alias(f"n{suffix}"), F.col("lang").alias(f"lang{suffix}"))
        return rows.join(w, key)

    pairs, triples = found.where("c = 0").select("a", "b", "n"), found.where("c <> 0")
    inner = F.inline(F.array(F.struct(F.col("a"), F.col("b"), F.col("n").alias("by")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("n").alias("by"))))
    cover = triples.select(inner).groupBy("a", "b").agg(F.max("by").alias("by"))
    two = pairs.join(cover, ["a", "b"], "left").where(F.coalesce(100 * F.col("by") < percent * F.col("n"), F.lit(True))).drop("by")
    two = named(named(two, "a", "1"), "b", "2").select(F.col("lang1").alias("lang"), F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"))
    two = two.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))

    three = triples.join(pairs.select("a", "b", F.col("n").alias("n12")), ["a", "b"])
    three = three.join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n23")), ["b", "c"])
    three = named(named(named(three, "a", "1"), "b", "2"), "c", "3")
    ways = [F.struct(score(F.col("n"), x, y).alias("score"), F.lit(k).alias("k"), x.alias("l"), y.alias("r")) for k, x, y in ((1, F.col("n1"), F.col("n23")), (2, F.col("n12"), F.col("n3")))]
    three = three.select(F.col("lang1").alias("lang"), F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), F.least(*ways).alias("cut"))
    three = three.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
