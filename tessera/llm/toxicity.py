"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed bytes with
word edges marked), a segment of some 16 words is the mean of its words, and a
linear softmax over that mean gives the odds of label 1.  A document scores as
its most toxic segment, so a few words weigh the same in a short note and in a
book.  Embeddings and softmax are trained jointly in numpy by gradient steps with
momentum, each array's step scaled by its largest recent gradient, the loss
being taken at each document's currently highest segment.  Since a misspelt or
inflected word shares most n-grams with the words seen, it shares their score.

Training uses a bounded sample of labelled rows in one task of an executor; the
driver only sees the trained model, one fixed-size table (2**18 floats) whatever
the corpus.  Scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._words import WHITE, Words, chunks

_U32 = np.uint32
SIZES = (3, 4, 5)
BUCKET_BITS = 18
_BLOCK = 1 << 19


@dataclass(frozen=True)
class Settings:
    """Bounds and hyperparameters.  Training takes at most ``most`` labelled ids of each
    class, the first in the order of a hash among those with a text of at most ``longest``
    characters, and one such text of each; so its memory is bounded.  All texts are scored.
    N-grams that are seen fewer than ``least`` times in training are left out."""

    most: int = 2000
    longest: int = 12_000
    segment: int = 16
    dim: int = 4
    least: int = 6
    rounds: int = 90
    warm: int = 30
    rates: tuple[float, float, float] = (2.0, 0.05, 0.2)
    decay: float = 1e-7
    seed: int = 7


@dataclass
class Padded:
    """Words of some documents, each behind one space, and their n-gram buckets."""

    data: np.ndarray
    lead: np.ndarray

    @classmethod
    def of(cls, words: Words) -> Padded:
        size = words.end - words.start
        n = len(size)
        total = int(size.sum())
        out = np.full(total + n + 8, 0x20, np.uint8)
        lead = np.zeros(n, np.int64)
        np.cumsum(size[:-1] + 1, out=lead[1:])
        word = np.repeat(np.arange(n), size)
        out[np.arange(total) + word + 1] = words.data[np.repeat(words.start - lead, size) + np.arange(total) + word]
        return cls(out, lead)

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n-gram size: (bucket, valid) of the n-gram that starts at each place."""
        n = len(self.data) - 7
        space = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(self.data == 0x20, out=space[1:])
        h = np.zeros(n, _U32)
        wide = self.data.astype(_U32)
        for k in range(1, max(SIZES) + 1):
            h = h * _U32(16777619) + wide[k - 1 : k - 1 + n] + _U32(1)
            if k in SIZES:
                mixed = (h ^ (h >> _U32(15))) * _U32(2654435761)
                yield mixed >> _U32(32 - BUCKET_BITS), space[k - 1 : k - 1 + n] == space[1 : n + 1]


def segments(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment starts (in words), and the first segment of each document that has words."""
    n = np.diff(first)
    has = n > 0
    count = np.maximum(1, (n[has] + size // 2) // size)
    at = np.zeros(len(count), np.int64)
    np.cumsum(count[:-1], out=at[1:])
    k = np.arange(int(count.sum())) - np.repeat(at, count)
    return np.repeat(first[:-1][has], count) + k * np.repeat(n[has], count) // np.repeat(count, count), at


@dataclass
class Model:
    """``weight`` has each bucket's embedding times the softmax's difference of classes."""

    weight: np.ndarray
    bias: float
    segment: int

    def words(self, padded: Padded) -> np.ndarray:
        total = np.zeros(len(padded.data) - 7)
        count = np.zeros(len(total), np.int32)
        for bucket, ok in padded.buckets():
            total += self.weight[bucket] * ok
            count += ok
        return np.add.reduceat(total, padded.lead) / np.maximum(np.add.reduceat(count, padded.lead), 1)

    def score(self, column: pa.Array) -> np.ndarray:
        """A score of each text; texts without words get that of an empty bag."""
        out = np.full(len(column), self.bias)
        for words in chunks(column, WHITE, lower=True):
            if not len(words.start):
                continue
            value = self.words(Padded.of(words))
            start, at = segments(words.first, self.segment)
            mean = np.add.reduceat(value, start) / np.diff(np.append(start, len(value)))
            has = np.flatnonzero(np.diff(words.first) > 0)
            out[words.lo + has] = self.bias + np.maximum.reduceat(mean, at)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _sums(values: np.ndarray, take: np.ndarray, share: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``values[take] * share`` between starts, some blocks at a time to bound memory."""
    out = np.empty((len(start), values.shape[1]), np.float32)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + _BLOCK)))
        a, b = int(start[lo]), int(start[hi]) if hi < len(start) else len(take)
        out[lo:hi] = np.add.reduceat(values[take[a:b]] * share[a:b, None], start[lo:hi] - a)
        lo = hi
    return out


class _Bags:
    """Means of rows by a ragged index, and their gradient back to the rows.

    Entries are ordered by bag; ``share`` is what each counts in its bag's mean."""

    def __init__(self, ids: np.ndarray, bag: np.ndarray, share: np.ndarray, bags: int):
        self.ids, self.share, self.bags = ids.astype(np.int32, copy=False), share.astype(np.float32, copy=False), bags
        self.start = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        self.has = bag[self.start]
        order = np.argsort(ids, kind="stable").astype(np.int32)
        back = self.ids[order]
        self.cuts = np.flatnonzero(np.append(True, back[1:] != back[:-1]))
        self.used = back[self.cuts]
        del back
        self.back_bag, self.back_share = bag.astype(np.int32, copy=False)[order], self.share[order]

    def mean(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.bags, values.shape[1]), np.float32)
        out[self.has] = _sums(values, self.ids, self.share, self.start)
        return out

    def back(self, grad: np.ndarray, rows: int) -> np.ndarray:
        """Gradient of the rows, given that of the bags' means."""
        out = np.zeros((rows, grad.shape[1]), np.float32)
        out[self.used] = _sums(grad, self.back_bag, self.back_share, self.cuts)
        return out


class _Vocabulary:
    """The words of the training texts: number of each token, tokens of each text, n-grams of each word."""

    def __init__(self, texts: list[str], least: int):
        parts = list(chunks(pa.array(texts, pa.large_string()), WHITE, lower=True))
        count = np.concatenate([np.diff(w.first) for w in parts]) if parts else np.zeros(0, np.int64)
        self.has = count > 0
        self.first = np.concatenate(([0], np.cumsum(count[self.has])))
        hashes = np.concatenate([w.hashes() for w in parts]) if parts else np.zeros(0, np.uint64)
        _, at, token = np.unique(hashes, return_index=True, return_inverse=True)
        order = np.argsort(at)  # words in order of first occurrence
        rank = np.empty(len(at), np.int32)
        rank[order] = np.arange(len(at), dtype=np.int32)
        self.token, at = rank[token], at[order]
        self.size = len(at)
        self.padded: list[tuple[int, Padded]] = []
        base = done = 0
        for w in parts:
            new = at[done : int(np.searchsorted(at, base + len(w.start)))] - base
            if len(new):
                self.padded.append((done, Padded.of(Words(0, 1, w.data, w.start[new], w.end[new], np.array([0, len(new)])))))
            done += len(new)
            base += len(w.start)
        often = np.bincount(self.token, minlength=self.size)
        seen, whole = np.zeros(1 << BUCKET_BITS), np.zeros(self.size)
        for bucket, owner in self._pieces():
            seen += np.bincount(bucket, often[owner], 1 << BUCKET_BITS)
            whole += np.bincount(owner, minlength=self.size)
        ids, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for pieces in self._by_chunk():
            bucket, owner = (np.concatenate(x) for x in zip(*((b[k], o[k]) for b, o in pieces for k in [seen[b] >= least]), strict=True))
            order = np.argsort(owner, kind="stable")
            ids.append(bucket[order])
            owners.append(owner[order])
        ids, self.owner = np.concatenate(ids), np.concatenate(owners)
        self.padded, owners = [], []
        self.used = np.flatnonzero(np.bincount(ids, minlength=1 << BUCKET_BITS))
        rank = np.zeros(1 << BUCKET_BITS, np.int32)
        rank[self.used] = np.arange(len(self.used))
        self.ids = rank[ids]
        self.share = (1 / whole)[self.owner].astype(np.float32)

    def _by_chunk(self) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
        for base, padded in self.padded:
            owner = np.repeat(
                np.arange(len(padded.lead), dtype=np.int32) + base, np.diff(np.append(padded.lead, len(padded.data) - 7))
            )
            yield ((bucket[ok].astype(np.int32), owner[ok]) for bucket, ok in padded.buckets())

    def _pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for pieces in self._by_chunk():
            yield from pieces


def train(texts: Iterable[str], labels: Iterable[int], settings: Settings = Settings()) -> Model:
    """Fit on texts with labels 0/1; without both classes the score is the share of 1."""
    texts, y = list(texts), np.asarray(list(labels), float)
    share = float(y.mean()) if len(y) else 0.0
    known = _Vocabulary(texts, settings.least)
    y = y[known.has]
    if not len(y) or y.min() == y.max() or not len(known.used):
        edge = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(edge / (1 - edge))), settings.segment)
    used, token, size = known.used, known.token, known.size
    grams = _Bags(known.ids, known.owner, known.share, size)
    start, first = segments(known.first, settings.segment)
    del known
    length = np.diff(np.append(start, len(token)))
    pieces = np.diff(np.append(first, len(start)))
    doc = np.repeat(np.arange(len(y)), pieces)
    piece = np.repeat(np.arange(len(start)), length)
    tokens = _Bags(token, piece, 1 / length[piece], len(start))

    rng = np.random.default_rng(settings.seed)
    table = rng.normal(0, 0.02, (len(used), settings.dim)).astype(np.float32)
    soft = rng.normal(0, 1, (settings.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    speed = [np.zeros_like(p) for p in (table, soft, bias)]
    scale = [0.0, 0.0, 0.0]
    for step in range(1, settings.rounds + 1):
        vectors = grams.mean(table)
        middle = tokens.mean(vectors)
        odds = middle @ (soft[:, 1] - soft[:, 0])
        if step <= settings.warm:  # all segments alike, to find first words
            take, w = np.arange(len(start)), 1 / pieces[doc]
        else:
            top = np.maximum.reduceat(odds, first)
            hit = np.flatnonzero(odds >= top[doc])
            take, w = hit[np.unique(doc[hit], return_index=True)[1]], np.ones(len(y))
        logit = middle[take] @ soft + bias
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(take)), y[doc[take]].astype(int)] -= 1
        p *= (balance[doc[take]] * w)[:, None]
        grad = np.zeros_like(middle)
        grad[take] = p @ soft.T
        grads = [
            grams.back(tokens.back(grad, size), len(used)) + settings.decay * table,
            middle[take].T @ p + settings.decay * soft,
            p.sum(0),
        ]
        slow = min(1.0, 1.5 * (1 - (step - 1) / settings.rounds))
        # one step size for each array and not for each number: what many documents share moves most
        for i, (value, g) in enumerate(zip((table, soft, bias), grads, strict=True)):
            scale[i] = max(0.9 * scale[i], float(np.abs(g).max()), 1e-12)
            speed[i] = 0.8 * speed[i] + g / scale[i]
            value -= settings.rates[i] * slow * speed[i]
    weight = np.zeros(1 << BUCKET_BITS, np.float32)
    weight[used] = table @ (soft[:, 1] - soft[:, 0])
    prior = np.log(y.sum() / (len(y) - y.sum()))  # the loss weighs both classes alike; scores follow their shares
    return Model(weight, float(bias[1] - bias[0] + prior), settings.segment)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most 2 * settings.most rows (id, text, label); each labelled id counts once, with its
    highest label and, where several rows share it, with the text of least hash."""
    known = (
        labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull())
        .groupBy(labels[id_col].alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where(
        F.col("text").isNotNull() & (F.length("text") <= settings.longest)
    )
    usable = known.join(texts.select("id"), "id", "left_semi")
    chosen = None
    for label in (0, 1):
        rows = usable.where(f"label = {label}").orderBy(F.xxhash64("id"), "id").limit(settings.most)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    found = texts.join(F.broadcast(cut(chosen)), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("one")
    return found.groupBy("id", "label").agg(one).select("id", "one.text", "label")


def _fit(settings: Settings):
    """One row (weight, bias) from all rows (id, text, label) of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        if rows:
            model = train([r[1] for r in rows], [r[2] for r in rows], settings)
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weight", "bias"]
            )

    return run


def fitted(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of the bounded rows (id, text, label), trained in one task of an executor."""
    found = rows.coalesce(1).mapInArrow(_fit(settings), "weight binary, bias double").first()
    if found is None:
        return train([], [], settings)
    return Model(np.frombuffer(found["weight"], np.float32), found["bias"], settings.segment)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    score_col: str = "toxicity",
    settings: Settings = Settings(),
    training_docs: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with a score from 0 to 1, higher when label 1 is likelier.

    Every row of ``docs`` is scored, whole texts; labels belong to the texts of
    ``training_docs`` (by default ``docs``).  Null, empty and white texts
    get the score of an empty bag; without labels of both classes all scores are
    the share of label 1 (0 without labels).  Repeated rows repeat the score.
    An empty table gives an empty result.  A column named ``score_col`` is replaced,
    all others pass through.
    """
    rows = training_rows(docs if training_docs is None else training_docs, labels, settings, id_col, text_col, label_col)
    model = fitted(rows.select("id", "text", "label"), settings)
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.segment))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(Model(*held.value).score(text))

    return docs.withColumn(score_col, score(docs[text_col]))
