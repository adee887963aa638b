"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least ``percent`` of its distinct word
shingles occur there.  Banded MinHash cannot find that in long documents (an item
of 40 words inside 20,000 has Jaccard similarity 0.002), so each item keeps a
bottom-k MinHash sketch of the size that its own size calls for, and the share of
the sketch that a document holds is an estimate of the item's containment.  Of an
item's q shingles a document that contains it lacks at most ``q - need``; so with a
sketch of ``2 (q - need) + 1`` values, at least half of them are hit, and asking for
that many misses nothing.  Items are partitioned by size; a partition is only asked
of documents with enough shingles to contain its smallest item.
Candidates are verified at once on the full shingle sets of document and item.

Items come to the executors in blocks of bounded size, each by one pass over the
documents; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._words import NOT_ALNUM, Words, chunks, grams

_U = np.uint64
BLOCK_CHARS = 8_000_000
_FILTER_BITS = 20


@dataclass
class SizeClass:
    """Sketches of the items of one size class: sorted hashes, whose they are, and how many
    of an item's must be hit; ``least``: shingles of the smallest document that can contain one."""

    least: int
    probes: np.ndarray
    owner: np.ndarray
    members: np.ndarray
    hits: np.ndarray

    def likely(self, hashes: np.ndarray) -> list[int]:
        """Items of which enough of the sketch is among the distinct hashes of one document."""
        lo, hi = np.searchsorted(self.probes, hashes), np.searchsorted(self.probes, hashes, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        found = np.bincount(np.concatenate([self.owner[a:b] for a, b in zip(lo[hit].tolist(), hi[hit].tolist(), strict=True)]), minlength=len(self.members))
        return self.members[found >= self.hits].tolist()


class Items:
    """Shingle sets and sketches of a block of items."""

    def __init__(self, ids: list, texts: list[str | None], shingle: int, percent: int):
        self.ids, self.shingle = ids, shingle
        self.sets: list[np.ndarray] = []
        for words in chunks(pa.array(texts, pa.large_string()), NOT_ALNUM, lower=True):
            self.sets += list(document_sets(words, shingle))
        size = np.array([len(s) for s in self.sets], np.int64)
        self.need = -(-size * percent // 100)
        by_class: dict[int, list[int]] = {}
        for i, q in enumerate(size.tolist()):
            if q:
                by_class.setdefault(q.bit_length(), []).append(i)
        self.classes = []
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        for _, group in sorted(by_class.items()):
            members = np.array(group, np.int64)
            spare = size[members] - self.need[members]
            length = np.minimum(size[members], 2 * spare + 1)
            sketch = [np.sort(self.sets[i])[:m] for i, m in zip(group, length.tolist(), strict=True)]
            probes = np.concatenate(sketch)
            owner = np.repeat(np.arange(len(group)), length)
            order = np.argsort(probes, kind="stable")
            self.classes.append(SizeClass(int(self.need[members].min()), probes[order], owner[order], members, length - spare))
            self.seen[(probes >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def fitting(self, size: int) -> list[SizeClass]:
        """The size classes that have an item which a document of so many shingles can contain."""
        return [c for c in self.classes if size >= c.least]

    def contained(self, hits: np.ndarray, whole: np.ndarray) -> list[tuple[int, int]]:
        """(item, common shingles) of the items contained in a document.

        hits: its shingles that pass the filter; whole: all its distinct shingles."""
        out = []
        for c in self.fitting(len(whole)):
            for i in c.likely(hits):
                both = len(np.intersect1d(self.sets[i], whole, assume_unique=True))
                if both >= self.need[i]:
                    out.append((i, both))
        return sorted(out)


def document_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each document; fewer than k words are one shingle."""
    h = words.hashes()
    g = grams(h, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        else:
            yield grams(h[a:b], b - a, salt=1) if b > a else np.zeros(0, _U)


def _search(held, listed: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = held.value
        for batch in batches:
            found: list[list[dict]] = []
            for words in chunks(batch.column(1), NOT_ALNUM, lower=True):
                h = words.hashes()
                g = grams(h, items.shingle)
                hot = np.flatnonzero(items.seen[(g >> _U(64 - _FILTER_BITS)).astype(np.int64)])
                first = words.first
                lo = np.searchsorted(hot, first[:-1]).tolist()
                hi = np.searchsorted(hot, np.maximum(first[1:] - items.shingle + 1, first[:-1])).tolist()
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b - a >= items.shingle:
                        hits = g[hot[lo[i] : hi[i]]]
                        whole = np.unique(g[a : b - items.shingle + 1]) if len(hits) else hits
                    else:
                        hits = whole = grams(h[a:b], b - a, salt=1) if b > a else g[:0]
                    pairs = items.contained(np.unique(hits), whole) if len(hits) else []
                    found.append([{"item": items.ids[i], "common": n, "of": len(items.sets[i])} for i, n in pairs])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns) if i != 1), pa.array(found, listed)],
                [*(n for i, n in enumerate(batch.schema.names) if i != 1), "hits"],
            )

    return run


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document: id, hits; hits lists (item, common, of) by item id.

    Words are runs of letters and digits, A-Z lower-cased, so case and punctuation
    do not matter.  Texts of fewer than ``shingle`` words are one shingle, which
    only an equally short text can contain; texts without words contain and match
    nothing.  Item ids keep their type; null ones are ignored, and an item id that
    stands on several rows gives a hit for each row that matches.  Repeated documents
    repeat the result.  Texts of any length are read whole; without documents the
    result is empty, without items every list of hits is.  Other columns of both
    tables are ignored, whatever their names.
    """
    spark = docs.sparkSession
    known = items.select(items[item_col].alias("id"), items[item_text_col].alias("text")).where(
        "id is not null and text is not null"
    )
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    item = known.schema["id"].dataType
    listed = f"array<struct<item: {item.simpleString()}, common: bigint, of: bigint>>"
    hits, arrow = f"hits {listed}", pa.list_(pa.struct([("item", to_arrow_type(item)), ("common", pa.int64()), ("of", pa.int64())]))
    if blocks == 1:
        found = rows.mapInArrow(_search(_held(spark, known, shingle, percent), arrow), f"id {kind}, {hits}")
    else:
        keyed = rows.select("id", "text", F.sha2("text", 256).alias("sha"))
        found = keyed.select("id", "sha")
        parts = None
        for b in range(blocks):
            block = known.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == b)
            part = keyed.mapInArrow(_search(_held(spark, block, shingle, percent), arrow), f"id {kind}, sha string, {hits}")
            part = part.where(F.size("hits") > 0).distinct()
            parts = part if parts is None else parts.unionByName(part)
        merged = parts.groupBy("id", "sha").agg(F.flatten(F.collect_list("hits")).alias("hits"))
        same = found["id"].eqNullSafe(merged["id"]) & found["sha"].eqNullSafe(merged["sha"])
        empty = F.array().cast(listed)
        found = found.join(merged, same, "left").select(found["id"], F.coalesce(merged["hits"], empty).alias("hits"))
    return found.select(F.col("id").alias(id_col), F.sort_array("hits").alias("hits"))


def _held(spark, known: DataFrame, shingle: int, percent: int):
    """A block of items at the executors; its size is bounded by ``block_chars``."""
    rows = sorted(known.collect(), key=lambda r: (r["id"], r["text"]))
    return spark.sparkContext.broadcast(Items([r["id"] for r in rows], [r["text"] for r in rows], shingle, percent))


def contaminated(df: DataFrame) -> DataFrame:
    """Rows of ``contained_items`` as id, contaminated, n_items, item_ids, best_item_id, best_share.

    Of equal shares the smallest item id is the best one."""
    share = F.transform("hits", lambda h: F.struct((-h["common"] / h["of"]).alias("less"), h["item"].alias("item")))
    best = F.array_min(share)
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    return df.select(
        *[c for c in df.columns if c != "hits"],
        (F.size("hits") > 0).alias("contaminated"),
        F.size(ids).cast("long").alias("n_items"),
        F.array_join(ids.cast("array<string>"), ",").alias("item_ids"),
        best["item"].alias("best_item_id"),
        F.round(-best["less"], 6).alias("best_share"),
    )
