"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted.  Pieces are placed in falling order of
size, each into the open bin that it leaves least room in (best fit).  If none has
room, a bin of the size with the least cost per token is opened, the tokens being
those that a bin of that size would take: its first piece and, largest first, the
pieces still to be placed that fit.
In the end every bin shrinks to the least permitted length that holds its
contents.

Packing is sequential, so pieces are dealt evenly over shards of bounded size by
a row number, whatever their ids or texts; each shard is packed by itself, and
only lengths travel, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut


@dataclass(frozen=True)
class Lengths:
    """Permitted sequence lengths in tokens, the fixed cost of a sequence, and pieces of a shard."""

    permitted: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    overhead: int = 64
    shard: int = 5000

    def cost(self, capacity: int) -> int:
        return capacity + self.overhead


def pack(sizes: Sequence[int], lengths: Lengths = Lengths()) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and each bin's capacity.

    Sizes are from 0 to the largest permitted length."""
    permitted = sorted(lengths.permitted)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    falling = [-sizes[i] for i in order]
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    filled: list[int] = []
    room: list[tuple[int, int]] = []  # (free tokens, bin), sorted
    for place, i in enumerate(order):
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b = len(filled)
            filled.append(0)
            free = min(
                (c for c in permitted if c >= size),
                key=lambda c: (lengths.cost(c) / max(1, _would_take(falling, place, c)), c),
            )
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if free > size:
            insort(room, (free - size, b))
    return bins, offsets, [next(c for c in permitted if c >= f) for f in filled]


def _would_take(falling: list[int], place: int, capacity: int) -> int:
    """Tokens in a bin that opens with the piece at ``place`` and then takes the largest that fit.

    ``falling`` has the negated sizes in order."""
    free, at = capacity + falling[place], place + 1
    while free > 0:
        at = bisect_left(falling, -free, at)
        if at >= len(falling) or not falling[at]:
            break
        free += falling[at]
        at += 1
    return capacity - free


def word_tokens(text: Column) -> Column:
    """Length of a text in words, plus one separator."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return words.cast("long") + 1


def _pack_shard(lengths: Lengths):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        bins, offsets, capacity = pack(table["size"].to_pylist(), lengths)
        at = np.asarray(bins, np.int64)
        shard = table["shard"][0].as_py()
        return pa.table(
            {
                "id": table["id"],
                "piece": table["piece"],
                "size": table["size"],
                "bin": pa.array((shard << 24) + at),
                "capacity": pa.array(np.asarray(capacity, np.int64)[at]),
                "offset": pa.array(np.asarray(offsets, np.int64)),
            }
        )

    return run


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, text_col: str = "text", lengths: Lengths = Lengths()
) -> DataFrame:
    """One row per piece: id, piece, n_tokens, bin_id, capacity, bin_offset.

    ``tokens`` is a document's length (null: 0), by default its words and one
    separator.  A document longer than the largest permitted length is cut into
    pieces of that length and a rest, numbered from 0; every other document is
    one piece, also an empty one.  Nothing is dropped; rows that repeat an id are
    packed like others.  Pieces of a bin do not overlap and end within its
    capacity, which is the least permitted one for its contents.
    """
    size = F.coalesce((word_tokens(df[text_col]) if tokens is None else tokens).cast("long"), F.lit(0).cast("long"))
    rows = cut(df.select(df[id_col].alias("id"), size.alias("n"), F.monotonically_increasing_id().alias("row")))
    most = max(lengths.permitted)
    pieces = rows.select(
        "id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / most)).cast("long"))).alias("piece")
    ).select("id", "row", "piece", F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("size"))
    count = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / most)))).first()[0] or 0
    shards = max(1, -(-int(count) // lengths.shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards).cast("long")))
    kind = rows.schema["id"].dataType.simpleString()
    packed = dealt.groupBy("shard").applyInArrow(
        _pack_shard(lengths), f"id {kind}, piece long, size long, bin long, capacity long, offset long"
    )
    return packed.select(
        F.col("id").alias(id_col),
        "piece",
        F.col("size").alias("n_tokens"),
        F.col("bin").alias("bin_id"),
        "capacity",
        F.col("offset").alias("bin_offset"),
    )
