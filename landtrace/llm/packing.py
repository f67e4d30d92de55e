"""Packing of token ids into sequences of fixed length by best-fit decreasing.

A document's ids (with the end id) are first cut into full windows; each is a sequence of its
own. What is left is a piece shorter than a window. Pieces are dealt by hash into groups of
about ``GROUP`` pieces, and a group is packed in one task: longest piece first, each into the
open sequence with the least room that still takes it. A segment tree over the room left finds
that sequence in a dozen steps. Every id lies in exactly one piece. The hash takes a piece's id, place and
content; where rows repeat all of that so often that a group gets twice its size, the row's number is added.

NULL and empty texts have only the end id. Repeated rows are packed each. An empty table gives
an empty result. Other columns are not read. A task holds one batch of texts, or one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import outer_id, row_id, settle, ship
from landtrace.llm.tokens import worker_tokenizer

CAPACITY = 4096
END_ID = 2
GROUP = 50_000
PIECE_KEY = ["_id", "start", "ids_crc32", "length"]
PIECES = "_id long, start long, length long, ids_crc32 long, doc_tokens long"


class RoomTree:
    """Open sequences by room left; ``best(n)`` is the least room of at least ``n``."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)  # how many open sequences below a node
        self.at: list[list[int]] = [[] for _ in range(self.width)]

    def _count(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.open[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        self._count(room, 1)

    def take(self, room: int) -> int:
        self._count(room, -1)
        return self.at[room].pop()

    def best(self, need: int) -> int | None:
        node = need + self.width
        if self.open[node]:
            return need
        while node > 1:  # up to the first right neighbour that has something
            if not node & 1 and self.open[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.width:
            node *= 2
            if not self.open[node]:
                node += 1
        return node - self.width


def best_fit_decreasing(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece."""
    lengths = list(lengths)
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    tree, n = RoomTree(capacity), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.best(need)
        if room is None:
            s, room = n, capacity
            n += 1
        else:
            s = tree.take(room)
        sequence[i], offset[i] = s, capacity - room
        if room > need:
            tree.put(room - need, s)
    return sequence, offset


def _pieces_of(path: str, capacity: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()
    window = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                raws: list[bytes] = []
                ids = keys.slice(lo, 512).to_pylist()
                for key, raw in zip(ids, encode(texts.slice(lo, 512).to_pylist())):
                    raw += end
                    total = len(raw) // 4
                    for a in range(0, len(raw), window):
                        part = raw[a:a + window]
                        rows.append((key, a // 4, len(part) // 4, zlib.crc32(part), total))
                        if keep_ids:
                            raws.append(part)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                names = ["_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(r, "<u4").astype("int32") for r in raws], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _place(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in PIECE_KEY])
        sequence, offset = best_fit_decreasing(table.column("length").to_pylist(), capacity)
        group = table.column("_group").to_pylist()
        table = table.append_column("sequence_id", pa.array([g * (1 << 32) + s for g, s in zip(group, sequence)], pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
    text_col: str = "text", group: int = GROUP, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    With ``keep_ids`` the ids themselves come as an array. The pieces are written to the shared
    folder once, so that their number sets the number of groups. ``tokenizer_path`` must be
    readable on the executors.
    """
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    texts = docs.select(row_id(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    pieces = settle(texts.mapInArrow(_pieces_of(tokenizer_path, capacity, end_id, keep_ids), schema))
    groups = max(1, -(-pieces.count() // group))

    def deal(*more: Column) -> DataFrame:
        return pieces.withColumn("_group", F.pmod(F.xxhash64(*PIECE_KEY, *more), F.lit(groups)))

    dealt = deal()
    if (dealt.groupBy("_group").count().agg(F.max("count")).first()[0] or 0) > 2 * group:
        dealt = deal(F.monotonically_increasing_id())
    placed = dealt.groupBy("_group").applyInArrow(
        _place(capacity), schema + ", _group long, sequence_id long, offset long")
    rest = ["ids"] if keep_ids else []
    return placed.select(
        outer_id().alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *rest)


ship(__name__)
