"""Removal of repeated passages by content-defined chunks.

A gear hash rolls over the UTF-8 bytes of a text; where its top bits are zero a chunk ends, if the
chunk has at least ``SHORTEST`` bytes and a character ends there too. So boundaries follow the content and an
insertion moves only those beside it. Chunks are compared by a 128-bit digest. A chunk that also
stands earlier (smaller id, or further up) is a repeat, and a run of neighbouring repeats of at
least ``PASSAGE`` bytes is removed: shorter ones are nearly always everyday phrases, and stay. A text that repeats as a whole
is removed however short it is.

NULL and empty texts have no chunk and come out empty. Rows that repeat an id and a text count as one document
and come out alike; rows that share only the id are ordered by their text's hash. A NULL id comes
first. Other columns are not read. Within a batch only a digest's first chunk is sent
to be compared, so a passage that a third of all documents share meets as one row per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landtrace.llm.common import keyed, outer_id, ship

TOP_BITS = 4
SHORTEST, LONGEST = 16, 256
PASSAGE = 100
GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)
KEY = ["_id", "_v"]


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(data)
    if not n:
        return []
    rolling = GEAR[data]
    for step in (1, 2, 4, 8):  # the sum over 16 bytes, each shifted by its distance
        shifted = rolling.copy()
        shifted[step:] += rolling[:-step] << np.uint16(step)
        rolling = shifted
    starts = np.ones(n + 1, bool)  # a character starts here, or the text ends
    starts[:n] = (data & 0xC0) != 0x80
    ends, at = [], 0
    for end in (np.flatnonzero((rolling >> np.uint16(16 - TOP_BITS) == 0) & starts[1:]) + 1).tolist() + [n]:
        while end - at > LONGEST:
            cut = at + LONGEST
            while not starts[cut]:
                cut -= 1
            ends.append(cut)
            at = cut
        if end - at >= SHORTEST or end == n and end > at:
            ends.append(end)
            at = end
    return ends


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        digests, starts, sizes, owner = [], [], [], []
        for i, text in enumerate(batch.column(2).cast(pa.binary())):
            raw = text.as_py() or b""
            ends = chunk_ends(np.frombuffer(raw, np.uint8))
            begins = [0, *ends[:-1]]
            digests += [digest(raw[a:b]) for a, b in zip(begins, ends)]
            starts += begins[:len(ends)]
            sizes += [b - a for a, b in zip(begins, ends)]
            owner += [i] * len(ends)
        if not digests:
            continue
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        h1, h2 = both[:, 0].copy(), both[:, 1].copy()
        own, start = np.array(owner), np.array(starts, np.int32)
        order = np.lexsort((start, versions[own], ids[own], h2, h1))
        same = np.zeros(len(order), bool)
        same[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        first = order[head]  # of the batch, for each place in the order
        twin = (ids[own[order]] == ids[own[first]]) & (versions[own[order]] == versions[own[first]]) & (start[order] == start[first])
        later = np.empty(len(order), bool)
        later[order] = same & ~twin
        yield pa.RecordBatch.from_arrays([
            pa.array(later), pa.array(np.where(later, own, h1)), pa.array(np.where(later, start, h2)),
            pa.array(ids[own]), pa.array(versions[own]), pa.array(start), pa.array(np.array(sizes, np.int32))],
            ["_later", "_h1", "_h2", "_id", "_v", "_start", "_size"])


def passages(starts, sizes, least: int = PASSAGE) -> list[tuple[int, int]]:
    """Runs of neighbouring repeats that are long enough."""
    runs: list[list[int]] = []
    for a, size in sorted(set(zip(starts, sizes))):
        if runs and runs[-1][1] == a:
            runs[-1][1] = a + size
        else:
            runs.append([a, a + size])
    return [(a, b) for a, b in runs if b - a >= least]


def _keep(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "text": []}
            for raw, repeats in zip(texts, batch.column(2).to_pylist()):
                raw = raw or b""
                places = [r["s"] for r in repeats or ()], [r["n"] for r in repeats or ()]
                spans = passages(*places, least)
                if passages(*places, 1) == [(0, len(raw))]:  # a copy as a whole
                    spans = [(0, len(raw))]
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(b - a for a, b in spans))
                out["n_spans"].append(len(spans))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["text"].append(b"".join(kept).decode())
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")],
                pa.array(out["spans"], spans_type), pa.array(out["text"], pa.string())],
                ["_id", "n_bytes", "n_removed", "n_spans", "spans", "text"])

    return run


def dedup_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = PASSAGE,
) -> DataFrame:
    """Each row's id, bytes, bytes removed, the removed spans and the text that is kept."""
    rows = keyed(docs, id_col, text_col)
    chunks = rows.mapInArrow(
        _chunks, "_later boolean, _h1 long, _h2 long, _id long, _v long, _start int, _size int")
    place = F.struct(*KEY, "_start")
    first = F.first(place).over(Window.partitionBy("_later", "_h1", "_h2").orderBy(*KEY, "_start"))
    repeats = chunks.withColumn("_first", first).filter(F.col("_later") | (place != F.col("_first")))
    spans = repeats.groupBy(*KEY).agg(
        F.collect_list(F.struct(F.col("_start").alias("s"), F.col("_size").alias("n"))).alias("_repeats"))
    out = rows.join(spans, KEY, "left").select("_id", "_text", "_repeats").mapInArrow(
        _keep(least_bytes), "_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, text string")
    return out.select(outer_id().alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", F.col("text").alias(text_col))


ship(__name__)
