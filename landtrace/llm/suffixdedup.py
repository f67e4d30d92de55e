"""Removal of every byte below a 100-byte string that also starts earlier, exactly.

Suffix arrays find the repeated strings; what goes into one is chosen so that equal strings always
meet. The smallest hash among the 32-byte pieces of a 100-byte window is the window's anchor. Neighbouring
windows with the same anchor form a segment, and equal windows lie in segments with equal
anchors. So:

1. texts are cut into segments, of which anchor, digest and place are shuffled by anchor;
2. an anchor with one segment has no repeat. Equal segments keep the first and mark the others;
3. the bytes of segments that share an anchor with a different one are fetched, shards of such
   segments get a suffix array by induced sorting with permuted common prefixes, and of the windows
   that share 100 bytes all but the first are marked;
4. the marks of a document are united and its other bytes are kept.

Within a batch equal segments are marked before the shuffle, so a copy of a long text costs a few
rows. An anchor with more than ``MOST`` different segments is dealt on by the windows' content,
so a shard stays small however many texts share an anchor.

NULL and empty texts have no bytes. Rows that repeat an id and a text are one document and come out
alike; rows that share only the id are ordered by their text's hash. A NULL id comes first. Other
columns are not read. Segments count as equal if anchor and digest, 128 bits together, are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import keyed, outer_id, settle, ship
from landtrace.llm.suffixes import permuted_common_prefixes, suffix_array

LENGTH = 100
PIECE = 32
MOST = 12_000
BLOCK = 2_000_000
PART = 1_000_000
MIX = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)
FACTOR = 0x9E3779B97F4A7C15
KEY = ["_id", "_v"]
SEGMENTS = "_anchor long, _digest long, _id long, _v long, _start int, _end int, _mark boolean"
PLACES = "_kind int, _anchor long, _id long, _v long, _start int, _end int"
MARKS = "_id long, _v long, _start int, _end int"


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on."""
    h, factor, step = MIX[data], FACTOR, 1
    while step < PIECE:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), step * 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(FACTOR)
    return h ^ (h >> np.uint64(29))


def window_anchors(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the place of its smallest piece, the first of equal ones."""
    width = length - PIECE + 1
    low, at, have = hashes, np.arange(len(hashes), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        right = low[step:] < low[:-step]
        low = np.where(right, low[step:], low[:-step])
        at = np.where(right, at[step:], at[:-step])
        have += step
    return at


def _parts(ids, versions, texts) -> Iterator[tuple]:
    """Texts long enough, in order of their documents, about ``PART`` bytes at a time."""
    order = np.lexsort((versions, ids))
    held, size = [], 0
    for i in order:
        raw = texts[i].as_py()
        if raw is not None and len(raw) >= LENGTH:
            held.append((int(i), raw))
            size += len(raw)
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for held in _parts(ids, versions, batch.column(2).cast(pa.binary())):
            rows = np.array([i for i, _ in held])
            sizes = np.array([len(raw) for _, raw in held])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            buffer = b"".join([raw for _, raw in held])
            data = np.frombuffer(buffer, np.uint8)
            hashes = piece_hashes(data)
            at = window_anchors(hashes, LENGTH)  # one for each window of the buffer
            inside = np.zeros(len(at), bool)  # windows that lie in one text
            opens = np.zeros(len(at), bool)
            for b, n in zip(begin.tolist(), sizes.tolist()):
                inside[b:b + n - LENGTH + 1] = True
                opens[b] = True
            opens[1:] |= (at[1:] != at[:-1])
            opens &= inside
            first = np.flatnonzero(opens)
            closes = np.zeros(len(at), bool)
            closes[:-1] = inside[:-1] & (~inside[1:] | opens[1:])
            closes[-1] = inside[-1]
            end = np.flatnonzero(closes) + LENGTH
            prints = np.array([digest(buffer[a:b]) for a, b in zip(first.tolist(), end.tolist())], np.uint64).view(np.int64)
            own = np.searchsorted(begin, first, "right") - 1
            doc, version = ids[rows[own]], versions[rows[own]]
            start, stop = first - begin[own], end - begin[own]
            anchors = hashes[at[first]].view(np.int64)
            order = np.lexsort((np.arange(len(prints)), anchors, prints))
            same = np.zeros(len(order), bool)
            same[1:] = (prints[order][1:] == prints[order][:-1]) & (anchors[order][1:] == anchors[order][:-1])
            head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            twin = (doc[order] == doc[head]) & (version[order] == version[head]) & (start[order] == start[head])
            later = np.zeros(len(order), bool)
            later[order] = same & ~twin
            # runs of marks in a text become one row
            run = later & ~np.concatenate([[False], later[:-1] & (own[1:] == own[:-1])])
            run_end = np.flatnonzero(later & ~np.concatenate([later[1:] & (own[1:] == own[:-1]), [False]]))
            run = np.flatnonzero(run)
            some = np.concatenate([np.flatnonzero(~later), run])
            upto = np.concatenate([stop[~later], stop[run_end]])
            mark = np.zeros(len(some), bool)
            mark[len(some) - len(run):] = True
            yield pa.RecordBatch.from_arrays([
                pa.array(anchors[some]), pa.array(prints[some]), pa.array(doc[some]), pa.array(version[some]),
                pa.array(start[some].astype(np.int32)), pa.array(upto.astype(np.int32)), pa.array(mark)],
                ["_anchor", "_digest", "_id", "_v", "_start", "_end", "_mark"])


def _compare_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, digest and place: marks (kind 0), and the segments to sort (kind 1).

    Holds one batch and the last different segment before it.
    """
    names = ["_anchor", "_digest", "_id", "_v", "_start", "_end"]

    def out(kind: int, rows: list[np.ndarray]) -> pa.RecordBatch:
        n = len(rows[0])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), *[pa.array(rows[i]) for i in (0, 2, 3, 4, 5)]],
            ["_kind", "_anchor", "_id", "_v", "_start", "_end"])

    held, told = None, False
    for batch in batches:
        mark = batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        if mark.any():
            yield out(0, [c[mark] for c in rows])
            rows = [c[~mark] for c in rows]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(held, rows)]
        anchor, digest, doc, version, start, _ = rows
        same = np.zeros(len(anchor), bool)
        same[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        later = same & ~((doc == doc[head]) & (version == version[head]) & (start == start[head]))
        if later.any():
            yield out(0, [c[later] for c in rows])
        heads = np.flatnonzero(~same)
        shared = np.zeros(len(heads), bool)
        pair = anchor[heads][1:] == anchor[heads][:-1]
        shared[1:] |= pair
        shared[:-1] |= pair
        last_shared = bool(shared[-1]) or (len(heads) == 1 and told)
        if told:
            shared[0] = False
        if shared.any():
            yield out(1, [c[heads[shared]] for c in rows])
        held, told = [c[heads[-1]:heads[-1] + 1] for c in rows], last_shared


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted segments; those of crowded anchors window by window."""
    import xxhash

    names = ["_anchor", "_salt", "_id", "_v", "_start", "_raw"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for doc, version, text, wanted in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3)
        ):
            raw = text.as_py()
            for w in wanted.as_py():
                if w["salts"] <= 1:
                    rows.append((w["anchor"], 0, doc, version, w["start"], raw[w["start"]:w["end"]]))
                else:
                    for a in range(w["start"], w["end"] - LENGTH + 1):
                        window = raw[a:a + LENGTH]
                        salt = 1 + xxhash.xxh3_64_intdigest(window) % w["salts"]
                        rows.append((w["anchor"], salt, doc, version, a, window))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def repeated_windows(
    raws: list[bytes], docs: np.ndarray, versions: np.ndarray, starts: np.ndarray, length: int = LENGTH,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of the bytes below windows that also start earlier in another place."""
    sizes = np.array([len(r) for r in raws])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8).astype(np.int32) + 1
    text[begin + sizes] = 0
    sa = suffix_array(text, 257)
    _, common = permuted_common_prefixes(text, sa, 0)
    as_before = common[sa] >= length
    group = np.cumsum(~as_before)
    member = as_before.copy()
    member[:-1] |= as_before[1:]
    places, group = sa[member], group[member]
    segment = np.searchsorted(begin, places, "right") - 1
    offset = places - begin[segment]
    order = np.lexsort((starts[segment] + offset, versions[segment], docs[segment], group))
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    later = order[~first]
    order = later[np.lexsort((offset[later], segment[later]))]
    segment, offset = segment[order], offset[order]
    new = np.ones(len(order), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (offset[1:] > offset[:-1] + length)
    close = np.append(new[1:], True) if len(new) else new
    return segment[new], offset[new], offset[close] + length


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from the suffix arrays of shards; an anchor's segments of one salt stay together."""

    def finish(held: list[tuple]) -> pa.RecordBatch:
        docs, versions, starts = (np.array([r[i] for r in held], np.int64) for i in (2, 3, 4))
        segment, lo, hi = repeated_windows([r[5] for r in held], docs, versions, starts)
        return marks(docs[segment], versions[segment], starts[segment] + lo, starts[segment] + hi)

    def marks(docs, versions, lo, hi) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(versions, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
            ["_id", "_v", "_start", "_end"])

    held: list[tuple] = []
    size, last = 0, None
    for batch in batches:
        equal: list[tuple] = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if last is not None and row[:2] == last[:2]:
                if row[5] == last[5]:  # a window again
                    if row[2:5] != last[2:5]:
                        equal.append((row[2], row[3], row[4], row[4] + len(row[5])))
                    continue
            elif size >= BLOCK:
                yield finish(held)
                held, size = [], 0
            held.append(row)
            last = row
            size += len(row[5]) + 1
        if equal:
            yield marks(*[np.array(c) for c in zip(*equal)])
    if held:
        yield finish(held)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n_bytes, n_removed, all_spans, digests = [], [], [], []
        for text, marks in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
            raw = text.as_py() or b""
            spans = union([(m["s"], m["e"]) for m in marks.as_py() or ()])
            rest, at = hashlib.sha256(), 0
            for a, b in spans:
                rest.update(raw[at:a])
                at = b
            rest.update(raw[at:])
            n_bytes.append(len(raw))
            n_removed.append(sum(b - a for a, b in spans))
            all_spans.append([{"start": a, "end": b} for a, b in spans])
            digests.append(rest.hexdigest())
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array(all_spans, spans_type), pa.array(digests, pa.string())],
            ["_id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """Each row's id, bytes, bytes removed, removed spans (in bytes) and the digest of what is kept."""
    rows = keyed(docs, id_col, text_col)
    segments = rows.mapInArrow(_segments, SEGMENTS).repartition("_anchor").sortWithinPartitions(
        "_anchor", "_digest", *KEY, "_start")
    places = settle(segments.mapInArrow(_compare_segments, PLACES))
    wanted = places.filter("_kind = 1").drop("_kind")
    crowded = wanted.groupBy("_anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(
        "_anchor", F.ceil(F.col("_n") * 20 / most).cast("int").alias("_salts"))
    wanted = wanted.join(crowded, "_anchor", "left").groupBy(*KEY).agg(F.collect_set(F.struct(
        F.col("_anchor").alias("anchor"), F.col("_start").alias("start"), F.col("_end").alias("end"),
        F.coalesce("_salts", F.lit(1)).alias("salts"))).alias("_wanted"))
    fetched = rows.join(wanted, KEY).select(*KEY, "_text", "_wanted").mapInArrow(
        _fetch, "_anchor long, _salt int, _id long, _v long, _start int, _raw binary")
    shards = fetched.repartition("_anchor", "_salt").sortWithinPartitions("_anchor", "_salt", "_raw", *KEY, "_start")
    marks = places.filter("_kind = 0").select(*KEY, "_start", "_end").unionByName(shards.mapInArrow(_sort_shards, MARKS))
    spans = marks.groupBy(*KEY).agg(
        F.collect_list(F.struct(F.col("_start").alias("s"), F.col("_end").alias("e"))).alias("_marks"))
    out = rows.join(spans, KEY, "left").select("_id", "_text", "_marks").mapInArrow(
        _keep, "_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")
    return out.select(outer_id().alias(id_col), "n_bytes", "n_removed", "spans", "kept_sha256")


ship(__name__)
