"""Near-duplicate documents by SimHash fingerprints and generalised pigeonhole search.

A fingerprint bit is the majority vote of the hashes of a text's word shingles. Documents link
if their fingerprints differ in few bits; a document's component is what it reaches over links.

Equal fingerprints are brought together first, so copies cost nothing more. For the others, the 64
bits are grouped into parts - correlated bits into the same one - and each part gets its own
threshold, -1 (not searched) to 2, such that any two fingerprints within ``distance`` bits agree up to the
threshold in at least one part: the thresholds plus one add up to ``distance`` + 1. Their number, their widths
and their thresholds are what a dynamic program over estimated candidate counts finds cheapest;
the estimates come from the joint counts of all pairs of bits over all fingerprints. A fingerprint
goes to the bucket of its value in each part, and to those within the part's threshold. Within a
bucket, pairs are verified in full, and only the links that hold its clusters together leave it.

A bucket with more than ``BUCKET`` members is dealt again, by the pigeonhole of its other bits,
so that its memory stays bounded. NULL and empty texts have fingerprint zero and link like any
other. Nodes are fingerprints, so rows that share an id or have none are not linked by that. A NULL id comes
first. Repeated rows come out alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import keyed, outer_id, packed, settle, ship
from landtrace.llm.components import components

WORDS = 4
DISTANCE = 4
SEED = 42
BUCKET = 20_000
SMALL = 64
ROW_COST, PAIR_COST = 1.0, 0.01


def fingerprint(data: bytes, words: int = WORDS, block: int = 250_000) -> int:
    """Fingerprint of a UTF-8 text."""
    import xxhash

    parts = data.lower().split()
    if not parts:
        return 0
    text = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1:] if len(parts) >= words else ends[-1:]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, block):
        pairs = zip(starts[lo:min(n, lo + block)].tolist(), last[lo:lo + block].tolist())
        hashes = np.array([digest(text[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints.view("<i8"))], ["_id", "_v", "_fp"])

    return run


def _bits(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        total += bits.T @ bits
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], ["cell", "n"])


class Plan:
    """Parts (bit numbers) with their thresholds."""

    def __init__(self, parts: list[list[int]], thresholds: list[int]):
        self.parts, self.thresholds = parts, thresholds


def group_bits(both: np.ndarray, n: float, parts: int) -> list[list[int]]:
    """Bits in groups of near equal size, correlated ones together."""
    mean = np.diag(both) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs(both / n - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, groups = list(range(64)), []
    for k in range(parts, 0, -1):
        size = -(-len(left) // k)
        first = max(left, key=lambda b: (tie[b, left].sum(), -b))
        group = [first]
        left.remove(first)
        while len(group) < size:
            nxt = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(nxt)
            left.remove(nxt)
        groups.append(group)
    return groups


def agreement(both: np.ndarray, n: float, bits: list[int], most: int) -> list[float]:
    """P(two fingerprints differ in at most t of ``bits``), t = 0 .. most, along the chain of bits."""
    state = None
    for a, b in zip([None, *bits], bits):
        p = both[b, b] / n
        same = p * p + (1 - p) * (1 - p)
        if state is None:
            state = np.zeros((2, most + 1))
            state[0, 0] = same
            if most:
                state[1, 1] = 1 - same
            continue
        q = both[a, a] / n
        p11 = both[a, b] / n
        p10, p01 = max(q - p11, 0.0), max(p - p11, 0.0)
        p00 = max(1 - p11 - p10 - p01, 0.0)
        ss = p11**2 + p10**2 + p01**2 + p00**2
        sd = 2 * (p00 * p01 + p10 * p11)
        ds = 2 * (p00 * p10 + p01 * p11)
        dd = 2 * (p00 * p11 + p01 * p10)
        step = np.array([[ss, sd], [ds, dd]]) / np.maximum([[ss + sd], [ds + dd]], 1e-12)
        new = np.zeros_like(state)
        for before in (0, 1):
            new[0] += state[before] * step[before, 0]
            new[1, 1:] += state[before, :-1] * step[before, 1]
        state = new
    return np.cumsum(state.sum(axis=0)).tolist()


def ball(width: int, radius: int) -> int:
    from math import comb

    return sum(comb(width, r) for r in range(radius + 1))


def make_plan(both: np.ndarray, n: float, distance: int = DISTANCE) -> Plan:
    """The parts and thresholds with the least estimated rows and compared pairs."""
    n = max(n, 1.0)
    best = None
    for m in range(1, 2 * distance + 1):
        groups = group_bits(both, n, m)
        costs = []
        for bits in groups:
            near = agreement(both, n, bits, 2)
            costs.append([0.0] + [ROW_COST * n * ball(len(bits), t) + PAIR_COST * n * n / 2 * near[t] for t in range(3)])
        need = distance + 1
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for got, (total, ts) in least.items():
                for t in range(-1, 3):
                    have = min(need, got + t + 1)
                    if have not in step or total + cost[t + 1] < step[have][0]:
                        step[have] = (total + cost[t + 1], [*ts, t])
            least = step
        if need in least and (best is None or least[need][0] < best[0]):
            best = (least[need][0], groups, least[need][1])
    return Plan(best[1], best[2])


def _take(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(prints), np.uint64)
    for i, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def _signatures(plan: Plan):
    from itertools import combinations

    flips = []
    for bits, t in zip(plan.parts, plan.thresholds):
        masks = [0]
        for r in range(1, t + 1):
            masks += [sum(1 << b for b in some) for some in combinations(range(len(bits)), r)]
        flips.append(masks if t >= 0 else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column(0).to_numpy(zero_copy_only=False)
            prints = signed.view(np.uint64)
            for part, bits in enumerate(plan.parts):
                own = _take(prints, bits)
                for mask in flips[part]:
                    keys = (own ^ np.uint64(mask)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), batch.column(0), batch.column(1)],
                        ["_part", "_key", "_fp", "_node"])

    return run


def cluster(prints: np.ndarray, distance: int) -> np.ndarray:
    """For each fingerprint the index of the first one it reaches, without writing out pairs."""
    n = len(prints)
    root = np.arange(n)
    rest = np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = prints[seed:seed + 1]
        while len(front) and len(rest):
            some, front = front[:128], front[128:]
            near = np.zeros(len(rest), bool)
            for lo in range(0, len(rest), 65_536):
                block = prints[rest[lo:lo + 65_536]]
                near[lo:lo + 65_536] = (np.bitwise_count(some[:, None] ^ block[None, :]) <= distance).any(axis=0)
            new, rest = rest[near], rest[~near]
            root[new] = seed
            front = np.concatenate([front, prints[new]])
    return root


def _small_groups(prints: np.ndarray, group: np.ndarray, distance: int) -> np.ndarray:
    """``cluster`` for many small groups at once; ``group`` is sorted."""
    n = len(prints)
    left, right = [], []
    for k in range(1, SMALL):
        same = np.flatnonzero(group[k:] == group[:-k]) if k < n else np.empty(0, np.int64)
        if not len(same):
            break
        near = same[np.bitwise_count(prints[same] ^ prints[same + k]) <= distance]
        left.append(near)
        right.append(near + k)
    root = np.arange(n)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(root[a], root[b])
            if (root[a] == low).all() and (root[b] == low).all():
                break
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
    return root


def _edges(keys: int, distance: int, most: int | None):
    """Links out of buckets sorted by their first ``keys`` columns; kind 1 rows belong to buckets above ``most``."""

    def out(columns: list[np.ndarray], kind: int, a, b, part=None, key=None):
        n = len(a)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b),
            pa.array(np.zeros(n, np.int32) if part is None else part), pa.array(np.zeros(n, np.int64) if key is None else key),
        ], ["_kind", "a", "b", "_part", "_key"])

    def finish(columns: list[np.ndarray]):
        """Whole buckets."""
        prints, nodes = columns[keys].view(np.uint64), columns[keys + 1]
        change = np.zeros(len(nodes), bool)
        change[0] = True
        for c in columns[:keys]:
            change[1:] |= c[1:] != c[:-1]
        group = np.cumsum(change)
        sizes = np.bincount(group)
        big = sizes[group] > SMALL
        root = np.arange(len(nodes))
        few = np.flatnonzero(~big)
        root[few] = few[_small_groups(prints[few], group[few], distance)]
        for g in np.unique(group[big]):
            lo, hi = np.searchsorted(group, [g, g + 1])
            root[lo:hi] = lo + cluster(prints[lo:hi], distance)
        linked = np.flatnonzero((root != np.arange(len(nodes))) & (nodes != nodes[root]))
        return out(columns, 0, nodes[linked], nodes[root[linked]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # pieces of the bucket that may go on
        last = passed = None  # its key; the key of a bucket too large to hold
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys + 2)]
            if passed is not None:
                same = np.logical_and.reduce([c == v for c, v in zip(new, passed)])
                if same.any():
                    yield out(new, 1, new[keys][same], new[keys + 1][same], new[0][same], new[1][same])
                    new = [c[~same] for c in new]
                if len(new[0]):
                    passed = None
            if not len(new[0]):
                continue
            key = [c[-1] for c in new[:keys]]
            same = np.logical_and.reduce([c == v for c, v in zip(new, key)])
            cut = len(same) - int(same.sum())  # sorted: the last bucket is at the end
            if cut or key != last:
                held.append([c[:cut] for c in new])
                whole = [np.concatenate(x) for x in zip(*held)]
                if len(whole[0]):
                    yield finish(whole)
                held, last = [], key
            held.append([c[cut:] for c in new])
            if most is not None and sum(len(h[0]) for h in held) > most:
                for h in held:
                    yield out(h, 1, h[keys], h[keys + 1], h[0], h[1])
                held, last, passed = [], None, key
        if held:
            yield finish([np.concatenate(x) for x in zip(*held)])

    return run


def _second_keys(plan: Plan, distance: int):
    """Rows of large buckets, by each of ``distance`` + 1 groups of the bits outside the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            part = batch.column(2).to_numpy(zero_copy_only=False)
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                rest = [b for b in range(64) if b not in set(plan.parts[p])]
                for j in range(distance + 1):
                    value = _take(prints[mine], rest[j::distance + 1]).view(np.int64)
                    some = batch.take(pa.array(mine))
                    yield pa.RecordBatch.from_arrays([
                        some.column(2), some.column(3), pa.array(np.full(len(mine), j, np.int32)), pa.array(value),
                        some.column(0), some.column(1)], ["_part", "_key", "_sub", "_value", "_fp", "_node"])

    return run


def bit_pairs(prints: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits, for the 64 x 64 pairs."""
    cells = prints.select("_fp").mapInArrow(_pair_counts, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(4096)
    for cell, count in cells.collect():
        both[cell] = count
    return both.reshape(64, 64)


EDGES = "_kind int, a long, b long, _part int, _key long"


def links(prints: DataFrame, distance: int = DISTANCE, most: int = BUCKET, plan: Plan | None = None) -> DataFrame:
    """Edges (a, b) between nodes that connect whatever lies within ``distance`` bits; ``prints``: (_fp, _node), each _fp once."""
    plan = plan or make_plan(bit_pairs(prints), prints.count(), distance)
    rows = prints.select("_fp", "_node").mapInArrow(_signatures(plan), "_part int, _key long, _fp long, _node long")
    rows = rows.repartition("_part", "_key").sortWithinPartitions("_part", "_key")
    found = settle(rows.mapInArrow(_edges(2, distance, most), EDGES))
    again = found.filter("_kind = 1").select("a", "b", "_part", "_key").mapInArrow(
        _second_keys(plan, distance), "_part int, _key long, _sub int, _value long, _fp long, _node long")
    keys = ["_part", "_key", "_sub", "_value"]
    again = again.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_edges(4, distance, None), EDGES)
    return found.filter("_kind = 0").select("a", "b").unionByName(again.select("a", "b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE,
    bucket: int = BUCKET,
) -> DataFrame:
    """Every row's id, fingerprint (16 hex digits) and component (its smallest id)."""
    rows, placed = _components(docs, id_col, text_col, words, distance, bucket)
    return rows.join(placed, "_fp").select(
        outer_id().alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        outer_id("_first._id").alias("component_id"))


def _components(docs, id_col, text_col, words, distance, bucket) -> tuple[DataFrame, DataFrame]:
    """(_id, _v, _fp) of every row; (_fp, _root, _first) with the component's number and its smallest (_id, _v)."""
    texts = keyed(docs, id_col, text_col)
    rows = settle(texts.mapInArrow(_fingerprints(words), "_id long, _v long, _fp long"))
    prints = settle(rows.groupBy("_fp").agg(F.min(F.struct("_id", "_v")).alias("_own")))
    roots = components(links(prints.select("_fp", F.col("_fp").alias("_node")), distance, bucket))
    placed = prints.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("root", "_fp").alias("_root"), "_own")
    firsts = placed.groupBy("_root").agg(F.min("_own").alias("_first"))
    return rows, placed.join(firsts, "_root").select("_fp", "_root", "_first")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: that with the smallest id (then text hash)."""
    _, placed = _components(docs, id_col, text_col, words, distance, bucket)
    kept = placed.select("_first._id", "_first._v").distinct()
    # equal rows of an id and a text become one before they meet
    rows = packed(docs, id_col, text_col).groupBy("_id", "_v").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return rows.join(kept, ["_id", "_v"], "left_semi").select("_row.*")


ship(__name__)
