"""N-gram Jaccard join by pigeonhole over a partitioned universe, exact.

Documents are sets of shingles. Two sets of at most ``t`` members that are similar enough differ in at most ``D(t)`` members.
For each band of sizes the universe of shingles is hashed into segments; what a set has in one segment is indexed
as a whole, and in *deep* segments also with each one member left out. A plain segment finds partners that are equal
there (one unit), a deep one partners that differ in up to one member (two units). With ``D + 1`` units some segment finds each
partner; a scheme has some spare units more, so a set need not search by its smallest, least selective segments, and partners
must meet in several units. ``allocate`` chooses how many units are spare and how many segments deep by estimated cost:
index entries against the pairs of unrelated sets that would meet. A band's scheme serves all pairs whose larger set lies in
it, so a set also enters the next bands' schemes if it can be the smaller one there.

Verification doesn't go pair by pair. Sets that share an entry gather in blocks of bounded size around the set that
shares most, and a task compares a block's sets with each other in full; then blocks that still have to meet, because entries
are shared between sets of different components, meet in twos. Only links leave a task, and at most one less than it has sets. Nothing
is capped: a large group is more blocks.

Members are compared by 64-bit hashes of shingles, equal sets found by 128-bit digests. Equal sets are one node. NULL, empty
and blank texts have no members and are linked with nothing, not even each other. Words are lower-cased in ASCII; a text with
fewer words than a shingle is one shingle. A NULL id is returned as its own component unless it is linked to a row with an id.
Rows that repeat an id are separate nodes. Repeated rows are returned again. Other columns are ignored. A very long text is one
set in memory (8 bytes for each of its shingles) and a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import keyed, outer_id, settle, ship
from landtrace.llm.components import components
from landtrace.llm.nearcopies import shingle_set

WORDS = 4
SIMILARITY = (85, 100)
GROWTH = 1.6  # of a band's sizes
WEIGHT = 500_000  # shingles in a block
MEETING = 4  # what two sets that meet cost, in entries
KEEP = 1_000_000  # ids that are broadcast at most
PROBE, EXACT, DOUBLE, STRICT = 1, 2, 4, 8  # flags of an entry


def most_apart(size: int, similarity: tuple[int, int]) -> int:
    """In how many members two sets of at most ``size`` can differ and be similar enough."""
    num, den = similarity
    return 2 * size * (den - num) // (den + num)


def band_edges(largest: int, similarity: tuple[int, int]) -> list[int]:
    """Upper ends of the bands; sets up to the first one are similar only if equal."""
    end = 0
    while most_apart(end + 1, similarity) == 0 and end < largest:
        end += 1
    edges = [end]
    while edges[-1] < largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
    return edges


@dataclass(frozen=True)
class Scheme:
    """How the sets of a band are cut: ``units`` shares of the universe, the first ``2 * deep`` of them in deep segments.
    A set may leave out ``skip`` units when it searches, and partners meet in ``need`` units or more."""

    band: int
    units: int
    deep: int
    skip: int
    need: int

    @property
    def segments(self) -> int:
        return self.units - self.deep


def _excess(mean: float, spared: int) -> float:
    """Expected number beyond ``spared`` of a Poisson count."""
    if mean > 50:
        return max(0.0, mean - spared)
    term, below, total = math.exp(-mean), 0.0, 0.0
    for k in range(spared + 1):
        below += term
        total += term * k
        term *= mean / (k + 1)
    return max(0.0, (mean - total) - spared * (1 - below))


def allocate(band: int, low: int, high: int, docs: float, similarity: tuple[int, int]) -> Scheme:
    """The cheapest scheme for sets of ``low`` to ``high`` members: entries, and pairs of unrelated sets that meet in
    segments with next to nothing in them, which counts ``docs`` squared. Most of these are met by the scheme's smallest sets, which
    lie below ``low``: they enter as partners, about as many for their range of sizes as the band has for its own."""
    num, den = similarity
    apart = most_apart(high, similarity)
    partners = min(1.0, math.log(den / num) / math.log(high / (low - 1))) if low > 1 else 0.0
    best = None
    for spare in sorted({s for s in (*range(13), 16, 20, 24, apart // 16, apart // 8) if s <= apart + 1}):
        units = apart + 1 + spare
        for deep in sorted({d for d in (0, 1, 2, 3, 4, units // 4, units // 2) if 2 * d <= units}):
            skip = max(0, spare - 1)
            entries = units - deep + deep * 2 * high / units
            meeting = 0.0
            for size, count in ((low, docs), (low * num / den, docs * partners)):
                share = size / units
                plain, pair = math.exp(-share), math.exp(-2 * share) * (1 + 2 * share)
                weak = (units - 2 * deep) * plain + 2 * deep * pair
                meeting += docs * count * _excess(weak, skip) * max(plain if units > 2 * deep else 0.0, pair if deep else 0.0)
            cost = docs * (1 + partners) * entries + MEETING * meeting
            if best is None or cost < best[0]:
                best = cost, Scheme(band, units, deep, skip, 2 if spare else 1)
    return best[1]


def schemes(edges: list[int], docs: list[float], similarity: tuple[int, int]) -> list[Scheme]:
    """One for each band after the first; ``docs`` are rough numbers of sets in each."""
    return [allocate(k, edges[k - 1] + 1, edges[k], max(1.0, docs[k]), similarity) for k in range(1, len(edges))]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def entries(members: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Index entries (hash, flags) of a set: its segments, and those of deep segments with one member left out."""
    own = _mix(members + np.uint64((scheme.band * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    unit = (own >> np.uint64(32)) % np.uint64(scheme.units)
    two = np.uint64(2 * scheme.deep)
    segment = np.where(unit < two, unit >> np.uint64(1), unit - np.uint64(scheme.deep)).astype(np.int64)
    content = np.zeros(scheme.segments, np.uint64)
    weight = own * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    np.add.at(content, segment, weight)
    sizes = np.bincount(segment, minlength=scheme.segments)
    cost = np.where(np.arange(scheme.segments) < scheme.deep, 2, 1)
    smallest = np.argsort(sizes, kind="stable")
    search = np.ones(scheme.segments, bool)
    search[smallest[np.cumsum(cost[smallest]) <= scheme.skip]] = False
    base = _mix(np.arange(scheme.segments, dtype=np.uint64) + np.uint64(scheme.band << 40))
    strict = STRICT if scheme.need > 1 else 0
    found, flags = [_mix(content ^ base)], [EXACT + PROBE * search + DOUBLE * (cost == 2) + strict]
    left = segment < scheme.deep
    if left.any():
        at = segment[left]
        found.append(_mix((content[at] - weight[left]) ^ base[at]))
        flags.append(PROBE * search[at] + strict)
    return np.concatenate(found), np.concatenate(flags).astype(np.int8)


def _indexed(words: int, edges: list[int], plans: list[Scheme], similarity: tuple[int, int]):
    import xxhash

    num, den = similarity
    least = [-(-num * (e + 1) // den) for e in edges[:-1]]  # smallest partner of a band's smallest set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                sizes, digests, keys, flags = [], [], [], []
                for text in some.column(2).cast(pa.binary()):
                    members = shingle_set(text.as_py() or b"", words)
                    n = len(members)
                    sizes.append(n)
                    digests.append(np.frombuffer(xxhash.xxh3_128_digest(members.tobytes()), "<i8"))
                    made = [entries(members, p) for k, p in enumerate(plans) if least[k] <= n <= edges[k + 1]]
                    keys.append(np.concatenate([m[0] for m in made]).view(np.int64) if made else np.empty(0, np.int64))
                    flags.append(np.concatenate([m[1] for m in made]).tobytes() if made else b"")
                both = np.array(digests).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()),
                    pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(flags, pa.binary())],
                    ["_id", "_v", "_d1", "_d2", "_n", "_keys", "_flags"])

    return run


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each entry."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            some = batch.slice(lo, 256)
            keys = some.column(1)
            each = np.asarray(pc.list_value_length(keys))
            flags = np.frombuffer(b"".join(f.as_py() for f in some.column(2)), np.int8)
            yield pa.RecordBatch.from_arrays(
                [keys.flatten(), pa.array(np.repeat(np.asarray(some.column(0)), each)), pa.array(flags)], ["_s", "_node", "_f"])


def _set_rows(words: int):
    """A node's set, once for each task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                nodes, sets = [], []
                for node, text in zip(batch.column(0).slice(lo, 64).to_pylist(), batch.column(1).slice(lo, 64).cast(pa.binary())):
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(shingle_set(text.as_py() or b"", words).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["_node", "_set"])

    return run


class _Forest:
    """Which of a group's sets are linked, as far as known."""

    def __init__(self, roots: list[int]):
        names: dict[int, int] = {}
        self.up = [names.setdefault(r, k) for k, r in enumerate(roots)]

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k


def linked(sets: list[np.ndarray], sides: list[int], roots: list[int], similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Positions of similar sets that join what ``roots`` doesn't; sets of side 2 meet all, other sets those of another side,
    or all if there is but one side."""
    num, den = similarity
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    names, dense = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.zeros(len(names), bool)
    side = np.array([sides[k] for k in order])
    two_sided = 0 in sides and 1 in sides
    forest, found = _Forest([roots[k] for k in order]), []
    for i in range(len(order)):
        # later sets are as large or larger, up to the size that can still be similar
        last = int(np.searchsorted(sizes, sizes[i] * den // num, side="right"))
        if last <= i + 1:
            continue
        if two_sided:
            ok = (side[i + 1:last] != side[i]) | (side[i] == 2) | (side[i + 1:last] == 2)
            if not ok.any():
                continue
        mine = dense[starts[i]:starts[i + 1]]
        flags[mine] = True
        shared = np.add.reduceat(flags[dense[starts[i + 1]:starts[last]]], starts[i + 1:last] - starts[i + 1], dtype=np.int64)
        flags[mine] = False
        near = shared * (num + den) >= num * (sizes[i] + sizes[i + 1:last])
        if two_sided:
            near &= ok
        for j in (np.flatnonzero(near) + i + 1).tolist():
            a, b = forest.find(i), forest.find(j)
            if a != b:
                forest.up[max(a, b)] = min(a, b)
                found.append((order[i], order[j]))
    return found


def _compared(similarity: tuple[int, int]):
    """Links within each group of rows (_g1, _g2, _node, _root, _side, _set), which arrive sorted by group and node."""

    def found_in(group: list) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        found = linked([np.frombuffer(g[3], np.uint64) for g in group], [g[2] for g in group], [g[1] for g in group], similarity)
        return [(group[i][0], group[j][0]) for i, j in found]

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            pairs = []
            for g1, g2, *rest in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if (g1, g2) != now:
                    pairs += found_in(group)
                    now, group = (g1, g2), []
                if not group or group[-1][0] != rest[0]:
                    group.append(rest)
            yield out(pairs)
        yield out(found_in(group))

    return run


def _bounded(df: DataFrame) -> DataFrame:
    """A written table of keys, broadcast where it is known to be small; joins shuffle otherwise."""
    return F.broadcast(df) if df.count() <= KEEP else df


def _verified(groups: DataFrame, rows: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) in ``groups`` (_g1, _g2, _node, _root, _side), each a bounded number of shingles."""
    groups = settle(groups)
    named = groups.select("_node").distinct().join(rows.select(F.col("_row").alias("_node"), "_id", "_v"), "_node")
    sets = texts.join(_bounded(settle(named)), ["_id", "_v"]).select("_node", "_text").mapInArrow(
        _set_rows(words), "_node long, _set binary")
    full = groups.join(sets, "_node").select("_g1", "_g2", "_node", "_root", "_side", "_set")
    full = full.repartition("_g1", "_g2").sortWithinPartitions("_g1", "_g2", "_node")
    return settle(full.mapInArrow(_compared(similarity), "a long, b long"))


def _shared_entries(places: DataFrame) -> DataFrame:
    """(_s, _node, _f, _c): the entries that lead somewhere, ``_c`` the number of nodes that have it."""
    by_key = places.repartition("_s")
    useful = by_key.groupBy("_s").agg(F.count("*").alias("_c"), F.bit_or("_f").alias("_any")).filter(
        (F.col("_c") > 1) & (F.col("_any").bitwiseAND(PROBE + EXACT) == PROBE + EXACT))
    return settle(by_key.join(useful.select("_s", "_c"), "_s"))


def _blocks(shared: DataFrame, sizes: DataFrame, weight: int) -> DataFrame:
    """(_node, _n, _home, _part, _block): nodes by the busiest set they share an entry with, in parts of about ``weight``
    shingles; ``_block`` is the part's smallest node."""
    busy = shared.groupBy("_node").agg(F.sum("_c").alias("_busy"))
    hubs = shared.select("_s", "_node").join(busy, "_node").groupBy("_s").agg(F.max(F.struct("_busy", "_node")).alias("_hub"))
    homes = shared.select("_s", "_node").join(hubs, "_s").groupBy("_node").agg(F.max("_hub").alias("_hub")).join(sizes, "_node")
    homes = settle(homes.select("_node", "_n", F.col("_hub._node").alias("_home")))
    parts = homes.groupBy("_home").agg(F.ceil(F.sum("_n") / weight).cast("long").alias("_parts"))
    parted = homes.join(parts, "_home").select(
        "_node", "_n", "_home", F.pmod(F.xxhash64("_node"), "_parts").alias("_part"))
    firsts = parted.groupBy("_home", "_part").agg(F.min("_node").alias("_block"))
    return settle(parted.join(firsts, ["_home", "_part"]).select("_node", "_n", "_home", "_part", "_block"))


def _meetings(shared: DataFrame, blocks: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Groups (_g1, _g2, _node, _root, _side) of two blocks, with the nodes that still can be linked across them.

    ``blocks``: (_node, _n, _block, _root). A node belongs to the meeting if it shares entries of enough units with nodes of the
    other block that have another root and a size that can be similar, and search there.
    """
    num, den = similarity
    placed = shared.select("_s", "_node", "_f").join(blocks.select("_node", "_n", "_block", "_root"), "_node")
    apart = placed.groupBy("_s").agg(
        F.min("_root").alias("r"), F.max("_root").alias("s"), F.min("_block").alias("x"), F.max("_block").alias("y"))
    placed = settle(placed.join(apart.filter("r <> s and x <> y").select("_s"), "_s", "left_semi"))
    there = placed.filter(F.col("_f").bitwiseAND(PROBE) > 0).groupBy("_s", F.col("_block").alias("_other")).agg(
        F.min("_root").alias("_r1"), F.max("_root").alias("_r2"), F.min("_n").alias("_n1"), F.max("_n").alias("_n2"),
        F.bit_or("_f").alias("_any"))
    met = placed.join(there, "_s").filter("_block <> _other and (_r1 <> _root or _r2 <> _root)").filter(
        (F.col("_n") * den >= F.col("_n1") * num) & (F.col("_n2") * den >= F.col("_n") * num)).filter(
        F.col("_any").bitwiseOR(F.col("_f")).bitwiseAND(EXACT) > 0)
    strict = F.col("_f").bitwiseAND(STRICT) > 0
    units = F.when(F.col("_f").bitwiseAND(DOUBLE) > 0, 2).otherwise(1)
    enough = met.groupBy("_block", "_other", "_node", "_root", strict.alias("_strict")).agg(F.sum(units).alias("_units")).filter(
        "_units >= if(_strict, 2, 1)")
    groups = enough.select(
        F.least("_block", "_other").alias("_g1"), F.greatest("_block", "_other").alias("_g2"), "_node", "_root",
        (F.col("_block") > F.col("_other")).cast("int").alias("_side")).distinct()
    groups = settle(groups)
    both = groups.groupBy("_g1", "_g2").agg(F.min("_side").alias("x"), F.max("_side").alias("y")).filter("x < y")
    return groups.join(both.select("_g1", "_g2"), ["_g1", "_g2"], "left_semi")


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(components(edges), F.col("_node") == F.col("node"), "left").select(
        *nodes.columns, F.coalesce("root", "_node").alias("_root"))


def _bands(texts: DataFrame, similarity: tuple[int, int]) -> tuple[list[int], list[float]]:
    """Band edges up to the longest text, and about how many texts have so many words (6 bytes each)."""
    size = F.octet_length("_text")
    found = texts.groupBy(F.floor(F.log2(F.greatest(size / 6, F.lit(1))) * 8).alias("k")).agg(
        F.count("*").alias("n"), F.max(size).alias("m")).collect()
    edges = band_edges(max([r["m"] for r in found], default=0) // 2 + 1, similarity)
    docs = [0.0] * len(edges)
    for r in found:
        docs[min(len(edges) - 1, int(np.searchsorted(edges, 2 ** (r["k"] / 8))))] += r["n"]
    return edges, docs


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY,
    weight: int = WEIGHT,
) -> DataFrame:
    """Every row's ``id_col``, n_shingles and component_id, the smallest id in its component."""
    texts = keyed(docs, id_col, text_col)
    edges, sizes = _bands(texts, similarity)
    plans = schemes(edges, sizes, similarity)
    kinds = "_id long, _v long, _d1 long, _d2 long, _n long, _keys array<long>, _flags binary"
    rows = settle(texts.mapInArrow(_indexed(words, edges, plans, similarity), kinds).withColumn("_row", F.monotonically_increasing_id()))
    digest = ["_d1", "_d2"]
    light = rows.filter("_n > 0").select("_row", *digest, "_n", outer_id().alias("_own"))
    nodes = settle(light.groupBy(*digest).agg(
        F.min("_row").alias("_node"), F.min("_n").alias("_n"), F.min("_own").alias("_own")))
    repeats = settle(light.join(nodes.select(*digest, "_node"), digest).filter("_row <> _node").select("_row"))
    places = rows.filter(F.length("_flags") > 0).join(_bounded(repeats), "_row", "left_anti").select("_row", "_keys", "_flags").mapInArrow(
        _entry_rows, "_s long, _node long, _f byte")
    shared = _shared_entries(places)
    blocks = _blocks(shared, nodes.select("_node", "_n"), weight)

    own = blocks.select(F.col("_home").alias("_g1"), F.col("_part").alias("_g2"), "_node")
    hubs = blocks.select(F.col("_home").alias("_g1"), F.col("_part").alias("_g2"), F.col("_home").alias("_node"))
    groups = own.unionByName(hubs).distinct().select("_g1", "_g2", "_node", F.col("_node").alias("_root"), F.lit(0).alias("_side"))
    found = _verified(groups, rows, texts, words, similarity)
    rest = _meetings(shared, settle(_rooted(blocks, found)), similarity)
    found = found.unionByName(_verified(rest, rows, texts, words, similarity))

    placed = settle(_rooted(nodes, found))
    least = placed.groupBy("_root").agg(F.min("_own").alias("_least"))
    named = placed.select(*digest, "_root").join(least, "_root").select(*digest, "_least")
    linked_rows = rows.filter("_n > 0").select("_id", *digest, "_n").join(named, digest).select(
        outer_id().alias(id_col), F.col("_n").alias("n_shingles"), F.col("_least").alias("component_id"))
    return linked_rows.unionByName(rows.filter("_n = 0").select(
        outer_id().alias(id_col), F.col("_n").alias("n_shingles"), outer_id().alias("component_id")))


ship(__name__)
