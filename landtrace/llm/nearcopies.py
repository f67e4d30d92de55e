"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First by SimHash (``simhash``): links between fingerprints that differ in few bits, each confirmed by the sets.
By estimate, fingerprints at 0.8 differ in 10 of 64 bits on average and often in more, too many to search by parts; so the
pairs that SimHash leaves apart are looked for once more, by prefix filtering.

That makes it exact: if the shingles of all sets stand in one common order, two sets that are
similar enough share one of the first ``n - ceil(0.8 n) + 1`` shingles of either. Any order is right; the one here puts shingles that a sample of
the texts repeats last, and so keeps common ones out of the prefixes. A shared shingle's place bounds
what two sets can share, which spares most comparisons; all other candidates are compared in full.

Only components are needed, so documents that share a shingle and that SimHash left apart are first compared with one of them, in
``STARS`` turns; what is still apart after that meets pair by pair, in tasks of two blocks where many share the
shingle. Before any text moves, each candidate pair is held against a sketch of both sets: the number of shingles in each of up to
``BINS`` bins. The smaller numbers of all bins, added up, are the most that two sets can share, so no
similar pair is lost and hardly any other is left. Texts of the pairs that are left move and are compared in full, in ``FIRSTS`` turns
only a few pairs of each node, as many pairs of a large group then lie in one component and need no comparison. Rows with the same set of shingles
are one node, whatever their ids. Words are lower-cased in ASCII; shingles are compared by 64-bit
hashes, sets by 128-bit digests. A text with fewer words is one shingle; NULL, empty and blank texts have
the empty set and are copies of each other. A NULL id comes first. An empty table gives an empty result. A very
long text costs a fifth of its shingles in the search and moves only if its sketch fits another's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtrace.llm.common import keyed, packed, settle, ship
from landtrace.llm.components import components
from landtrace.llm.simhash import fingerprint, links

WORDS = 5
SIMILARITY = (4, 5)
SAMPLE = 20_000  # about so many texts give the order of common shingles, and so many shingles have a place in it
COMMON = 100_000
STARS = 2
FIRSTS = 2  # turns in which some pairs of each node are compared before all that are left
CHOICES = 4  # so many of a node
MIDDLES = 4  # in a turn, members that share many shingles meet about so many others
BINS = 4096
CROWD = 64  # members of a shingle from which on pairs are formed inside tasks
BLOCK = 512
KEEP = 1_000_000  # keys that are broadcast at most
KEY = ["_id", "_v"]
DIGEST = ["_d1", "_d2"]


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a UTF-8 text's shingles."""
    import xxhash

    parts = data.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    size, digest = min(words, len(parts)), xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, parts), np.uint64, len(parts))
    n = len(parts) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ each[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8").tolist())


def prefix(shingles: np.ndarray, common: np.ndarray, place: np.ndarray, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """The first shingles in the order: those not in ``common`` by hash, then the others by ``place``."""
    n, (num, den) = len(shingles), similarity
    if not n:
        return shingles
    long = n - -(-num * n // den) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, place[at], 0)
        shingles = shingles[np.argsort(rank, kind="stable")]
    return shingles[:long]


def sketch(shingles: np.ndarray, bins: int = BINS) -> bytes:
    """Shingles by bin, a byte each; empty where a byte is too small, which any pair passes."""
    size = min(bins, 1 << max(4, len(shingles).bit_length() - 1))
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The most shingles that the set of sketch ``one`` can share with each row of ``others``."""
    size = min(len(one), others.shape[1])
    one, others = (x.reshape(len(x), -1, size).sum(axis=1, dtype=np.uint32) for x in (one[None, :], others))
    return np.minimum(one, others).sum(axis=1)


def _sampled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py() or b"", words).view(np.int64))], ["_s"])

    return run


def _described(words: int, common: np.ndarray, place: np.ndarray, similarity: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                sets = [shingle_set(t.as_py() or b"", words) for t in some.column(2).cast(pa.binary())]
                digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
                firsts = [prefix(s, common, place, similarity).view(np.int64) for s in sets]
                sketches = pa.array([sketch(s) for s in sets], pa.binary())
                prints = np.array([fingerprint(t.as_py() or b"") for t in some.column(2).cast(pa.binary())], "<u8")
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(firsts, pa.list_(pa.int64())), sketches,
                    pa.array(prints.view("<i8"))], [*KEY, *DIGEST, "_n", "_prefix", "_sketch", "_fp"])

    return run


def _possible(similarity: tuple[int, int]):
    """Pairs whose sketches allow the similarity."""
    num, den = similarity

    def fits(x: bytes, y: bytes, n: int) -> bool:
        if not x or not y:
            return True
        return int(most_shared(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)[None, :])[0]) * (num + den) >= num * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_pylist()
            keep = [fits(x.as_py(), y.as_py(), n) for x, y, n in zip(batch.column(3), batch.column(4), sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(words: int, similarity: tuple[int, int]):
    """Pairs whose texts are similar enough."""
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None  # rows come sorted by b
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), *(batch.column(k).cast(pa.binary()) for k in (2, 3))):
                if b != last:
                    last, right = b, shingle_set(y.as_py(), words)
                left = shingle_set(x.as_py(), words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both * (num + den) >= num * (len(left) + len(right)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _in_blocks(similarity: tuple[int, int]):
    """Pairs of two blocks (or inside one) of a crowded shingle that positions, roots and sketches allow."""
    num, den = similarity

    def run(rows: pa.Table) -> pa.Table:
        node, n, pos, root, block = (rows.column(c).to_numpy() for c in ("_node", "_n", "_pos", "_root", "_block"))
        sketches = rows.column("_sketch").to_pylist()
        one_block = rows.column("_i")[0] == rows.column("_j")[0]
        lengths = np.array([len(s) for s in sketches])
        kinds = {}
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            data = np.frombuffer(b"".join(sketches[k] for k in at), np.uint8).reshape(len(at), size)
            kinds[size] = at, data
        left, right = [], []
        for k in range(len(node)):
            for size, (at, data) in kinds.items():
                ok = (root[at] != root[k]) & (node[at] > node[k]) & (one_block | (block[at] != block[k]))
                ok &= np.minimum(n[k] - pos[k], n[at] - pos[at]) * (num + den) >= num * (n[k] + n[at])
                some = np.flatnonzero(ok)
                if size and lengths[k] and len(some):
                    shared = most_shared(np.frombuffer(sketches[k], np.uint8), data[some]).astype(np.int64)
                    some = some[shared * (num + den) >= num * (n[k] + n[at[some]])]
                left.append(np.full(len(some), node[k], np.int64))
                right.append(node[at[some]].astype(np.int64))
        return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})

    return run


def _common(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of the distinct texts repeats most, sorted, and their places in the order."""
    every = max(1, texts.count() // SAMPLE)
    sample = texts.filter(F.pmod("_v", F.lit(every)) == 0).groupBy("_v").agg(F.first("_text").alias("_text"))
    counted = sample.select("_text").mapInArrow(_sampled(words), "_s long").groupBy("_s").agg(F.count("*").alias("_n"))
    top = counted.filter("_n > 2").orderBy(F.desc("_n"), "_s").limit(COMMON).toArrow()
    found = top.column("_s").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - np.arange(len(found)))[order]


def _may(a: str, b: str, similarity: tuple[int, int]) -> Column:
    """Whether two sets with this shingle as their first common one can be similar enough."""
    num, den = similarity
    left = F.least(F.col(f"{a}._n") - F.col(f"{a}._pos"), F.col(f"{b}._n") - F.col(f"{b}._pos"))
    return left * (num + den) >= num * (F.col(f"{a}._n") + F.col(f"{b}._n"))


PAIR = "a long, b long"


def _sketched(pairs: DataFrame, rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sketches allow the similarity."""
    left = rows.select(F.col("_row").alias("a"), F.col("_n").alias("_k"), F.col("_sketch").alias("_x"))
    right = rows.select(F.col("_row").alias("b"), F.col("_n").alias("_m"), F.col("_sketch").alias("_y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("_k") + F.col("_m")).alias("_n"), "_x", "_y")
    return both.mapInArrow(_possible(similarity), PAIR)


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that are similar enough."""
    nodes = pairs.select(F.col("a").alias("_node")).unionByName(pairs.select(F.col("b").alias("_node"))).distinct()
    needed = settle(rows.select(F.col("_row").alias("_node"), *KEY).join(nodes, "_node"))
    # texts stay where they are while the keys are few enough to be sent to them
    keys = F.broadcast(needed) if needed.count() <= KEEP else needed
    found = settle(texts.join(keys, KEY).select("_node", "_text").dropDuplicates(["_node"]))
    left, right = (found.select(F.col("_node").alias(c), F.col("_text").alias(t)) for c, t in (("a", "_x"), ("b", "_y")))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").sortWithinPartitions("b")
    return settle(both.mapInArrow(_similar(words, similarity), PAIR))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (_row, _fp) that connect what SimHash links: equal fingerprints, and those within its distance."""
    prints = settle(nodes.groupBy("_fp").agg(F.min("_row").alias("_node")))
    equal = nodes.join(prints, "_fp").filter("_row <> _node").select(F.col("_node").alias("a"), F.col("_row").alias("b"))
    return equal.unionByName(links(prints)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star(buckets: DataFrame, turn: int) -> DataFrame:
    """Members ``x`` of each bucket with its middle ``y``, the same one in buckets of a kind that hold the same members."""
    chance = F.xxhash64(F.lit(turn), F.pmod("_s", F.lit(MIDDLES)), "_root")
    middle = F.min(F.struct(chance.alias("h"), "_root", "_node", "_n", "_pos")).alias("y")
    return buckets.select("_s", F.struct("_node", "_n", "_pos", "_root").alias("x")).join(
        buckets.groupBy("_s").agg(middle), "_s").select("x", "y")


def _paired(both: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    return both.filter("x._root <> y._root").filter(_may("x", "y", similarity)).select(
        F.least("x._node", "y._node").alias("a"), F.greatest("x._node", "y._node").alias("b")).distinct()


def _rest(buckets: DataFrame, rows: DataFrame, tested: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs of all that still lie apart in a bucket."""
    sizes = buckets.groupBy("_s").agg(F.count("*").alias("_k"))
    few = buckets.join(sizes.filter(F.col("_k") <= CROWD).select("_s"), "_s", "left_semi")
    one, two = (few.select("_s", F.struct("_node", "_n", "_pos", "_root").alias(c)) for c in "xy")
    pairs = _paired(one.join(two, "_s").filter("x._node < y._node"), similarity).join(tested, ["a", "b"], "left_anti")
    pairs = _sketched(pairs, rows, similarity)

    many = buckets.join(sizes.filter(F.col("_k") > CROWD).withColumn("_blocks", F.ceil(F.col("_k") / BLOCK)), "_s")
    many = many.withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")))
    many = many.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    many = many.join(rows.select(F.col("_row").alias("_node"), "_sketch"), "_node").select(
        "_s", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"),
        "_node", "_n", "_pos", "_root", "_block", "_sketch")
    crowded = many.groupBy("_s", "_i", "_j").applyInArrow(_in_blocks(similarity), PAIR).distinct().join(tested, ["a", "b"], "left_anti")
    return pairs.unionByName(crowded).distinct()


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the component of ``_node`` as ``_root``."""
    return nodes.join(components(edges), F.col("_node") == F.col("node"), "left").select(
        *nodes.columns, F.coalesce("root", "_node").alias("_root"))


def _apart(places: DataFrame) -> DataFrame:
    """Buckets that lie in more than one component. A window, as an aggregate and a join would move the places twice."""
    bucket = Window.partitionBy("_s")
    ends = places.withColumns({"_a": F.min("_root").over(bucket), "_b": F.max("_root").over(bucket)})
    return settle(ends.filter("_a <> _b").select("_s", "_node", "_n", "_pos", "_root"))


def _across(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of nodes that ``edges`` leave in different components."""
    roots = settle(components(edges))
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab")
    return pairs.join(left, "a", "left").join(right, "b", "left").filter("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """(_id, _v, _root): each row's key and its component, which is a number."""
    texts = keyed(docs, id_col, text_col)
    common, place = _common(texts, words)
    kinds = "_id long, _v long, _d1 long, _d2 long, _n long, _prefix array<long>, _sketch binary, _fp long"
    rows = settle(texts.mapInArrow(_described(words, common, place, similarity), kinds).withColumn(
        "_row", F.monotonically_increasing_id()))
    nodes = settle(rows.groupBy(*DIGEST).agg(F.min("_row").alias("_node")))
    tested = settle(fingerprint_pairs(rows.select("_row", "_fp").join(nodes.select(F.col("_node").alias("_row")), "_row")))
    edges = _verified(settle(_sketched(tested, rows, similarity)), rows, texts, words, similarity)
    rooted = settle(_rooted(nodes.select("_node"), edges))
    places = rows.select(F.col("_row").alias("_node"), "_n", "_prefix").join(rooted, "_node")
    buckets = _apart(places.select("_node", "_n", "_root", F.posexplode("_prefix").alias("_pos", "_s")))
    for turn in range(STARS):
        pairs = settle(_paired(_star(buckets, turn), similarity).join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(pairs)
        edges = edges.unionByName(_verified(settle(_sketched(pairs, rows, similarity)), rows, texts, words, similarity))
        buckets = _apart(_rooted(buckets.drop("_root"), edges))
    rest = settle(_rest(buckets, rows, tested, similarity))
    for turn in range(FIRSTS):
        some = [F.min_by("a", F.xxhash64(F.lit(turn * CHOICES + k), "a", "b")) for k in range(CHOICES)]
        firsts = settle(rest.groupBy("b").agg(F.array_distinct(F.array(*some)).alias("a")).select(F.explode("a").alias("a"), "b"))
        edges = edges.unionByName(_verified(firsts, rows, texts, words, similarity))
        rest = settle(_across(rest.join(firsts, ["a", "b"], "left_anti"), edges))
    edges = edges.unionByName(_verified(rest, rows, texts, words, similarity))
    placed = _rooted(nodes, edges).select(*DIGEST, "_root")
    return rows.select(*KEY, *DIGEST).join(placed, DIGEST).select(*KEY, "_root")


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: that with the smallest id (then text hash)."""
    first = near_copies(docs, id_col, text_col, words, similarity).groupBy("_root").agg(F.min(F.struct(*KEY)).alias("_first"))
    kept = first.select("_first.*")
    # equal rows of an id and a text become one before they meet
    rows = packed(docs, id_col, text_col).groupBy(*KEY).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return rows.join(kept, KEY, "left_semi").select("_row.*")


ship(__name__)
