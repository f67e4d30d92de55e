"""Target-distribution importance resampling: draw documents whose hashed word runs look like a target's.

Features are all runs of ``low`` to ``high`` consecutive words, hashed into buckets. A bucket's gain is the log
ratio of its smoothed shares in the target and in the corpus, a document's weight the floored mean of its features'
gains, and the draw takes the best scores: weight plus Gumbel noise from the id's hash, which samples without replacement.

Newlines separate words, so texts are cut into lines. A line that many documents repeat is taken apart once: its
features are found by distinct line and multiplied by its occurrences, for the corpus counts as well as for the
weights. Only runs that cross lines are found by document. Distinct lines' buckets are a written table, so words are cut
once. A line that a third of all documents have is no hot key: documents stand in blocks of about ``BLOCK``, and
a block names each of its lines once. Lines are recognised by their MD5.

NULL, empty and wordless texts have no features and weight 0. A NULL id hashes as an empty string and comes first among
equal scores; rows that repeat an id have the same noise, and are ranked by the text's hash where their scores are equal.
Repeated rows are counted, returned and ranked apart. Other columns are ignored. An empty corpus gives an empty result;
with an empty target every gain only says how rare the bucket is. A very long text is a row per line, a very long line
one row, as it is in the input.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landtrace.llm.common import LOWER, UPPER, keyed, outer_id, settle, shared_folder, ship

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
BLOCK = 256
KEY = ["_id", "_v"]
KNOWN = 1_000_000  # features whose buckets a task remembers


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(line)).alias("_h")


class Hasher:
    """Buckets of word runs."""

    def __init__(self, low: int, high: int, buckets: int):
        self.sizes, self.buckets, self.known = range(low, high + 1), buckets, {}
        self.words = re.compile(WORD).findall
        self.lower = str.maketrans(UPPER, LOWER)

    def bucket(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found

    def of_line(self, line: str) -> tuple[int, list[int]]:
        """Number of words, and the buckets of all runs."""
        words = self.words(line.translate(self.lower) if not line.islower() else line)
        n = len(words)
        return n, [self.bucket(words[i] if size == 1 else " ".join(words[i:i + size]))
                   for size in self.sizes for i in range(n - size + 1)]

    def crossing(self, text: str) -> list[int]:
        """Buckets of the runs that lie in more than one line."""
        words, places = [], []
        for k, line in enumerate(text.translate(self.lower).split("\n")):
            some = self.words(line)
            words += some
            places += [k] * len(some)
        return [self.bucket(" ".join(words[i:i + size])) for size in self.sizes
                for i in range(len(words) - size + 1) if places[i] != places[i + size - 1]]


def _of_lines(low: int, high: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(low, high, buckets)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                made = [hasher.of_line(line.as_py()) for line in some.column(2)]
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array([m[0] for m in made], pa.int64()),
                    pa.array([m[1] for m in made], pa.list_(pa.int32()))], ["_h", "_n", "_words", "_found"])

    return run


def _across_lines(low: int, high: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(max(2, low), high, buckets)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1),
                    pa.array([hasher.crossing(t.as_py()) for t in some.column(2)], pa.list_(pa.int32()))], [*KEY, "_found"])

    return run


def _summed(gains: np.ndarray, keep: int):
    """The first ``keep`` columns, then the number and the gain of the buckets in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(keep)
            each = gains[np.asarray(found.flatten())]
            ends = np.cumsum(np.asarray(found.value_lengths()))
            total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            sizes = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(keep)], pa.array(sizes, pa.int64()), pa.array(total[ends] - total[ends - sizes])],
                [*batch.schema.names[:keep], "_features", "_gain"])

    return run


class Features:
    """A table's features: once for each distinct line, and by document where they cross lines."""

    def __init__(self, texts: DataFrame, low: int, high: int, buckets: int, folder: str):
        """``texts``: (_id, _v, _text)."""
        self.texts = texts
        lines = texts.select(F.explode(F.split("_text", "\n")).alias("_line")).groupBy("_line").agg(F.count("*").alias("_n"))
        lines.select(line_hash("_line"), "_n", "_line").mapInArrow(
            _of_lines(low, high, buckets), "_h binary, _n long, _words long, _found array<int>").write.parquet(folder)
        self.lines = texts.sparkSession.read.parquet(folder).filter("_words > 0")
        self.crossing = texts.mapInArrow(
            _across_lines(low, high, buckets), "_id long, _v long, _found array<int>") if high > 1 else None

    def counts(self) -> DataFrame:
        """(bucket, n): occurrences in the whole table; at most one row per bucket."""
        found = self.lines.select(F.explode("_found").alias("bucket"), "_n")
        if self.crossing is not None:
            found = found.unionByName(self.crossing.select(F.explode("_found").alias("bucket"), F.lit(1).cast("long").alias("_n")))
        return found.groupBy("bucket").agg(F.sum("_n").alias("n"))

    def by_document(self, gains: np.ndarray) -> DataFrame:
        """(_id, _v, n_words, n_features, gain): sums over all rows that share an id and a text; wordless ones are missing."""
        blocks = max(1, self.texts.count() // BLOCK)
        sums = self.lines.select("_h", "_words", "_found").mapInArrow(
            _summed(gains, 2), "_h binary, _words long, _features long, _gain long")
        named = self.texts.select(*KEY, F.explode(F.split("_text", "\n")).alias("_line")).select(
            F.pmod(F.xxhash64(*KEY), F.lit(blocks)).alias("_block"), *KEY, line_hash("_line"))
        links = named.repartition("_block", "_h").groupBy("_block", "_h", *KEY).agg(F.count("*").alias("_times")).groupBy(
            "_block", "_h").agg(F.collect_list(F.struct(*KEY, "_times")).alias("_rows"))
        parts = links.join(sums, "_h").select(F.inline("_rows"), "_words", "_features", "_gain").select(
            *KEY, *[(F.col("_times") * F.col(c)).alias(c) for c in ("_words", "_features", "_gain")])
        if self.crossing is not None:
            parts = parts.unionByName(self.crossing.mapInArrow(
                _summed(gains, 2), "_id long, _v long, _features long, _gain long").select(
                *KEY, F.lit(0).cast("long").alias("_words"), "_features", "_gain"))
        return parts.groupBy(*KEY).agg(*[F.sum(a).alias(b) for a, b in (
            ("_words", "n_words"), ("_features", "n_features"), ("_gain", "gain"))])


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gains by bucket; ``buckets`` numbers pass through the driver."""
    spark = corpus.sparkSession
    sides = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(
        target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t"))).unionByName(
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t")))
    # bucket -1 holds the totals
    both = settle(sides.unionByName(sides.withColumn("bucket", F.lit(-1))).groupBy("bucket").agg(
        F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = both.filter("bucket = -1").first()
    ratio = ((F.col("t") + 1).cast("double") * float(total["s"] + buckets)) / (
        (F.col("s") + 1).cast("double") * float(total["t"] + buckets))
    gain = F.floor(F.log(ratio) * 1000)
    found = both.filter("bucket >= 0").select("bucket", gain.alias("g")).orderBy("bucket").collect()
    return np.array([r["g"] for r in found], np.int64)


def gumbel(id_col: Column, seed: int) -> Column:
    """Floored thousandths of Gumbel noise from 32 bits of the id's SHA-256."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """``rows`` with their place in the global ``order`` as ``rank``, NULL beyond ``most``: a range sort, then one
    offset for each of its partitions."""
    placed = settle(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_at") + 1
    return placed.withColumn("_part", part).withColumn("_at", at).join(offsets, "_part").withColumn(
        "rank", F.when(place <= most, place)).drop("_part", "_at", "_offset")


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), low: int = 1, high: int = 1, buckets: int = BUCKETS,
    min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id",
    target_text: str = "text",
) -> DataFrame:
    """Every row's ``id_col``, n_features, weight, score and rank (NULL if not drawn).

    ``share`` (a part, of a whole) of the documents with ``min_words`` words or more is drawn, rounded down.
    """
    folder = shared_folder(docs.sparkSession, f"resampling-{uuid.uuid4().hex}")
    corpus = Features(keyed(docs, id_col, text_col), low, high, buckets, f"{folder}/corpus")
    wanted = Features(keyed(target, target_id, target_text), low, high, buckets, f"{folder}/target")
    gains = bucket_gains(corpus.counts(), wanted.counts(), buckets)
    copies = corpus.texts.groupBy(*KEY).agg(F.count("*").alias("_copies"))
    known = copies.join(corpus.by_document(gains), KEY, "left")
    one = [F.expr(f"coalesce({c}, 0) div _copies").alias(c) for c in ("n_words", "n_features")]
    weight = F.expr("if(n_features > 0, (gain - pmod(gain, n_features)) div n_features, 0)").alias("weight")
    rows = known.select(*KEY, *one, weight, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).withColumn(
        "score", F.col("weight") + gumbel(outer_id(), seed))
    rows = settle(rows)
    able = rows.filter(F.col("n_words") >= min_words)
    drawn = ranked(able, [F.desc("score"), F.asc("_id"), F.asc("_v"), F.asc("_copy")], able.count() * share[0] // share[1])
    others = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select(outer_id().alias(id_col), "n_features", "weight", "score", "rank")


ship(__name__)
