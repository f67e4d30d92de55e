"""Token totals by source, language and tokenizer version, kept up by signed deltas.

A ledger is a folder with the events, the standing counts and the deltas of each commit. A batch holds
inserts, deletes and revised counts of (document, tokenizer). For each change the ledger looks up what
the document last counted for, and adds ``-old`` and ``+new`` to the totals of their groups. That is found
in the standing counts of the batch before, a row per live document, and no earlier batch is read. A batch
is committed when its deltas are complete, which are written last; until then its folders are written anew by a retry,
and a batch that is committed already is left alone, so a replay counts nothing twice. Totals, also those after any
earlier batch, are sums over the committed deltas and never need the documents again.

Of several changes to a key in one batch the one with the largest ``seq`` holds. Inserting what is there
revises it, revising what isn't there inserts it, deleting what isn't there does nothing. NULL
source or lang is a group of its own; a NULL count is 0; a NULL id is a key like any other.
Repeated equal changes count once. An empty batch changes nothing. ``_part`` (0 where changes don't have it)
tells documents apart that share an id: ``token_counts`` puts the text's hash there for rows without an
id and for rows whose id comes more than once, so different texts count each and equal ones once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landtrace.llm.common import NO_ID, row_id, ship
from landtrace.llm.tokens import worker_tokenizer

GROUP = ["source", "lang", "tokenizer"]
KEY = ["_id", "_part", "tokenizer"]
EVENTS = "_id long, _part long, tokenizer string, live boolean, source string, lang string, n_tokens long"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(path)
        for batch in batches:
            sizes: list[int] = []
            for lo in range(0, batch.num_rows, 512):
                sizes += [len(ids) // 4 for ids in encode(batch.column(4).slice(lo, 512).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sizes, pa.int64())], ["_id", "_v", "source", "lang", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """(_id, _part, _v, source, lang, n_tokens) of every row; ``_v`` is the text's hash."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        row_id(id_col).alias("_id"), F.xxhash64(text).alias("_v"), F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"), text.alias("_text"))
    counted = rows.mapInArrow(_count(tokenizer_path), "_id long, _v long, source string, lang string, n_tokens long")
    many = docs.select(row_id(id_col).alias("_id")).groupBy("_id").agg(F.count("*").alias("_n")).filter(
        (F.col("_n") > 1) | (F.col("_id") == NO_ID)).select("_id", F.lit(True).alias("_many"))
    part = F.when(F.col("_many"), F.col("_v")).otherwise(F.lit(0)).cast("long")
    return counted.join(many, "_id", "left").select("_id", part.alias("_part"), "_v", "source", "lang", "n_tokens")


class TokenLedger:
    """Totals in ``folder``, which all executors must reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _paths(self, kind: str, batches: list[int]) -> list[str]:
        return [f"{self.folder}/{kind}/batch={b}" for b in batches]

    def committed(self) -> list[int]:
        """Numbers of the complete batches."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/deltas")
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        done = []
        for status in fs.listStatus(root):
            path = status.getPath()
            if fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                done.append(int(path.getName().split("=")[1]))
        return sorted(done)

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._paths(kind, batches))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Take over a batch of (_id, tokenizer, op, source, lang, n_tokens, seq) and perhaps _part; False if it was there."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        last = F.max(F.struct("seq", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))).alias("_c")
        part = F.col("_part").cast("long") if "_part" in changes.columns else F.lit(0).cast("long")
        new = changes.withColumns({"_id": F.coalesce(F.col("_id").cast("long"), F.lit(NO_ID)), "_part": part}).groupBy(*KEY).agg(last).select(
            *KEY, (F.col("_c.op") != "delete").alias("live"), F.col("_c.source").alias("source"),
            F.col("_c.lang").alias("lang"), F.col("_c.n_tokens").alias("n_tokens"))
        new.write.mode("overwrite").parquet(*self._paths("events", [batch]))
        new = self._read("events", EVENTS, [batch])
        standing = self._read("standing", EVENTS, done[-1:])
        rest = standing.join(new.select(*KEY), KEY, "left_anti")
        rest.unionByName(new.filter("live")).write.mode("overwrite").parquet(*self._paths("standing", [batch]))
        old = standing.join(new.select(*KEY), KEY, "left_semi")
        signed = [rows.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).alias("n_tokens"))
                  for rows, sign in ((new.filter("live"), 1), (old, -1))]
        deltas = signed[0].unionByName(signed[1]).groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        deltas.write.mode("overwrite").parquet(*self._paths("deltas", [batch]))
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, lang and tokenizer."""
        sums = self._read("deltas", DELTAS, self.committed()).groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def history(self) -> DataFrame:
        """``totals`` as they were after each ``batch``; an array per group holds its deltas, one per batch."""
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], f"batch int, {DELTAS}")
        deltas = self.spark.read.schema(f"{DELTAS}, batch int").option("basePath", f"{self.folder}/deltas").parquet(
            *self._paths("deltas", done))
        groups = deltas.groupBy(*GROUP).agg(F.collect_list(F.struct("batch", "n_docs", "n_tokens")).alias("_d"))
        rows = groups.select(*GROUP, "_d", F.explode(F.array(*[F.lit(b) for b in done])).alias("batch"))

        def upto(name: str) -> Column:
            return F.aggregate(
                F.filter("_d", lambda x: x["batch"] <= F.col("batch")), F.lit(0).cast("long"), lambda n, x: n + x[name]).alias(name)

        return rows.select("batch", *GROUP, upto("n_docs"), upto("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")


def copies(counted: DataFrame) -> DataFrame:
    """Rows of ``token_counts`` whose text also comes under a smaller id."""
    first = counted.groupBy("_v").agg(F.min("_id").alias("_first"))
    return counted.join(first, "_v").filter("_id <> _first").drop("_first")


ship(__name__)
