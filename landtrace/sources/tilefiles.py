"""Files of tiles on a local disk, or on one that all machines mount.

Hadoop starts a process for the rights of every folder, file and checksum file that it makes there, some 10 ms each, which
is nearly all the time that a table of small tiles takes. Here each task makes its folders and files itself, with Arrow, below
a folder of its own, and the driver moves the groups of the tasks that ended. What a failed task left is not moved.
"""

from __future__ import annotations

import os
import shutil
import sys
import uuid
from collections.abc import Iterator, Sequence

from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

try:
    import pyarrow as pa
    import pyarrow.parquet as pq
except ImportError:
    pa = None

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installed copy

NUMBERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
PLAIN = (*NUMBERED, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.DateType)
CODECS = {"snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "none": "none", "uncompressed": "none"}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ROW_GROUP = 500_000


def local_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a folder on a local disk; None on any other file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(place).toUri()
    return full.getPath() if full.getScheme() == "file" else None


def codec(df: DataFrame) -> str | None:
    return CODECS.get(df.sparkSession.conf.get("spark.sql.parquet.compression.codec").lower())


def writable(df: DataFrame, by: Sequence[str]) -> bool:
    """Groups by whole numbers, and other columns that Spark reads from Arrow's files as from its own."""
    if pa is None or codec(df) is None or not set(by) < set(df.columns) or len(set(df.columns)) < len(df.columns):
        return False
    kinds = {f.name: f.dataType for f in df.schema if not f.metadata}
    return len(kinds) == len(df.columns) and all(
        isinstance(kind, NUMBERED if name in by else PLAIN) or name not in by and kind == T.StringType()
        for name, kind in kinds.items())


def write_tiles(dealt: DataFrame, path: str, by: Sequence[str], max_records: int, replace: bool) -> None:
    """A folder below ``path`` for each group, named as Hive does; with ``replace`` groups that are there go."""
    staging = f"{path}/.tiles-{uuid.uuid4().hex}"
    os.makedirs(staging)
    try:
        written = write_groups(dealt, staging, by, max_records)
        if replace:
            for group in {g for folder in written for g in groups(folder, len(by))}:
                if os.path.isdir(f"{path}/{group}"):
                    shutil.rmtree(f"{path}/{group}")
        for folder in written:
            move(folder, path)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def write_groups(dealt: DataFrame, staging: str, by: Sequence[str], max_records: int) -> list[str]:
    """Write the groups of each task into a folder below ``staging``; the folders of the tasks that ended."""
    by, compression = list(by), codec(dealt)
    rows = dealt.sortWithinPartitions(*by).select(*by, *[c for c in dealt.columns if c not in by])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{staging}/{uuid.uuid4().hex}"
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4()}"
        group = file = None
        kept, waiting, n, files = [], 0, 0, 0

        def flush() -> None:
            nonlocal kept, waiting
            if kept:
                file.write_table(pa.Table.from_batches(kept), row_group_size=ROW_GROUP)
            kept, waiting = [], 0

        def close() -> None:
            nonlocal file
            flush()
            if file is not None:
                file.close()
            file = None

        for batch in batches:
            keys, values = batch.select(by), batch.select(batch.schema.names[len(by):])
            for start, end in runs(keys):
                here = [c[start].as_py() for c in keys.columns]
                if here != group:
                    close()
                    group, n = here, 0
                while start < end:
                    if file is not None and n == max_records > 0:
                        close()
                        n = 0
                    if file is None:
                        folder = "/".join([own, *[f"{k}={NO_VALUE if v is None else v}" for k, v in zip(by, group)]])
                        os.makedirs(folder, exist_ok=True)
                        file = pq.ParquetWriter(
                            f"{folder}/{name}.c{files:03d}.parquet", values.schema, compression=compression, store_schema=False)
                        files += 1
                    some = min(end - start, max_records - n) if max_records > 0 else end - start
                    kept.append(values.slice(start, some))
                    start, n, waiting = start + some, n + some, waiting + some
                    if waiting >= ROW_GROUP:
                        flush()
        close()
        if files:
            yield pa.RecordBatch.from_pydict({"folder": [own]})

    return [r.folder for r in rows.mapInArrow(write, "folder string").collect()]


def runs(keys: pa.RecordBatch) -> list[tuple[int, int]]:
    """Start and end of the rows that follow each other with equal keys."""
    import numpy as np

    if not keys.num_rows:
        return []
    new = np.zeros(keys.num_rows - 1, bool)
    for c in keys.columns:
        empty, value = np.asarray(c.is_null()), np.asarray(c.fill_null(0))
        new |= (empty[1:] != empty[:-1]) | (value[1:] != value[:-1])
    cuts = (np.flatnonzero(new) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, keys.num_rows]))


def groups(folder: str, depth: int) -> list[str]:
    """Folders ``depth`` levels below, as paths from there."""
    if depth == 1:
        return os.listdir(folder)
    return [f"{d}/{rest}" for d in os.listdir(folder) for rest in groups(f"{folder}/{d}", depth - 1)]


def move(source: str, target: str) -> None:
    """Move a folder, or its content if the target is there. Names of files are never the same."""
    if not os.path.isdir(target):
        os.rename(source, target)
        return
    for name in os.listdir(source):
        if os.path.isdir(f"{source}/{name}"):
            move(f"{source}/{name}", f"{target}/{name}")
        else:
            os.rename(f"{source}/{name}", f"{target}/{name}")
