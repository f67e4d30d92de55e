"""Whitening of embeddings from an exact scatter matrix built out of bit planes.

An entry c counts as the integer floor(1024 c) + 100000. A block of rows is shifted by its own smallest
integers, each dimension is cut into bit planes, and each plane is packed across the rows into 64-bit words.
The cross-product of two dimensions is then a sum of powers of two times the number of rows in which two
planes both have a one: AND and popcount. Undoing the shift gives exact sums of products of the unshifted
integers. Tasks return one row per pair of dimensions, in 32-bit limbs that Spark adds up, so what reaches
the driver depends on the width alone. There the covariance is centred as whole numbers,
n * sum(xy) - sum(x) * sum(y), before it is divided and given to ``eigh``.

Rows whose vector is NULL, empty, or has a NULL, NaN or infinite entry are left out, and so are rows of
another width than the most common one (the larger of two as common). Entries whose integer lies beyond 2^62
count as +-2^62. Repeated rows and NULL ids are rows like any other; other columns are ignored. Without a row
left the result is empty. A component without variance (fewer rows than dimensions, constant dimensions) has
``explained`` 0 and ``whitened`` NULL, and ``identity_error`` leaves it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtrace.llm.common import ship

SCALE, SHIFT = 1024.0, 100_000  # fixed values of the integer form
FAR = 1 << 62
BLOCK = 8192  # rows in one set of bit planes
LIMBS = 6  # of 32 bits each, so sums may have 191 bits
BIG = 10**38


@dataclass
class Scatter:
    """Number of rows, exact sums and exact sums of products of the integer vectors."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def centred(self) -> list[list[int]]:
        """n squared times the covariance."""
        return [[self.n * p - a * b for p, b in zip(row, self.sums)] for row, a in zip(self.products, self.sums)]


def integers(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    near = np.abs(scaled) < FAR - SHIFT
    whole = np.where(near, scaled, 0.0).astype(np.int64) + SHIFT
    return np.where(near, whole, np.where(scaled < 0, -FAR, FAR))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, width)


def bit_products(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and sums of products of a block of integer vectors, as Python integers."""
    rows, width = block.shape
    low = block.min(axis=0)
    raised = block.view(np.uint64) - low.view(np.uint64)
    depth = max(1, int(raised.max()).bit_length())
    padded = np.zeros((-(-rows // 64) * 64, width), np.uint64)
    padded[:rows] = raised
    planes = np.empty((width, depth, len(padded) // 64), np.uint64)
    for bit in range(depth):
        ones = ((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        planes[:, bit] = np.packbits(ones, axis=0, bitorder="little").T.copy().view(np.uint64)
    flat = planes.reshape(width * depth, -1)
    powers = np.array([1 << bit for bit in range(depth)], dtype=object)
    # a partial sum of popcounts times powers stays below 2^62 in this many planes at a time
    step = max(1, 62 - rows.bit_length() - depth.bit_length())
    products = np.zeros((width, width), dtype=object)
    for d in range(width):
        for bit in range(depth):
            both = np.bitwise_count(flat[d * depth:] & flat[d * depth + bit]).sum(axis=1, dtype=np.int64).reshape(width - d, depth)
            part = np.zeros(width - d, dtype=object)
            for lo in range(0, depth, step):
                few = both[:, lo:lo + step] << np.arange(min(step, depth - lo))
                part += few.sum(axis=1).astype(object) << lo
            products[d, d:] += part << bit
    upper = np.triu(products)
    products = upper + np.triu(products, 1).T
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(object)
    raised_sums, base = (ones * powers).sum(axis=1), low.astype(object)
    return raised_sums + rows * base, (
        products + np.outer(base, raised_sums) + np.outer(raised_sums, base) + rows * np.outer(base, base))


def _partial(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, products, held = 0, 0, 0, []

        def flush():
            nonlocal total, sums, products, held
            block = np.concatenate(held)
            held = []
            s, p = bit_products(block)
            total, sums, products = total + len(block), sums + s, products + p

        waiting = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                held.append(integers(_matrix(batch.column(0).slice(lo, BLOCK), width)))
                waiting += len(held[-1])
                if waiting >= BLOCK:
                    flush()
                    waiting = 0
        if held and waiting:
            flush()
        if not total:
            return
        # one row for each pair a <= b, one with b = -1 for each sum, one with a = -1 for the count
        entries = [(-1, -1, total)] + [(a, -1, sums[a]) for a in range(width)]
        entries += [(a, b, products[a, b]) for a in range(width) for b in range(a, width)]
        for lo in range(0, len(entries), 10_000):
            some = entries[lo:lo + 10_000]
            limbs = [[(v >> (32 * k)) & 0xFFFFFFFF if k < LIMBS - 1 else v >> (32 * k) for _, _, v in some] for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in some], pa.int32()), pa.array([e[1] for e in some], pa.int32()),
                 *[pa.array(x, pa.int64()) for x in limbs]], ["a", "b", *[f"l{k}" for k in range(LIMBS)]])

    return run


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that count, and their width (0 without any)."""
    finite = F.forall("v", lambda c: F.abs(c) < float("inf"))
    kept = rows.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v")).filter(
        F.coalesce(finite, F.lit(False)) & (F.size("v") > 0))
    widths = kept.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    width = widths["w"] if widths else 0
    return kept.filter(F.size("v") == width), width


def scatter(vectors: DataFrame, width: int) -> Scatter:
    names = [f"l{k}" for k in range(LIMBS)]
    schema = "a int, b int, " + ", ".join(f"{n} long" for n in names)
    rows = vectors.select("v").mapInArrow(_partial(width), schema).groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    found = {}
    for r in rows.to_pylist():
        found[r["a"], r["b"]] = sum(r[n] << (32 * k) for k, n in enumerate(names))
    products = [[found[min(a, b), max(a, b)] for b in range(width)] for a in range(width)]
    return Scatter(found[-1, -1], [found[a, -1] for a in range(width)], products)


@dataclass
class Whitening:
    """Directions of falling variance: unit eigenvectors as columns, their variances, and the part each explains."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def fit(found: Scatter, components: int) -> Whitening:
    n = found.n
    covariance = np.array([[v / (n * n) for v in row] for row in found.centred()], dtype=np.float64)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, trace = values[order], float(np.trace(covariance))
    values = np.where(values > abs(values[0]) * len(covariance) * np.finfo(float).eps, values, 0.0)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    return Whitening(n, found.sums, vectors[:, order], values, explained)


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows projected on the components and scaled; NaN where a component has no variance."""
    whole = np.array([s // model.n for s in model.sums], dtype=object)
    rest = np.array([(s % model.n) / model.n for s in model.sums])
    if max(map(abs, whole.tolist())) < FAR:
        off = (x - whole.astype(np.int64)).astype(np.float64) - rest
    else:
        off = (x.astype(object) - whole).astype(np.float64) - rest
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.variances > 0, 1 / np.sqrt(model.variances), np.nan)
    return off @ model.vectors * scale


def _deviations(x: np.ndarray, model: Whitening) -> list[int]:
    reach = max(1, int(np.abs(x).max())) * model.n + max(map(abs, model.sums))
    if reach * reach * x.shape[1] < 1 << 63:
        off = model.n * x - np.array(model.sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = x.astype(object) * model.n - np.array(model.sums, dtype=object)
    return (off * off).sum(axis=1).tolist()


def _moments(model: Whitening, width: int):
    """Sums and sums of products of whitened rows, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                w = _projected(integers(_matrix(batch.column(0).slice(lo, BLOCK), width)), model)
                sums += w.sum(axis=0)
                products += w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))],
            ["s", "p"])

    return run


def identity_error(vectors: DataFrame, model: Whitening, width: int) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""
    k = len(model.variances)
    parts = vectors.select("v").mapInArrow(_moments(model, width), "s array<double>, p array<double>")
    sums = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    products = parts.select(F.posexplode("p").alias("i", "x")).groupBy((F.col("i") + k).alias("i")).agg(F.sum("x").alias("x"))
    flat = [r["x"] for r in sorted(sums.unionByName(products).collect(), key=lambda r: r["i"])]
    mean = np.array(flat[:k]) / model.n
    covariance = np.array(flat[k:]).reshape(k, k) / model.n - np.outer(mean, mean)
    used = model.variances > 0
    return float(np.abs(covariance - np.eye(k))[np.ix_(used, used)].max()) if used.any() else None


def _whitened(model: Whitening, width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                x = integers(_matrix(some.column(1), width))
                w = _projected(x, model).ravel()
                deviations = [str(v) if v < BIG else None for v in _deviations(x, model)]
                at = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array([deviations[i] for i in at], pa.string()), pa.array(w, mask=np.isnan(w)),
                     pa.array(np.tile(model.explained, len(x)))], names)

    return run


def whiten(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component (at most the width): ``id_col``, component, n, deviation (decimal), whitened,
    explained, identity_error. A deviation of more than 38 digits is NULL."""
    kept, width = whole_vectors(rows, id_col, vector_col)
    kind = kept.schema[id_col].dataType.simpleString()
    names = [id_col, "component", "deviation", "whitened", "explained"]
    schema = f"`{id_col}` {kind}, component int, deviation string, whitened double, explained double"
    if width:
        model = fit(scatter(kept, width), min(components, width))
        error = identity_error(kept, model, width)
        found = kept.mapInArrow(_whitened(model, width, names), schema)
        n = model.n
    else:
        found, n, error = kept.sparkSession.createDataFrame([], schema), 0, None
    return found.select(
        id_col, "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


ship(__name__)
