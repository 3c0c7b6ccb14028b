"""Whitening of embeddings by a tiled covariance.

Vectors are whole numbers here (scaled, floored and shifted entries), so sums and deviations are exact. Centred vectors are
cut into row blocks and these into column blocks; pairs of column blocks are the tiles of the covariance. The column
blocks are shuffled by row block, the two of each tile meet there and are multiplied, products are summed within the task
and then per tile. What reaches the driver is the assembled matrix, whose size is that of a vector squared, whatever the
number of rows: it is eigendecomposed there, and the components go back to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, lean, remove, rows_of, written

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of a row block and dimensions of a column block.
ROWS, WIDTH = 4096, 32
#: Longest vector taken: the covariance and its eigenvectors take 8 bytes a pair of dimensions in the driver, 134 MB at most.
DIMENSIONS = 4096
#: Scaled entries beyond this count as this: up to here doubles hold whole numbers.
FAR = 1 << 52


def vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the rows whose vector is there and has only finite entries."""
    held = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return held.filter(F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(False)))


def _whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x of the vectors of a batch, as longs of ``d`` columns; shorter vectors end with zeros."""
    lists = column(batch, "embedding")
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(values) == len(lists) * d:
        c = values.reshape(len(lists), d)
    else:
        c = np.zeros((len(lists), d))
        c[np.arange(d) < lengths[:, None]] = values
    return np.clip(np.floor(SCALE * c), -FAR, FAR).astype(np.int64) + SHIFT


def _sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """n and the sum of each dimension, exact: tasks sum longs in Python's whole numbers and give decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            n += batch.num_rows
            x = _whole(batch, d)
            total = total + ((x >> 26).sum(0).astype(object) << 26) + (x & ((1 << 26) - 1)).sum(0).astype(object)  # halves, as whole sums could overflow
        if n:
            yield rows_of(["dim", "n", "total"], [np.arange(d), np.full(d, n), [str(t) for t in total]], [pa.int32(), pa.int64(), pa.string()])

    parts = rows.mapInArrow(lean(run), "dim int, n long, total string")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(28,0)")).alias("total")).collect()
    total = np.zeros(d, object)
    for r in found:
        total[r["dim"]] = int(r["total"])
    return (int(found[0]["n"]) if found else 0), total


def means(n: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S/n as a whole number and what is left of it, which doubles hold to their last bit."""
    base = np.array([int(t) // n for t in total], np.int64)
    rest = np.array([(int(t) % n) / n for t in total])
    return base, rest


def covariance(rows: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """The covariance (divisor ``n``) of x about its mean, by tiles."""
    d = len(total)
    base, rest = means(n, total)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            centred = (_whole(batch, d) - base) - rest
            starts = range(0, d, WIDTH)
            cells = [np.ascontiguousarray(centred[:, s : s + WIDTH]).tobytes() for s in starts]
            yield rows_of(["row_block", "col_block", "height", "cells"], [[(task << 32) + k] * len(cells), list(range(len(cells))), [batch.num_rows] * len(cells), cells], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, height, a, b in zip(*(column(batch, c).to_pylist() for c in ("i", "j", "height", "a", "b")), strict=True):
                product = np.frombuffer(a).reshape(height, -1).T @ np.frombuffer(b).reshape(height, -1)
                tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product
        for (i, j), tile in tiles.items():
            at = np.arange(tile.size)
            yield rows_of(["i", "j", "at", "value"], [np.full(tile.size, i), np.full(tile.size, j), at, tile.ravel()], [pa.int32(), pa.int32(), pa.int32(), pa.float64()])

    cut = written(rows.mapInArrow(lean(blocks, ROWS), "row_block long, col_block int, height int, cells binary"))
    left = cut.select("row_block", F.col("col_block").alias("i"), "height", F.col("cells").alias("a"))
    right = cut.select("row_block", F.col("col_block").alias("j"), F.col("cells").alias("b"))
    tiles = left.join(right.hint("merge"), "row_block").filter("i <= j").select("i", "j", "height", "a", "b").mapInArrow(lean(multiply, 64), "i int, j int, at int, value double")
    out = np.zeros((d, d))
    for r in tiles.groupBy("i", "j", "at").agg(F.sum("value").alias("value")).toLocalIterator():
        row, col = divmod(r["at"], min(WIDTH, d - r["j"] * WIDTH))
        row, col = row + r["i"] * WIDTH, col + r["j"] * WIDTH
        out[row, col] = out[col, row] = r["value"] / n
    remove(cut)
    return out


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each vector in the directions of largest variance, scaled to variance one.

    A row for each vector that is there and finite, and each of the ``components`` largest (no more than dimensions):
    ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``. Repeated rows and ids
    count and come back as often as they are there; other columns are ignored; no vectors give no rows. A vector shorter
    than the longest counts as ending with zeros; one of no entries at all is nothing but zeros, and a table of only such
    has no components. A component without variance (fewer vectors than dimensions, equal vectors) has null ``whitened``, and
    null ``explained`` where nothing varies; ``identity_error`` is over the components with variance. A ``deviation`` that
    a long can't hold is null. Vectors of more than ``DIMENSIONS`` entries are an error.
    """
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; the covariance is held for up to {DIMENSIONS}")
    n, total = _sums(rows, d) if d else (0, None)
    if not n:
        return spark.createDataFrame([], schema)
    base, rest = means(n, total)
    values, directions = np.linalg.eigh(covariance(rows, n, total))
    k = min(components, d)
    values, directions = np.maximum(values[::-1], 0), directions[:, ::-1][:, :k]
    trace = float(values.sum())
    there = values[:k] > trace * d * np.finfo(float).eps
    scale = np.where(there, 1 / np.sqrt(np.where(there, values[:k], 1)), np.nan)
    explained = [float(v) / trace if trace else None for v in values[:k]]

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _whole(batch, d)
        return x, ((x - base) - rest) @ directions * scale

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros((k, k)), 0
        for batch in batches:
            _, z = projected(batch)
            total, most = total + z.T @ z, most + batch.num_rows
        if most:
            yield rows_of(["at", "value"], [np.arange(k * k), total.ravel()], [pa.int32(), pa.float64()])

    # the mean of whitened is zero to the last bits, as the vectors are centred before they are projected
    held = rows.mapInArrow(lean(products), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    identity = np.zeros(k * k)
    for r in held:
        identity[r["at"]] = r["value"] / n
    off = np.abs(identity.reshape(k, k) - np.eye(k))[np.ix_(there, there)]
    error = float(off.max()) if off.size else None
    low = np.array([int(t) - n * int(b) for t, b in zip(total, base, strict=True)], np.int64)  # n*x - S = n*(x - base) - low

    def deviations(x: np.ndarray) -> list[int | None]:
        apart = x - base
        if float(np.abs(apart).max(initial=0) + 1) ** 2 * float(n) ** 2 * d < 2.0**62:
            return ((n * apart - low) ** 2).sum(1).tolist()
        exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, low, strict=True)) for row in apart]
        return [v if v < 1 << 63 else None for v in exact]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, z = projected(batch)
            m = len(x)
            ids = column(batch, "vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            z = pa.array(z.ravel(), pa.float64(), from_pandas=True)  # not a number where there is no variance: null
            yield rows_of(
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                [ids, np.tile(np.arange(1, k + 1), m), [n] * (m * k), [v for v in deviations(x) for _ in range(k)], z, explained * m, [error] * (m * k)],
                [ids.type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()],
            )

    return rows.mapInArrow(lean(emit), schema)


def op12_whitening(embeddings: DataFrame) -> DataFrame:
    """The eight directions of largest variance of all embeddings, and every embedding in them."""
    return whitened(embeddings)
