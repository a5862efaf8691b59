"""Whitening of embeddings by a tiled covariance.

The covariance of d dimensions is cut into tiles, pairs of column blocks of
TILE dimensions.  The rows of the fit list (each distinct vector once) are cut
into row blocks, and each task writes a row block's columns, centred, as one
record for each column block.  These are shuffled by row block, so that the two
column blocks of every tile meet; each task multiplies its tile pairs and sums
them as it goes, and the sums of the tasks are added for each tile, in two steps.
The driver gets tiles alone: d * d numbers, whatever the number of rows.  It
assembles and decomposes them; the projection is a narrow pass over all rows.

The operator works on whole numbers floor(scale * entry), so that equal rows,
sums and deviations are exact.

Defined results: rows whose vector is null or holds null, NaN or infinite
entries are dropped; a vector shorter than the longest counts as 0 beyond its
end; repeated rows and ids are rows like others, but a vector counts once in the
fit; numbers beyond 64 bits are held at their limits, and a deviation beyond
them is null; a component without variance (below 1e-12 of the trace) has
whitened 0 and explained 0, and no part in identity_error; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import tidy, written

#: Dimensions of a column block, and bytes of the longest record (one column block of a row block).
TILE, BLOCK_BYTES = 32, 1_000_000
#: Tasks whose sums of a tile are added in one group.
FAN = 256
FLAT = 1e-12


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * entry) as long for every entry, null where the vector is null or has an entry that is null or not finite."""
    number = F.transform(vector, lambda c: c.cast("double"))
    limit = F.lit(float(2**63 - 1024))
    x = F.transform(number, lambda c: F.floor(F.greatest(-limit, F.least(limit, c * scale))).cast("long"))
    finite = F.forall(number, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.when(vector.isNotNull() & finite, x)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of width numbers, short lists filled with 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the binary float64 column `sums` for each combination of keys, in two steps of at most FAN tasks' parts or so."""
    names = [*keys, "task"]
    kind = ", ".join(f"{k} long" for k in keys)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending")])
        total = 0.0
        for sums in table["sums"]:
            total = total + np.frombuffer(sums.as_py())
        return pa.table({**{k: [table[k][0].as_py()] for k in keys}, "task": [table["task"][0].as_py()], "sums": [total.tobytes()]})

    for step in (F.floor(F.col("task") / FAN), F.lit(0)):
        parts = parts.select(*[F.col(k).cast("long").alias(k) for k in names], "sums").withColumn("step", step.cast("long"))
        parts = parts.groupBy(*keys, "step").applyInArrow(lambda t: add(t.select([*names, "sums"])), f"{kind}, task long, sums binary")
    return parts.select(*keys, "sums")


@dataclass
class Whitening:
    """n vectors with sums S; unit eigenvectors (columns) and eigenvalues of the leading components, and the trace."""

    width: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def factors(self) -> np.ndarray:
        """What a centred vector is multiplied by: eigenvectors over the root of their eigenvalues, 0 for components without variance."""
        open_ = self.values > FLAT * max(self.trace, 0)
        return np.where(open_, self.vectors / np.sqrt(np.where(open_, self.values, 1)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part of S/n taken off in whole numbers."""
        whole = np.array([s // self.n for s in self.sums], object)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        if x.size and max(int(np.abs(x.astype(float)).max()), *(abs(int(w)) for w in whole)) >= 1 << 61:
            return (x.astype(object) - whole).astype(float) - rest
        return x - whole.astype(np.int64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; null beyond 64 bits."""
        most = self.n * max(1.0, float(np.abs(x.astype(float)).max(initial=0))) + max((abs(s) for s in self.sums), default=0)
        if most * most * self.width < 2**62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in map(int, exact)]


def tiled_covariance(fit: DataFrame, width: int, n: int, center: Whitening, tile: int = TILE) -> np.ndarray:
    """The covariance (divisor n) of the list column x of fit, from tiles."""
    blocks = -(-width // tile)
    rows = max(1, BLOCK_BYTES // (8 * tile))

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, len(batch), rows):
                c = center.centred(matrix(batch.column(0).slice(k, rows), width))
                parts = [np.ascontiguousarray(c[:, tile * j : tile * (j + 1)]).tobytes() for j in range(blocks)]
                name = (task << 32) + count
                count += 1
                yield pa.RecordBatch.from_arrays([pa.array([name] * blocks, pa.int64()), pa.array(range(blocks), pa.int32()), pa.array(parts, pa.binary())], names=["row_block", "col", "part"])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, a, b in zip(*(batch.column(k) for k in range(4)), strict=True):
                i, j = i.as_py(), j.as_py()
                left = np.frombuffer(a.as_buffer()).reshape(-1, min(tile, width - tile * i))
                right = np.frombuffer(b.as_buffer()).reshape(-1, min(tile, width - tile * j))
                product = left.T @ right
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
        task = TaskContext.get().partitionId()
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([task] * len(keys), pa.int64()), pa.array([sums[k].tobytes() for k in keys], pa.binary())],
            names=["i", "j", "task", "sums"],
        )

    cut = fit.select("x").mapInArrow(tidy(column_blocks), "row_block long, col int, part binary")
    cut = written(cut, "column_blocks")
    left = cut.select("row_block", F.col("col").alias("i"), F.col("part").alias("a"))
    right = cut.select("row_block", F.col("col").alias("j"), F.col("part").alias("b"))
    # Of each row block, the pairs of column blocks that are tiles of the upper half.
    pairs = left.join(right.hint("shuffle_merge"), "row_block").where("i <= j").select("i", "j", "a", "b")
    tiles = _added(pairs.mapInArrow(tidy(multiplied), "i long, j long, task long, sums binary"), ["i", "j"])
    out = np.zeros((width, width))
    for r in tiles.collect():
        size = (min(tile, width - tile * r.i), min(tile, width - tile * r.j))
        part = np.frombuffer(r.sums).reshape(size)
        out[tile * r.i : tile * r.i + size[0], tile * r.j : tile * r.j + size[1]] = part
        out[tile * r.j : tile * r.j + size[1], tile * r.i : tile * r.i + size[0]] = part.T
    return out / n


def fit(vectors: DataFrame, components: int, tile: int = TILE) -> tuple[Whitening, float] | None:
    """The whitening of the distinct vectors in the list column x, and its identity error; None for an empty table."""
    listed = written(vectors.select("x").distinct(), "fit_list")
    n, width = listed.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not width:
        return None

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            for k in range(0, len(batch), 4096):
                x = matrix(batch.column(0).slice(k, 4096), width)
                big = np.abs(x.astype(float)).max(initial=0) >= 1 << 50
                total = total + (x.astype(object) if big else x).sum(axis=0)
        # Python's whole numbers: as text, added exactly.
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([str(int(t)) for t in total])], names=["dim", "total"])

    sums = listed.mapInArrow(tidy(summed), "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by_dim = {r.dim: int(r.total) for r in sums.collect()}  # one row a dimension
    w = Whitening(width, n, [by_dim[k] for k in range(width)], np.zeros((width, 0)), np.zeros(0), 0.0)
    covariance = tiled_covariance(listed, width, n, w, tile)
    values, vectors_ = np.linalg.eigh(covariance)
    k = min(components, width)
    w.values, w.vectors, w.trace = np.maximum(values[::-1][:k], 0), vectors_[:, ::-1][:, :k], float(np.trace(covariance))
    return w, identity_error(listed, w)


def identity_error(listed: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured over the rows."""
    factors = w.factors()
    open_ = np.flatnonzero(np.abs(factors).sum(axis=0))
    factors = factors[:, open_]
    k = len(open_)
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                z = w.centred(matrix(batch.column(0).slice(at, 4096), w.width)) @ factors
                first, second = first + z.sum(axis=0), second + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.concatenate((first, second.ravel())).tobytes()], pa.binary())], names=["all", "task", "sums"])

    sums = _added(listed.mapInArrow(tidy(moments), "all long, task long, sums binary"), ["all"]).first()["sums"]
    both = np.frombuffer(sums) / w.n
    mean, square = both[:k], both[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every row that has a whole vector and each leading component."""
    kept = rows.select(F.col(vec_id).alias("vec_id"), quantised(F.col(vector), scale).alias("x")).where("x is not null")
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(kept, components, tile)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    w, error = fitted
    factors, k = w.factors(), w.vectors.shape[1]
    explained = np.where(w.values > FLAT * w.trace, w.values / (w.trace or 1), 0.0)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x, m = matrix(part.column(1), w.width), len(part)
                z = w.centred(x) @ factors
                row = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                        pa.array(w.deviations(x), pa.int64()).take(pa.array(row)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return kept.mapInArrow(tidy(projected), schema)
