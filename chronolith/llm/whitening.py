"""Embedding whitening from a covariance of two passes.

Vectors become integers (floor(scale * c) + shift), so that their sums are exact and the mean is the quotient of two
integers. A second pass centres every vector before it multiplies (an integer difference less the mean's fraction, so
nothing is lost to the mean's size) and adds the outer products of its rows by one matrix product a block. Both passes
end in one partial result a partition; treeAggregate merges them in levels of a few partials each, so that neither the
driver nor a task gets more than a few matrices. The covariance goes to LAPACK's symmetric eigensolver on the driver
and the leading axes, divided by their deviations, are broadcast (dimension x components numbers). A third pass over
the whitened values measures how far their covariance is from the identity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a block of vectors worked on at once; partial results merged in one step of a tree.
ENTRIES, FAN = 1 << 21, 8
#: Largest dimension: a covariance of 4,096 dimensions takes 128 MB.
WIDEST = 4096
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Model:
    """What was fitted on the n vectors of one dimension: exact sums, axes (dimension, components), eigenvalues by
    falling size, trace, and the largest absolute entry of the whitened covariance minus the identity (NaN until it is
    measured). ``good`` marks components of positive variance; the others have no whitened value."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    good: np.ndarray
    identity_error: float = math.nan

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: whole parts are taken off as integers."""
        parts = [divmod(s, self.n) for s in self.sums]
        whole, rest = np.array([q for q, _ in parts], np.int64), np.array([r / self.n for _, r in parts])
        if _widest(x) + max(map(abs, whole.tolist()), default=0) > HIGH:
            return (x.astype(object) - whole.astype(object)).astype(np.float64) - rest
        return (x - whole).astype(np.float64) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.centred(x) @ self.axes / np.where(self.good, np.sqrt(np.abs(self.values)), np.nan)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - sum)^2, exact; at the end of the 64-bit range beyond it."""
        most = self.n * _widest(x) + max(map(abs, self.sums), default=0)
        if most * most * x.shape[1] <= HIGH:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1)
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return np.array([min(HIGH, int((row * row).sum())) for row in off], np.int64)


def _widest(x: np.ndarray) -> int:
    return max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): rows whose vector is not null and holds no null or non-finite entry. Ids may be null."""
    rows = vectors.select("vec_id", F.transform(column, lambda c: c.cast("double")).alias("v"))
    return rows.filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def _blocks(batch: pa.RecordBatch, scale: float, shift: int):
    """(dimension, row numbers, integer matrix) of a batch, a bounded number of entries at a time."""
    lists = batch.column(1)
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for dim in np.unique(sizes).tolist():
        if dim > WIDEST:
            raise ValueError(f"vectors of {dim} dimensions; at most {WIDEST} can be whitened")
        where = np.flatnonzero(sizes == dim)
        step = max(1, ENTRIES // max(dim, 1))
        for at in range(0, len(where), step):
            some = where[at : at + step]
            with np.errstate(over="ignore"):
                x = np.floor(scale * flat[ends[some][:, None] + np.arange(dim)])
            inside = np.abs(x) < 2.0**62
            whole = np.where(inside, x, 0).astype(np.int64) + shift
            yield dim, some, np.where(inside, whole, np.where(x > 0, 1 << 62, -(1 << 62)))


def _merged(partials: DataFrame, add):
    """Partial results {dimension: value} of the partitions (one pickled column), added up in a tree."""
    import pickle

    rdd = partials.rdd.map(lambda row: pickle.loads(row[0]))
    depth = max(2, math.ceil(math.log(max(rdd.getNumPartitions(), 2), FAN)))

    def both(a, b):
        for dim, value in b.items():
            a[dim] = add(a[dim], value) if dim in a else value
        return a

    return rdd.treeAggregate({}, both, both, depth)


def _partial(rows: DataFrame, scale: float, shift: int, of, add) -> DataFrame:
    """One row a partition: the sum of ``of(dimension, matrix)`` over its blocks, by dimension, pickled."""
    import pickle

    def run(batches):
        found: dict = {}
        for batch in batches:
            for dim, _, x in _blocks(batch, scale, shift):
                value = of(dim, x)
                found[dim] = add(found[dim], value) if dim in found else value
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["part"])

    return rows.mapInArrow(run, "part binary")


def _plus(a, b):
    return tuple(x + y for x, y in zip(a, b))


def _sums(dim: int, x: np.ndarray):
    """(rows, exact sums as Python's integers) of a block."""
    total = x.sum(0).tolist() if _widest(x) * len(x) <= HIGH else x.astype(object).sum(0).tolist()
    return len(x), np.array([int(s) for s in total], object)


def fit(rows: DataFrame, components: int = 8, scale: float = 1024, shift: int = 100_000) -> dict[int, Model]:
    """Models by dimension of ``rows`` (vec_id, v), see ``usable``: every vector counts, copies as often as they occur."""
    context = rows.sparkSession.sparkContext
    first = _merged(_partial(rows, scale, shift, _sums, _plus), _plus)
    means = context.broadcast({dim: Model(n, tuple(s.tolist()), np.zeros((dim, 0)), np.zeros(0), 0.0, np.zeros(0, bool)) for dim, (n, s) in first.items()})

    def outer(dim, x):
        c = means.value[dim].centred(x)
        return (c.T @ c,)

    second = _merged(_partial(rows, scale, shift, outer, _plus), _plus)
    models = {}
    for dim, (n, s) in first.items():
        covariance = second[dim][0] / n
        values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        values, axes = values[order], axes[:, order]
        lead = np.abs(axes).argmax(0) if dim else np.zeros(0, int)
        axes = axes * np.where(axes[lead, np.arange(len(order))] < 0, -1.0, 1.0)
        trace = float(np.trace(covariance))
        models[dim] = Model(n, tuple(s.tolist()), axes, values, trace, values > trace * 1e-13)
    fitted = context.broadcast(models)

    def spread(dim, x):
        w = np.nan_to_num(fitted.value[dim].whitened(x))
        return w.sum(0), w.T @ w

    third = _merged(_partial(rows, scale, shift, spread, _plus), _plus)
    for dim, m in models.items():
        mean, square = third[dim][0] / m.n, third[dim][1] / m.n
        off = np.abs(square - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(m.good, m.good)]
        models[dim] = Model(m.n, m.sums, m.axes, m.values, m.trace, m.good, float(off.max()) if off.size else math.nan)
    return models


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024, shift: int = 100_000, column: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) for every usable vector.

    whitened has up to ``components`` values, a vector's coordinates on the leading axes in deviations; explained has
    those axes' shares of the variance. n counts the vectors fitted on, deviation is the exact sum of (n x - sum)^2.

    Vectors that are null or hold a null or non-finite entry have no row; those without an id do. Vectors of different
    dimensions are whitened apart, each dimension on its own vectors; an empty vector has no components. Components
    without variance (a single vector, copies of one, constant entries, a dependent one) have a null whitened value and
    take no part in identity_error. Entries beyond 2^62 and deviations beyond 64 bits are set to the range's end.
    Repeated rows and copies count and come out as often as they occur; other columns are ignored; an empty table gives
    none. Signs are fixed: an axis's largest entry is positive.
    """
    rows = usable(vectors, column)
    models = fit(rows, components, scale, shift)
    sent = rows.sparkSession.sparkContext.broadcast(models)
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"

    def lists(values: np.ndarray) -> pa.Array:
        ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), from_pandas=True))  # NaN: null

    def run(batches):
        for batch in batches:
            for dim, some, x in _blocks(batch, scale, shift):
                m = sent.value[dim]
                share = m.values / m.trace if m.trace > 0 else np.full(len(m.values), np.nan)
                columns = [batch.column(0).take(pa.array(some)), pa.array(np.full(len(x), m.n)), pa.array(m.deviations(x)), lists(m.whitened(x)), lists(np.tile(share, (len(x), 1))), pa.array(np.full(len(x), m.identity_error), from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, schema)


def op11_whitening(spark, sf_dir) -> DataFrame:
    """A row for each embedding and each of the eight leading components."""
    from chronolith.llm.common import table

    found = whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = found.select("vec_id", "n", "deviation", "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
