"""PCA whitening of embeddings, with the covariance from upper-triangle column aggregates.

Components become integers x = floor(scale * c) + shift. One aggregation counts the vectors and sums each dimension; a second one sums, for every pair of dimensions
i <= j, the product of the centred columns, as a generated expression each. Columns are centred by the whole number next to their mean, so that products and sums are exact
integers, whatever the partitions; what that number lacks to the mean is taken off exactly on the driver, in Python's integers: the covariance is the exact one, rounded once. LAPACK
decomposes it. Each vector is then projected in Arrow batches, and a last aggregation of the same kind over the whitened columns gives the largest departure from the identity.

One aggregation holds at most ``PAIRS`` pairs; beyond, several are run over the same rows. Aggregates combine within tasks, so a task sends one row, of 8 bytes a pair.
Sums are doubles where the number of vectors times the largest squared deviation is below 2 ** 53, so that they are exact, then 64-bit integers where it proves that they fit, else decimals of 38 digits.

Edge cases: rows whose vector is null or holds a null or a non-finite entry are left out. A vector shorter than the longest counts as if zeros followed, an empty one as all zeros. Rows that
repeat an id each count and each have their rows, as have those without id. Components whose eigenvalue is zero but for rounding (where vectors are fewer than dimensions, or
equal) are whitened to zero and aren't part of the departure from the identity; the departure is 0 where there are no others. An entry of 2 ** 46 or more, or a deviation that
doesn't fit into 64 bits, raises. An empty table gives an empty result. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm import _shared as S

SCALE, SHIFT, COMPONENTS, PAIRS = 64, 1_000_000, 32, 8256
LARGEST = 2.0**46


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v, as doubles, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is larger than any number
    return df.where(v.isNotNull() & finite).select(F.col("vec_id").cast("long"), v.alias("v"))


def integers(dims: int, scale: int = SCALE, shift: int = SHIFT) -> list[Column]:
    """Column x of each dimension of v."""
    entry = lambda d: F.coalesce(F.get("v", F.lit(d)), F.lit(0.0))
    return [(F.floor(F.lit(float(scale)) * entry(d)).cast("long") + F.lit(shift).cast("long")).alias(f"x{d}") for d in range(dims)]


def pair_sums(df: DataFrame, columns: list[str], kind: str) -> np.ndarray:
    """Sums of products of all pairs of columns, a symmetric matrix of Python's numbers. kind: the type that products are summed as."""
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    out = np.zeros((len(columns), len(columns)), object)
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        found = df.agg(*(F.expr(f"sum(cast({columns[i]} AS {kind}) * {columns[j]})").alias(f"s{i}_{j}") for i, j in some)).collect()[0]
        for (i, j), s in zip(some, found, strict=True):
            out[i, j] = out[j, i] = s or 0
    return out


class Fit:
    """n, the sums S of each dimension, the projection and what each component explains."""

    def __init__(self, n: int, sums: list[int], low: list[int], high: list[int], covariance: np.ndarray, components: int):
        self.n, self.sums = n, sums
        value, vector = np.linalg.eigh(covariance)  # rising, by LAPACK
        value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
        trace = float(np.trace(covariance))
        self.real = value > max(trace, 0.0) * len(covariance) * 2.0**-50
        self.weights = vector * np.where(self.real, 1 / np.sqrt(np.where(self.real, value, 1.0)), 0.0)
        self.explained = [float(v / trace) if r else 0.0 for v, r in zip(value, self.real, strict=True)]
        # what n * x - S can come to, so that its squares are known to fit
        self.most = max((max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums, strict=True)), default=0)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The deviation and the whitened components of each row of x, integers."""
        if len(self.sums) * self.most**2 < 2**63:
            away = self.n * x - np.array(self.sums, np.int64)
            deviation = (away * away).sum(axis=1)
        else:
            away = self.n * x.astype(object) - np.array(self.sums, object)
            deviation = (away * away).sum(axis=1)
            if any(d >= 2**63 for d in deviation):
                raise OverflowError("a deviation doesn't fit into 64 bits")
            deviation = deviation.astype(np.int64)
        return deviation, (away.astype(np.float64) / self.n) @ self.weights


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Fit | None:
    """rows: of ``usable``. None without vectors or dimensions."""
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).head()
    if not size["dims"]:
        return None
    if (size["most"] or 0.0) >= LARGEST:
        raise OverflowError("an entry of 2 ** 46 or more")
    wide = rows.select(*integers(size["dims"], scale, shift))
    each = wide.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in wide.columns for f in (F.sum, F.min, F.max))).head()
    n = each["n"]
    sums, low, high = ([each[f"{f}_{c}"] for c in wide.columns] for f in ("sum", "min", "max"))
    middle = [s // n for s in sums]
    off = max(max(b - m, m - a) for a, b, m in zip(low, high, middle, strict=True))
    centred = wide.select(*((F.col(c) - F.lit(m)).alias(c) for c, m in zip(wide.columns, middle, strict=True)))
    most = n * off**2  # no sum, of any part of the rows, is beyond it
    products = pair_sums(centred, wide.columns, "double" if most < 2**53 else "bigint" if most < 2**63 else "decimal(19,0)")
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    covariance = np.array([[(n * int(products[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(len(rest))] for i in range(len(rest))])
    return Fit(n, sums, low, high, covariance, components)


def project(rows: DataFrame, model: Fit, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """rows: of ``usable``. vec_id, deviation and whitened, an array of all components."""
    dims, held = len(model.sums), rows.sparkSession.sparkContext.broadcast(model)  # dims * components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            size = np.diff(column.offsets.to_numpy()).astype(np.int64)
            x = np.full((b.num_rows, dims), 0.0)
            row = np.repeat(np.arange(b.num_rows), size)
            x[row, S.spread(np.zeros(b.num_rows, np.int64), size)] = column.flatten().to_numpy()
            deviation, white = held.value.apply(np.floor(scale * x).astype(np.int64) + shift)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation), pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, model: Fit) -> float:
    """The largest entry, without sign, of the whitened vectors' covariance minus the identity."""
    at = np.flatnonzero(model.real).tolist()
    if not at:
        return 0.0
    wide = projected.select(*(F.col("whitened")[d].alias(f"w{i}") for i, d in enumerate(at)), F.lit(1.0).alias("one"))
    sums = pair_sums(wide, wide.columns, "double").astype(np.float64) / model.n  # x was centred before it was projected; what rounding left of the means is in the last column
    covariance = sums[:-1, :-1] - np.outer(sums[:-1, -1], sums[:-1, -1])
    return float(np.abs(covariance - np.eye(len(at))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors: vec_id, embedding. A row for each vector that takes part and each component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors)
    model = fit(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    projected = project(rows, model)
    error = identity_error(projected, model)
    long = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, model.explained)), F.col("_at") + 1)
    return long.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(S.table(spark, sf_dir, "embeddings"))
