"""Embedding whitening with leading components found by spectrum slicing.

Entries become integers x = floor(1024 c) + 100000. Tasks sum them exactly; then
each row's deviation n x - S is an exact integer, so a row is centred before
anything is multiplied. Tasks add up outer products of centred rows, and rows of
the covariance are summed by their number after one shuffle of d x d numbers a
task. The covariance itself (d columns, whatever the number of rows) is taken
apart on the driver: LDL' factorisations of V - s I count the eigenvalues below
s, bisection on the counts isolates each leading one, Rayleigh quotient iteration
from there converges cubically, and two more counts beside the result certify its
number. Eigenvalues that no count can separate are one cluster, whose vectors
are iterated at right angles to each other.

Defined results: vectors that are null or empty or hold null or non-finite
entries take no part, nor do those of another length than the most common one
(the longer on ties) or with an entry of 2**42 or more in size, which has no exact
deviation; rows with a null or repeated vec_id are rows like any other;
components without variance (n = 1, equal rows, columns that depend on others)
have no whitened value and are left out; an empty table gives no rows; other
columns are ignored. A ``deviation`` beyond 38 digits is null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**42
COMPONENTS = 8
_PIVOT = (1 + 17**0.5) / 8


def valid_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    rows = df.select(F.col(key).alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == sizes[0]["n"]) if sizes else rows


def _whole(column) -> np.ndarray:
    """x of each entry, as int64."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(SCALE * v).astype("i8") + SHIFT


def _chunks(batches, rows: int = 2000):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(number of rows, exact sums of x by column)."""

    def add(batches):
        import pyarrow as pa

        n, high, low = 0, 0, 0
        for part in _chunks(batches):
            x = _whole(part.column(1))
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(low)), pa.int32()), pa.array(np.full(len(low), n), pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = rows.mapInArrow(add, "i int, n long, high long, low long").groupBy("i")
    whole = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    sums = parts.agg(F.sum("n").alias("n"), whole("high"), whole("low")).orderBy("i").collect()
    return (sums[0]["n"], [(int(r["high"]) << 26) + int(r["low"]) for r in sums]) if sums else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: int64 where it fits, else Python's integers."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, "i8")
    return x.astype(object) * n - np.array(sums, object)


def squares(d: np.ndarray) -> list[int]:
    """Exact sums of squares of rows."""
    if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    return [sum(int(y) * int(y) for y in r) for r in d]


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of x with divisor n."""

    def products(batches):
        import pyarrow as pa

        total = 0
        for part in _chunks(batches):
            y = deviations(_whole(part.column(1)), n, sums).astype("f8") / n
            total = total + y.T @ y
        if np.ndim(total):
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def added(batches):
        import pyarrow as pa

        rows_: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                rows_[i] = rows_[i] + v if i in rows_ else np.array(v)
        if rows_:
            yield pa.record_batch([pa.array(list(rows_), pa.int32()), pa.array(list(rows_.values()), pa.list_(pa.float64()))], names=["i", "v"])

    schema = "i int, v array<double>"
    found = rows.mapInArrow(products, schema).repartition("i").mapInArrow(added, schema).collect()
    v = np.array([r["v"] for r in sorted(found, key=lambda r: r["i"])]) / n
    return (v + v.T) / 2


# --- spectrum slicing ---------------------------------------------------------------


def negative_pivots(a: np.ndarray) -> int:
    """Eigenvalues of a symmetric matrix below zero: the negative ones of D in LDL', by pivots of one or two rows."""
    a, below, k = np.array(a, "f8"), 0, 0
    n = len(a)

    def swap(i, j):
        if i != j:
            a[[i, j], k:] = a[[j, i], k:]
            a[k:, [i, j]] = a[k:, [j, i]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        largest = column.max(initial=0.0)
        here, pair = abs(a[k, k]), False
        if max(here, largest) == 0:
            k += 1
            continue
        if here < _PIVOT * largest:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            beside = row.max()
            if here * beside < _PIVOT * largest**2:
                if abs(a[r, r]) >= _PIVOT * beside:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    pair = True
        if pair:  # its determinant is negative: one eigenvalue on either side
            below += 1
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            if len(rest):
                a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            below += a[k, k] < 0
            rest = a[k + 1 :, k].copy()
            if len(rest):
                a[k + 1 :, k + 1 :] -= np.outer(rest / a[k, k], rest)
            k += 1
    return int(below)


class Slicer:
    """Counts of eigenvalues above shifts of one symmetric matrix, remembered."""

    def __init__(self, v: np.ndarray):
        self.v, self.n = v, len(v)
        self.reach = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-12) or 1.0
        self.close = 8 * self.n * np.finfo(float).eps * self.reach
        self.known = {-self.close: self.n, self.reach + self.close: 0}

    def above(self, s: float) -> int:
        if s not in self.known:
            self.known[s] = self.n - negative_pivots(self.v - s * np.eye(self.n))
        return self.known[s]

    def bounds(self, j: int) -> tuple[float, float]:
        """The narrowest known interval that holds the j-th largest eigenvalue."""
        return max(s for s, c in self.known.items() if c >= j), min(s for s, c in self.known.items() if c < j)

    def isolate(self, j: int) -> tuple[float, float]:
        """An interval with the j-th largest eigenvalue alone, or too narrow to be cut."""
        lo, hi = self.bounds(j)
        while hi - lo > self.close and not (self.known[lo] == j and self.known[hi] == j - 1):
            self.above((lo + hi) / 2)
            lo, hi = self.bounds(j)
        return lo, hi

    def certified(self, j: int, value: float, slack: float) -> bool:
        """Fewer than j eigenvalues lie above value + slack, j at least above value - slack."""
        return self.above(value + slack) < j <= self.above(value - slack)


def _rayleigh(v: np.ndarray, shift: float, others: np.ndarray, seed: int, close: float) -> tuple[float, np.ndarray, float]:
    """(eigenvalue, vector, residual) from a shift, at right angles to ``others`` (columns)."""
    free = lambda x: x - others @ (others.T @ x)
    x = free(free(np.random.default_rng(seed).standard_normal(len(v))))
    x /= np.linalg.norm(x)
    for turn in range(60):
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (shift + close) * np.eye(len(v)), x)
        size = np.abs(y).max()
        if not np.isfinite(size) or size == 0:
            break
        y = free(free(y / size))
        x = y / np.linalg.norm(y)
        value = float(x @ v @ x)
        left = float(np.linalg.norm(free(v @ x) - value * x))
        if left <= close / 4:
            break
        if turn:  # the first step is plain inverse iteration at the shift
            shift = value
    return value, x, left


def leading_components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors as columns) of the ``most`` largest eigenvalues of a covariance that are above rounding, largest first."""
    cut = Slicer(v)
    values, vectors = [], np.zeros((len(v), 0))
    for j in range(1, min(most, len(v)) + 1):
        lo, hi = cut.isolate(j)
        if hi <= 2 * cut.close:
            break  # no variance beyond rounding
        for attempt in range(60):
            value, x, left = _rayleigh(v, (lo + hi) / 2, vectors, 1 + attempt, cut.close)
            slack = max(cut.close, 2 * left)
            if lo - slack <= value <= hi + slack and cut.certified(j, value, slack):
                break
            cut.above((lo + hi) / 2)  # it went to a neighbour: begin nearer
            lo, hi = cut.bounds(j)
        else:
            raise ArithmeticError(f"eigenvalue {j} was not certified")
        values.append(value)
        vectors = np.column_stack([vectors, x * np.sign(x[np.abs(x).argmax()])])
    order = np.argsort(-np.array(values), kind="stable")
    kept = [k for k in order if values[k] > 2 * cut.close]
    return np.array([values[k] for k in kept]), vectors[:, kept]


# --- whitening ----------------------------------------------------------------------

SCHEMA = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double"


def whitened(df: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    kind = dict(df.dtypes)[key]
    rows = valid_rows(df, key, vector)
    n, sums = column_sums(rows)
    v = covariance(rows, n, sums) if n else np.zeros((0, 0))
    values, vectors = leading_components(v, components) if n else (np.zeros(0), v)
    if not len(values):
        return df.sparkSession.createDataFrame([], SCHEMA.format(id=kind) + ", identity_error double")
    explained, axes = values / np.trace(v), vectors / np.sqrt(values)
    model = df.sparkSession.sparkContext.broadcast((axes, explained, n, sums))  # columns x components

    def second(batches):
        import pyarrow as pa

        axes_, _, n_, sums_ = model.value
        total = np.zeros((axes_.shape[1],) * 2)
        for part in _chunks(batches):
            w = deviations(_whole(part.column(1)), n_, sums_).astype("f8") / n_ @ axes_
            total += w.T @ w
        yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    # deviations sum to zero, so whitened values are centred already
    sums2 = rows.mapInArrow(second, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros(len(values) ** 2)
    for r in sums2:
        cov[r["i"]] = r["v"] / n
    error = float(np.abs(cov.reshape(len(values), -1) - np.eye(len(values))).max())

    def project(batches):
        from decimal import Context, Decimal

        import pyarrow as pa

        exact = Context(prec=60)
        axes_, explained_, n_, sums_ = model.value
        k = axes_.shape[1]
        for part in _chunks(batches):
            d = deviations(_whole(part.column(1)), n_, sums_)
            w = d.astype("f8") / n_ @ axes_
            size = [exact.create_decimal(s) if s < 10**38 else None for s in squares(d)]
            m, at = len(w), np.repeat(np.arange(len(w)), k)
            held: list[Decimal | None] = [s for s in size for _ in range(k)]
            yield pa.record_batch(
                [part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n_), pa.int64()), pa.array(held, pa.decimal128(38, 0)), pa.array(w.ravel()), pa.array(np.tile(explained_, m))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(project, SCHEMA.format(id=kind)).withColumn("identity_error", F.lit(error))
