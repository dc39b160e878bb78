"""Operator 13: whitening of vectors by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance come from passes V Q = (sum of (x - mean)(x - mean)' Q) / n
over staged blocks of the distinct vectors: each task centres its rows and adds up its part, Spark
adds the parts, and only a width x block matrix reaches the driver.  A polynomial of Chebyshev
recurrence damps the unwanted part of the spectrum, then QR and Rayleigh-Ritz turn the block; this
repeats until the residuals certify the wanted vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlake.llm.common import staged
from chatlake.llm.vectors import common_width, matrix, narrow, unpacked, usable

#: Bytes of doubles that a task centres at a time.
BLOCK_BYTES = 2 << 20
#: Columns of the block beyond the wanted ones.
GUARD = 28
#: Largest degree of a filter between two Rayleigh-Ritz steps.
DEGREE = 12
#: Residual, as a part of the largest eigenvalue, that certifies a vector.
TOLERANCE = 1e-14
#: A residual below this is accepted once it no longer falls (rounding of the passes themselves).
ROUNDING = 1e-11
#: Most growth of the leading vector over the rest in one filter; more would drown the others in rounding.
GROWTH = 1e12


def leading(apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guard: int = GUARD, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues, falling, their vectors as columns, and the largest residual (as a part of the first value).

    ``apply`` multiplies a positive semidefinite matrix of ``width`` rows by a block of columns.  The
    last column starts anew at random each time, so that no direction stays unseen.  A block that
    converges slowly (values close together) is doubled, up to the whole space.
    """
    draw = np.random.default_rng(seed)
    bottom = LowerEnd(draw.normal(size=width))
    apply = bottom.riding(apply)
    wanted = min(wanted, width)
    size = min(width, wanted + guard)
    q = np.linalg.qr(draw.normal(size=(width, size)))[0]
    vq, worst, slow = apply(q), np.inf, 0
    while True:
        value, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(value[0], 0.0)
        if top == 0:
            return np.zeros(wanted), q[:, :wanted], 0.0
        before, worst = worst, float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * value[:wanted], axis=0).max() / top)
        if worst <= TOLERANCE or worst <= ROUNDING and (worst > before / 2 or size == width):
            return value[:wanted], q[:, :wanted], worst
        slow = slow + 1 if worst > before / 8 else 0
        if slow >= 6 and size == width:
            raise ArithmeticError(f"the residual stays at {worst:.2g} of the largest eigenvalue")
        if slow >= 6:  # a wider block: its cut lies lower
            size, slow, worst = min(width, 2 * size), 0, np.inf
            q = np.linalg.qr(np.hstack([q, draw.normal(size=(width, size - q.shape[1]))]))[0]
            vq = apply(q)
            continue
        # Damp [low, cut]: the block's least value bounds from above what it does not hold.
        cut = max(float(value[-1]), 1e-8 * top)
        low = min(bottom.value(), cut / 2 if size < width and value[-1] < bottom.value() else 0.99 * cut)
        centre, half = (cut + low) / 2, (cut - low) / 2
        degree = int(np.clip(np.log(GROWTH) / np.arccosh(max((top - centre) / half, 1 + 1e-9)), 2, DEGREE))
        last, now = q, (vq - centre * q) / half
        for _ in range(degree - 1):
            last, now = now, 2 / half * (apply(now) - centre * now) - last
        if size < width:
            now[:, -1] = draw.normal(size=width) * np.linalg.norm(now[:, -1]) / width ** 0.5
        q = np.linalg.qr(now / np.maximum(np.linalg.norm(now, axis=0), 1e-300))[0]
        vq = apply(q)


class LowerEnd:
    """A lower bound of a matrix's eigenvalues by Lanczos steps of one more column in the passes of others.

    The least Ritz value less twice its residual; at least 0.  A bound that were too high would cost
    passes, not accuracy: what it misses grows in the block and shows there as a value below it.
    """

    def __init__(self, start: np.ndarray, most: int = 40):
        self.basis, self.turned, self.most, self.left = [start / np.linalg.norm(start)], [], most, 0.0

    def riding(self, apply: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        def both(block: np.ndarray) -> np.ndarray:
            if len(self.turned) >= min(self.most, len(block)) or len(self.basis) == len(self.turned):
                return apply(block)
            out = apply(np.column_stack([block, self.basis[-1]]))
            self.step(out[:, -1])
            return out[:, :-1]

        return both

    def step(self, image: np.ndarray) -> None:
        self.turned.append(image)
        known = np.array(self.basis)
        rest = image - known.T @ (known @ image)
        rest -= known.T @ (known @ rest)
        self.left = float(np.linalg.norm(rest))
        if self.left > 1e-10 * np.linalg.norm(image):
            self.basis.append(rest / self.left)

    def value(self) -> float:
        known, image = np.array(self.basis[:len(self.turned)]), np.array(self.turned)
        value, turn = np.linalg.eigh((known @ image.T + image @ known.T) / 2)
        return max(0.0, float(value[0] - 2 * self.left * abs(turn[-1, 0])))


@dataclass
class Whitening:
    n: int  # distinct vectors
    sums: list[int]  # per dimension, over them
    vectors: np.ndarray  # components as columns, by falling eigenvalue
    values: np.ndarray
    explained: np.ndarray  # value / trace
    identity_error: float
    residual: float  # largest of the components, as a part of the first eigenvalue

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Decimal(s) / self.n) for s in self.sums])


def fit(vectors: DataFrame, width: int, wanted: int = 4) -> Whitening | None:
    """Components of the distinct vectors ``x`` of ``vectors``; None without vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * width))
        for batch in batches:
            whole = matrix(batch.column(0)) if batch.num_rows else np.zeros((0, width), np.int64)
            for a in range(0, len(whole), step):
                x = whole[a:a + step]
                exact = x if float(np.abs(x.astype(np.float64)).max()) ** 2 * len(x) < 2 ** 62 else x.astype(object)
                sums = [[[Decimal(int(v)) for v in s]] for s in (exact.sum(axis=0), (exact * exact).sum(axis=0))]
                yield pa.RecordBatch.from_arrays([pa.array([len(x)]), pa.array([narrow(x).tobytes()], pa.binary()), *[pa.array(s, pa.list_(pa.decimal128(38, 0))) for s in sums]],
                                                 ["rows", "data", "sums", "squares"])

    blocks = staged(vectors.select("x").distinct().mapInArrow(pack, "rows long, data binary, sums array<decimal(38,0)>, squares array<decimal(38,0)>"), "whitening")
    n = blocks.agg(F.sum("rows")).first()[0]
    if not n:
        return None
    moments = blocks.select(F.posexplode(F.arrays_zip("sums", "squares")).alias("at", "m")) \
        .groupBy("at").agg(F.sum("m.sums").alias("sum"), F.sum("m.squares").alias("square")).orderBy("at").collect()
    sums, squares = [int(r["sum"]) for r in moments], [int(r["square"]) for r in moments]
    trace = float(Decimal(sum(n * q - s * s for s, q in zip(sums, squares))) / n / n)
    fitted = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0, 0.0)
    if trace <= 0:
        return fitted
    mean = fitted.mean

    def total(part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum over all blocks of ``part`` of their centred rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                for rows, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out += part(unpacked(data.as_buffer(), width, rows) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["at", "v"])

        found = blocks.select("rows", "data").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(shape)
        out.ravel()[found.column("at").to_numpy()] = found.column("v").to_numpy()
        return out

    apply = lambda q: total(lambda x: x.T @ (x @ q), q.shape) / n
    values, q, residual = leading(apply, width, wanted)
    some = values > 1e-12 * values[0]
    values, q = values[some], q[:, some]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1, 1)
    scaled = q / np.sqrt(values)
    k = len(values)
    # Sums and products of the whitened rows in one pass: their covariance is taken about their own mean.
    moment = total(lambda x: np.vstack([(w := x @ scaled).sum(axis=0), w.T @ w]), (k + 1, k)) / n
    error = np.abs(moment[1:] - np.outer(moment[0], moment[0]) - np.eye(k)).max()
    return Whitening(n, sums, q, values, values / trace, float(error), residual)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """sum over dimensions of (n * x - sums) ** 2 of each row, exact, as decimals."""
    width, most = len(sums), int(np.abs(x.astype(np.float64)).max(initial=0))
    if width * (n * most + max(map(abs, sums), default=0)) ** 2 < 2 ** 62:
        off = n * x.astype(np.int64) - np.array(sums, np.int64)
        return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
    if width * most ** 2 >= 2 ** 62 or width * most >= 2 ** 38:
        off = n * x.astype(object) - np.array(sums, object)
        return pa.array([Decimal(int(v)) for v in (off * off).sum(axis=1)], pa.decimal128(38, 0))
    # n^2 x.x - 2 n x.S + S.S, with S in limbs of 24 bits so that every product of arrays is exact in 64 bits
    x, sign, rest, shift = x.astype(np.int64), np.sign(np.array(sums, object)), np.abs(np.array(sums, object)), 0
    squares, cross = (x * x).sum(axis=1).tolist(), [0] * len(x)
    while any(rest):
        limb = (sign * (rest & 0xFFFFFF)).astype(np.int64)
        cross = [c + (v << shift) for c, v in zip(cross, (x * limb).sum(axis=1).tolist())]
        rest, shift = rest >> 24, shift + 24
    own = sum(s * s for s in sums)
    return pa.array([Decimal(n * n * a - 2 * n * c + own) for a, c in zip(squares, cross)], pa.decimal128(38, 0))


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(table: DataFrame, wanted: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    ``table``: (vec_id, embedding).  Components are numbered from 1 by falling eigenvalue of the
    covariance of the distinct integer vectors floor(scale * component).  Rows whose vector is null,
    empty, holds null or non-finite components, or has another length than most rows have, go.  There
    are fewer components than ``wanted`` where the covariance has fewer values above zero, and so no
    rows at all for an empty table, or if all vectors are equal.  Null ids stay, repeated rows stay
    repeated (the fit counts equal vectors once), other columns are not read.  Components of equal
    eigenvalues are any orthonormal ones.
    """
    rows = usable(table, scale)
    width = common_width(rows)
    rows = rows.filter(F.size("x") == width)
    model = fit(rows, width, wanted) if width else None
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], SCHEMA)
    mean, n, sums, explained, error = model.mean, model.n, model.sums, model.explained, model.identity_error
    scaled = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, step = scaled.shape[1], max(1, BLOCK_BYTES // (8 * width))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                x = matrix(batch.column(1))
                again = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)),
                    deviations(x, n, sums).take(again), pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
