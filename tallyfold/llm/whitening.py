"""Embedding whitening by block Golub-Kahan-Lanczos bidiagonalisation.

The rows of the centred matrix A (one row per distinct vector) stay distributed.  A step
sends a narrow matrix W to every task, which multiplies its rows, u = A W, multiplies back,
Aᵀu, and gives the sums over its rows: the alternating products of one step of the
recurrence in one pass, with nothing of a row's length kept.  Left vectors are known by
the W that makes them (u = A W), so their inner products, and with these the full
reorthogonalisation of both sides, need no further pass.

A block holds ``EXTRA`` vectors more than components are wanted, so equal eigenvalues are
found as often as they occur, and a pass over the rows serves the whole block.  The small
block-bidiagonal matrix is taken apart by its SVD; steps go on until the wanted residuals
vanish beside the largest singular value, or the basis is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

COMPONENTS = 16
EXTRA = 4  # vectors of a block beyond the wanted ones
OFFSET = 1_000_000
SCALE = 64
STEP_BYTES = 8 << 20  # of rows that one numpy product holds as doubles
CONVERGED = 1e-14  # residual over the largest squared singular value
ZERO = 1e-13  # eigenvalues below this share of the largest are no components
LARGEST = 1 << 62  # quantised entries beyond this are no vector's


def _wide(embeddings: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """Ids and vectors as doubles, and the commonest width (the least of equals; 0 without vectors)."""
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    widths = rows.filter("size(c) > 0").groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows, widths.d if widths else 0


def quantised(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that stay, and their entries floor(64 c) (that is x less ``OFFSET``) as longs."""
    lengths = np.diff(column.offsets.to_numpy())
    lengths[column.is_null().to_numpy(zero_copy_only=False)] = 0
    at = np.flatnonzero(lengths == width)
    flat = column.take(pa.array(at)).flatten()
    c = flat.to_numpy(zero_copy_only=False).reshape(-1, width) * SCALE  # nulls become NaN
    good = (np.abs(c) < LARGEST).all(1)
    return at[good], np.floor(c[good]).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """A row's numbers as bytes, four each if all of its numbers fit, so that equal rows have equal bytes."""
    narrow = ((x >= -(1 << 31)) & (x < 1 << 31)).all(1)
    small = x.astype(np.int32)
    return [small[i].tobytes() if narrow[i] else x[i].tobytes() for i in range(len(x))]


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    if all(len(r) == 4 * width for r in rows):
        return np.frombuffer(b"".join(rows), np.int32).reshape(-1, width)
    return np.stack([np.frombuffer(r, np.int32 if len(r) == 4 * width else np.int64).astype(np.int64) for r in rows])


class FitList:
    """The distinct vectors, staged as blocks of packed numbers, and what their centring needs."""

    def __init__(self, vectors: DataFrame, width: int):
        self.width = width

        def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, x = quantised(batch.column(0), width)
                yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], names=["x"])

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = unpacked(batch.column(0).to_pylist(), width)
                    yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["n", "data"])

        distinct = vectors.select("c").mapInArrow(quantise, "x binary").distinct()
        self.blocks = stage(distinct.mapInArrow(block, "n long, data binary"), "fit-list")
        totals = self._reduced(lambda x: [x.sum(0, dtype=np.int64 if x.dtype == np.int32 else object).astype(object)], "decimal(38,0)", centred=False)
        self.n = int(self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        #: per-dimension sums of the vectors less ``OFFSET``
        self.sums = [int(totals[0][i]) for i in range(width)] if self.n else []
        self.mean = np.array([float(Fraction(s, self.n)) for s in self.sums]) if self.n else np.zeros(width)

    def _reduced(self, products: Callable[[np.ndarray], list[np.ndarray]], kind: str, centred: bool = True) -> list[np.ndarray]:
        """Sums over all rows of some arrays of each block of rows, added up by Spark; their sizes depend on no row count."""
        width, mean = self.width, None if not centred else self.mean
        exact = kind.startswith("decimal")

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: list = []
            for batch in batches:
                for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = data.as_buffer()
                    x = np.frombuffer(raw, np.int32 if len(raw) == 4 * n * width else np.int64).reshape(n, width)
                    step = max(1, STEP_BYTES // (8 * width))
                    for i in range(0, n, step):
                        part = x[i : i + step]
                        found = products(part if mean is None else part - mean)
                        sums = found if not sums else [a + b for a, b in zip(sums, found, strict=True)]
            for which, values in enumerate(sums):
                values = values.reshape(-1)
                numbers = pa.array([str(v) for v in values], pa.string()) if exact else pa.array(values, pa.float64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(values), which, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), numbers,
                ], names=["which", "at", "value"])

        found = self.blocks.mapInArrow(scan, f"which int, at int, value {'string' if exact else 'double'}")
        rows = found.groupBy("which", "at").agg(F.sum(F.col("value").cast(kind)).alias("value")).collect()  # of the products' size
        out: list[dict] = []
        for r in rows:
            while len(out) <= r.which:
                out.append({})
            out[r.which][r.at] = r.value
        return [np.array([part[i] for i in range(len(part))]) for part in out]

    def gram(self, w: np.ndarray) -> np.ndarray:
        """Aᵀ A W in one pass: u = A W and back."""
        return self._reduced(lambda a: [a.T @ (a @ w)], "double")[0].reshape(w.shape)

    def moments(self, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the rows on some axes: sums, sums of products; and the sum of all squares of A."""
        def products(a: np.ndarray) -> list[np.ndarray]:
            y = a @ axes
            return [y.sum(0), y.T @ y, np.array([np.einsum("ij,ij->", a, a)])]

        sums, squares, total = self._reduced(products, "double")
        return sums, squares.reshape(axes.shape[1], axes.shape[1]), float(total[0])


def _orthonormal(block: np.ndarray, against: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis of the block's columns orthogonal to ``against``, as far as there is room.

    A column without a direction of its own gets a random one: the recurrence starts
    anew there.
    """
    scale = np.linalg.norm(block, axis=0).max(initial=0.0)
    done = against
    for j in range(min(block.shape[1], len(block) - against.shape[1])):
        v = block[:, j].copy()
        for _ in range(2):
            v -= done @ (done.T @ v)
        if np.linalg.norm(v) <= 1e-13 * scale or not scale:
            v = rng.standard_normal(len(block))
            for _ in range(3):
                v -= done @ (done.T @ v)
        done = np.column_stack((done, v / np.linalg.norm(v)))
    return done[:, against.shape[1] :]


def principal_axes(fit: FitList, components: int = COMPONENTS, extra: int = EXTRA) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) and eigenvalues of the fit list's covariance, by falling eigenvalue.

    Right vectors V, and left vectors U = A W by their W, obey A V = U B with B upper
    block-bidiagonal; the SVD of B gives singular values and, through V, the axes.
    """
    d, wanted = fit.width, min(components, fit.width)
    if not fit.n:
        return np.zeros((d, 0)), np.zeros(0)
    rng = np.random.default_rng(0)
    width = min(d, components + extra)
    v = _orthonormal(rng.standard_normal((d, width)), np.zeros((d, 0)), rng)
    right, left, image = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, W with U = A W, and Aᵀ U
    while True:
        right = np.column_stack((right, v))
        w, z = v, fit.gram(v)
        # the new U: A v less what lies in the U before; inner products are uᵢᵀ A w = (Aᵀ uᵢ)ᵀ w
        for _ in range(2):
            along = image.T @ w
            w, z = w - left @ along, z - image @ along
        squares, turn = np.linalg.eigh((w.T @ z + z.T @ w) / 2)
        largest = max(squares.max(), np.linalg.norm(image, 2) ** 2 if image.size else 0.0)
        real = squares > ZERO * max(largest, 1e-300)
        turn = turn[:, real] / np.sqrt(squares[real])
        left, image = np.column_stack((left, w @ turn)), np.column_stack((image, z @ turn))
        outer, values, axes = np.linalg.svd(image.T @ right)  # B = (Aᵀ U)ᵀ V
        if right.shape[1] >= d:
            break
        # the new V: Aᵀ u less what lies in the V before; it is also what the singular pairs leave over
        rest = image[:, left.shape[1] - real.sum() :]
        for _ in range(2):
            rest = rest - right @ (right.T @ rest)
        if len(values) >= wanted and values[0] > 0:
            over = np.linalg.norm(rest @ outer[left.shape[1] - real.sum() :, :wanted], axis=0)
            if (over * values[:wanted] <= CONVERGED * values[0] ** 2).all():
                break
        v = _orthonormal(np.column_stack((rest, np.zeros((d, width - rest.shape[1])))), right, rng)
    found = right @ axes.T[:, :wanted]
    # one more pass turns the axes inside their span until the covariance is diagonal there
    found, _ = np.linalg.qr(found)
    image = fit.gram(found)
    values, turn = np.linalg.eigh((found.T @ image + image.T @ found) / 2)
    order = np.argsort(-values, kind="stable")
    values, found = np.maximum(values[order], 0) / fit.n, found @ turn[:, order]
    keep = values > ZERO * max(values.max(initial=0.0), 1e-300)
    return found[:, keep], values[keep]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S) ** 2 of every row, as exact integers."""
    limit = max((max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * n + max(map(abs, sums), default=0)), 1)
    if limit < (1 << 31) and limit * limit * max(1, x.shape[1]) < 1 << 63:
        return ((n * x.astype(np.int64) - np.array(sums, np.int64)) ** 2).sum(1).astype(object)
    whole = x.astype(object) * n - np.array(sums, dtype=object)
    return (whole * whole).sum(1)


def whitened(
    embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, extra: int = EXTRA
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every row and component.

    Rows with a null vector, or with a null or non-finite entry, or one beyond 2 ** 62
    when quantised, are dropped.  Vectors must have one width to be compared: those of
    another than the table's commonest width (the least of equally common ones), empty
    ones included, are dropped.  Equal vectors are fitted once and each give their rows.
    Components of no variance (a share of ``ZERO`` of the largest) are left out, so one
    vector alone, or an empty table, gives no rows.  ``deviation`` is null where it does
    not fit a long.  Ids may be null or repeat.  Other columns are not read.
    """
    vectors, width = _wide(embeddings, vec_id, vector)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    fit = FitList(vectors, width)
    axes, values = principal_axes(fit, components, extra)
    count = len(values)
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    scaled = axes / np.sqrt(values)
    sums, squares, trace = fit.moments(scaled)
    n, totals, mean = fit.n, fit.sums, fit.mean
    covariance = squares / n - np.outer(sums / n, sums / n)
    error = float(np.abs(covariance - np.eye(count)).max())
    explained = values / (trace / n)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, STEP_BYTES // (8 * (width + 7 * count)))
        for whole in batches:
            for i in range(0, len(whole), step):
                batch = whole.slice(i, step)
                places, x = quantised(batch.column(1), width)
                y = (x - mean) @ scaled
                deviations = pa.array([v if v < 1 << 63 else None for v in _deviations(x, n, totals)], pa.int64())
                at = np.repeat(np.arange(len(x)), count)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(places[at])), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(at), n)), deviations.take(pa.array(at)), pa.array(y.reshape(-1)),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, schema)


def digest_rows(embeddings: DataFrame) -> DataFrame:
    """The contract's columns."""
    return whitened(embeddings)
