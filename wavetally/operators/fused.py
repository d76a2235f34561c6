"""All frame-based scores of a pair from one pass over its frames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavetally.operators.frames import STD_FLOOR, with_previous_frames
from wavetally.operators.joins import spread_join, with_keys
from wavetally.operators.pairing import MISSING_PREDICTION, MISSING_REFERENCE, OK, as_list
from wavetally.operators.similarity import NO_COMMON_FRAMES, segment_correlations

FRAME_SCORES = ("stoi", "sim_o", "sim_r")
# what a chunk adds up: of each side's coefficients and of the envelopes number, mean and squared deviation; then the
# segments of the bands with their correlations' total, and the number of coefficients of a frame
_SUMS = ["n_r", "m_r", "d_r", "n_e", "m_e", "d_e", "n", "m_x", "m_y", "d_x", "d_y", "d_xy", "segments", "total", "k"]


def _basis(bands: int, n: int) -> np.ndarray:
    """The first ``n`` vectors of the orthonormal DCT-II, as columns."""
    k, b = np.arange(min(n, bands)), np.arange(bands)[:, None]
    return np.sqrt(2 / bands) * np.where(k == 0, np.sqrt(0.5), 1.0) * np.cos(np.pi * k * (2 * b + 1) / (2 * bands))


class _Side:
    """The frames of one side in a chunk: numbers in order, band values, and which are the chunk's own."""

    def __init__(self, rows: pa.Table, frame: str, values: str, chunk: int, span: int):
        frames = rows.column(frame).to_numpy().astype(np.int64)
        order = np.argsort(frames, kind="stable")
        self.frames = frames[order]
        flat = rows.column(values).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.bands = flat.reshape(len(frames), -1)[order] if len(frames) else np.zeros((0, 1))
        self.own = self.frames // span == chunk

    def coefficients(self, n: int) -> np.ndarray:
        return self.bands @ _basis(self.bands.shape[1], n)

    def envelope(self) -> np.ndarray:
        """Mean rise over the frame before; 0 without one."""
        rise = np.zeros(len(self.frames))
        if len(rise) > 1:
            rise[1:] = np.maximum(np.diff(self.bands, axis=0), 0).mean(axis=1)
        return rise


def _spread(x: np.ndarray) -> list[float]:
    """Number, mean and sum of squared deviations."""
    return [x.size, x.mean(), ((x - x.mean()) ** 2).sum()] if x.size else [0.0, 0.0, 0.0]


def _chunk_sums(r: _Side, e: _Side, coefficients: int, segment: int, clip: float) -> tuple[list[float], np.ndarray]:
    """The values of ``_SUMS``, and for each common frame the means, energies and product of both sides' coefficients."""
    cr, ce = r.coefficients(coefficients), e.coefficients(coefficients)
    sums = _spread(cr[r.own]) + _spread(ce[e.own])
    common, at_r, at_e = np.intersect1d(r.frames, e.frames, return_indices=True)
    own = r.own[at_r]
    x, y = r.envelope()[at_r][own], e.envelope()[at_e][own]
    if len(x):
        dx, dy = x - x.mean(), y - y.mean()
        sums += [len(x), x.mean(), y.mean(), (dx * dx).sum(), (dy * dy).sum(), (dx * dy).sum()]
    else:
        sums += [0.0] * 6
    segments, total = 0, 0.0
    # runs without a gap, of the frames before the chunk and its own; each segment belongs to its last frame
    for run in np.split(np.arange(len(common)), np.flatnonzero(np.diff(common) != 1) + 1):
        if len(run) >= segment:
            rho = segment_correlations(np.abs(r.bands[at_r[run]]), np.abs(e.bands[at_e[run]]), segment, clip)
            rho = rho[own[run[segment - 1 :]]]
            valid = np.isfinite(rho)
            segments, total = segments + int(valid.sum()), total + float(rho[valid].sum())
    a, b = cr[at_r][own], ce[at_e][own]
    fa, fb = (v.mean(axis=1) if len(v) else np.zeros(0) for v in (a, b))
    a, b = a - fa[:, None], b - fb[:, None]
    sums += [segments, total, max(cr.shape[1] if len(cr) else 0, ce.shape[1] if len(ce) else 0)]
    return sums, np.concatenate([fa, fb, (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)])


def _merged(sums: Column, n: int, mean: int, spread: int) -> tuple[Column, Column, Column]:
    """Number, mean and deviation of all chunks together, from the places of their parts."""
    count = F.sum(sums[n])
    average = F.try_divide(F.sum(sums[n] * sums[mean]), count)
    squares = F.sum(sums[spread] + sums[n] * sums[mean] * sums[mean]) - count * average * average
    return count, average, F.sqrt(F.greatest(F.try_divide(squares, count), F.lit(0.0)))


def frame_scores(
    ref: DataFrame,
    est: DataFrame,
    key: str | Sequence[str],
    frame: str = "frame",
    values: str = "values",
    coefficients: int = 13,
    segment: int = 30,
    clip_db: float = 15.0,
    span: int = 1024,
) -> DataFrame:
    """``key, stoi, sim_o, sim_r, status`` from band frames of both sides (key, frame, values).

    ``stoi`` takes the magnitudes of the bands as in :func:`~wavetally.operators.similarity.band_intelligibility`,
    ``sim_o`` the first ``coefficients`` cepstral coefficients and ``sim_r`` the onset envelopes, as :func:`sim_o` and
    :func:`sim_r` there do. Frames of both sides meet in one shuffle by (key, chunk); NumPy reduces a chunk of at most
    ``span`` frames and the ``segment`` before it to a row of sums and five numbers for each common frame, which hold
    all that the scores need once a sample's mean and deviation are known. The status comes from the same sums; every
    sample of either side has a row.
    """
    on = as_list(key)
    clip = 1 + 10 ** (clip_db / 20)
    both = ref.select(*on, frame, values, F.lit(True).alias("_ref")).unionByName(
        est.select(*on, frame, values, F.lit(False).alias("_ref"))
    )
    chunks = with_previous_frames(with_keys(both, on), frame, max(1, segment - 1), span)
    schema = T.StructType(
        [*(chunks.schema[k] for k in on), T.StructField("_chunk", T.LongType())]
        + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_sums", "_moments")]
    )

    def reduce_chunk(group: tuple, rows: pa.Table) -> pa.Table:
        chunk = group[-1].as_py()
        mine = rows.column("_ref")
        r, e = (_Side(rows.filter(m), frame, values, chunk, span) for m in (mine, pc.invert(mine)))
        sums, moments = _chunk_sums(r, e, coefficients, segment, clip)
        keys = [pa.array([g.as_py()], g.type) for g in group]
        lists = [pa.array([v], pa.list_(pa.float64())) for v in (sums, moments)]
        return pa.table([*keys, *lists], names=schema.names)

    reduced = chunks.groupBy(*on, "_chunk").applyInArrow(reduce_chunk, schema)
    place = {name: i for i, name in enumerate(_SUMS)}
    sums = F.col("_sums")

    def merged(*names: str) -> tuple[Column, Column, Column]:
        return _merged(sums, *(place[n] for n in names))

    nr, mr, sr = merged("n_r", "m_r", "d_r")
    ne, me, se = merged("n_e", "m_e", "d_e")
    # statistics and scores both start from the one shuffle of the frames; only the reduction runs for each
    stats = reduced.groupBy(*on).agg(
        nr.alias("_nr"), mr.alias("_mr"), sr.alias("_sr"), ne.alias("_ne"), me.alias("_me"), se.alias("_se"),
        F.max(sums[place["k"]]).alias("_k"),
        F.min("_chunk").alias("_first"), F.max("_chunk").alias("_last"),
    )
    m = (F.size("_moments") / 5).cast("int")
    fr, fe, rr, ee, re = (F.slice("_moments", j * m + 1, m) for j in range(5))

    def cosine(z: Column) -> Column:
        dr, de = z["fr"] - F.col("_mr"), z["fe"] - F.col("_me")
        scale_r, scale_e, k = F.col("_sr") + STD_FLOOR, F.col("_se") + STD_FLOOR, F.col("_k")
        norms = F.sqrt(z["rr"] + k * dr * dr) / scale_r * F.sqrt(z["ee"] + k * de * de) / scale_e
        return (z["re"] + k * dr * de) / scale_r / scale_e / (norms + STD_FLOOR)

    zipped = F.arrays_zip(*(c.alias(n) for c, n in zip((fr, fe, rr, ee, re), ("fr", "fe", "rr", "ee", "re"))))
    joined = spread_join(reduced, stats, on, "_chunk", "_last", 1, "_first")
    cosines = F.aggregate(F.transform(zipped, cosine), F.lit(0.0), lambda s, v: s + v)
    scored = joined.withColumns({"_cosines": cosines, "_common": m})
    n, mx, sx = merged("n", "m_x", "d_x")
    _, my, sy = merged("n", "m_y", "d_y")
    products = F.sum(sums[place["d_xy"]] + sums[place["n"]] * sums[place["m_x"]] * sums[place["m_y"]])
    out = scored.groupBy(*on).agg(
        F.first("_nr").alias("_nr"), F.first("_ne").alias("_ne"),
        F.sum("_common").alias("_common"), F.sum("_cosines").alias("_cosines"),
        n.alias("_n"), mx.alias("_mx"), my.alias("_my"), sx.alias("_sx"), sy.alias("_sy"), products.alias("_xy"),
        F.sum(sums[place["segments"]]).alias("_segments"), F.sum(sums[place["total"]]).alias("_total"),
    )
    covariance = F.try_divide(F.col("_xy") - F.col("_n") * F.col("_mx") * F.col("_my"), F.col("_n"))
    # rounding leaves this much of the deviation of a constant envelope
    varies = (F.col("_sx") > 1e-12 * F.abs("_mx")) & (F.col("_sy") > 1e-12 * F.abs("_my"))
    status = (
        F.when(F.col("_ne") == 0, F.lit(MISSING_PREDICTION))
        .when(F.col("_nr") == 0, F.lit(MISSING_REFERENCE))
        .when(F.col("_common") == 0, F.lit(NO_COMMON_FRAMES))
        .otherwise(F.lit(OK))
    )
    return out.select(
        *on,
        F.try_divide("_total", "_segments").alias("stoi"),
        F.try_divide("_cosines", F.col("_common").cast("double")).alias("sim_o"),
        F.when(varies, F.try_divide(covariance, F.col("_sx") * F.col("_sy"))).alias("sim_r"),
        status.alias("status"),
    )
