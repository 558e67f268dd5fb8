"""Centres of points by KMeans, with draws and rounding that any engine can repeat.

First centres come from a summary: the points' counts and means in the cells of a grid of fixed size. They are drawn as
KMeans++ does (Arthur and Vassilvitskii 2007), with a chance that goes with a cell's points and its squared distance
from the centres that are already there: each cell waits for an exponential time of that rate, told by a hash, and
the first one is drawn. Lloyd's steps then go over all points: each step is one pass, in which tasks add up the points of
each centre, and a row for each task and centre is shuffled. Centres are rounded after each step, so that the order of
sums does not show.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.points import profile
from .pyramid import with_finest

#: The summary's grid has two to this power of columns and rows; 16,384 cells at most come to the driver.
SUMMARY_LEVELS = 7
STEPS, DIGITS = 10, 6
_ROWS = 1 << 12


def _waits(seed: int, step: int, cells: np.ndarray) -> np.ndarray:
    """Exponential times of rate 1, from the same digest as the portable worlds'."""
    uniform = [int(hashlib.md5(f"{seed}|{step}|{c}".encode()).hexdigest()[:13], 16) / 2.0**52 for c in cells.tolist()]
    return np.array([-math.log(1 - u) for u in uniform])


def first_centres(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """``k`` centres (lon, lat) out of the cells' means, fewer where fewer cells have points."""
    p = profile(points)
    placed = with_finest(points.select("lon", "lat"), p, SUMMARY_LEVELS)
    cells = placed.groupBy("j", "i").agg(F.count("*").alias("w"), F.round(F.avg("lon"), DIGITS).alias("x"), F.round(F.avg("lat"), DIGITS).alias("y")).collect()
    cells.sort(key=lambda r: (r.i, r.j))
    at, weight = np.array([(r.x, r.y) for r in cells]).reshape(-1, 2), np.array([r.w for r in cells], float)
    names = np.array([r.i * (1 << SUMMARY_LEVELS) + r.j for r in cells])
    return drawn(at, weight, names, k, seed)


def drawn(at: np.ndarray, weight: np.ndarray, names: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the places ``at``, one after another, fewer where no others are left."""
    out, away = [], np.ones(len(at))
    for step in range(min(k, len(at))):
        rate = weight * away
        if not (rate > 0).any():
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            # Cells at a centre wait for ever.
            first = int(np.where(rate > 0, _waits(seed, step, names) / rate, np.inf).argmin())
        out.append(at[first])
        d = ((at - at[first]) ** 2).sum(axis=1)
        away = d if step == 0 else np.minimum(away, d)
    return np.array(out).reshape(-1, 2)


def _nearest(batch: pa.RecordBatch, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places of a batch, some at a time, with their squared distances from all centres."""
    where = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat")], axis=1)
    for first in range(0, len(where), _ROWS):
        some = where[first : first + _ROWS]
        yield first, some, (some[:, None, 0] - centres[None, :, 0]) ** 2 + (some[:, None, 1] - centres[None, :, 1]) ** 2


def lloyd(points: DataFrame, centres: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Centres moved to the means of the points nearest to them (of equally near ones the first), rounded, ``steps`` times.

    A centre without points stays. It ends early once no centre moves.
    """
    places = points.select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    for _ in range(steps):
        sent = centres

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(sent), np.int64), np.zeros((len(sent), 2))
            for batch in batches:
                for _, some, d in _nearest(batch, sent):
                    own = d.argmin(axis=1)
                    n += np.bincount(own, minlength=len(sent))
                    total += np.stack([np.bincount(own, some[:, c], len(sent)) for c in (0, 1)], axis=1)
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(n[has]), pa.array(total[has, 0]), pa.array(total[has, 1])], names=["c", "n", "x", "y"])

        moved = centres.copy()
        for r in places.mapInArrow(sums, "c long, n long, x double, y double").groupBy("c").agg(*(F.sum(v).alias(v) for v in ("n", "x", "y"))).collect():
            moved[r.c] = [round(r.x / r.n, DIGITS), round(r.y / r.n, DIGITS)]
        if (moved == centres).all():
            break
        centres = moved
    return centres


def nearest_to(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``c, point_id, lon, lat``: for each centre the nearest point, of equally near ones the least point_id; one pass."""
    places = points.select("point_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            ids = batch.column("point_id").to_numpy(zero_copy_only=False)
            for first, some, d in _nearest(batch, centres):
                own = ids[first : first + len(some)]
                for c, (low, column) in enumerate(zip(d.min(axis=0).tolist() if len(some) else [], d.T)):
                    at = np.flatnonzero(column == low)
                    k = at[own[at].argmin()]
                    found = (low, int(own[k]), float(some[k, 0]), float(some[k, 1]))
                    best[c] = min(best.get(c, found), found)
        rows = [(c, *v) for c, v in best.items()]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["c", "d", "point_id", "lon", "lat"])

    found = places.mapInArrow(least, "c long, d double, point_id long, lon double, lat double")
    return found.groupBy("c").agg(F.min(F.struct("d", "point_id", "lon", "lat")).alias("p")).select("c", "p.point_id", "p.lon", "p.lat")
