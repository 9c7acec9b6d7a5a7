"""Voxels over a stream of points (an addition: the operators above are batch only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.geometry import COORDS
from gridstone.operators.points import _cells


def stream_voxels(points: DataFrame, voxel_size=1.0, origin=0.0, time: str | None = None, window: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and feature sums by voxel, and by event-time window if ``time`` and ``window`` are given.

    With windows the state of a window goes once the watermark (``late`` behind the newest event) has passed it, so
    append mode works and state stays bounded; without, use complete or update mode.
    """
    names = [c for c in points.columns if c[0] == "f" and c[1:].isdigit()]
    cells = _cells(points, voxel_size, origin)
    keys = [F.col(c) for c in COORDS]
    if time and window:
        cells = cells.withWatermark(time, late)
        keys = [F.window(time, window), *keys]
    return cells.groupBy(*keys).agg(F.count("*").alias("count"), *[F.sum(F.col(c).cast("double")).alias(c) for c in names])
