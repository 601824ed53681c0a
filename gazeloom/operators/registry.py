"""One entry by method name for segmentation and for areas of interest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.relational import Plan
from . import events, grouped, learning, scanpaths, segmentation

#: Duration limits where none are given, in seconds.
TWO_CLASS = {"min_fix": 0.07, "max_fix": 2.0, "min_sac": 0.015, "status_threshold": 0.5}
THREE_CLASS = {"fix": (0.07, 2.0), "pursuit": (0.1, 2.0)}
#: Methods with two classes (fixation, saccade) and with three (pursuit, too).
BINARY = ("I_VT", "I_DiT", "I_DeT", "I_KF", "I_MST", "I_2MC", "I_HMM")
TERNARY = ("I_VVT", "I_VMP", "I_BDT", "I_VDT")
#: Methods that are window expressions, and scans with their names.
_PLANS: dict[str, Callable[..., Plan]] = {"I_VVT": segmentation.ivvt, "I_VMP": segmentation.ivmp, "I_BDT": segmentation.ibdt}
_SCANS = {"I_DiT": "idit", "I_DeT": "idet", "I_KF": "ikf", "I_MST": "imst", "I_2MC": "i2mc", "I_HMM": "ihmm", "I_VDT": "ivdt"}
#: Methods for areas of interest.
AREAS = {"I_KM": "kmeans", "I_DT": "dbscan", "I_DP": "density_peaks", "I_MS": "mean_shift", "I_AP": "affinity"}


def segment(gaze: DataFrame, method: str, fs: float, limits: dict | None = None, **parameters) -> DataFrame:
    """(recording_id, i, label) of gaze (recording_id, i, x, y, z, status, speed, vx, vy) by a method of ``BINARY`` or ``TERNARY``: 1 fixation, 2 saccade, 3 pursuit, 0 none.

    ``parameters`` are those of the method, ``limits`` the durations of its post-processing.
    """
    if method not in BINARY + TERNARY:
        raise ValueError(f"no segmentation method {method}; there are {', '.join(BINARY + TERNARY)}")
    limits = (TWO_CLASS if method in BINARY else THREE_CLASS) | (limits or {})
    if method in _SCANS:
        return grouped.segment(gaze, _SCANS[method], fs, limits, **parameters)
    given = Plan().then("given", "SELECT * FROM {gaze}")
    if method == "I_VT":
        plan = segmentation.ivt(given, "given", "lab", parameters.pop("threshold"), fs, **parameters, **limits)
    else:
        by_time = {} if method == "I_VVT" else {"fs": fs}
        plan = segmentation.three_class(_PLANS[method](given, "given", "raw", **parameters, **by_time), "raw", "lab", fs, **limits)
    return plan.then("out", "SELECT recording_id, i, label FROM lab").spark(gaze.sparkSession, gaze=gaze)


def areas(points: DataFrame, method: str, diagonal: float, fewest: int = 1, neighbours: int | None = None) -> DataFrame:
    """(recording_id, k, x, y, dur, aoi, cx, cy) of fixations (recording_id, k, x, y, dur) by a method of ``AREAS``: the area and its centre.

    In each recording areas with fewer than ``fewest`` fixations join the one whose centre is nearest (the first name at a tie).
    """
    if method not in AREAS:
        raise ValueError(f"no method {method} for areas; there are {', '.join(AREAS)}")
    points = points.select("recording_id", "k", "x", "y", "dur")
    named = points.join(grouped.clusters(points, AREAS[method], diagonal, neighbours), ["recording_id", "k"])
    centres = named.groupBy("recording_id", "aoi").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    if fewest > 1:
        large = centres.where(F.col("n") >= fewest).select("recording_id", F.col("aoi").alias("target"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
        far = F.pow(F.col("cx") - F.col("tx"), 2) + F.pow(F.col("cy") - F.col("ty"), 2)
        # without a large area a recording keeps its small ones
        moves = centres.join(large, "recording_id", "left").groupBy("recording_id", "aoi").agg(F.min_by("target", F.struct(far, "target")).alias("target"))
        named = named.join(moves, ["recording_id", "aoi"]).withColumn("aoi", F.coalesce("target", "aoi")).drop("target")
        centres = named.groupBy("recording_id", "aoi").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return named.join(centres.select("recording_id", "aoi", "cx", "cy"), ["recording_id", "aoi"]).select("recording_id", "k", "x", "y", "dur", "aoi", "cx", "cy")


def sequences(recordings: DataFrame, method: str = "I_KM", fs: float = 1.0, threshold: float = 100.0, diagonal: float = 1.0, joint: bool = True, limits: dict | None = None) -> DataFrame:
    """(recording_id, k, aoi, cx, cy) from raw gaze (recording_id, i, x, y, z, status, speed, vx, vy) of one or many recordings.

    Fixations by I_VT with the speed ``threshold``, their centres and durations as
    scanpaths, and areas: with ``joint`` shared by all recordings (k-means over all
    their fixations), else of each recording by ``method``.
    """
    limits = TWO_CLASS | (limits or {})
    plan = segmentation.ivt(Plan().then("given", "SELECT * FROM {gaze}"), "given", "lab", threshold, fs, **limits)
    plan = scanpaths.from_fixations(events.event_table(plan, "lab", "label = 1", "fix", fs, "label > 0"), "fix", "sp")
    paths = plan.then("out", "SELECT recording_id, k, x, y, dur FROM sp").spark(recordings.sparkSession, gaze=recordings)
    return learning.joint_areas(paths) if joint else areas(paths, method, diagonal).select("recording_id", "k", "aoi", "cx", "cy")
