"""Live gaze: threshold labels, closed events and dwell times over unbounded input with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_ivvt(gaze: DataFrame, fast: float, slow: float, fs: float, late: str = "2 seconds") -> DataFrame:
    """(recording_id, t, label) from (recording_id, t, x, y): the step from the previous sample decides; the state is that sample."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("t")
        px, py = state.get if state.exists else (pdf.x.iloc[0], pdf.y.iloc[0])
        xs, ys = [px, *pdf.x], [py, *pdf.y]
        speed = [((xs[k + 1] - xs[k]) ** 2 + (ys[k + 1] - ys[k]) ** 2) ** 0.5 * fs for k in range(len(pdf))]
        state.update((float(xs[-1]), float(ys[-1])))
        yield pd.DataFrame({"recording_id": key[0], "t": pdf.t, "label": [2 if v > fast else 3 if v > slow else 1 for v in speed]})

    return gaze.withWatermark("t", late).groupBy("recording_id").applyInPandasWithState(run, "recording_id long, t timestamp, label int", "x double, y double", "append", GroupStateTimeout.NoTimeout)


def live_events(labels: DataFrame, late: str = "2 seconds") -> DataFrame:
    """(recording_id, label, start, end, n): runs of one label, emitted when the run closes; the state is the open run."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("t")
        open_run = list(state.get) if state.exists else None
        rows = []
        for t, label in zip(pdf.t, pdf.label, strict=True):
            ms = int(t.value // 1_000_000)
            if open_run and open_run[0] == label:
                open_run[2:] = [ms, open_run[3] + 1]
            else:
                if open_run:
                    rows.append((key[0], *open_run))
                open_run = [int(label), ms, ms, 1]
        state.update(tuple(open_run))
        yield pd.DataFrame(rows, columns=["recording_id", "label", "start_ms", "end_ms", "n"])

    return labels.withWatermark("t", late).groupBy("recording_id").applyInPandasWithState(run, "recording_id long, label int, start_ms long, end_ms long, n long", "label int, start_ms long, end_ms long, n long", "append", GroupStateTimeout.NoTimeout)


def live_dwell(samples: DataFrame, window: str = "10 seconds", late: str = "2 seconds") -> DataFrame:
    """Samples per AoI and tumbling window."""
    return samples.withWatermark("t", late).groupBy(F.window("t", window), "recording_id", "aoi").agg(F.count("*").alias("n"))


def live_visits(samples: DataFrame, gap: str = "1 second", late: str = "2 seconds") -> DataFrame:
    """Visits per AoI as session windows."""
    return samples.withWatermark("t", late).groupBy(F.session_window("t", gap), "recording_id", "aoi").agg(F.count("*").alias("n"))
