"""Runs of consecutive samples (gaps and islands) and duration filters, as window columns on the samples.

A run is named by its first and last sample on every sample of it, so whatever works on
runs needs neither a join nor another shuffle: all windows part by the recording first.

Three length conventions meet here and nowhere else: a run's size is ``b - a`` when runs
are made, ``b - a + 1`` when durations are filtered or reported, and speeds of a run
leave out its last sample.
"""

from __future__ import annotations

import math

from ..functions.kinematics import W
from ..functions.relational import Plan


def with_runs(p: Plan, source: str, out: str, key: str, tag: str, status: bool = False) -> Plan:
    """Adds ``a_<tag>``, ``b_<tag>`` and ``r_<tag>``: first and last sample of the run of equal ``key`` without a gap in ``i``, and its number in the recording from 1; on request ``s_<tag>``, the run's sum of ``status``."""
    run = f"PARTITION BY recording_id, r_{tag}"
    p = p.then(f"{out}_c", f"SELECT *, CASE WHEN {key} = lag({key}) OVER ({W}) AND i = lag(i) OVER ({W}) + 1 THEN 0 ELSE 1 END AS c_{tag} FROM {source}")
    p = p.then(f"{out}_r", f"SELECT *, sum(c_{tag}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r_{tag} FROM {out}_c")
    more = f", sum(status) OVER ({run}) AS s_{tag}" if status else ""
    return p.then(out, f"SELECT *, min(i) OVER ({run}) AS a_{tag}, max(i) OVER ({run}) AS b_{tag}{more} FROM {out}_r")


def run_samples(p: Plan, source: str, out: str, where: str, low: float = 0, high: float | None = None, status_share: float | None = None) -> Plan:
    """Samples of the maximal runs that satisfy ``where``, with the run's first and last sample ``a``, ``b``.

    Kept if low <= b - a < high and, on request, sum(status) / (b - a) > status_share.
    """
    p = p.then(f"{out}_f", f"SELECT *, 1 AS one_{out} FROM {source} WHERE {where}")
    p = with_runs(p, f"{out}_f", f"{out}_w", f"one_{out}", out, status_share is not None)
    a, b = f"a_{out}", f"b_{out}"
    keep = [f"{b} - {a} >= {low}"] + ([f"{b} - {a} < {high}"] if high is not None else [])
    if status_share is not None:
        keep.append(f"({b} = {a} OR s_{out} / nullif({b} - {a}, 0) > {status_share})")
    return p.then(out, f"SELECT *, {a} AS a, {b} AS b FROM {out}_w WHERE {' AND '.join(keep)}")


def runs(p: Plan, source: str, out: str, where: str, low: float = 0, high: float | None = None, status_share: float | None = None) -> Plan:
    """(recording_id, k, a, b): the runs of :func:`run_samples`, numbered in each recording."""
    p = run_samples(p, source, f"{out}_s", where, low, high, status_share)
    return p.then(out, f"SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY a) - 1 AS BIGINT) AS k, a, b FROM (SELECT DISTINCT recording_id, a, b FROM {out}_s) q")


def samples_of(p: Plan, samples: str, intervals: str, out: str) -> Plan:
    """Samples with the interval of any given table that holds them (k, a, b): an equi join on the recording with a range residual. Runs made here carry a and b already."""
    return p.then(out, f"SELECT s.*, t.k, t.a, t.b FROM {samples} s JOIN {intervals} t ON s.recording_id = t.recording_id AND s.i BETWEEN t.a AND t.b")


def two_class(p: Plan, source: str, out: str, is_fixation: str, fs: float, min_fix: float = 0.07, max_fix: float = 2.0, min_sac: float = 0.015, status_threshold: float = 0.5) -> Plan:
    """Post-processing of two-class methods: the columns of ``source`` and ``label`` (1 fixation, 2 saccade, 0 none), ``a``, ``b`` of the sample's run.

    Long enough runs of non-fixation are saccades; the gaps between saccades that are too short for a fixation join them; fixations are runs of the rest within the duration limits.
    ``source`` needs recording_id, i and status.
    """
    t_fix, t_max, t_sac = math.ceil(min_fix * fs), math.ceil(max_fix * fs), math.ceil(min_sac * fs)
    p = p.then(f"{out}_0", f"SELECT *, CASE WHEN {is_fixation} THEN 1 ELSE 0 END AS fix0 FROM {source}")
    p = with_runs(p, f"{out}_0", f"{out}_w0", "fix0", "w0")
    p = p.then(f"{out}_1", f"SELECT *, CASE WHEN fix0 = 0 AND b_w0 - a_w0 >= {t_sac} THEN 0 ELSE 1 END AS fix1 FROM {out}_w0")
    p = with_runs(p, f"{out}_1", f"{out}_w1", "fix1", "w1")
    p = p.then(f"{out}_2", f"SELECT *, CASE WHEN fix1 = 1 AND r_w1 > 1 AND r_w1 < max(r_w1) OVER (PARTITION BY recording_id) AND b_w1 - a_w1 + 1 < {t_fix} THEN 0 ELSE fix1 END AS fix2 FROM {out}_w1")
    p = with_runs(p, f"{out}_2", f"{out}_w2", "fix2", "w2", status=True)
    size = "b_{0} - a_{0}"
    valid = "({1} = 0 OR s_{0} / nullif({1}, 0) > " + str(status_threshold) + ")"
    w2, w3 = size.format("w2"), size.format("w3")
    p = p.then(f"{out}_3", f"SELECT *, CASE WHEN fix2 = 1 AND {w2} >= {t_fix} AND {w2} < {t_max} AND {valid.format('w2', w2)} THEN 1 ELSE 0 END AS fix3 FROM {out}_w2")
    p = with_runs(p, f"{out}_3", f"{out}_w3", "fix3", "w3", status=True)
    return p.then(out, f"SELECT *, CASE WHEN fix3 = 1 THEN 1 WHEN {valid.format('w3', w3)} THEN 2 ELSE 0 END AS label, a_w3 AS a, b_w3 AS b FROM {out}_w3")


def duration_filter(p: Plan, labels: str, out: str, fs: float, limits: dict[int, tuple[float, float]], other: int = 2) -> Plan:
    """Keep runs of each label in ``limits`` whose n = b - a + 1 lies within the seconds; all other samples get ``other``. All other columns stay."""
    p = p.then(f"{out}_g", f"SELECT *, label AS given FROM {labels}")
    p = with_runs(p, f"{out}_g", f"{out}_w", "given", out)
    n = f"b_{out} - a_{out} + 1"
    keep = " OR ".join(f"(given = {label} AND {n} BETWEEN {max(1, math.ceil(low * fs))} AND {math.floor(high * fs)})" for label, (low, high) in sorted(limits.items()))
    return p.then(out, f"SELECT @except(label, given), CASE WHEN {keep} THEN given ELSE {other} END AS label FROM {out}_w")
