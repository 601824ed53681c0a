"""Segmentation methods that are window expressions: velocity thresholds, direction consistency, Bayesian decision."""

from __future__ import annotations

import math

from ..functions.kinematics import W
from ..functions.relational import Plan
from .islands import duration_filter, two_class, with_runs


def ivt(p: Plan, source: str, out: str, threshold: float, fs: float, speed: str = "speed", **limits) -> Plan:
    """I-VT: a sample is fixation if its own or the previous forward speed is at most the threshold."""
    p = p.then(f"{out}_in", f"SELECT recording_id, i, x, y, z, speed, status, CASE WHEN {speed} <= {threshold} OR lag({speed}) OVER ({W}) <= {threshold} THEN 1 ELSE 0 END AS slow FROM {source}")
    return two_class(p, f"{out}_in", out, "slow = 1", fs, **limits)


def ivvt(p: Plan, source: str, out: str, saccade: float, pursuit: float, speed: str = "speed") -> Plan:
    """I-VVT: 2 saccade above the high threshold, 3 pursuit above the low one, else 1 fixation."""
    return p.then(out, f"SELECT recording_id, i, status, x, y, z, speed, CASE WHEN {speed} IS NULL OR {speed} > {saccade} THEN 2 WHEN {speed} > {pursuit} THEN 3 ELSE 1 END AS label FROM {source}")


def ivmp(p: Plan, source: str, out: str, saccade: float, rayleigh: float, window: float, fs: float, speed: str = "speed") -> Plan:
    """I-VMP: runs between saccades are cut into tiles; a tile is pursuit if the squared mean of its unit directions exceeds ``rayleigh``. Tiles of one sample stay fixation."""
    w = math.ceil(window * fs)
    p = p.then(f"{out}_sp", f"SELECT *, CASE WHEN {speed} > {saccade} THEN 1 ELSE 0 END AS sac, sqrt(vx * vx + vy * vy) AS vn FROM {source}")
    p = with_runs(p, f"{out}_sp", f"{out}_run", "sac", out)
    p = p.then(f"{out}_tile", f"SELECT *, coalesce(vx / nullif(vn, 0), 0) AS cx, coalesce(vy / nullif(vn, 0), 0) AS cy, CAST(floor((i - a_{out}) / {w}) AS BIGINT) AS tile FROM {out}_run")
    of_tile = f"OVER (PARTITION BY recording_id, a_{out}, tile)"
    p = p.then(f"{out}_dir", f"SELECT *, count(*) {of_tile} AS n_tile, power(avg(cx) {of_tile}, 2) + power(avg(cy) {of_tile}, 2) AS r2 FROM {out}_tile")
    return p.then(out, f"SELECT recording_id, i, status, x, y, z, speed, CASE WHEN sac = 1 THEN 2 WHEN n_tile >= 2 AND r2 > {rayleigh} THEN 3 ELSE 1 END AS label FROM {out}_dir")


def ibdt(p: Plan, source: str, out: str, window: float, fixation: float, pursuit: float, saccade: float, sd: float, fs: float, speed: str = "speed") -> Plan:
    """I-BDT: pursuit likelihood is the share of the last samples faster than the fixation level, its running mean the prior; speeds are Gaussian around three levels. Ties go to fixation, saccade, pursuit in turn."""
    d = max(1, math.ceil(window * fs))
    frame = f"({W} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"
    p = p.then(f"{out}_l", f"SELECT *, avg(CASE WHEN {speed} > {fixation} THEN 1e0 ELSE 0e0 END) OVER {frame} AS pl FROM {source}")
    p = p.then(f"{out}_p", f"SELECT *, avg(pl) OVER {frame} AS pr FROM {out}_l")
    gauss = lambda level, left: f"(CASE WHEN {left} THEN 1e0 ELSE exp(greatest(-700.0, -0.5 * power(({speed} - {level}) / {sd}, 2))) END)"
    p = p.then(f"{out}_q", f"SELECT *, (1 - pr) / 2 * {gauss(fixation, f'{speed} < {fixation}')} AS qf, (1 - pr) / 2 * {gauss(saccade, f'{speed} > {saccade}')} AS qs, pr * pl AS qp FROM {out}_p")
    return p.then(out, f"SELECT recording_id, i, status, x, y, z, speed, CASE WHEN qf >= qs AND qf >= qp THEN 1 WHEN qs >= qp THEN 2 ELSE 3 END AS label FROM {out}_q")


def three_class(p: Plan, labels: str, out: str, fs: float, fix: tuple[float, float] = (0.07, 2.0), pursuit: tuple[float, float] = (0.1, 2.0)) -> Plan:
    """Duration limits of three-class methods; what they reject is saccade. ``event`` names the class."""
    p = duration_filter(p, labels, f"{out}_d", fs, {1: fix, 3: pursuit})
    return p.then(out, f"SELECT *, CASE label WHEN 1 THEN 'fix' WHEN 2 THEN 'sac' ELSE 'pur' END AS event FROM {out}_d")
