"""A sheet's pose from the streets its labels name: bearings voted for, placements where two labels meet their streets, then a robust fit.

A label is a pixel, a direction on the sheet and a name; its street is a set of segments on a plane of metres
about the place where the sheet is thought to be. A pose is (east, north, bearing in degrees, log of pixels a
metre) of the sheet's centre. All of a sheet's labels are taken at once, as arrays; sheets are groups.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plumbline.operators.greedy import distinct_lines, first_of_each


@dataclass(frozen=True)
class Gates:
    """What a pose must meet, and how far a search goes. Fixed values, but for overrides by name."""

    angle_deg: float = 8.0
    position_m: float = 50.0
    least: int = 3
    least_share: float = 0.6
    least_streets: int = 3
    diversity_deg: float = 30.0
    parallel_deg: float = 10.0
    spacing_m: float = 20.0
    polish_m: float = 60.0
    polish_deg: float = 3.0
    stable_m: float = 30.0
    stable_deg: float = 2.0
    slack_m: float = 60.0
    sigma_line_m: float = 15.0
    sigma_angle_deg: float = 3.0
    sigma_scale: float = 0.05
    sigma_place_m: float = 400.0
    bearings: int = 8
    scales: int = 5
    placements: int = 6
    beyond_m: float = 500.0


def gates_with(overrides: str, base: Gates | None = None) -> Gates:
    """Gates with overrides as name=value,name=value; an unknown name is an error."""
    base = base or Gates()
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(Gates)}
    given = dict(p.split("=", 1) for p in overrides.split(",") if p.strip())
    unknown = sorted(k.strip() for k in given if k.strip() not in kinds)
    if unknown:
        raise ValueError(f"unknown gates: {', '.join(unknown)}")
    return replace(base, **{k.strip(): kinds[k.strip()](float(v)) for k, v in given.items()})


@dataclass
class Label:
    """A label with its street's segments (x0, y0, x1, y1), and those that stand for straight runs of it."""

    x: float
    y: float
    direction: float
    street: str
    segments: np.ndarray
    lines: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lines = self.segments[distinct_lines(self.segments)] if len(self.segments) else self.segments


def half_turn(d):
    """Degrees between undirected bearings, in [-90, 90)."""
    return (d + 90.0) % 180.0 - 90.0


def bearings_of(segments: np.ndarray) -> np.ndarray:
    return np.degrees(np.arctan2(segments[:, 2] - segments[:, 0], segments[:, 3] - segments[:, 1])) % 180.0


def nearest_segments(points: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, bearing) of the nearest segment to each point."""
    d, off = segments[:, 2:] - segments[:, :2], points[:, None] - segments[None, :, :2]
    t = np.clip((off * d).sum(axis=2) / np.maximum((d * d).sum(axis=1), 1e-9), 0, 1)
    away = np.hypot(*np.moveaxis(off - t[..., None] * d, 2, 0))
    best = away.argmin(axis=1)
    return away[np.arange(len(points)), best], bearings_of(segments)[best]


def extended(segments: np.ndarray, metres: float) -> np.ndarray:
    """Segments drawn on beyond ends at which no other one goes on."""
    if not len(segments):
        return segments
    ends = np.round(segments.reshape(-1, 2), 2)
    _, back, n = np.unique(ends, axis=0, return_inverse=True, return_counts=True)
    loose = (n[back.reshape(-1)] < 2).reshape(-1, 2)
    d = segments[:, 2:] - segments[:, :2]
    size = np.hypot(*d.T)[:, None]
    step = np.divide(d, size, out=np.zeros_like(d), where=size > 1e-6) * metres
    return np.c_[segments[:, :2] - step * loose[:, :1], segments[:, 2:] + step * loose[:, 1:]]


def world(pose: np.ndarray, pixels: np.ndarray, size: tuple[float, float]) -> np.ndarray:
    """Metres east and north of pixels under a pose."""
    r, k = math.radians(pose[2]), math.exp(-pose[3])
    right, up = (pixels[:, 0] - size[0] / 2) * k, (size[1] / 2 - pixels[:, 1]) * k
    return np.c_[pose[0] + up * math.sin(r) + right * math.cos(r), pose[1] + up * math.cos(r) - right * math.sin(r)]


def label_bearings(bearing: float, labels: list[Label]) -> np.ndarray:
    return (bearing + 90.0 + np.degrees([q.direction for q in labels])) % 180.0


def errors(pose: np.ndarray, labels: list[Label], size: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(metres, degrees) that each label is off its street."""
    at = world(pose, np.array([[q.x, q.y] for q in labels]), size)
    own, out = label_bearings(pose[2], labels), np.zeros((2, len(labels)))
    for i, q in enumerate(labels):
        away, bearing = nearest_segments(at[i : i + 1], q.segments)
        out[:, i] = away[0], half_turn(own[i] - bearing[0])
    return out[0], out[1]


def bearing_votes(labels: list[Label], gates: Gates) -> list[float]:
    """Bearings of the sheet, those that most labels and lines of their streets agree on first; either way up."""
    votes = [(b - 90.0 - math.degrees(q.direction) + turn) % 360.0 for q in labels for b in (bearings_of(q.lines) if len(q.lines) else ()) for turn in (0.0, 180.0)]
    groups: list[list[float]] = []
    for v in sorted(votes):
        near = next((g for g in groups if abs((v - g[0] + 180) % 360 - 180) <= 2.0), None)
        groups.append([v]) if near is None else near.append(v)
    mean = lambda g: math.degrees(math.atan2(np.sin(np.radians(g)).sum(), np.cos(np.radians(g)).sum())) % 360.0
    return [mean(g) for g in sorted(groups, key=len, reverse=True)[: gates.bearings]]


def scale_options(labels: list[Label], bearing: float, prior: float, size: tuple[float, float], gates: Gates) -> list[float]:
    """Logs of scale: the prior, and what the spacing of parallel streets makes of their labels' spacing; like ones once."""
    at = world(np.array([0.0, 0.0, bearing, 0.0]), np.array([[q.x, q.y] for q in labels]), size)
    found = [prior]
    for i, a in enumerate(labels):
        for j, b in enumerate(labels[i + 1 :], i + 1):
            if a.street == b.street:
                continue
            for la, ba in zip(a.lines, bearings_of(a.lines) if len(a.lines) else (), strict=False):
                for lb, bb in zip(b.lines, bearings_of(b.lines) if len(b.lines) else (), strict=False):
                    normal = np.array([math.cos(math.radians(ba)), -math.sin(math.radians(ba))])
                    spacing, pixels = abs((lb[:2] - la[:2]) @ normal), abs((at[j] - at[i]) @ normal)
                    if abs(half_turn(ba - bb)) <= gates.parallel_deg and spacing >= gates.spacing_m and pixels >= 1e-6:
                        found.append(math.log(pixels / spacing))
    return [found[k] for k in first_of_each(found, lambda x, y: abs(x - y) <= 0.01, gates.scales)]


def agreeing(position: np.ndarray, angle: np.ndarray, gates: Gates) -> np.ndarray:
    return (position <= gates.position_m) & (np.abs(angle) <= gates.angle_deg)


def diversity(bearings: np.ndarray) -> float:
    return float(np.abs(half_turn(bearings[:, None] - bearings[None])).max()) if len(bearings) else 0.0


def placements(labels: list[Label], bearing: float, scales: list[float], size: tuple[float, float], gates: Gates) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pose, agreeing labels): places where two labels stand on crossing streets of theirs, those with the most agreeing labels first, then the least distance."""
    own, names, scored = label_bearings(bearing, labels), np.array([q.street for q in labels]), []
    for scale in scales:
        base = world(np.array([0.0, 0.0, bearing, scale]), np.array([[q.x, q.y] for q in labels]), size)
        rows = [(i, math.cos(math.radians(b)), -math.sin(math.radians(b)), b, *s[:2]) for i, q in enumerate(labels) for s, b in zip(q.lines, bearings_of(q.lines) if len(q.lines) else (), strict=False)]
        if len(rows) < 2:
            continue
        label, nx, ny, b, px, py = np.array(rows).T
        label = label.astype(int)
        rest = nx * (px - base[label, 0]) + ny * (py - base[label, 1])
        i, j = np.triu_indices(len(rows), 1)
        det = nx[i] * ny[j] - ny[i] * nx[j]
        ok = (label[i] != label[j]) & (np.abs(half_turn(b[i] - b[j])) >= gates.diversity_deg) & (np.abs(det) > 1e-6)
        i, j, det = i[ok], j[ok], det[ok]
        shift = np.c_[(rest[i] * ny[j] - ny[i] * rest[j]) / det, (nx[i] * rest[j] - rest[i] * nx[j]) / det]
        shift = shift[np.sort(np.unique(np.round(shift), axis=0, return_index=True)[1])]
        off = np.array([nearest_segments(shift + base[k], q.segments) for k, q in enumerate(labels)]).reshape(len(labels), 2, -1)
        position, angle = off[:, 0].T, half_turn(own[None] - off[:, 1].T)
        inside = agreeing(position, angle, gates)
        for k in range(len(shift)):
            n = inside[k]
            if n.sum() >= max(gates.least, gates.least_share * len(labels)) and len(set(names[n])) >= gates.least_streets and diversity(own[n]) >= gates.diversity_deg:
                scored.append((-int(n.sum()), float(position[k, n].mean()), len(scored), np.array([*shift[k], bearing, scale]), n))
    scored.sort(key=lambda s: s[:3])
    keep = first_of_each([s[3] for s in scored], lambda p, q: math.hypot(*(p - q)[:2]) < 20 and abs(p[3] - q[3]) < 0.01, gates.placements)
    return [scored[k][3:] for k in keep]


def weighed(pose: np.ndarray, labels: list[Label], size: tuple[float, float], prior: float, gates: Gates, place_m: float) -> np.ndarray:
    """Residuals in sigmas: of labels' places and angles, of the scale and of the place."""
    position, angle = errors(pose, labels, size)
    return np.r_[position / gates.sigma_line_m, angle / gates.sigma_angle_deg, (pose[3] - prior) / gates.sigma_scale, pose[:2] / place_m]


def soft_cost(r: np.ndarray) -> float:
    return float((np.sqrt(1 + r * r) - 1).sum())


def fitted(start: np.ndarray, labels: list[Label], size: tuple[float, float], prior: float, gates: Gates, place_m: float, rounds: int = 60) -> np.ndarray:
    """The pose of least soft cost from a start, by damped steps; each point takes its nearest segment anew."""
    pose, unit, damping = start.astype(float), np.array([1e-3, 1e-3, 1e-4, 1e-6]), 1e-2
    r = weighed(pose, labels, size, prior, gates, place_m)
    for _ in range(rounds):
        j = np.stack([(weighed(pose + h, labels, size, prior, gates, place_m) - weighed(pose - h, labels, size, prior, gates, place_m)) / (2 * h.sum()) for h in np.diag(unit)], axis=1)
        w = 1 / np.sqrt(1 + r * r)
        hess, grad = (j * w[:, None]).T @ j, (j * w[:, None]).T @ r
        step = np.linalg.solve(hess + damping * np.diag(np.diag(hess) + 1e-12), -grad)
        after = weighed(pose + step, labels, size, prior, gates, place_m)
        if soft_cost(after) < soft_cost(r):
            small = soft_cost(r) - soft_cost(after) < 1e-10
            pose, r, damping = pose + step, after, damping / 3
            if small:
                break
        elif (damping := damping * 5) > 1e10:
            break
    return pose


def spread_without_one(pose: np.ndarray, labels: list[Label], size: tuple[float, float], prior: float, gates: Gates, place_m: float) -> tuple[float, float]:
    """How far (metres, degrees) the pose moves when any one label is left out."""
    moves = [(0.0, 0.0)]
    for i in range(len(labels)):
        rest = labels[:i] + labels[i + 1 :]
        if len(rest) >= 2:
            other = fitted(pose, rest, size, prior, gates, place_m)
            moves.append((math.hypot(*(other - pose)[:2]), abs(half_turn(other[2] - pose[2]))))
    return max(m for m, _ in moves), max(d for _, d in moves)


def solved(labels: list[Label], size: tuple[float, float], prior: float, gates: Gates | None = None, radius_m: float = 0.0, bearings: list[float] | None = None) -> tuple[np.ndarray | None, int, str]:
    """(pose, agreeing labels, reason): the pose of least cost over all labels that meets the gates; without one, why the cheapest failed."""
    gates = gates or Gates()
    labels = [q for q in labels if len(q.segments)]
    if len(labels) < gates.least:
        return None, 0, "too-few-labels"
    place_m = max(gates.sigma_place_m, radius_m)
    best: tuple[tuple, np.ndarray | None, int, str] | None = None
    for bearing in (bearings or bearing_votes(labels, gates))[: gates.bearings]:
        for seed, inside in placements(labels, bearing, scale_options(labels, bearing, prior, size, gates), size, gates):
            mine = [q for q, n in zip(labels, inside, strict=True) if n]
            pose = fitted(seed, mine, size, prior, gates, place_m)
            why = ""
            if math.hypot(*(pose - seed)[:2]) > gates.polish_m or abs(half_turn(pose[2] - seed[2])) > gates.polish_deg:
                why = "polish-runaway"
            elif not agreeing(*errors(pose, mine, size), gates).all():
                why = "polish-lost-labels"
            elif radius_m and math.hypot(*pose[:2]) > radius_m + gates.slack_m:
                why = "outside-radius"
            elif len(mine) >= gates.least + 2:
                shift, turn = spread_without_one(pose, mine, size, prior, gates, place_m)
                why = "unstable" if shift > gates.stable_m or turn > gates.stable_deg else ""
            key = (bool(why), soft_cost(weighed(pose, labels, size, prior, gates, place_m)))
            if best is None or key < best[0]:
                best = key, None if why else pose, len(mine), why or "posed"
    return best[1:] if best else (None, 0, "no-consensus")


def solved_sheets(labels: DataFrame, segments: DataFrame, prior: float, gates: Gates | None = None) -> DataFrame:
    """(sheet, status, labels, east, north, bearing, log_scale) for each sheet of labels (sheet, key, x, y, direction, street, width, height) and segments (sheet, street, x0, y0, x1, y1)."""

    def made(own: pd.DataFrame, streets: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame([], columns=["sheet", "status", "labels", "east", "north", "bearing", "log_scale"])
        by = {s: extended(g.sort_values(["x0", "y0", "x1", "y1"])[["x0", "y0", "x1", "y1"]].to_numpy(float), (gates or Gates()).beyond_m) for s, g in streets.groupby("street")}
        own = own.sort_values("key")
        held = [Label(r.x, r.y, r.direction, r.street, by.get(r.street, np.zeros((0, 4)))) for r in own.itertuples()]
        pose, n, why = solved(held, (own["width"].iloc[0], own["height"].iloc[0]), prior, gates)
        return pd.DataFrame([(own["sheet"].iloc[0], why, n, *(pose if pose is not None else [None] * 4))], columns=["sheet", "status", "labels", "east", "north", "bearing", "log_scale"])

    return labels.groupBy("sheet").cogroup(segments.groupBy("sheet")).applyInPandas(made, "sheet long, status string, labels long, east double, north double, bearing double, log_scale double")


def on_streets(points: np.ndarray, directions: np.ndarray, streets: list[np.ndarray], affine: np.ndarray, reach: float, turn: float = math.pi / 6) -> tuple[np.ndarray, np.ndarray]:
    """(distance, agrees): how far labels' places under an affine (2 by 3) lie from their streets, and whether that is within reach and the direction within a turn."""
    at, along = points @ affine[:, :2].T + affine[:, 2], np.c_[np.cos(directions), np.sin(directions)] @ affine[:, :2].T
    away, agrees = np.full(len(points), np.inf), np.zeros(len(points), bool)
    for i, s in enumerate(streets):
        if len(s):
            d, bearing = nearest_segments(at[i : i + 1], s)
            r = math.radians(bearing[0])
            cosine = abs(along[i] @ np.array([math.sin(r), math.cos(r)])) / max(float(np.hypot(*along[i])), 1e-12)
            away[i], agrees[i] = d[0], d[0] <= reach and cosine >= math.cos(turn)
    return away, agrees


def best_of_each(labels: np.ndarray, away: np.ndarray, agrees: np.ndarray) -> list[int]:
    """Of readings of one label (equal keys) the agreeing one that lies nearest."""
    best: dict = {}
    for i in np.flatnonzero(agrees).tolist():
        if labels[i] not in best or away[i] < away[best[labels[i]]]:
            best[labels[i]] = i
    return sorted(best.values())
