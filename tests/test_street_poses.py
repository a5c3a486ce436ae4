"""Sheets laid on made-up streets at known poses."""

import math

import numpy as np
import pytest

from plumbline.operators import street_poses as sp

SIZE = (1000.0, 800.0)
STREETS = {f"A{i}": np.array([[i * 100.0 - 200, -400, i * 100.0 - 200, 400]]) for i in range(5)} | {f"B{i}": np.array([[-400, i * 130.0 - 260, 400, i * 130.0 - 260]]) for i in range(5)}


def labels_at(pose, names):
    """Labels standing on their streets, as seen on a sheet of the pose."""
    r, k = math.radians(pose[2]), math.exp(pose[3])
    out = []
    for n, (name, along) in enumerate(names):
        x0, y0, x1, y1 = STREETS[name][0]
        east, north = x0 + along * (x1 - x0) - pose[0], y0 + along * (y1 - y0) - pose[1]
        up, right = east * math.sin(r) + north * math.cos(r), east * math.cos(r) - north * math.sin(r)
        bearing = math.degrees(math.atan2(x1 - x0, y1 - y0)) % 180
        out.append(sp.Label(SIZE[0] / 2 + right * k, SIZE[1] / 2 - up * k, math.radians((bearing - 90 - pose[2]) % 180), name, STREETS[name]))
    return out


NAMES = [("A0", 0.4), ("A2", 0.6), ("A3", 0.5), ("B1", 0.45), ("B3", 0.6), ("B2", 0.5)]


@pytest.mark.parametrize("turn", [0.0, 20.0, 200.0])
def test_solved(turn):
    pose = np.array([30.0, -20.0, turn, math.log(2.0)])
    labels = labels_at(pose, NAMES)
    position, angle = sp.errors(pose, labels, SIZE)
    assert position.max() < 1e-6 and np.abs(angle).max() < 1e-6
    assert any(abs((b - turn + 180) % 360 - 180) < 1e-6 for b in sp.bearing_votes(labels, sp.Gates()))
    got, n, why = sp.solved(labels, SIZE, math.log(1.95), bearings=[turn])
    assert why == "posed" and n == 6 and got[:2] == pytest.approx(pose[:2], abs=2) and got[2] == pytest.approx(turn, abs=0.5) and got[3] == pytest.approx(pose[3], abs=0.03)


def test_reasons():
    labels = labels_at(np.array([0.0, 0, 0, 0.7]), NAMES)
    assert sp.solved(labels[:2], SIZE, 0.7)[2] == "too-few-labels"
    assert sp.solved(labels[:3], SIZE, 0.7)[2] == "no-consensus"  # parallel streets tell no place
    assert sp.solved([], SIZE, 0.7) == (None, 0, "too-few-labels")
    gates = sp.gates_with("position_m=20, least=4")
    assert (gates.position_m, gates.least, type(gates.least)) == (20.0, 4, int)
    with pytest.raises(ValueError, match="nonsense"):
        sp.gates_with("nonsense=1")


def test_extended_and_scales():
    path = np.array([[0.0, 0, 10, 0], [10, 0, 20, 0]])
    assert sp.extended(path, 5.0).tolist() == [[-5, 0, 10, 0], [10, 0, 25, 0]]
    labels = labels_at(np.array([0.0, 0, 0, 0.5]), NAMES)
    assert any(abs(s - 0.5) < 1e-9 for s in sp.scale_options(labels, 0.0, 0.1, SIZE, sp.Gates()))


def test_labels_on_streets():
    points, directions = np.array([[0.0, 0.0], [0.0, 5.0], [0.0, 0.0]]), np.array([0.0, 0.0, math.pi / 2])
    street = np.array([[-10.0, 0, 10, 0]])
    away, agrees = sp.on_streets(points, directions, [street, street, street], np.array([[1.0, 0, 0], [0, -1, 0]]), 2.0)
    assert away.tolist() == [0.0, 5.0, 0.0] and agrees.tolist() == [True, False, False]
    assert sp.best_of_each(np.array([1, 1, 2]), np.array([3.0, 1.0, 0.0]), np.array([True, True, False])) == [1]


def test_solved_sheets(spark):
    rows, segments = [], []
    for sheet, pose in ((1, (30.0, -20.0, 10.0, 0.7)), (2, (0.0, 40.0, 95.0, 0.6))):
        rows += [(sheet, i, float(q.x), float(q.y), q.direction, q.street, *SIZE) for i, q in enumerate(labels_at(np.array(pose), NAMES))]
        segments += [(sheet, n, *map(float, s[0])) for n, s in STREETS.items()]
    rows.append((3, 0, 1.0, 1.0, 0.0, "A0", *SIZE))
    got = {r["sheet"]: r for r in sp.solved_sheets(spark.createDataFrame(rows, "sheet long, key long, x double, y double, direction double, street string, width double, height double"), spark.createDataFrame(segments, "sheet long, street string, x0 double, y0 double, x1 double, y1 double"), 0.65).collect()}
    assert got[1]["status"] == got[2]["status"] == "posed" and got[3]["status"] == "too-few-labels" and got[3]["east"] is None
    assert min(abs((got[1]["bearing"] - b + 180) % 360 - 180) for b in (10.0, 190.0)) < 1 and got[1]["log_scale"] == pytest.approx(0.7, abs=0.05)
