"""Fits of one page's rows: optimal assignment and smoothed thin-plate splines, page by page as in greedy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.greedy import by_page, edges
from plumbline.session import table


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row (rows <= columns) at the least total cost, by shortest augmenting paths with potentials."""
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        here, column, far = row, -1, 0.0
        scanned = [row]
        while True:
            slack = far + cost[here] - row_price[here] - column_price
            better = ~done & (slack < reach)
            reach[better], via[better] = slack[better], column
            column = int(np.argmin(np.where(done, np.inf, reach)))
            far = reach[column]
            done[column] = True
            if owner[column] < 0:
                break
            here = owner[column]
            scanned.append(here)
        inner = done.copy()
        inner[column] = False
        row_price[row] += far
        for c in np.flatnonzero(inner):
            row_price[owner[c]] += far - reach[c]
            column_price[c] -= far - reach[c]
        while column >= 0:
            before = via[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def spline(source: np.ndarray, target: np.ndarray, smoothing: float):
    """A map of the plane through pairs of points: r^2 log r kernels plus an affine part, relaxed by smoothing."""
    bend = lambda p: (lambda r2: np.where(r2 > 0, r2 * 0.5 * np.log(np.maximum(r2, 1e-12)), 0.0))(((p[:, None] - source[None]) ** 2).sum(axis=2))
    flat = lambda p: np.c_[np.ones(len(p)), p]
    n = len(source)
    left = np.block([[bend(source) + smoothing * np.eye(n), flat(source)], [flat(source).T, np.zeros((3, 3))]])
    solved = np.linalg.lstsq(left, np.r_[target, np.zeros((3, 2))], rcond=None)[0]
    return lambda p: bend(p) @ solved[:n] + flat(p) @ solved[n:]


def least_assignment(df: DataFrame, page: str, key: str, value: str, slots: int, step: float) -> DataFrame:
    """(page, key, value, slot): each row of a page gets a slot of its own, the total of |value - step * slot| being least.

    A page of more rows than slots gets as many slots as rows. Of equal totals any one is taken, always the same.
    """

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        out, values = np.zeros(len(rows), np.int64), rows[value].to_numpy(float)
        for i, j in edges(rows[page]):
            out[i:j] = assignment(np.abs(values[i:j, None] - step * np.arange(max(slots, j - i))[None]))
        return rows[[page, key, value]].assign(slot=out)

    used = df.select(page, key, F.col(value).cast("double")).dropna()
    return by_page(used, page, [key, value], made, f"{page} long, {key} long, {value} double, slot long")


def spline_residuals(df: DataFrame, page: str, source: tuple[str, str], target: tuple[str, str], smoothing: float = 1.0) -> DataFrame:
    """(page, n, rmse): how far each page's smoothed spline stays from its pairs; a page needs three pairs."""

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, out = rows[list(source)].to_numpy(float), rows[list(target)].to_numpy(float), []
        for i, j in edges(rows[page]):
            if j - i >= 3:
                away = spline(a[i:j], b[i:j], smoothing)(a[i:j]) - b[i:j]
                out.append((rows[page].iloc[i], j - i, float(np.sqrt((away**2).sum(axis=1).mean()))))
        return pd.DataFrame(out, columns=[page, "n", "rmse"])

    used = df.select(page, *(F.col(c).cast("double") for c in (*source, *target))).dropna()
    return by_page(used, page, [*source, *target], made, f"{page} long, n long, rmse double")


def slot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return least_assignment(lines, "l_orderkey", "l_partkey", "l_quantity", 8, 7.0)


def page_splines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100)
    return spline_residuals(lines.toDF("l_orderkey", "x", "y", "u", "v"), "l_orderkey", ("x", "y"), ("u", "v"))


QUERIES = {"slot_assignment": slot_assignment, "page_splines": page_splines}
ORACLES: dict[str, str] = {}
