"""Runs of stages over tables: each is made once from the tables it names, and again only if they, its parameters or its code changed.

A stage's table is a Parquet folder; beside it lies a record of what it was made of, written last, so a
stage that was cut off is made again.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """name; the tables it takes (inputs or earlier stages); a function of (spark, tables, params); parameters."""

    name: str
    takes: tuple[str, ...]
    make: Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
    params: dict = field(default_factory=dict)


def ordered(stages: Iterable[Stage], given: Iterable[str] = ()) -> list[Stage]:
    """Stages in an order in which each comes after those it takes from; a name that none makes, or a circle, is an error."""
    left, known, out = list(stages), set(given), []
    names = [s.name for s in left]
    if len(set(names)) < len(names) or set(names) & known:
        raise ValueError("two tables of one name")
    while left:
        ready = [s for s in left if set(s.takes) <= known]
        if not ready:
            missing = sorted({t for s in left for t in s.takes} - known - set(names))
            raise ValueError(f"no stage makes {', '.join(missing)}" if missing else "stages take from each other in a circle")
        out += ready
        known |= {s.name for s in ready}
        left = [s for s in left if s not in ready]
    return out


def mark(stage: Stage, inputs: dict[str, str]) -> str:
    """A digest of what a stage's table depends on: its parameters, its code, and the marks of what it takes."""
    try:
        code = inspect.getsource(stage.make)
    except (OSError, TypeError):
        code = repr(stage.make)
    return hashlib.sha256(json.dumps([stage.name, stage.params, code, sorted(inputs.items())], sort_keys=True, default=str).encode()).hexdigest()[:16]


def _text(spark: SparkSession, path: str, content: str | None = None) -> str | None:
    """Reads a small file wherever Spark's paths lead, or writes it; None if there is none."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if content is not None:
        out = fs.create(place, True)
        out.write(bytearray(content.encode()))
        out.close()
        return content
    if not fs.exists(place):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())  # one record


def run(spark: SparkSession, stages: Iterable[Stage], inputs: dict[str, DataFrame], folder: str, version: str = "") -> tuple[dict[str, DataFrame], list[dict]]:
    """(tables, records): every stage's table, and what was done: stage, mark, whether it was made, seconds.

    version stands for the inputs' state; with another one all stages are made anew.
    """
    tables, marks, records = dict(inputs), dict.fromkeys(inputs, version), []
    for stage in ordered(stages, inputs):
        path, now = f"{folder}/{stage.name}", mark(stage, {t: marks[t] for t in stage.takes})
        before = json.loads(_text(spark, f"{path}.record.json") or "{}")
        began, made = time.time(), before.get("mark") != now
        if made:
            stage.make(spark, {t: tables[t] for t in stage.takes}, stage.params).write.mode("overwrite").parquet(path)
            before = {"mark": now, "seconds": round(time.time() - began, 3), "params": stage.params, "ended": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
            _text(spark, f"{path}.record.json", json.dumps(before, default=str))
        tables[stage.name], marks[stage.name] = spark.read.parquet(path), now
        records.append({"stage": stage.name, "mark": now, "made": made, "seconds": before["seconds"]})
    return tables, records


def fetched(url: str, open_url: Callable[[str], bytes], attempts: int = 5, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """What open_url gives for a url, asked again after ever longer waits; the last error is raised."""
    for i in range(attempts):
        try:
            return open_url(url)
        except OSError:
            if i + 1 == attempts:
                raise
            sleep(delay * 2**i)
    raise ValueError("no attempts")
