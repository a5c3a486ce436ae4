"""Streams with state of their own: sessions of a user, and sliding windows that late rows no longer change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.streaming.upsert import events, upserted

#: Seconds without an event that end a session.
GAP_S = 30 * 60


def _sessions(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Sessions and events of a user so far; the state holds them and the last event's time. A batch's rows are taken in order of time."""
    sessions, n, last = state.get if state.exists else (0, 0, None)
    rows = pd.concat([*batches])
    for at in sorted(rows["at"]):
        sessions += last is None or at > last + GAP_S * 1_000_000
        last, n = at if last is None else max(at, last), n + 1
    state.update((int(sessions), n, int(last)))
    yield pd.DataFrame({"user_id": [key[0]], "sessions": [sessions], "n": [n]})


def sessions(stream: DataFrame) -> DataFrame:
    """(user_id, sessions, n): a stream of updates for a stream of events (user_id, ts)."""
    rows = stream.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.unix_micros("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(_sessions, "user_id long, sessions long, n long", "sessions long, n long, last long", "update", GroupStateTimeout.NoTimeout)


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(sessions(events(spark, sf_dir)), ["user_id"])


def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of an hour that start each half hour."""
    counts = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return upserted(counts.select("event_type", F.unix_timestamp("w.start").alias("start_s"), "n"), ["event_type", "start_s"])


QUERIES = {"stream_sessions": stream_sessions, "stream_sliding_counts": stream_sliding_counts}
ORACLES = {
    "stream_sessions": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, count(*) FILTER (prev IS NULL OR ts > prev + INTERVAL 30 MINUTE) AS sessions, count(*) AS n FROM e GROUP BY user_id""",
    "stream_sliding_counts": """WITH w AS (SELECT event_type, (floor(epoch(ts) / 1800) * 1800)::BIGINT AS s FROM events)
SELECT event_type, s - d AS start_s, count(*) AS n FROM w, (SELECT unnest([0, 1800]) AS d) GROUP BY 1, 2""",
}
