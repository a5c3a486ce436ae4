"""Decision rules, graph hops, geodesy and grouped roll-ups, as Spark SQL over the driver's tables.

As in linkage, each query is one declarative plan over keyed joins, windows and aggregates.
"""

from __future__ import annotations

import re

from plumbline.plans.linkage import _CLAIMS, _POINTS, query

#: Queries whose text is the same in both engines.
SAME = {
    "score_rollup": """SELECT coalesce(CAST(c_nationkey AS STRING), 'all') AS volume, coalesce(o_orderstatus, 'all') AS status, count(*) AS pages, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total_cents
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_nationkey, o_orderstatus)""",
    "flag_cube": """SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "common_pages": """SELECT l_partkey AS page FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'""",
    "missing_pages": """SELECT p_partkey AS page FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 40""",
    "dominant_angle": """WITH t AS (SELECT l_suppkey AS street, sum(l_quantity * l_quantity - l_linenumber * l_linenumber) AS d, sum(2 * l_quantity * l_linenumber) AS m FROM lineitem GROUP BY l_suppkey)
SELECT street, round(degrees(atan2(m, d)) / 2, 5) AS angle FROM t""",
    "procrustes_rotation": """SELECT l_suppkey AS page, round(degrees(atan2(sum(l_discount * (l_quantity * 3 - l_linenumber)), sum(l_discount * (l_quantity + l_linenumber * 3)))), 5) AS rotation
FROM lineitem GROUP BY l_suppkey HAVING sum(l_discount) > 0""",
    "consistent_points": """SELECT l_partkey AS px, l_suppkey AS py, count(*) AS n, min(l_quantity) AS geo FROM lineitem GROUP BY l_partkey, l_suppkey HAVING max(l_quantity) - min(l_quantity) <= 5""",
    "terminal_endpoints": """WITH e AS (SELECT l_partkey AS node FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) SELECT node FROM e WHERE node IS NOT NULL GROUP BY node HAVING count(*) = 1""",
    "dominated_labels": """WITH d AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS size, CAST(l_discount AS DOUBLE) AS conf FROM lineitem)
SELECT a.l_orderkey, a.l_partkey, a.l_linenumber, a.size, a.conf FROM d a LEFT ANTI JOIN d b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) <= 1 AND b.size > a.size AND b.conf > a.conf""",
    "fused_position": """SELECT l_partkey AS page, round(sum(l_discount * l_quantity) / sum(l_discount), 6) AS x, round(sum(l_discount * l_extendedprice) / sum(l_discount), 4) AS y FROM lineitem GROUP BY l_partkey HAVING sum(l_discount) > 0""",
    "stamp_energy": f"""WITH {_POINTS}, p AS (SELECT s.id AS a, c.id AS b, sqrt((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y)) AS d FROM sup s JOIN cus c ON s.id = c.id)
SELECT a, b, round(least(2.0, (d / 126) * (d / 126)), 6) AS energy FROM p""",
    "status_cascade": """SELECT CASE WHEN l.l_orderkey IS NULL THEN 'unplaced' WHEN n < 2 THEN 'too-few' WHEN spread > 45 THEN 'outlier' WHEN best < 20 THEN 'misscale' ELSE 'fitted' END AS status, count(*) AS n_pages
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) - min(l_quantity) AS spread, max(l_quantity) AS best FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l.l_orderkey
GROUP BY CASE WHEN l.l_orderkey IS NULL THEN 'unplaced' WHEN n < 2 THEN 'too-few' WHEN spread > 45 THEN 'outlier' WHEN best < 20 THEN 'misscale' ELSE 'fitted' END""",
    "suspect_edges": f"""WITH {_CLAIMS}, e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM claims), g AS (SELECT v, count(*) AS degree FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) t GROUP BY v)
SELECT e.a, e.b, p.degree AS degree_a, q.degree AS degree_b, CASE WHEN p.degree = 1 AND q.degree = 1 THEN 'alone' WHEN p.degree > 2 * q.degree THEN 'suspect-b' WHEN q.degree > 2 * p.degree THEN 'suspect-a' ELSE 'kept' END AS verdict
FROM e JOIN g p ON e.a = p.v JOIN g q ON e.b = q.v""",
    "user_sessions": """WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL '30' MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM e)
SELECT user_id, session, count(*) AS n FROM s GROUP BY user_id, session""",
    "haversine": f"""WITH {_POINTS}, p AS (SELECT s.id, radians(s.x / 20) AS lon1, radians(s.y / 20) AS lat1, radians(c.x / 20) AS lon2, radians(c.y / 20) AS lat2 FROM sup s JOIN cus c ON s.id = c.id)
SELECT id, round(2 * (20925524e0 / 3.280839895e0) * asin(sqrt(sin((lat2 - lat1) / 2) * sin((lat2 - lat1) / 2) + cos(lat1) * cos(lat2) * sin((lon2 - lon1) / 2) * sin((lon2 - lon1) / 2))), 2) AS metres,
  round(degrees(atan2(sin(lon2 - lon1) * cos(lat2), cos(lat1) * sin(lat2) - sin(lat1) * cos(lat2) * cos(lon2 - lon1))), 5) AS bearing FROM p""",
}

#: Queries whose text differs: Spark's, DuckDB's.
PAIRS = {
    "asof_purchase": (
        "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase_id FROM events",
        "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase_id FROM events",
    ),
    "polygon_area": (
        "WITH p AS (SELECT l_orderkey, sort_array(collect_list(struct(l_linenumber, l_partkey, l_suppkey))) AS r FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, abs(aggregate(sequence(0, size(r) - 1), 0L, (t, i) -> t + r[i].l_partkey * r[(i + 1) % size(r)].l_suppkey - r[(i + 1) % size(r)].l_partkey * r[i].l_suppkey)) / 2.0D AS area FROM p WHERE size(r) >= 3",
        "WITH p AS (SELECT l_orderkey, l_partkey AS x, l_suppkey AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT p.l_orderkey, abs(sum(p.x * q.y - q.x * p.y))::DOUBLE / 2 AS area FROM p JOIN p q ON p.l_orderkey = q.l_orderkey AND q.i = p.i % p.n + 1 WHERE p.n >= 3 GROUP BY p.l_orderkey",
    ),
    "newest_json_props": (
        "SELECT event_type, get_json_object(props, '$.k') AS k, count(*) AS n, max(event_id) AS newest FROM events GROUP BY event_type, get_json_object(props, '$.k')",
        "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1, 2",
    ),
}

QUERIES = {name: query(sql) for name, sql in SAME.items()} | {name: query(sql) for name, (sql, _) in PAIRS.items()}
ORACLES = {name: re.sub(r"\bAS STRING\)", "AS VARCHAR)", sql).replace("LEFT ANTI JOIN", "ANTI JOIN") for name, sql in SAME.items()} | {name: sql for name, (_, sql) in PAIRS.items()}
