"""Record-linkage, selection, geometry and window queries, as Spark SQL over the driver's tables.

Each query is one declarative plan: joins are equi-joins on keys or on grid cells, windows and
aggregates are partitioned, so nothing is gathered on one task. Roles of the tables: sheet = order,
detection = lineitem (quantity = size, discount = confidence), volume = nation, claims = customer
nation to supplier nation, text = part names, positions = supplier and customer keys on a grid.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.session import kept, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NAMED = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b")


def query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs sql with the tables it names read from the folder; only the columns it uses are scanned."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = {m[1] for m in _NAMED.findall(sql)}
        return spark.sql(_NAMED.sub(r"\1 {\2}", sql), **{n: table(spark, sf_dir, n) for n in names})

    return run


#: Points on a plane for suppliers and customers, from their keys.
_POINTS = """sup AS (SELECT s_suppkey AS id, CAST((s_suppkey * 37) % 1000 AS DOUBLE) AS x, CAST((s_suppkey * 91) % 1000 AS DOUBLE) AS y FROM supplier),
cus AS (SELECT c_custkey AS id, CAST((c_custkey * 53) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 17) % 1000 AS DOUBLE) AS y FROM customer)"""
#: Directed claims between volumes, thresholded so that the graph is sparse.
_CLAIMS = """claims AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_returnflag = 'R' AND l_quantity >= 49 AND c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey HAVING count(*) >= 3)"""
_DET = "l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate"

#: Queries whose text is the same in both engines.
SAME = {
    "sheet_portions": """WITH t AS (SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l.l_orderkey, count(*) AS panels, round(max(CASE WHEN total > 0 THEN l_extendedprice / total ELSE 1.0 / n END), 6) AS largest, round(min(CASE WHEN total > 0 THEN l_extendedprice / total ELSE 1.0 / n END), 6) AS smallest
FROM lineitem l JOIN t ON l.l_orderkey = t.l_orderkey GROUP BY l.l_orderkey""",
    "run_diff": """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey)
SELECT coalesce(a.k, b.k) AS page, a.v AS before_v, b.v AS after_v, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'lost' WHEN b.v < a.v THEN 'regressed' WHEN b.v > a.v THEN 'improved' ELSE 'same' END AS verdict FROM a FULL OUTER JOIN b ON a.k = b.k""",
    "coverage_counts": """SELECT o_orderstatus AS status, count(*) AS pages, count(l.l_orderkey) AS placed, sum(CASE WHEN l.l_orderkey IS NULL THEN 1 ELSE 0 END) AS unplaced
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l.l_orderkey GROUP BY o_orderstatus""",
    "mutual_edges": f"WITH {_CLAIMS} SELECT p.a, p.b, p.n AS forward, q.n AS backward FROM claims p JOIN claims q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b",
    "one_sided_edges": f"WITH {_CLAIMS} SELECT p.a, p.b, p.n FROM claims p LEFT ANTI JOIN claims q ON p.a = q.b AND p.b = q.a",
    "truth_edge_score": f"""WITH {_CLAIMS}, truth AS (SELECT m.n_nationkey AS a, n.n_nationkey AS b FROM nation m JOIN nation n ON m.n_regionkey = n.n_regionkey AND m.n_nationkey < n.n_nationkey),
found AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM claims),
s AS (SELECT sum(CASE WHEN t.a IS NOT NULL AND f.a IS NOT NULL THEN 1 ELSE 0 END) AS hits, count(f.a) AS found, count(t.a) AS truth FROM truth t FULL OUTER JOIN found f ON t.a = f.a AND t.b = f.b)
SELECT hits, found, truth, round(CAST(hits AS DOUBLE) / found, 6) AS precision_share, round(CAST(hits AS DOUBLE) / truth, 6) AS recall_share FROM s""",
    "admission_gate": """SELECT l_returnflag, l_linestatus, count(*) AS detections, sum(CASE WHEN l_discount >= 0.05 AND l_quantity >= 10 THEN 1 ELSE 0 END) AS admitted,
  sum(CASE WHEN l_discount >= 0.05 AND l_quantity < 10 THEN 1 ELSE 0 END) AS too_small, sum(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END) AS unsure FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "relaxed_threshold": """WITH s AS (SELECT l_orderkey, sum(CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END) AS strict_n FROM lineitem GROUP BY l_orderkey)
SELECT s.l_orderkey, strict_n, count(*) AS kept FROM s JOIN lineitem l ON s.l_orderkey = l.l_orderkey AND l.l_discount >= CASE WHEN strict_n >= 2 THEN 0.08 ELSE 0.04 END GROUP BY s.l_orderkey, strict_n""",
    "fill_filter": """WITH m AS (SELECT l_suppkey, avg(l_quantity) AS mean_q, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY l_suppkey)
SELECT l.l_suppkey, count(*) AS kept FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey WHERE abs(l_quantity - mean_q) <= 1.5 * sd + 0.000001 GROUP BY l.l_suppkey""",
    "latest_status": """SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1""",
    "first_source_wins": """WITH claims AS (SELECT o_custkey AS page, 1 AS source, max(o_orderkey) AS best FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey UNION ALL SELECT o_custkey, 2, max(o_orderkey) FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey UNION ALL SELECT c_custkey, 3, NULL FROM customer)
SELECT page, source, best FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY source) AS rn FROM claims) t WHERE rn = 1""",
    "page_spec_islands": """WITH d AS (SELECT DISTINCT l_suppkey AS volume, l_partkey AS page FROM lineitem), g AS (SELECT volume, page, page - row_number() OVER (PARTITION BY volume ORDER BY page) AS island FROM d)
SELECT volume, min(page) AS first_page, max(page) AS last_page, count(*) AS pages FROM g GROUP BY volume, island""",
    "select_argmax": f"SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity, l_shipdate) AS rn FROM (SELECT {_DET} FROM lineitem) s) t WHERE rn = 1",
    "distinct_margin": """WITH b AS (SELECT l_orderkey, l_suppkey, max(l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey, l_suppkey), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY v DESC, l_suppkey) AS rn FROM b)
SELECT l_orderkey, max(CASE WHEN rn = 1 THEN l_suppkey END) AS best, round(max(CASE WHEN rn = 1 THEN v END) - coalesce(max(CASE WHEN rn = 2 THEN v END), 0), 2) AS margin FROM r WHERE rn <= 2 GROUP BY l_orderkey""",
    "gate_sweep": """WITH g AS (SELECT 0.02 AS gate UNION ALL SELECT 0.04 UNION ALL SELECT 0.06 UNION ALL SELECT 0.08 UNION ALL SELECT 0.1), d AS (SELECT CAST(l_discount AS DOUBLE) AS conf, l_returnflag, count(*) AS n FROM lineitem GROUP BY CAST(l_discount AS DOUBLE), l_returnflag)
SELECT CAST(gate AS DOUBLE) AS gate, sum(CASE WHEN conf >= gate - 0.0001 THEN n ELSE 0 END) AS accepted, sum(CASE WHEN conf >= gate - 0.0001 AND l_returnflag = 'R' THEN n ELSE 0 END) AS wrong FROM d JOIN g ON TRUE GROUP BY gate""",
    "range_join": f"""WITH {_POINTS} SELECT s.id AS sup_id, count(*) AS n, min(c.id) AS first_cus FROM (SELECT *, CAST(floor(x / 50) AS BIGINT) AS cx, CAST(floor(y / 50) AS BIGINT) AS cy FROM sup) s
JOIN (SELECT id, x, y, CAST(floor(x / 50) AS BIGINT) + dx AS cx, CAST(floor(y / 50) AS BIGINT) + dy AS cy FROM cus JOIN (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) u ON TRUE JOIN (SELECT -1 AS dy UNION ALL SELECT 0 UNION ALL SELECT 1) v ON TRUE) c ON s.cx = c.cx AND s.cy = c.cy
WHERE abs(s.x - c.x) <= 40 AND abs(s.y - c.y) <= 40 GROUP BY s.id""",
    "distance_join": f"""WITH {_POINTS}, p AS (SELECT s.id AS sup_id, c.id AS cus_id, (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) AS d2 FROM (SELECT *, CAST(floor(x / 50) AS BIGINT) AS cx, CAST(floor(y / 50) AS BIGINT) AS cy FROM sup) s
JOIN (SELECT id, x, y, CAST(floor(x / 50) AS BIGINT) + dx AS cx, CAST(floor(y / 50) AS BIGINT) + dy AS cy FROM cus JOIN (SELECT -1 AS dx UNION ALL SELECT 0 UNION ALL SELECT 1) u ON TRUE JOIN (SELECT -1 AS dy UNION ALL SELECT 0 UNION ALL SELECT 1) v ON TRUE) c ON s.cx = c.cx AND s.cy = c.cy)
SELECT sup_id, cus_id, round(sqrt(d2), 6) AS distance FROM p WHERE d2 <= 2500""",
    "point_in_polygon": f"""WITH {_POINTS}, ring AS (SELECT 1 AS k, 100.5 AS x1, 100.5 AS y1, 900.5 AS x2, 200.5 AS y2 UNION ALL SELECT 2, 900.5, 200.5, 700.5, 900.5 UNION ALL SELECT 3, 700.5, 900.5, 400.5, 400.5 UNION ALL SELECT 4, 400.5, 400.5, 100.5, 100.5)
SELECT c.id, count(*) % 2 AS inside FROM cus c JOIN ring ON (y1 > c.y) <> (y2 > c.y) AND c.x < (CAST(x2 AS DOUBLE) - x1) * (c.y - y1) / (CAST(y2 AS DOUBLE) - y1) + x1 GROUP BY c.id HAVING count(*) % 2 = 1""",
    "affine_fit": """WITH p AS (SELECT l_suppkey AS page, CAST(l_quantity AS DOUBLE) AS px, CAST(l_extendedprice AS DOUBLE) AS wx FROM lineitem), m AS (SELECT page, count(*) AS n, avg(px) AS mx, avg(wx) AS my, avg(px * px) AS mxx, avg(px * wx) AS mxy FROM p GROUP BY page)
SELECT page, n, round((mxy - mx * my) / (mxx - mx * mx), 3) AS scale, round(my - mx * (mxy - mx * my) / (mxx - mx * mx), 2) AS offset_v FROM m WHERE mxx - mx * mx > 0.000001""",
    "similarity_fit": """WITH p AS (SELECT l_suppkey AS page, CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, CAST(2 * l_quantity - l_linenumber + 3 AS DOUBLE) AS u, CAST(l_quantity + 2 * l_linenumber + 5 AS DOUBLE) AS v FROM lineitem),
m AS (SELECT page, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, avg(x * x + y * y) AS ss, avg(x * u + y * v) AS a0, avg(x * v - y * u) AS b0 FROM p GROUP BY page),
f AS (SELECT *, (a0 - mx * mu - my * mv) / (ss - mx * mx - my * my) AS a, (b0 - mx * mv + my * mu) / (ss - mx * mx - my * my) AS b FROM m)
SELECT page, round(a, 5) AS a, round(b, 5) AS b, round(mu - a * mx + b * my, 3) AS tx, round(mv - b * mx - a * my, 3) AS ty FROM f""",
    "grid_rmse": """SELECT l_suppkey AS page, count(*) AS n, round(sqrt(avg((l_quantity - 25.5) * (l_quantity - 25.5))), 6) AS rmse, round(max(abs(l_quantity - 25.5)), 6) AS worst FROM lineitem GROUP BY l_suppkey""",
    "rotation_votes": """WITH v AS (SELECT l_suppkey AS page, CAST(l_partkey % 90 AS BIGINT) % 90 AS deg, count(*) AS votes FROM lineitem GROUP BY l_suppkey, l_partkey % 90), s AS (SELECT p.page, p.deg, sum(q.votes) AS support FROM v p JOIN v q ON p.page = q.page AND least(abs(p.deg - q.deg), 90 - abs(p.deg - q.deg)) <= 2 GROUP BY p.page, p.deg)
SELECT page, deg, support FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY support DESC, deg) AS rn FROM s) t WHERE rn = 1""",
    "average_precision": """WITH r AS (SELECT d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id), p AS (SELECT source, quality, CAST(sum(quality) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / k AS prec FROM r)
SELECT source, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN prec END), 6) AS ap FROM p GROUP BY source""",
    "vocab_pass_merge": """WITH a AS (SELECT l_orderkey AS page, l_partkey AS label, max(l_discount) AS c1 FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_partkey), b AS (SELECT l_orderkey AS page, l_partkey AS label, max(l_discount) AS c2 FROM lineitem WHERE l_linenumber > 3 GROUP BY l_orderkey, l_partkey)
SELECT coalesce(a.page, b.page) AS page, count(*) AS labels, sum(CASE WHEN c1 IS NULL THEN 1 ELSE 0 END) AS second_only, sum(CASE WHEN c1 >= c2 THEN 1 ELSE 0 END) AS first_kept FROM a FULL OUTER JOIN b ON a.page = b.page AND a.label = b.label GROUP BY coalesce(a.page, b.page)""",
    "digit_family": """SELECT length(CAST(o_orderkey AS STRING)) AS digits, substr(CAST(o_orderkey AS STRING), 1, 1) AS lead_digit, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY length(CAST(o_orderkey AS STRING)), substr(CAST(o_orderkey AS STRING), 1, 1)""",
    "alias_index": """WITH w AS (SELECT p_partkey AS canonical, upper(p_name) AS name FROM part), a AS (SELECT canonical, name AS alias FROM w UNION SELECT canonical, replace(name, 'STREET', 'ST') FROM w UNION SELECT canonical, replace(name, ' ', '') FROM w)
SELECT alias, min(canonical) AS canonical, count(DISTINCT canonical) AS claims FROM a GROUP BY alias""",
}

#: Queries whose text differs: Spark's, DuckDB's.
PAIRS = {
    "canonical_match": (
        """WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '') AS name FROM part), g AS (SELECT name, min(p_partkey) AS canonical, count(*) AS matches FROM n GROUP BY name)
SELECT p_partkey, min(canonical) AS canonical, sum(matches) AS matches FROM n JOIN g ON n.name = g.name GROUP BY p_partkey""",
        """SELECT p.p_partkey, min(q.p_partkey) AS canonical, count(*) AS matches FROM part p JOIN part q ON regexp_replace(lower(p.p_name), '[^a-z]', '') = regexp_replace(lower(q.p_name), '[^a-z]', '') GROUP BY p.p_partkey""",
    ),
    "upper_median": (
        "SELECT l_suppkey, count(*) AS n, element_at(sort_array(collect_list(l_quantity)), CAST(floor(count(*) / 2) AS INT) + 1) AS upper_median FROM lineitem GROUP BY l_suppkey",
        "SELECT l_suppkey, count(*) AS n, list_extract(list_sort(list(l_quantity)), (count(*) // 2 + 1)::INT) AS upper_median FROM lineitem GROUP BY l_suppkey",
    ),
    "auto_percentile": (
        "SELECT l_suppkey, round(percentile(CAST(l_extendedprice AS DOUBLE), 0.05), 4) AS p05, round(percentile(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS p50, round(percentile(CAST(l_extendedprice AS DOUBLE), 0.95), 4) AS p95 FROM lineitem GROUP BY l_suppkey",
        "SELECT l_suppkey, round(quantile_cont(l_extendedprice::DOUBLE, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 4) AS p95 FROM lineitem GROUP BY l_suppkey",
    ),
    "page_key_parse": (
        r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/([0-9]+)([?#]|$)', 1) AS page_key FROM pages",
        r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '/([0-9]+)([?#]|$)', 1) AS page_key FROM pages",
    ),
    "street_normalize": (
        r"SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name), '[^A-Z0-9 ]', ' '), ' +', ' ')) AS street, size(split(trim(p_name), ' +')) AS words FROM part",
        r"SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(p_name), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS street, len(regexp_split_to_array(trim(p_name), ' +'))::INT AS words FROM part",
    ),
    "vocab_expand": (
        "SELECT word, count(*) AS n, min(p_partkey) AS first_part FROM (SELECT p_partkey, explode(array_distinct(split(lower(trim(p_name)), ' +'))) AS word FROM part) t GROUP BY word",
        "SELECT word, count(*) AS n, min(p_partkey) AS first_part FROM (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(trim(p_name)), ' +')) AS word FROM part) t GROUP BY word",
    ),
    "event_windows": (
        "SELECT event_type, CAST(unix_timestamp(CAST(window.start AS TIMESTAMP)) AS BIGINT) AS start_s, count(*) AS n FROM (SELECT event_type, window(ts, '1 hour') AS window FROM events) t GROUP BY event_type, window",
        "SELECT event_type, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start_s, count(*) AS n FROM events GROUP BY 1, 2",
    ),
}

#: Each string with itself and what is left of it without one of its characters: strings within one edit of each other share one of these.
_LESS = "explode(concat(array(t), transform(sequence(1, length(t)), i -> concat(substr(t, 1, i - 1), substr(t, i + 1)))))"

#: Queries whose plan differs from the plain SQL that says the same, which is in WHOLE_SQL.
WHOLE = {
    # The rules of stems and letters don't apply: keys and reads are decimal numbers. A read that no rule settles stays as it is.
    "levenshtein_snap": f"""WITH k AS (SELECT DISTINCT CAST(s_suppkey AS STRING) AS t FROM supplier), r AS (SELECT DISTINCT p_partkey AS page, CAST(p_partkey AS STRING) AS t FROM part),
kv AS (SELECT t, {_LESS} AS v FROM k), rv AS (SELECT page, t, {_LESS} AS v FROM r),
m AS (SELECT DISTINCT rv.page, rv.t AS raw, kv.t, levenshtein(rv.t, kv.t) AS d FROM rv JOIN kv ON rv.v = kv.v WHERE levenshtein(rv.t, kv.t) <= 1),
n AS (SELECT *, min(d) OVER (PARTITION BY page) AS least_d FROM m),
g AS (SELECT page, CASE WHEN count(*) = 1 THEN max(t) WHEN count_if(endswith(t, raw)) = 1 THEN max(CASE WHEN endswith(t, raw) THEN t END) END AS t FROM n WHERE d = least_d GROUP BY page)
SELECT r.page, CAST(coalesce(g.t, r.t) AS BIGINT) AS id FROM r LEFT JOIN g ON r.page = g.page""",
    "street_intersections": """WITH s AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS street FROM lineitem)
SELECT p.street AS a, q.street AS b, count(*) AS crossings FROM s p JOIN s q ON p.node = q.node AND p.street < q.street GROUP BY p.street, q.street""",
    "circular_mean": "SELECT event_type, count(*) AS n, round(pmod(degrees(atan2(avg(sin(radians(event_id * 37 % 360))), avg(cos(radians(event_id * 37 % 360))))), 360D), 4) AS mean_deg FROM events GROUP BY event_type",
    # Scales are counted by page before they meet, at most 70 a page here. The fullest rung, then the one whose median keeps most members in the bands of 1, 0.5 and 2 times.
    "family_scale": """WITH v AS (SELECT l_suppkey AS page, CAST(1 + l_linenumber AS DOUBLE) * (1 + CAST(l_partkey % 10 AS DOUBLE) / 100) AS s FROM lineitem),
f AS (SELECT page, s, log2(s) - floor(log2(s)) AS frac, count(*) AS n FROM v WHERE s IS NOT NULL GROUP BY page, s),
c AS (SELECT p.page, p.s, p.frac, sum(q.n) AS support FROM f p JOIN f q ON p.page = q.page AND least(abs(p.frac - q.frac), 1 - abs(p.frac - q.frac)) <= log2(1.15D) GROUP BY p.page, p.s, p.frac),
a AS (SELECT page, s AS anchor, frac, support FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY support DESC, s) AS rn FROM c) t WHERE rn = 1),
m AS (SELECT a.page, anchor, support, f.s, f.n, CAST(rint(log2(f.s / anchor)) AS BIGINT) AS rung FROM a JOIN f ON a.page = f.page AND least(abs(a.frac - f.frac), 1 - abs(a.frac - f.frac)) <= log2(1.15D)),
r AS (SELECT page, anchor, support, rung, sum(n) AS members, percentile(s, 0.5, n) AS middle FROM m GROUP BY page, anchor, support, rung),
b AS (SELECT r.page, r.anchor, r.support, r.rung, members, middle, sum(CASE WHEN m.s / middle BETWEEN 0.75D AND 1.25D OR m.s / middle BETWEEN 0.4D AND 0.6D OR m.s / middle BETWEEN 1.8D AND 2.2D THEN m.n ELSE 0 END) AS covered
  FROM r JOIN m ON r.page = m.page GROUP BY r.page, r.anchor, r.support, r.rung, members, middle)
SELECT page, round(anchor, 4) AS anchor, support, rung, members, round(middle, 4) AS scale FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY members DESC, covered DESC, abs(rung), rung) AS rn FROM b) t WHERE rn = 1""",
}

WHOLE_SQL = {
    "levenshtein_snap": """WITH k AS (SELECT DISTINCT s_suppkey::VARCHAR AS t FROM supplier), r AS (SELECT DISTINCT p_partkey AS page, p_partkey::VARCHAR AS t FROM part),
m AS (SELECT r.page, r.t AS raw, k.t, levenshtein(r.t, k.t) AS d, min(levenshtein(r.t, k.t)) OVER (PARTITION BY r.page) AS least_d FROM r JOIN k ON levenshtein(r.t, k.t) <= 1),
g AS (SELECT page, CASE WHEN count(*) = 1 THEN max(t) WHEN count(*) FILTER (ends_with(t, raw)) = 1 THEN max(t) FILTER (ends_with(t, raw)) END AS t FROM m WHERE d = least_d GROUP BY page)
SELECT r.page, coalesce(g.t, r.t)::BIGINT AS id FROM r LEFT JOIN g ON r.page = g.page""",
    "circular_mean": "SELECT event_type, count(*) AS n, round((degrees(atan2(avg(sin(radians(event_id * 37 % 360))), avg(cos(radians(event_id * 37 % 360))))) + 360) % 360, 4) AS mean_deg FROM events GROUP BY event_type",
    "family_scale": """WITH v AS (SELECT l_suppkey AS page, (1 + l_linenumber)::DOUBLE * (1 + (l_partkey % 10)::DOUBLE / 100) AS s FROM lineitem), f AS (SELECT page, s, log2(s) - floor(log2(s)) AS frac, count(*) AS n FROM v WHERE s IS NOT NULL GROUP BY page, s),
c AS (SELECT p.page, p.s, p.frac, sum(q.n)::BIGINT AS support FROM f p JOIN f q ON p.page = q.page AND least(abs(p.frac - q.frac), 1 - abs(p.frac - q.frac)) <= log2(1.15::DOUBLE) GROUP BY ALL),
a AS (SELECT page, s AS anchor, frac, support FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY support DESC, s) = 1),
m AS (SELECT a.page, anchor, support, v.s, round_even(log2(v.s / anchor), 0)::BIGINT AS rung FROM a JOIN v ON a.page = v.page AND least(abs(a.frac - (log2(v.s) - floor(log2(v.s)))), 1 - abs(a.frac - (log2(v.s) - floor(log2(v.s))))) <= log2(1.15::DOUBLE)),
r AS (SELECT page, anchor, support, rung, count(*) AS members, median(s) AS middle FROM m GROUP BY ALL),
b AS (SELECT r.*, (SELECT count(*) FILTER (m.s / r.middle BETWEEN 0.75 AND 1.25 OR m.s / r.middle BETWEEN 0.4 AND 0.6 OR m.s / r.middle BETWEEN 1.8 AND 2.2) FROM m WHERE m.page = r.page) AS covered FROM r)
SELECT page, round(anchor, 4) AS anchor, support, rung, members, round(middle, 4) AS scale FROM b QUALIFY row_number() OVER (PARTITION BY page ORDER BY members DESC, covered DESC, abs(rung), rung) = 1""",
    "knn_offsets": f"""WITH {_POINTS}, r AS (SELECT s.id AS sup_id, c.x - s.x AS ox, c.y - s.y AS oy, row_number() OVER (PARTITION BY s.id ORDER BY (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y), c.id) AS rn FROM sup s CROSS JOIN cus c)
SELECT sup_id, count(*) AS k, list_sort(list(ox))[3] AS median_dx, list_sort(list(oy))[3] AS median_dy FROM r WHERE rn <= 5 GROUP BY sup_id""",
}

#: Neighbours of a point, and the first radius they are looked for in, which is the size of a cell; how many times the neighbours a square of that side may hold before it is halved.
NEIGHBOURS, RADIUS, DENSE = 5, 100.0, 32


def nearest(left: DataFrame, right: DataFrame, k: int = NEIGHBOURS, radius: float = RADIUS) -> DataFrame:
    """(id, other, ox, oy, d2) of the k points of right (id long, x double, y double) nearest to each of left, at any distance; of equals the lowest ids.

    Points with fewer than k within the radius are looked up again at twice of it, in cells of its size. Without k points on the right there are no rows.
    Points of left in one place are looked up once, and of those of right only k can count; where right is dense, the first radius is smaller.
    """
    rows = kept(left.dropna(), "knn-points")
    order = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    right = kept(right.dropna().withColumn("nth", order).where(F.col("nth") <= k).drop("nth"), "knn-points")
    spots = left = kept(rows.groupBy("x", "y").agg(F.min("id").alias("id")).select("id", "x", "y"), "knn-points")
    n, width, height = right.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    found = []
    enough = n >= k
    while enough and n * radius * radius > DENSE * k * width * height > 0:
        radius /= 2
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    while enough and not left.isEmpty():
        cell = lambda c: F.floor(F.col(c) / radius)  # noqa: B023, E731
        others = right.select(F.col("id").alias("other"), F.col("x").alias("u"), F.col("y").alias("v"), cell("x").alias("rx"), cell("y").alias("ry"))
        others = others.withColumn("dx", near).withColumn("dy", near).withColumn("cx", F.col("rx") + F.col("dx")).withColumn("cy", F.col("ry") + F.col("dy"))
        pairs = left.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(others, ["cx", "cy"])
        pairs = pairs.select("id", "other", (F.col("u") - F.col("x")).alias("ox"), (F.col("v") - F.col("y")).alias("oy")).withColumn("d2", F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "other"))
        best = pairs.where(F.col("d2") <= radius * radius).withColumn("rank", rank).where(F.col("rank") <= k)
        best = kept(best, "knn-found")
        full = best.where(F.col("rank") == k).select("id")
        found.append(best.join(full, "id", "left_semi").drop("rank"))
        left = kept(left.join(full, "id", "left_anti"), "knn-points")
        radius *= 2
    empty = left.sparkSession.createDataFrame([], "id long, other long, ox double, oy double, d2 double")
    every = reduce(DataFrame.union, found, empty).join(spots, "id").drop("id")
    return rows.join(every, ["x", "y"]).select("id", "other", "ox", "oy", "d2")


def knn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians, by component, of the offsets to the five nearest customers of each supplier."""
    sup, cus = (query(f"WITH {_POINTS} SELECT id, x, y FROM {p}")(spark, sf_dir) for p in ("sup", "cus"))
    middle = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return nearest(sup, cus).groupBy(F.col("id").alias("sup_id")).agg(F.count("*").alias("k"), F.round(middle("ox"), 6).alias("median_dx"), F.round(middle("oy"), 6).alias("median_dy"))


QUERIES = {name: query(sql) for name, sql in SAME.items()} | {name: query(sql) for name, (sql, _) in PAIRS.items()} | {name: query(sql) for name, sql in WHOLE.items()} | {"knn_offsets": knn_offsets}
ORACLES = {name: re.sub(r"\bAS STRING\)", "AS VARCHAR)", sql).replace("LEFT ANTI JOIN", "ANTI JOIN") for name, sql in SAME.items()} | {name: sql for name, (_, sql) in PAIRS.items()}
ORACLES |= {"street_intersections": WHOLE["street_intersections"], **WHOLE_SQL}
ORACLES["canonical_match"] = ORACLES["canonical_match"].replace(", '[^a-z]', '')", ", '[^a-z]', '', 'g')")
