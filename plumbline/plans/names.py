"""Queries of street names, labels and page keys: texts are made of the tables' numbers by rule, so SQL can say what each has to become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import keys, streets
from plumbline.session import table

#: Parts that labels are made of: directions, cores and types as printed.
HEADS, CORES, TAILS = ["", "N", "S.", "ne", "ST", "W."], ["MAIN", "Van Buren", "CHARLES", "K", "Rep John", "Magazine", "Avenue"], ["", "ST", "Ave.", "Blvd", "st", "WAY", "Pl. SE"]


def _at(words: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(i, F.lit(len(words))).cast("int"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each kind of line: a direction, a name or a numbered ordinal, and a type."""
    c, n = F.col, F.pmod(F.col("l_partkey"), F.lit(130))
    ordinal = F.concat(n, F.when(F.col("l_suppkey") % 2 == 0, " ").otherwise(""), streets.ordinal_suffix(n))
    core = F.when(c("l_linenumber") > 3, ordinal).otherwise(_at(CORES, c("l_partkey")))
    label = F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in (_at(HEADS, c("l_suppkey")), core, _at(TAILS, c("l_quantity")))])
    return table(spark, sf_dir, "lineitem").select(label.alias("label")).distinct()


def street_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, base, family and printed letters of each label."""
    found = _labels(spark, sf_dir).select("label", streets.normalize_street(F.col("label")).alias("street"), streets.printed_letters(F.col("label")).alias("letters"))
    return found.select("label", "street", streets.base_name(F.col("street")).alias("base"), streets.name_family(F.col("street")).alias("family"), "letters")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the sheet's city: the normal forms of labels with a type, of every second part."""
    return _labels(spark, sf_dir).where(F.length("label") > 8).select(streets.normalize_street(F.col("label")).alias("name")).distinct()


def street_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many known names each label may stand for, and the first."""
    found = streets.matches(_labels(spark, sf_dir), _known(spark, sf_dir))
    return found.select("label", F.size("names").alias("n"), F.get("names", F.lit(0)).alias("first_name"))


def street_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to print each known name."""
    return streets.vocabulary(_known(spark, sf_dir)).groupBy("name").agg(F.countDistinct("text").alias("ways"), F.min("text").alias("least"))


def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page keys of image services named in three ways, and of labels where none is named."""
    i = F.col("o_orderkey")
    letter = F.when(i % 3 == 0, F.lit("N")).otherwise("")
    service = F.when(i % 4 == 0, F.concat(F.lit("https://x/service:a:1950-"), F.lpad(i.cast("string"), 7, "0"), letter, F.lit("/info.json")))
    service = service.when(i % 4 == 1, F.concat(F.lit("service:a:sb"), F.lpad((i % 100000).cast("string"), 5, "0"), F.when(i % 3 == 0, "S").otherwise("0"))).when(i % 4 == 2, F.concat(F.lit("service:a:01N_1950-ind"), i % 9))
    label = F.concat(F.lit("City, St. | 1950 | Vol. 5 p"), i, F.when(i % 5 == 0, F.concat(F.lit(" ["), i % 7, F.lit("]"))).otherwise(""))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", service.alias("service"), label.alias("label"))
    stem = F.concat(F.lit("vol_p"), i, F.lower(letter), F.when(i % 5 == 0, F.concat(F.lit("__"), i % 7)).otherwise(""), F.lit(".georef"), F.when(i % 2 == 0, "-final").otherwise(""), F.lit(".json"))
    return orders.select("o_orderkey", keys.source_page_key(F.col("service"), F.col("label")).alias("source_key"), keys.label_page_key(F.col("label")).alias("label_key"), keys.georef_page_key(stem).alias("file_key"))


def lost_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order size as a read: parts whose number holds its digits in order, and more."""
    reads = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("read")).distinct()
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"))
    # Reads are the 50 sizes at most.
    met = known.join(F.broadcast(reads), keys.is_lost_digits(F.col("read"), F.col("key")))
    return met.groupBy("read").agg(F.count("*").alias("n"), F.min(F.col("key").cast("long")).alias("least"), F.max(F.col("key").cast("long")).alias("most"))


def page_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's parts as a page spec, and the pages that it names again."""
    key = F.concat(F.col("l_partkey") % 30, F.when(F.col("l_quantity") > 40, "a").otherwise(""))
    spec = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(keys.page_spec_text(F.collect_list(key)).alias("spec"))
    return spec.select("l_orderkey", "spec", F.size(keys.page_spec(F.col("spec"))).alias("pages"))


QUERIES = {f.__name__: f for f in (street_names, street_matches, street_vocabulary, source_keys, lost_digits, page_specs)}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LABELS = f"""parts AS (SELECT DISTINCT {_list(HEADS)}[(l_suppkey % 6 + 1)::INT] AS h, {_list(["", "NORTH", "SOUTH", "NORTHEAST", "SAINT", "WEST"])}[(l_suppkey % 6 + 1)::INT] AS fh,
  CASE WHEN l_linenumber > 3 THEN n || CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE '' END || e ELSE {_list(CORES)}[(l_partkey % 7 + 1)::INT] END AS c,
  CASE WHEN l_linenumber <= 3 THEN {_list([c.upper() for c in CORES])}[(l_partkey % 7 + 1)::INT] WHEN n BETWEEN 1 AND 19 THEN {_list(streets.ONES)}[n] WHEN n BETWEEN 20 AND 99 THEN
    CASE WHEN n % 10 = 0 THEN {_list(streets.TENS)}[n // 10] ELSE {_list(streets.BEFORE)}[n // 10] || ' ' || {_list(streets.ONES)}[n % 10] END ELSE n || e END AS fc,
  {_list(TAILS)}[(l_quantity % 7 + 1)::INT] AS t, {_list(["", "STREET", "AVENUE", "BOULEVARD", "STREET", "WAY", "PLACE SE"])}[(l_quantity % 7 + 1)::INT] AS ft
  FROM (SELECT *, (l_partkey % 130)::INT AS n, CASE WHEN l_partkey % 130 % 100 BETWEEN 11 AND 13 THEN 'TH' ELSE ['TH', 'ST', 'ND', 'RD', 'TH', 'TH', 'TH', 'TH', 'TH', 'TH'][(l_partkey % 130 % 10 + 1)::INT] END AS e FROM lineitem)),
labels AS (SELECT DISTINCT concat_ws(' ', nullif(h, ''), c, nullif(t, '')) AS label, concat_ws(' ', nullif(fh, ''), fc, nullif(ft, '')) AS street FROM parts)"""
_TYPES, _DIRECTIONS = _list(streets.TYPES), _list(streets.DIRECTIONS)
_SHORTS = {full: [full, *[s + dot for s, f in (*streets.DIRECTION_OF.items(), *streets.TYPE_OF.items()) if f == full for dot in ("", ".")]] for full in (*streets.DIRECTION_OF.values(), *streets.TYPE_OF.values())}
_FORMS = "MAP {" + ", ".join(f"'{k}': {_list(v)}" for k, v in _SHORTS.items()) + "}"


def _shorter(before: str, after: str, cut: str, which: str) -> str:
    """A step of aliases: those of before, and what a cut leaves of some of them where it is one alias' alone."""
    return f"""{after} AS (SELECT * FROM {before} UNION ALL SELECT s, min(name) FROM (SELECT array_to_string({cut}, ' ') AS s, alias, name FROM (SELECT *, string_split(alias, ' ') AS w FROM {before}) WHERE len(w) > 1 AND {which})
  WHERE s NOT IN (SELECT alias FROM {before}) GROUP BY s HAVING count(DISTINCT alias) = 1)"""


#: SQL of the aliases of known names, for a query on k4 (alias, name).
ALIASES = f"WITH {_LABELS}, k0 AS (SELECT DISTINCT street AS alias, street AS name FROM labels WHERE length(label) > 8), " + ", ".join(
    _shorter(f"k{i}", f"k{i + 1}", cut, which)
    for i, (cut, which) in enumerate([("w[:-2]", f"list_contains({_TYPES}, w[-1])"), ("w[2:]", f"list_contains({_DIRECTIONS}, w[1])"), ("w[:-2]", f"list_contains({_DIRECTIONS}, w[-1])"), ("w[2:]", f"list_contains({_TYPES}, w[1])")])
)
ORACLES = {
    "street_names": f"""WITH {_LABELS}, w AS (SELECT *, string_split(street, ' ') AS ws FROM labels),
b AS (SELECT *, CASE WHEN len(ws) > 1 AND list_contains({_DIRECTIONS}, ws[-1]) THEN ws[:-2] ELSE ws END AS bs FROM w),
f AS (SELECT *, CASE WHEN len(bs) > 1 AND list_contains({_DIRECTIONS}, bs[1]) THEN bs[2:] ELSE bs END AS fs FROM b)
SELECT label, street, array_to_string(bs, ' ') AS base, array_to_string(CASE WHEN len(fs) > 1 AND list_contains({_TYPES}, fs[-1]) THEN fs[:-2] ELSE fs END, ' ') AS family, length(regexp_replace(label, '[^A-Za-z0-9]', '', 'g'))::INT AS letters FROM f""",
    "street_matches": f"""WITH {_LABELS}, known AS (SELECT DISTINCT street AS name FROM labels WHERE length(label) > 8),
l AS (SELECT label, street AS norm, trim(upper(label)) AS raw, length(regexp_replace(label, '[^A-Za-z0-9]', '', 'g')) AS letters FROM labels),
cand AS (SELECT name, unnest(CASE WHEN contains(name, ' ') AND list_contains({_DIRECTIONS[:-1]}, 'SAINT'], split_part(name, ' ', 1)) THEN [name, substr(name, strpos(name, ' ') + 1)] ELSE [name] END) AS c FROM known),
alias AS (SELECT label, name FROM l JOIN known ON raw = name AND raw <> norm),
dirs AS (SELECT label, name FROM l JOIN known ON name = norm OR (starts_with(name, norm || ' ') AND list_contains({_TYPES}, split_part(name, ' ', 2))) WHERE list_contains({_DIRECTIONS}, norm)),
met AS (SELECT DISTINCT label, name FROM l JOIN cand ON split_part(c, ' ', 1) = split_part(norm, ' ', 1) AND (norm = c OR (contains(c, ' ') AND starts_with(norm, c || ' ')) OR (starts_with(c, norm || ' ')
  AND (letters >= 5 OR len(list_filter(string_split(substr(c, length(norm) + 2), ' '), lambda x: NOT list_contains(list_concat({_TYPES}, {_DIRECTIONS}), x))) = 0))) WHERE NOT list_contains({_DIRECTIONS}, norm)),
al AS (SELECT * FROM alias UNION SELECT * FROM (SELECT * FROM dirs UNION SELECT * FROM met) WHERE label NOT IN (SELECT label FROM alias))
SELECT label, count(name)::INT AS n, min(name) AS first_name FROM l LEFT JOIN al USING (label) GROUP BY label""",
    "street_vocabulary": f"""WITH {_LABELS}, known AS (SELECT DISTINCT street AS name, string_split(street, ' ') AS w FROM labels WHERE length(label) > 8), forms AS (SELECT {_FORMS} AS f),
p AS (SELECT name, w, len(w) > 1 AND list_contains({_DIRECTIONS}, w[1]) AS h, len(w) > 1 AND list_contains({_TYPES}, w[-1]) AS t FROM known),
o AS (SELECT name, unnest(CASE WHEN h THEN list_append(f[w[1]], '') ELSE [''] END) AS a, w[1 + h::INT : len(w) - t::INT] AS core, t, w[-1] AS z FROM p, forms),
v AS (SELECT name, a, core, unnest(CASE WHEN t THEN list_append(coalesce(f[z], [z]), '') ELSE [''] END) AS b FROM o, forms), x AS (SELECT name, concat_ws(' ', nullif(a, ''), nullif(array_to_string(core, ' '), ''), nullif(b, '')) AS text FROM v)
SELECT name, count(DISTINCT text) AS ways, min(text) AS least FROM x WHERE text <> '' GROUP BY name""",
    "source_keys": """WITH o AS (SELECT o_orderkey, o_orderkey AS i, CASE WHEN o_orderkey % 5 = 0 THEN '__' || (o_orderkey % 7) ELSE '' END AS panel FROM orders)
SELECT o_orderkey, CASE i % 4 WHEN 0 THEN 'p' || i || CASE WHEN i % 3 = 0 THEN 'N' ELSE '' END WHEN 1 THEN 'p' || (i % 100000) || CASE WHEN i % 3 = 0 THEN 's' ELSE '' END WHEN 2 THEN 'ind' || (i % 9) ELSE 'p' || i END || panel AS source_key,
  'p' || i || panel AS label_key, 'p' || i || CASE WHEN i % 3 = 0 THEN 'n' ELSE '' END || panel AS file_key FROM o""",
    "lost_digits": """WITH r AS (SELECT DISTINCT p_size::VARCHAR AS read FROM part), k AS (SELECT p_partkey::VARCHAR AS key FROM part)
SELECT read, count(*) AS n, min(key::BIGINT) AS least, max(key::BIGINT) AS most FROM r JOIN k ON length(key) > length(read) AND key LIKE '%' || array_to_string(string_split(read, ''), '%') || '%' GROUP BY read""",
    "page_specs": """WITH k AS (SELECT DISTINCT l_orderkey, l_partkey % 30 AS n, l_quantity > 40 AS a FROM lineitem), g AS (SELECT l_orderkey, n, a, CASE WHEN NOT a THEN n - row_number() OVER (PARTITION BY l_orderkey, a ORDER BY n) ELSE 1000 + n END AS island FROM k),
i AS (SELECT l_orderkey, a, island, min(n) AS x, max(n) AS y, count(*) AS c FROM g GROUP BY ALL)
SELECT l_orderkey, string_agg(CASE WHEN a THEN x || 'A' WHEN x = y THEN x::VARCHAR ELSE x || '-' || y END, ',' ORDER BY a, x) AS spec, sum(c)::INT AS pages FROM i GROUP BY l_orderkey""",
}
