"""Mixing sources to target weights, in DataFrame operations only.

Words are counted per document and summed per source. Targets are filled like vessels: each source
gets words in proportion to its weight until it stops at ``MAX_RATE`` times its own size, and the
excess is shared among the others by weight until none is above. A source's repetition rate is its
target over its size; a document is emitted floor(rate) times, plus once with a probability of the
rest, decided by a seeded hash of its id, so reruns agree. No copy is made before the last step, and
the table of sources is broadcast only if it is small.

Defined cases: a null or empty text has size 0; a source without any words has target 0, and its
documents are emitted once (they take no words); a null source is a source of its own, the last;
documents with the same id decide alike; an empty table gives an empty mix; other columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.llm.store import small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MAX_RATE, SEED = (5, 2, 1), 3, "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def chance(doc_id: Column, seed: str) -> Column:
    """A number from 0 up to 1 that depends on the id and the seed alone: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows (source, size). The windows run over the sources, not the documents."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = sums.withColumn("weight", weight).withColumn("full", F.col("source_size") * MAX_RATE / F.col("weight"))
    everything, before = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    # With the sources before it stopped, what is left for a unit of weight; it rises until no further source stops.
    level = (F.sum("source_size").over(everything) - so_far(F.col("source_size") * MAX_RATE)) / (F.sum("weight").over(everything) - so_far(F.col("weight")))
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return filled.select("source", "source_size", F.least((F.col("source_size") * MAX_RATE).cast("double"), F.col("level") * F.col("weight")).alias("target"))


def planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc: struct of the row, size, source_size, target, copies) for each row of docs (doc_id, text, source, ...)."""
    found = written(targets(docs.select("source", word_count(F.col("text")).alias("size")), weights), "mix-targets")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), word_count(F.col("text")).alias("size"))
    both = rows.join(small(found), F.col("doc.source").eqNullSafe(found.source))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    whole = F.floor(rate)
    copies = whole + F.when(chance(F.col("doc.doc_id"), seed) < rate - whole, 1).otherwise(0)
    return both.select("doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    plan = planned(docs, weights, seed).where("copies > 0")
    return plan.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return plan.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def plan_sql(table: str) -> str:
    """DuckDB SQL for planned(): the table's rows with size, source_size, target and copies."""
    return f"""SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM (
SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 1.0 END AS rate,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM (
SELECT d.*, source_size, target FROM (SELECT *, len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {table}) d JOIN (
SELECT source, source_size, least((source_size * {MAX_RATE})::DOUBLE, max(level) OVER () * weight) AS target FROM (
SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * {MAX_RATE}) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level FROM (
SELECT *, source_size * {MAX_RATE}::DOUBLE / weight AS "full" FROM (
SELECT source, source_size, list_extract({list(WEIGHTS)}, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)) AS weight FROM (
SELECT source, sum(len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+')))::BIGINT AS source_size FROM {table} GROUP BY source)))
WINDOW w AS (ORDER BY "full", source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) t ON d.source IS NOT DISTINCT FROM t.source))"""


OP8_SQL = f"SELECT doc_id, size, source_size, target, copies * size AS taken FROM ({plan_sql('documents')})"
