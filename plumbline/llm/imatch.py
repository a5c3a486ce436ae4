"""I-Match fingerprints over randomised lexicon subsets, in DataFrame operations only.

The lexicon holds the words whose document frequency lies in a band. It is cut into ``SLOTS`` random
subsets by a word's hash, and this at ``LEVELS`` levels, each of which keeps a quarter of the words of
the one before; the first keeps all. Every text is fingerprinted alike: each subset's hash of the
text's sorted distinct words there, the sparsest level first. Texts are as like as the share of
agreeing hashes among the ``AIM`` sparsest subsets that aren't empty in both (all, if there are fewer):
a dense subset agrees in equal texts alone, a sparse one about as often as the texts share a word.

Neighbours in descending doc_id come from windows over buckets of the id's range; the first document
of the next bucket is copied to the end of each bucket, so no window spans all rows. Words above the
band are few in any corpus (at most 1 / ``MOST_SHARE`` times the mean of a document's distinct words),
so they are broadcast and leave before the join with the lexicon.
Words are told apart by ``BITS`` bits of a hash.

Defined cases: a null text is empty; a text without words of the band is fingerprinted by all its
distinct words, and is like another only if those agree; null ids come last in descending order, and
repeated ids are in order of their texts' hash; the one row of a table is its own next document; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.llm.store import drop, written

#: Random subsets at a level, levels, and subsets that two texts are compared by.
SLOTS, LEVELS, AIM = 16, 10, 24
#: The band: at least so many documents hold a word, and at most this share of them.
LEAST_DOCS, MOST_SHARE = 2, 0.002
#: Documents in a bucket of the id's range, and the most buckets.
BUCKET, MOST_BUCKETS = 2048, 1 << 16
LOWEST = -(1 << 63)
#: Bits of a word's hash. The lowest two for each level decide the levels, the highest four the subset.
BITS = 40


def terms(text: Column) -> Column:
    """Hashes of the text's distinct lower-cased words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << BITS) - 1))))


def bucket_of(key: Column, firsts: list[int]) -> Column:
    """The number of the last of firsts (descending) that isn't below key; searched in runs of about their square root."""
    run = math.isqrt(len(firsts)) + 1
    runs = [firsts[i : i + run] for i in range(0, len(firsts), run)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    last = lambda xs: F.greatest(F.size(F.filter(xs, lambda b: b >= key)) - 1, F.lit(0))
    at = last(longs([r[0] for r in runs]))
    return at * run + last(F.get(F.array(*[longs(r) for r in runs]), at))


def with_next(docs: DataFrame, n_docs: int) -> DataFrame:
    """(bucket, pos, next_bucket, next_pos, doc_id, text, next_text): each document with the next one in descending doc_id, the first after the last."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    buckets = min(MOST_BUCKETS, max(1, n_docs // BUCKET))
    shares = [i / buckets for i in range(1, buckets + 1)]
    found = rows.agg(F.percentile_approx("key", shares, max(10_000, 20 * buckets)).alias("q")).first()["q"] or []  # an id for each bucket
    firsts = sorted(set(found), reverse=True)
    n = max(1, len(firsts))
    mine = rows.withColumn("bucket", bucket_of(F.col("key"), firsts) if firsts else F.lit(0)).withColumn("guest", F.lit(False))
    guests = mine.where(F.col("key").isin(firsts)).withColumn("bucket", F.pmod(F.col("bucket") - 1, F.lit(n))).withColumn("guest", F.lit(True))
    w = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.xxhash64("text"))
    seen = mine.union(guests).select("*", F.row_number().over(w).alias("pos"), F.lead("text").over(w).alias("next_text"), F.lead("guest").over(w).alias("last"))
    return seen.where("NOT guest").select(
        "bucket", "pos", F.when(F.col("last"), F.pmod(F.col("bucket") + 1, F.lit(n))).otherwise(F.col("bucket")).alias("next_bucket"),
        F.when(F.col("last"), F.lit(1)).otherwise(F.col("pos") + 1).alias("next_pos"), "doc_id", "text", "next_text",
    )


def edited(text: Column, after: Column) -> Column:
    """The text, its last floor(n / 2) code points replaced by the first as many (or all) of the next one's."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(after, F.lit(1), half))


def prints(words: Column) -> Column:
    """31-bit hashes of the sorted words of each subset, the sparsest level first; 0 for an empty one."""
    mark = lambda there: F.when(F.size(there) > 0, F.greatest(F.lit(1), F.xxhash64(there).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))).otherwise(F.lit(0))
    slots = lambda left: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: mark(F.filter(left, lambda h: F.shiftright(h, BITS - 4) == k)))
    masks = F.array(*[F.lit((1 << 2 * level) - 1).cast("long") for level in reversed(range(LEVELS))])
    at = lambda mask: F.transform(F.array(F.filter(words, lambda h: h.bitwiseAND(mask) == 0)), slots)
    return F.flatten(F.flatten(F.transform(masks, at)))


def likeness(a: Column, b: Column) -> Column:
    """The share of agreeing subsets among the first AIM that aren't empty in both."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1001).otherwise(1))
    seen = F.aggregate(pairs, F.lit(0), lambda s, x: F.when(F.pmod(s, F.lit(1000)) >= AIM, s).otherwise(s + x))
    return F.when(seen > 0, F.floor(seen / 1000) / F.pmod(seen, F.lit(1000))).otherwise(F.lit(0.0))


def shown(marks: Column, everything: Column) -> Column:
    """A fingerprint as text: its hashes from the first that isn't empty, or that of all words where no subset holds any."""
    full = F.array_max(F.transform(marks, lambda x, i: F.when(x != 0, F.size(marks) - i).otherwise(F.lit(0))))
    return F.when(full > 0, F.array_join(F.transform(F.slice(marks, F.size(marks) - full + 1, F.greatest(full, F.lit(1))), F.hex), "-")).otherwise(F.concat(F.lit("x-"), F.hex(everything)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The result of op9 for docs (doc_id, text)."""
    n_docs = docs.count()
    counted = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    most = max(float(LEAST_DOCS), MOST_SHARE * n_docs)
    known = written(counted.where(F.col("df") >= LEAST_DOCS).select("h", (F.col("df") <= most).alias("band")), "imatch-words")
    band, common = known.where("band").select("h"), known.where("NOT band").select("h")
    both = with_next(docs, n_docs).withColumn("edit", edited(F.col("text"), F.col("next_text"))).select(
        (F.col("bucket").cast("long") * F.lit(1 << 40) + F.col("pos")).alias("row"), (F.col("next_bucket").cast("long") * F.lit(1 << 40) + F.col("next_pos")).alias("next_row"),
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), terms(F.col("text")).alias("a"), terms(F.col("edit")).alias("b"),
    )
    both = both.withColumn("a_all", F.xxhash64(F.sort_array("a"))).withColumn("b_all", F.xxhash64(F.sort_array("b"))).withColumn("ab", F.array_intersect("a", "b"))
    mark = lambda words, kind: F.transform(words, lambda h: h * 4 + kind)
    every = F.concat(F.array(F.lit(-1).cast("long")), mark("ab", 3), mark(F.array_except("a", "ab"), 1), mark(F.array_except("b", "ab"), 2))
    # A row for each word, and one (-1) that holds the rest.
    info = F.struct("next_row", "doc_id", "n_chars", "edited_sha256", "a_all", "b_all")
    each = both.select("row", info.alias("info"), F.explode(every).alias("word")).select("row", "word", F.when(F.col("word") == -1, F.col("info")).alias("info"), F.shiftright("word", 2).alias("h"))
    rows = written(each.join(F.broadcast(common), "h", "left_anti").select("row", "word", "info"), "imatch-rows", compression="zstd")
    infos = written(rows.where("word = -1").select("row", "info.*"), "imatch-infos", compression="zstd")
    held = written(rows.where("word >= 0").select("row", "word").join(band, F.shiftright("word", 2) == F.col("h")).select("row", "word"), "imatch-held", compression="zstd")
    drop(rows)
    found = held.groupBy("row").agg(F.sort_array(F.collect_list("word")).alias("found"))
    of = lambda bit: F.transform(F.filter("found", lambda x: x.bitwiseAND(F.lit(bit)) != 0), lambda x: F.shiftright(x, 2))
    marks = written(found.select(F.col("row").alias("at"), prints(of(1)).alias("a"), prints(of(2)).alias("b")), "imatch-prints", compression="zstd")
    none = F.array_repeat(F.lit(0), SLOTS * LEVELS)
    drop(held)
    info = infos.join(marks, F.col("row") == F.col("at"), "left").withColumn("a", F.coalesce("a", none)).withColumn("b", F.coalesce("b", none))
    alike = lambda x, x_all, y, y_all: F.when((x == y) & ((F.array_max(x) > 0) | (x_all == y_all)), 1.0).otherwise(likeness(x, y))
    info = info.withColumn("near_edited", alike(F.col("a"), F.col("a_all"), F.col("b"), F.col("b_all")))
    info = info.select("row", "next_row", "doc_id", "n_chars", "edited_sha256", "a", "a_all", "near_edited", shown(F.col("a"), F.col("a_all")).alias("fingerprint"), shown(F.col("b"), F.col("b_all")).alias("edited_fingerprint"))
    info = written(info, "imatch-info", compression="zstd")
    drop(infos)
    drop(marks)
    after = info.select(F.col("row").alias("n_row"), F.col("a").alias("n_a"), F.col("a_all").alias("n_all"))
    return info.join(after, F.col("next_row") == F.col("n_row")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", alike(F.col("a"), F.col("a_all"), F.col("n_a"), F.col("n_all")).alias("near_next")
    )


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
