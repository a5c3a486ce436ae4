"""Near duplicates by Jaccard similarity of word n-grams, by T-occurrence search (DivideSkip).

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two sets link when
100 * |x & y| >= 80 * |x | y|; the result is the components of these links, exact up to hash
collisions. Steps, each linear in its input but for pairs that do link:

1. Equal sets become one class. Only one row of each class goes on.
2. Prefix filter. Under one global order (the hash's) linked sets share at least ``need`` shingles of
   their prefixes, so a class whose prefix has fewer shingles that any other class has too links with
   nothing. A quarter of all shingles is shuffled; most classes end here, without a pair being made.
3. The remaining sets are dealt into blocks by least shingle; a large group is split over many
   blocks, and a few pivots of it visit each, so that its blocks meet. In each block DivideSkip runs:
   short inverted lists are merged by a heap, long ones probed by binary search for the candidates
   only, and documents that reach the overlap are joined, unless they are in one component already.
4. What is still open are pairs across components. A list whose classes are all in one component is
   dropped, then each class that the remaining lists can't lift to the overlap it needs, and so on.
   What is left is merged by shuffle (short lists) with the threshold lowered by a class's long
   lists, and each class visits just those blocks that can reach it, where DivideSkip decides.

Defined cases: null, empty or white-space texts have an empty set and link with nothing, as do
texts shorter than five words with anything but the same words; rows that repeat a doc_id are
rows of their own; a null doc_id takes part, but never names a component unless all ids of it are
null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.components import Forest, components
from plumbline.llm.store import drop, settle, small, written
from plumbline.llm.textkit import mix, word_hashes

WORDS = 5
#: Percent of the required overlap that the prefixes of the first and of the second filter must share.
FIRST, SECOND = 10, 20
#: Sets in a block, pivots of a split group, and classes in a list from which it counts as long.
BLOCK, PIVOTS, LONG_LIST = 64, 8, 64
#: Queries in a task of step 4, and rounds in which whole sets thin out what it has to look at.
QUERIES, PEELS = 256, 2
#: Blocks in a part of an inverted list of blocks.
CHUNK = 256

_ODD = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes of a word-hash sequence, in unsigned order."""
    n = min(len(words), WORDS)
    if not n:
        return words
    total = words[: len(words) - n + 1] * _ODD[0]
    for i in range(1, n):
        total = total + words[i : len(words) - n + 1 + i] * _ODD[i]
    return np.unique(mix(total + np.uint64(n)))


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any set it links with."""
    return (4 * n + 4) // 5


def prefix_length(n: int, percent: int) -> int:
    o = least_overlap(n)
    return n - o + 1 + percent * o // 100 if n else 0


def needed(n: int, percent: int) -> int:
    """Shingles that the prefixes of a set of n and of any set it links with have in common."""
    return 1 + percent * least_overlap(least_overlap(n)) // 100


def _needed(n: Column, percent: int) -> Column:
    o = lambda c: F.floor((4 * c + 4) / 5)
    return (1 + F.floor(percent * o(o(n)) / 100)).cast("long")


def _sets(whole: bool):
    """(doc_id, n, set_id, shingles) for rows (doc_id, text): all shingles, or those of the first prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, rows, offsets, words in word_hashes(b.column(1)):
                parts, ns, keys = [], [], []
                for i in range(rows):
                    s = shingles(words[offsets[i] : offsets[i + 1]])
                    ns.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                    parts.append(s if whole else s[: prefix_length(len(s), FIRST)])
                at = np.cumsum([0, *map(len, parts)], dtype=np.int32)
                values = np.concatenate(parts).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, rows).cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(at), pa.array(values))],
                    names=["doc_id", "n", "set_id", "shingles"],
                )

    return run


def sets(docs: DataFrame, whole: bool = False) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sets(whole), "doc_id long, n long, set_id string, shingles array<long>")


class BlockIndex:
    """Inverted lists of a block's sets, and DivideSkip over them."""

    MU = 0.02

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.sizes = [len(a) for a in arrays]
        values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        owners = np.repeat(np.arange(len(arrays)), self.sizes)
        order = np.argsort(values, kind="stable")
        values, owners = values[order], owners[order]
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(values)] if len(values) else starts
        self.lists = {int(values[a]): owners[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}

    def search(self, query: list[int], n: int, below: int, skip) -> Iterator[int]:
        """Sets with a number under below that link with a query of n shingles; skip(x) leaves one out."""
        need = least_overlap(n)
        found = []
        for s in query:
            if (ids := self.lists.get(s)) and ids[0] < below:
                found.append(ids)
        if len(found) < need:
            return
        found.sort(key=len)
        n_long = min(need - 1, int(need / (self.MU * math.log2(len(found[-1]) + 1) + 1)))
        split = len(found) - n_long
        short, long = found[:split], found[split:]
        last, count = -1, 0
        for x in heapq.merge(*short, [below]):
            if x == last:
                count += 1
                continue
            if count >= need - n_long and not skip(last):
                total, left, least = count, n_long, math.ceil(4 * (n + self.sizes[last]) / 9)
                for ids in long:
                    if total + left < least:
                        break
                    left -= 1
                    at = bisect_left(ids, last)
                    total += at < len(ids) and ids[at] == last
                if 9 * total >= 4 * (n + self.sizes[last]):
                    yield last
            if x >= below:
                return
            last, count = x, 1


def _arrays(t: pa.Table) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in t.column("shingles").combine_chunks()] if t.num_rows else []


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    a = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": a[:, 0], "b": a[:, 1]})


def _link_block(t: pa.Table) -> pa.Table:
    """Links a block's sets among each other: a spanning forest of its links."""
    t = t.take(pc.sort_indices(t, [("sid", "ascending")]))
    ids = t.column("sid").to_pylist()
    keep = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]  # a pivot is in its own block already
    arrays, ids = _arrays(t.take(keep)), [ids[i] for i in keep]
    index, forest, pairs = BlockIndex(arrays), Forest(), []
    for i, a in enumerate(arrays):
        for x in index.search(a.tolist(), len(a), i, lambda x, i=i: forest.root(x) == forest.root(i)):
            if forest.join(x, i):
                pairs.append((ids[x], ids[i]))
    return _edges(pairs)


def _reached(t: pa.Table) -> pa.Table:
    """(q, block) for the blocks in at least ``bar`` of the lists of a query."""
    t = t.take(pc.sort_indices(t, [("q", "ascending")]))
    asked, bars, lists = t.column("q").to_numpy(), t.column("bar").to_numpy(), t.column("blocks").combine_chunks()
    out_q, out_b = [], []
    starts = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(asked)], strict=True):
        blocks, counts = np.unique(lists.slice(a, z - a).flatten().to_numpy(), return_counts=True)
        blocks = blocks[counts >= bars[a]]
        out_q.append(np.full(len(blocks), asked[a]))
        out_b.append(blocks)
    return pa.table({"q": np.concatenate(out_q), "block": np.concatenate(out_b)})


def _link_queries(t: pa.Table) -> pa.Table:
    """Links query rows with a block's own rows of other components."""
    own, asked = t.filter(pc.invert(t.column("query"))), t.filter(t.column("query"))
    index, ids, labels = BlockIndex(_arrays(own)), own.column("sid").to_pylist(), own.column("label").to_pylist()
    forest, pairs = Forest(), []
    for sid, label, a in zip(asked.column("sid").to_pylist(), asked.column("label").to_pylist(), _arrays(asked), strict=True):
        for x in index.search(a.tolist(), len(a), len(ids), lambda x, k=label: forest.root(labels[x]) == forest.root(k)):
            if forest.join(labels[x], label):
                pairs.append((ids[x], sid))
    return _edges(pairs)


def _survivors(rows: DataFrame) -> DataFrame:
    """(row_id) of the classes that can link with another: see step 2."""
    each = rows.select("row_id", "n", F.explode("shingles").alias("h"))
    shared = written(each.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "ngram-shared")
    hits = each.join(shared, "h").groupBy("row_id", "n").agg(F.count("*").alias("k"))
    found = written(hits.where(F.col("k") >= _needed(F.col("n"), FIRST)).select("row_id"), "ngram-open")
    drop(shared)
    return found


def _blocks(whole: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(sid, block): each set's own block, and the blocks that the pivots of split groups visit besides."""
    keyed = whole.select("sid", F.element_at("shingles", 1).alias("least"))
    agg = [F.min_by("sid", F.xxhash64("sid", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    large = written(keyed.groupBy("least").agg(F.count("*").alias("k"), *agg).where(F.col("k") > BLOCK), "ngram-large").withColumn("parts", F.ceil(F.col("k") / BLOCK))
    n = max(1, math.ceil(total / BLOCK))
    part = lambda least, i: F.xxhash64(F.lit("part"), least, i)
    place = keyed.join(small(large.select("least", "parts")), "least", "left").select(
        "sid", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("least"), F.lit(n))).otherwise(part(F.col("least"), F.pmod(F.xxhash64("sid", F.lit("part")), "parts"))).alias("block")
    )
    place = written(place, "ngram-place")
    pivots = large.select("least", "parts", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("sid"))
    visits = pivots.select("sid", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: part(F.col("least"), i))).alias("block"))
    return place, written(visits.join(place, ["sid", "block"], "left_anti"), "ngram-pivots")


def _across(whole: DataFrame, light: DataFrame, total: int) -> DataFrame | None:
    """Edges between components that step 3 left apart, or None if no pair is open. light: (sid, block, label, rank)."""
    n, o = F.col("n"), F.floor((4 * F.col("n") + 4) / 5).cast("long")
    length = (n - o + 1 + F.floor(SECOND * o / 100)).cast("int")
    asks, rows = light, None
    for peel in range(1 + PEELS):  # first by prefixes, then by whole sets, among ever fewer classes
        taken = F.slice("shingles", F.lit(1), length) if not peel else F.col("shingles")
        each = whole.join(small(asks.select("sid", "block", "label", "rank")), "sid").select("sid", "n", "label", "rank", "block", F.explode(taken).alias("h"))
        mixed = written(
            each.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("h", (F.col("k") > LONG_LIST).alias("long")), "ngram-mixed"
        )
        if mixed.isEmpty():
            return None
        rows = written(each.join(mixed, "h"), "ngram-rows")
        need = o if peel else _needed(n, SECOND)
        asks = written(
            rows.groupBy("sid", "n", "label", "rank", "block").agg(F.count("*").alias("k"), F.sum(F.col("long").cast("long")).alias("n_long"))
            .where(F.col("k") >= need).select("sid", "block", "label", "rank", "n_long", need.alias("need")),
            "ngram-asks",
        )
    # Of two components the smaller one asks: a few strays visit a large group's blocks, not the group theirs.
    asks = asks.select(F.col("sid").alias("q"), F.col("rank").alias("q_rank"), "n_long", "need")
    lists = written(rows.join(small(asks.select(F.col("q").alias("sid"))), "sid", "left_semi").groupBy("h", "long", "block").agg(F.max("rank").alias("top")), "ngram-lists")
    # A list is an array of blocks, in chunks of bounded length; a block is in the same chunk of each list.
    chunks = max(1, math.ceil(light.select("block").distinct().count() / CHUNK))
    packed = lists.groupBy("h", "long", F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("top", "block")).alias("at"))
    packed = written(packed, "ngram-packed")
    mine = rows.select(F.col("sid").alias("q"), "h").join(small(asks), "q")
    met = mine.join(packed, "h").where("NOT long OR n_long >= need").select(
        "q", "chunk", F.when(F.col("n_long") < F.col("need"), F.col("need") - F.col("n_long")).otherwise(F.col("need")).alias("bar"),
        F.transform(F.filter("at", lambda x: x["top"] > F.col("q_rank")), lambda x: x["block"]).alias("blocks"),
    ).where(F.size("blocks") > 0)
    batches = max(1, math.ceil(asks.count() / 32))
    visits = written(met.groupBy(F.pmod(F.xxhash64("q"), F.lit(batches)), "chunk").applyInArrow(_reached, "q long, block long"), "ngram-visits")
    if visits.isEmpty():
        return None
    parts = written(visits.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("parts")), "ngram-parts")
    asked = visits.join(parts, "block").select(F.col("q").alias("sid"), "block", F.pmod(F.xxhash64("q"), "parts").alias("part"), F.lit(True).alias("query")).join(light.select("sid", "label"), "sid")
    own = light.join(parts, "block").select("sid", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"), "label")
    both = written(asked.unionByName(own), "ngram-both")
    return whole.join(small(both), "sid").select("block", "part", "sid", "label", "shingles", "query").groupBy("block", "part").applyInArrow(_link_queries, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, n_shingles, set_id, component_id, label) for each row of docs (doc_id long, text string); rows of one component have one label."""
    spark = docs.sparkSession
    table = written(sets(docs).withColumn("row_id", F.monotonically_increasing_id()), "ngram-sets")
    rows = written(table.drop("shingles"), "ngram-rows")
    classes = written(
        rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("row_id").alias("sid"), F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")), "ngram-classes"
    )
    copies = written(rows.select("row_id", "set_id").join(classes.where("copies > 1"), "set_id").where("row_id <> sid").select("row_id"), "ngram-copies")
    open_rows = _survivors(table.where("set_id IS NOT NULL").join(small(copies), "row_id", "left_anti"))
    drop(table)
    settle(spark)
    picked = written(rows.select("row_id", "doc_id", "set_id").join(small(open_rows), "row_id"), "ngram-picked")
    total = picked.count()
    named = classes.select("set_id", "sid", "first_doc")
    if total:
        labels = _labels(docs, picked, total)
        named = named.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("set_id", F.coalesce("component", "sid").alias("label"), "first_doc")
        named = written(named, "ngram-named")
        firsts = written(named.groupBy("label").agg(F.min("first_doc").alias("least")), "ngram-firsts")
        named = named.join(firsts, "label").select("set_id", "least", "label")
    else:
        named = named.select("set_id", F.col("first_doc").alias("least"), F.col("sid").alias("label"))
    named = written(named, "ngram-result")
    settle(spark)
    return rows.join(named, "set_id", "left").select("row_id", "doc_id", F.col("n").alias("n_shingles"), "set_id", F.coalesce("least", "doc_id").alias("component_id"), "label")


def _labels(docs: DataFrame, picked: DataFrame, total: int) -> DataFrame:
    """(node, component) over the picked classes (row_id, doc_id, set_id): steps 3 and 4."""
    ids = small(picked.select(F.col("doc_id").alias("wanted")).distinct(), total)
    texts = docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("wanted")), "left_semi")
    whole = written(sets(texts, whole=True).join(small(picked.select(F.col("row_id").alias("sid"), "set_id"), total), "set_id").select("sid", "n", "shingles"), "ngram-whole")
    if whole.count() > total:  # rows that repeat both doc_id and text
        whole = written(whole.dropDuplicates(["sid"]), "ngram-whole")
    place, pivots = _blocks(whole, total)
    at = place.union(pivots)
    edges = written(whole.join(small(at), "sid").select("block", "sid", "shingles").groupBy("block").applyInArrow(_link_block, "a long, b long"), "ngram-edges")
    labels = components(edges)
    settle(docs.sparkSession)
    light = written(place.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "block", F.coalesce("component", "sid").alias("label")), "ngram-light")
    sizes = written(light.groupBy("label").agg(F.count("*").alias("size")), "ngram-sizes")
    light = written(light.join(sizes, "label").select("sid", "block", "label", F.struct("size", "label").alias("rank")), "ngram-light")
    more = _across(whole, light, total)
    if more is None or (more := written(more, "ngram-more")).isEmpty():
        return labels
    return components(edges.union(more))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: that with the least doc_id stays, null ids last.

    Rows with an empty set stay. A doc_id may stand on several rows: each row is judged by its own text.
    """
    found = written(near_duplicates(docs).select("doc_id", "set_id", "label"), "ngram-found")
    first = found.where("set_id IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "set_id")).alias("r"))
    first = small(written(first.select(F.col("r.doc_id").alias("first_doc"), F.col("r.set_id").alias("first_set")), "ngram-first"))
    represents = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("set_id") == F.col("first_set"))
    named = found.where("doc_id IS NOT NULL")
    repeated = written(named.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("seen")), "ngram-repeated")
    gone = named.where("set_id IS NOT NULL").join(first, represents, "left_anti").select(F.col("doc_id").alias("seen"))
    gone = written(gone.union(repeated).distinct(), "ngram-gone")
    doc_id = F.col("doc_id").cast("long")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), doc_id.alias("named"))  # columns of docs may have any names
    lone = whole.where("named IS NOT NULL").join(small(gone), F.col("named") == F.col("seen"), "left_anti").select("doc.*")
    if repeated.isEmpty() and found.where("doc_id IS NULL").isEmpty():
        return lone
    # Rows whose id doesn't tell them apart: their sets are made again, by text.
    of_repeated = whole.where("named IS NOT NULL").join(small(repeated), F.col("named") == F.col("seen"), "left_semi")
    again = whole.where("named IS NULL").union(of_repeated).select("doc", F.col("named").alias("doc_id"), F.col("doc.text").alias("text"), F.xxhash64("doc.text").alias("h"))
    again = written(again, "ngram-again")
    made = written(sets(again.select(F.col("h").alias("doc_id"), "text").dropDuplicates(["doc_id"])).select(F.col("doc_id").alias("h"), "set_id"), "ngram-made")
    again = again.join(small(made), "h")
    kept = again.where("set_id IS NULL").select("doc.*")
    return lone.union(kept).union(again.where("set_id IS NOT NULL").join(first, represents, "left_semi").dropDuplicates(["set_id"]).select("doc.*"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


OP2_SQL = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS x FROM w),
e AS (SELECT r, len(x) AS n, unnest(x) AS x FROM s), p AS (SELECT a.r AS a, b.r AS b, count(*) AS c, any_value(a.n + b.n) AS n FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n - c)), g AS (SELECT a, b FROM l UNION SELECT b, a FROM l), t AS (SELECT r, r AS o FROM s UNION SELECT t.r, g.b FROM t JOIN g ON g.a = t.o),
m AS (SELECT t.r, min(s.doc_id) AS least FROM t JOIN s ON s.r = t.o GROUP BY t.r)
SELECT doc_id, len(x)::BIGINT AS n_shingles, least AS component_id FROM s JOIN m USING (r)"""
