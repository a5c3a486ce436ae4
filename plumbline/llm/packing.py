"""Best-fit packing into bins of several permitted lengths.

Documents longer than the largest length are cut into pieces of it and a rest. Pieces are dealt into
blocks of bounded size by a hash of their row, so no key can fill a block, and each block is packed
on its own: pieces in descending length, each into the open bin it leaves least room in. If none
fits, a bin is opened whose length costs least for each token it is going to hold, judged by the
pieces still to come; at last each bin is cut down to the shortest permitted length that holds it.
The lengths are chosen jointly: a block is packed with this rule over each set of the permitted lengths
from the shortest up, and with every bin opened at one of them, and the packing of least cost stays.

Defined cases: a null or empty text is one piece of one token (its end mark); repeated rows and
null ids are packed as rows of their own; an empty table gives no bins; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.mixing import WORD, word_count
from plumbline.llm.store import written

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a bin costs besides its length, in tokens; and the pieces in a block.
OVERHEAD, BLOCK = 16, 4096


def opening(size: int, waiting: list[int], opened: tuple[int, ...] = LENGTHS, lengths: tuple[int, ...] = LENGTHS) -> int:
    """The length of opened whose bin costs least for each token once cut down, if size is put in and then, greedily, what waits."""
    best, pick = math.inf, opened[-1]
    for c in opened:
        if c < size:
            continue
        room, top = c - size, len(waiting)
        while room and (top := bisect_right(waiting, room, 0, top)):
            top -= 1
            room -= waiting[top]
        held = c - room
        down = lengths[bisect_left(lengths, held)]
        if (each := (down + OVERHEAD) / held) < best:
            best, pick = each, c
    return pick


def cost(put: list[tuple[int, int, int]]) -> int:
    """Lengths of all bins and what each costs besides."""
    return sum(c + OVERHEAD for c in {b: c for b, _, c in put}.values())


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, offset, bin's length) for each size, none above the largest length: the least cost of the ways to open bins; of equals the first."""
    upto = [tuple(lengths[: i + 1]) for i in reversed(range(len(lengths)))]
    alone = [(c,) for c in lengths]
    return min((best_fit(sizes, lengths, opened) for opened in [*upto, *alone[1:]]), key=cost)


def best_fit(sizes: list[int], lengths: tuple[int, ...], opened: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(bin, offset, bin's length) for each size, with bins opened at the lengths of opened, or at the shortest one that holds the piece."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    waiting = sorted(sizes)
    rooms: list[tuple[int, int]] = []
    fill: list[int] = []
    put: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in order:
        size = sizes[i]
        waiting.pop()  # the largest that waits
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            b, room = len(fill), opening(size, waiting, opened, lengths) if size <= opened[-1] else lengths[bisect_left(lengths, size)]
            fill.append(0)
        put[i] = (b, fill[b])
        fill[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    return [(b, offset, lengths[bisect_left(lengths, fill[b])]) for b, offset in put]


def _packed(lengths: tuple[int, ...], passed: tuple[str, ...]):
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("item", "ascending"), ("piece", "ascending")]))
        got = np.array(pack(t.column("length").to_pylist(), lengths), dtype=np.int64).reshape(-1, 3)
        block = t.column("block").to_numpy()
        kept = {c: t.column(c) for c in ("piece", "start", "length")}
        return pa.table({passed[0]: t.column(passed[0]), **kept, "bin_id": block * (1 << 24) + got[:, 0], "bin_offset": got[:, 1], "capacity": got[:, 2], **{c: t.column(c) for c in passed[1:]}})

    return run


PLAN = "piece long, start long, length long, bin_id long, bin_offset long, capacity long"


def _planned(sized: DataFrame, lengths: tuple[int, ...], key: str, text: Column | None = None) -> DataFrame:
    """(key, piece, start, length, bin_id, bin_offset, capacity) of rows (key, size), with each piece's text where asked for."""
    most = lengths[-1]
    items = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / most)))).withColumn("start", F.col("piece") * most)
    items = items.withColumn("length", F.least(F.lit(most).cast("long"), F.col("size") - F.col("start")))
    more = [text.alias("text")] if text is not None else []
    items = written(items.select(key, "piece", "start", "length", *more).withColumn("item", F.monotonically_increasing_id()), "pack-items")
    blocks = max(1, math.ceil(items.count() / BLOCK))
    return items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))).groupBy("block").applyInArrow(
        _packed(tuple(lengths), (key, "text") if more else (key,)), f"{key} long, {PLAN}" + (", text string" if more else "")
    )


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, texts: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, capacity) for each piece of docs (doc_id long, text string).

    A document's length is its words and one end mark; start counts from the document's first word. With
    texts, a piece's text comes along: the whole where a document is one piece, else its words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (word_count(F.col("text")) + 1).alias("size"), *([F.col("text").alias("whole")] if texts else []))
    words = F.slice(F.regexp_extract_all("whole", F.lit(WORD), F.lit(0)), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    piece = F.when(F.col("size") <= lengths[-1], F.col("whole")).otherwise(F.array_join(words, " ")) if texts else None
    return _planned(rows, lengths, "doc_id", piece)


def bins(rows: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(bin_id, capacity, n_tokens, tokens, parts) of rows (row_id long, unique; doc_id long; tokens array): what stands in each bin, and where each document's part of it does.

    tokens are a bin's, one document after the other; parts are structs (offset, doc_id, piece, start, length).
    Rows without tokens are in no bin. A bin's tokens are at most the largest length.
    """
    sized = rows.where(F.size("tokens") > 0).select("row_id", F.size("tokens").cast("long").alias("size"))
    plan = _planned(sized, lengths, "row_id")
    part = F.struct(F.col("bin_offset").alias("offset"), "doc_id", "piece", "start", "length", F.slice("tokens", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("tokens"))
    each = plan.join(rows.select("row_id", "doc_id", "tokens"), "row_id").groupBy("bin_id", "capacity").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))
    return each.select("bin_id", "capacity", "n_tokens", F.flatten(F.transform("parts", lambda p: p["tokens"])).alias("tokens"), F.transform("parts", lambda p: p.dropFields("tokens")).alias("parts"))


def filling(plan: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row (bins, tokens, capacity, fill, cost, least): how full a plan's bins are, and its cost beside a bound that none can be under."""
    of = plan.groupBy("bin_id").agg(F.max("capacity").alias("capacity"), F.sum("length").alias("tokens"))
    total = of.agg(F.count("*").alias("bins"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity"))
    share = F.when(F.col("capacity") > 0, F.col("tokens") / F.col("capacity")).otherwise(1.0)
    return total.select("bins", "tokens", "capacity", share.alias("fill"), (F.col("capacity") + OVERHEAD * F.col("bins")).alias("cost"), (F.col("tokens") + OVERHEAD * F.ceil(F.col("tokens") / lengths[-1])).alias("least"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
