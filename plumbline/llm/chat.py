"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of a role merged into one,
and all concatenated. Control strings are ``<|turn|> <|text|> <|also|> <|end|>``; in roles and texts
``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, which is undone by reading back. ``<|also|>``
stands between the texts of a merged turn, so no turn is lost. The loss mask lists the code points
[start, stop) of each assistant text in the formatted string.

Defined cases: a null text or role is empty; rows are in order of turn, then role, then text, null
turns first; repeated rows are turns of their own; a null conv_id is one conversation; an empty table
gives none; other columns are ignored. A conversation is one row of the result, so it has to fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TURN, TEXT, ALSO, END = "<|turn|>", "<|text|>", "<|also|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) from rows (conv_id, turn, role, text)."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    role = lambda i: F.get("turns", i)["role"]
    firsts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    stops = F.concat(F.slice("firsts", F.lit(2), F.size("firsts")), F.array(F.size("turns")))
    merged = F.zip_with(
        "firsts", "stops",
        lambda a, z: F.struct(role(a).alias("role"), F.transform(F.slice("turns", a + 1, z - a), lambda t: t["text"]).alias("texts")),
    )
    # Each text with the control strings before and after it.
    cells = F.flatten(F.transform("merged", lambda m: F.transform(m["texts"], lambda t, i: F.struct(
        F.when(i == 0, F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT))).otherwise(F.lit(ALSO)).alias("head"),
        escape(t).alias("body"),
        F.when(i == F.size(m["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("tail"),
        (m["role"] == "assistant").alias("kept"),
    ))))
    length = lambda x: F.char_length(x).cast("long")
    walk = F.aggregate(
        "cells",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda acc, c: F.struct(
            (acc["at"] + length(c["head"]) + length(c["body"]) + length(c["tail"])).alias("at"),
            F.when(c["kept"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + length(c["head"])).alias("start"), (acc["at"] + length(c["head"]) + length(c["body"])).alias("stop"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    steps = turns.withColumn("firsts", firsts).withColumn("stops", stops).withColumn("merged", merged).withColumn("cells", cells)
    joined = F.array_join(F.transform("cells", lambda c: F.concat(c["head"], c["body"], c["tail"])), "")
    return steps.select("conv_id", joined.alias("formatted"), walk.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) as the formatted string and its mask have them."""
    parts = F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.size(F.split("formatted", r"<\|turn\|>")))
    of = lambda p: F.split(p, r"<\|text\|>")
    turns = F.flatten(F.transform(parts, lambda p: F.transform(
        F.split(F.regexp_replace(F.get(of(p), F.lit(1)), r"<\|end\|>$", ""), r"<\|also\|>"),
        lambda t: F.struct(unescape(F.get(of(p), F.lit(0))).alias("role"), unescape(t).alias("text")),
    )))
    lost = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    return chats.select("conv_id", turns.alias("turns"), lost.alias("loss_text"), "formatted")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_back(formatted(rows.union(extra)))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce("text", '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS was FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t)),
e AS (SELECT *, was IS NULL OR was <> role AS first, length(replace(replace(t, '&', '&amp;'), '<|', '&lt;|')) AS n, length(replace(replace(role, '&', '&amp;'), '<|', '&lt;|')) AS m FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(t) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN t END, '' ORDER BY k), '')) AS loss_sha256,
  sum(n + CASE WHEN first THEN 8 + m + 8 + 7 ELSE 8 END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""
