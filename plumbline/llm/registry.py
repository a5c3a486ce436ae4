"""Queries and SQL of this subpackage."""

from __future__ import annotations

from functools import wraps

import corpus_pipeline
from plumbline.llm import chat, imatch, lattice, mixing, ngram_join, packing, ppm, token_files, toxicity, warc
from plumbline.llm.store import shared_dir


def ready(query):
    """The query, in a session whose workers can import this package and get bounded batches: no DataFrame is made before that."""

    @wraps(query)
    def run(spark, sf_dir):
        shared_dir(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_warc_roundtrip": warc.op1_warc_roundtrip,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_ppm_scores": ppm.op3_ppm_scores,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_token_files": token_files.op5_token_files,
    "op6_chat_format": chat.op6_chat_format,
    "op7_toxic_segments": toxicity.op7_toxic_segments,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_imatch": imatch.op9_imatch,
    "op10_lattice_dedup": lattice.op10_lattice_dedup,
}
QUERIES = {name: ready(query) for name, query in QUERIES.items()}
ORACLES = {
    "op1_warc_roundtrip": warc.OP1_SQL,
    "op2_ngram_jaccard": ngram_join.OP2_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op10_lattice_dedup": lattice.OP10_SQL,
}
