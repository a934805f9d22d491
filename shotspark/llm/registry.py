"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from shotspark.llm import op01_language_id as op1
from shotspark.llm import op02_mixing as op2
from shotspark.llm import op03_jaccard_join as op3
from shotspark.llm import op04_records as op4
from shotspark.llm import op05_toxicity as op5
from shotspark.llm import op06_graph_ann as op6
from shotspark.llm import op07_pii as op7
from shotspark.llm import op08_exact_dedup as op8
from shotspark.llm import op09_byte_bpe as op9
from shotspark.llm import op10_url_filter as op10
from shotspark.llm import op11_merkle as op11
from shotspark.llm import op12_centroids as op12
from shotspark.llm import op13_quality as op13

QUERIES = {
    "op1_language_id": op1.op1_language_id,
    "op2_mixing": op2.op2_mixing,
    "op3_jaccard_join": op3.op3_jaccard_join,
    "op4_records": op4.op4_records,
    "op5_toxicity": op5.op5_toxicity,
    "op6_graph_ann": op6.op6_graph_ann,
    "op7_pii": op7.op7_pii,
    "op8_exact_dedup": op8.op8_exact_dedup,
    "op9_byte_bpe": op9.op9_byte_bpe,
    "op10_url_filter": op10.op10_url_filter,
    "op11_merkle": op11.op11_merkle,
    "op12_centroids": op12.op12_centroids,
    "op13_quality": op13.op13_quality,
}


def oracle() -> dict[str, str]:
    """SQL of the queries that it can state; the tests of the others compare
    with brute force, an exact round trip or held-out labels."""
    return {"op8_exact_dedup": op8.SQL, "op10_url_filter": op10.sql(), "op11_merkle": op11.SQL, "op12_centroids": op12.sql()}
