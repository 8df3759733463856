"""Registered queries: the searches over every question whose id is divisible by 50.

Each is a query of the same name with another query set, in its plan and in its SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources import views
from . import sql
from .registry import ORACLES, QUERIES, query
from .retrieval_queries import _SHORT


def _whole(name: str, oracle: str) -> None:
    f = QUERIES[name]

    @query(f"{name}_whole", re.sub(r"\b(vec_id|a\.id) < (?:1|20|40|120)\b", r"\1 % 50 = 0", oracle))
    def run(spark: SparkSession, d: str) -> DataFrame:
        with views.whole():
            return f(spark, d)


for _name in (
    "knn_topk", "knn_batch_topk", "knn_threshold_pairs", "scoped_knn", "fact_knn_joined", "rank_memories", "rank_facts_temporal",
    "rerank_blend", "graph_expand_knn", "precision_recall_mrr", "fact_dedup_tiers", "remember_decisions",
):
    _whole(_name, ORACLES[_name])

#: These count all words of a question.
for _name in ("keyword_match_topk", "bm25_topk", "rrf_fusion", "rrf_noise_floor"):
    _whole(_name, ORACLES[_name].replace(sql.lexemes(_SHORT), sql.lexemes("query")))
