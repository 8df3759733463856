"""The queries of this engine with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "rank_memories"


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from . import graph_queries, metric_queries, retrieval_queries, text_queries, verb_queries, write_queries  # noqa: E402, F401  (each registers its queries)
from . import stream_queries, whole_queries  # noqa: E402, F401, I001  (after those whose SQL they share)

# a query that does the whole job takes the place of the one on a thinned table or a few questions
for _name in [n for n in QUERIES if n.endswith("_whole")]:
    _plain = _name.removesuffix("_whole")
    if _plain not in ("extract_entities", "infer_relations", "merge_entities_and_edges"):
        QUERIES[_plain] = QUERIES.pop(_name)
        ORACLES[_plain] = ORACLES.pop(_name)
