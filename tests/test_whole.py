"""Jobs over whole tables and whole texts: what a cut would lose."""

import random

from pyspark.sql import functions as F

from tarnlake.operators import alike, arbitration
from tarnlake.plans.registry import QUERIES
from tarnlake.sources import io, views


def test_near_copies_past_any_rank(spark):
    def words(i):
        return [f"w{i}x{k}" for k in range(20)]

    texts = {i: " ".join(words(i)) for i in range(120)}
    texts[200] = texts[119]  # an equal text
    texts[201] = " ".join([*words(118)[:18], "other", "longer-word-than-before"])  # 18 of 22, another length
    texts[202] = " ".join([*words(117)[:16], "p", "q", "r", "s"])  # 16 of 24 is not enough
    texts |= {203: "", 204: " ", 205: None, 206: "one", 207: "ONE one"}
    # 301 falls to 300, so it can't take out 302, which is like 301 alone
    base = [f"v{k}" for k in range(40)]
    texts |= {300: " ".join(base), 301: " ".join([*base[:34], *"abcdef"]), 302: " ".join([*base[:28], *"abcdefghijkl"])}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    assert {r.id for r in arbitration.drop_similar_anywhere(df, "text").collect()} == set(texts) - {200, 201, 207, 301}


def test_a_large_group_makes_no_square(spark, monkeypatch):
    rng, base = random.Random(3), [f"w{k}" for k in range(60)]
    texts = {i: " ".join([*rng.sample(base, 60 - i % 12), *(f"x{i}y{k}" for k in range(i % 12))]) for i in range(500)}
    texts |= {1000 + i: " ".join(rng.sample(base, 1 + i % 7)) for i in range(60)}
    sets, stay = {i: set(t.split()) for i, t in texts.items()}, []
    for i in sorted(sets):
        if not any(len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) for j in stay):
            stay.append(i)
    rows, staged = [], io.staged
    monkeypatch.setattr(io, "staged", lambda df: rows.append((out := staged(df)).count()) or out)
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    assert sorted(r.id for r in arbitration.drop_similar_anywhere(df, "text").collect()) == stay
    assert max(rows) < 10 * len(texts)
    # in many blocks, without and with the driver's part
    monkeypatch.setattr(alike, "LEAST_SETS", 40)
    for settled in (0, alike.SETTLED):
        monkeypatch.setattr(alike, "SETTLED", settled)
        assert sorted(r.id for r in arbitration.drop_similar_anywhere(df, "text").collect()) == stay


def _documents(spark, tmp_path, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_entities_after_the_first_word(spark, tmp_path):
    d = _documents(spark, tmp_path, {1: "zebra " * 300 + "My name is Alice. She works at Acme Labs and uses Docker."})
    assert {"alice", "docker"} <= {r.name.lower() for r in QUERIES["extract_entities_whole"](spark, d).collect()}
    assert {("Alice", "Docker")} <= {(r.from_name, r.to_name) for r in QUERIES["infer_relations_whole"](spark, d).collect()}
    assert QUERIES["merge_entities_and_edges_whole"](spark, d).where(F.col("from_name") == "Alice").count() > 0


def test_reflect_reads_the_texts(spark, tmp_path):
    d = _documents(spark, tmp_path, {i: "zebra " * 300 + f"number {i} uses Kubernetes" for i in (20, 40, 60, 80)})
    out = QUERIES["reflect_batch"](spark, d).collect()
    assert any("kubernetes" in r.content.lower() for r in out) and not any("acme" in r.content.lower() for r in out)


def test_graph_of_all_lines(spark, tmp_path):
    d = str(tmp_path)
    # order 3007 would fold into 7; supplier 8 is on a second line alone
    lines = [(7, 1, 50, 1), (7, 2, 8, 2), (3007, 3, 9, 1), (100, 1, 9, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(50,), (8,), (9,)], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(7,), (3007,), (100,)], "o_orderkey long").write.parquet(f"{d}/orders.parquet")
    assert {(r.start, r.node, r.hops) for r in QUERIES["graph_neighbours_2hop"](spark, d).collect()} == {(101, 14, 1), (101, 17, 2)}
    assert {(r.memory_id, r.entity_id) for r in QUERIES["entities_of_memories"](spark, d).collect()} == {(100, 1)}
    assert {(r.memory_id, r.other) for r in QUERIES["graph_neighbours_1hop"](spark, d).collect()} == {(100, 7)}


def test_questions_of_all_ids(spark, data):
    due = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert len(due) > 1 and max(due) >= 120
    for name in ("knn_topk", "knn_batch_topk", "precision_recall_mrr", "fact_dedup_tiers"):
        assert {r.query_id for r in QUERIES[name](spark, data).collect()} == due
    # recalls answer each question from what the one who asks may see
    live = {r.id: r for r in views.memories(spark, data, vectors=False, text=False).where("(expires_at IS NULL OR expires_at > '2024-02-01') AND (invalid_at IS NULL OR invalid_at > '2024-02-01')").collect()}
    of = {r.memory_id for r in views.facts(spark, data).where("active_until IS NULL").collect()} & set(live)
    seeing = {q for q in due if any(live[i].user_id == q % 20 and (live[i].agent_id == q % 5 or live[i].shared) for i in of)}
    assert {r.query_id for r in QUERIES["recall_direct"](spark, data).collect()} == seeing != set()
    assert {r.query_id for r in QUERIES["recall_routed"](spark, data).collect()} == due


def test_words_past_a_prefix(spark, tmp_path):
    d = _documents(spark, tmp_path, {1: "alpha beta", 2: "alpha beta gamma", 3: "gamma"})
    spark.createDataFrame([(50, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(50, "alpha beta gamma")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [r.id for r in QUERIES["keyword_match_topk"](spark, d).collect()] == [2]
    assert {r.id for r in QUERIES["bm25_topk"](spark, d).collect()} == {1, 2, 3}
    late = "Some words of no weight come first in both turns, then: "
    turns = [(1, 0, late + "service runs kubernetes cluster"), (1, 1, late + "service no longer runs kubernetes cluster")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    assert [r.id for r in QUERIES["supersession_filter"](spark, d).collect()] == [101]
