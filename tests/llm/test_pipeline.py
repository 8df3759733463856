"""The pipeline's stages on awkward rows, and the whole of it against its operators one by one."""

import collections

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

import brute


def test_stages_on_edges(spark, edge, nothing, data):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, data)
        assert out.columns == edge.columns
        assert stage(spark, nothing, data).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, edge, data).count() >= edge.count()


def test_decisions(spark, data):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    base = " ".join(f"word{i}" for i in range(150))
    rows = [(1, base), (2, base), (3, base.replace("word75 ", "other ")), (4, "contact me at x@y.org please"), (5, "you idiot moron stupid trash scum worthless loser clown " * 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    copies = {r.doc_id for r in stages["exact_dedup"](spark, docs, data).collect()}
    assert copies == {2, 3, 4, 5}
    near = {r.doc_id for r in stages["near_dedup"](spark, docs.where("doc_id <> 1"), data).collect()}
    assert near == {2, 4, 5}
    hidden = {r.doc_id: r.text for r in stages["pii"](spark, docs, data).collect()}
    assert hidden[4] == "contact me at <EMAIL> please" and hidden[1] == base


def test_run(spark, data, documents):
    out = corpus_pipeline.run(spark, data).collect()
    kept = {r.doc_id for r in out}
    texts = {r.doc_id: r.text for r in documents.collect()}
    clean = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, documents, data).collect()}
    groups = collections.defaultdict(list)
    for i in clean:
        groups[texts[i].translate(brute._LOW)].append(i)
    distinct = {max(g): texts[max(g)] for g in groups.values()}
    comp = brute.near_components(distinct)
    assert kept == {i for i in distinct if comp[i] == i}
    toxic = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 0").collect()}
    assert np.mean([i in clean for i in toxic]) > 0.9
    sizes = collections.Counter()
    for r in out:
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048
    assert documents.where(F.col("doc_id").isin([*kept][:5])).count() == min(5, len(kept))
