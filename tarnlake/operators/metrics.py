"""Quality of retrieval and of answers, latency and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text


def found(expected: Column, results: Column) -> Column:
    """The expected text stands in one of the results, whatever its case."""
    return F.exists(results, lambda r: F.contains(F.lower(r), F.lower(expected)))


def retrieval(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """query_id, precision_at_k, recall_at_k, reciprocal_rank, in_top3. ranked: query_id, rank, relevant;
    totals: query_id, n_relevant. A short list counts as misses; without relevant rows recall is 0."""
    near = F.count_if((F.col("rank") <= k) & F.col("relevant"))
    g = ranked.groupBy("query_id").agg(near.alias("_hits"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("_first"))
    out = totals.join(g, "query_id", "left")
    hits = F.coalesce("_hits", F.lit(0))
    return out.select(
        "query_id", F.round(hits / F.lit(float(k)) if k else F.lit(0.0), 6).alias("precision_at_k"),
        F.round(F.coalesce(F.try_divide(hits.cast("double"), F.col("n_relevant").cast("double")), F.lit(0.0)), 6).alias("recall_at_k"),
        F.round(F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.coalesce(F.col("_first") <= 3, F.lit(False)).alias("in_top3"),
    )


def noise_rejection(results: Column, terms: Column) -> Column:
    """1 less the share of noise terms that stand in the results together; 1 without terms."""
    whole = F.lower(F.array_join(results, " "))
    hit = F.size(F.filter(terms, lambda t: F.contains(whole, F.lower(t))))
    return F.coalesce(F.lit(1.0) - F.try_divide(hit.cast("double"), F.size(terms).cast("double")), F.lit(1.0))


def relevant_tokens(c: Column) -> Column:
    return F.floor(F.size(text.words(c)) * F.lit(fixed.TOKENS_PER_WORD)).cast("int")


def token_efficiency(relevant: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(relevant.cast("double"), total.cast("double")), F.lit(0.0))


def token_f1(pairs: DataFrame) -> DataFrame:
    """id, f1 of the tokens of prediction and truth as multisets. Without a common token it is 0."""
    tokens = pairs.select("id", text.answer_tokens(F.col("prediction")).alias("p"), text.answer_tokens(F.col("truth")).alias("t"))
    sizes = tokens.select("id", F.size("p").alias("np"), F.size("t").alias("nt"))
    p = tokens.select("id", F.explode("p").alias("w")).groupBy("id", "w").agg(F.count("*").alias("a"))
    t = tokens.select("id", F.explode("t").alias("w")).groupBy("id", "w").agg(F.count("*").alias("b"))
    common = p.join(t, ["id", "w"]).groupBy("id").agg(F.sum(F.least("a", "b")).alias("common"))
    f1 = F.try_divide(F.lit(2.0) * F.col("common"), (F.col("np") + F.col("nt")).cast("double"))
    return sizes.join(common, "id", "left").select("id", F.round(F.coalesce(f1, F.lit(0.0)), 6).alias("f1"))


def answer_check(answer: Column, expected: Column, absent: Column) -> Column:
    """struct(accuracy, missing, violations, correct)."""
    low = F.lower(answer)
    missing = F.filter(expected, lambda t: ~F.contains(low, F.lower(t)))
    wrong = F.filter(absent, lambda t: F.contains(low, F.lower(t)))
    share = F.coalesce(F.try_divide((F.size(expected) - F.size(missing)).cast("double"), F.size(expected).cast("double")), F.lit(1.0))
    return F.struct(F.round(share, 6).alias("accuracy"), missing.alias("missing"), wrong.alias("violations"), ((F.size(missing) == 0) & (F.size(wrong) == 0)).alias("correct"))


def latency(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, p50 (interpolated), p95 (nearest rank from below), largest; exact, nulls don't count.

    Approximate quantiles fence in a narrow range around each rank that is wanted. What lies below a range
    is only counted; the distinct values within it are counted and added up in order. No step sorts a whole
    group, and a value that very many rows share is one entry.
    """
    df = df.where(F.col(value).isNotNull()).select(F.col(by).alias("_k"), F.col(value).cast("double").alias("_v"))
    near = 0.002
    fences = F.percentile_approx("_v", [0.5 - near, 0.5 + near, 0.95 - near, 0.95 + near], 10_000)
    groups = df.groupBy("_k").agg(F.count("*").alias("n"), F.max("_v").alias("largest"), fences.alias("_f"))
    wanted = F.array(
        *(F.struct(F.lit(i).alias("which"), F.get("_f", F.lit(2 * (i // 2))).alias("lo"), F.get("_f", F.lit(2 * (i // 2) + 1)).alias("hi"), r.cast("long").alias("rank"))
          for i, r in enumerate((F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1, F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1) + 1)))
    )
    marks = groups.select("_k", F.explode(wanted).alias("_w")).select("_k", "_w.*")
    # rows below a range count once, for its smallest value
    within = df.join(marks, "_k").where(F.col("_v") <= F.col("hi")).withColumn("_v", F.greatest("_v", "lo"))
    steps = within.groupBy("_k", "which", "rank", "_v").agg(F.count("*").alias("_c"))
    total = F.sum("_c").over(Window.partitionBy("_k", "which").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = steps.withColumn("_t", total).where(F.col("_t") >= F.col("rank")).groupBy("_k").pivot("which", [0, 1, 2]).agg(F.min("_v"))
    out = groups.join(found, "_k")
    return out.select(F.col("_k").alias(by), "n", F.round((F.col("0") + F.col("1")) / 2, 6).alias("p50"), F.round(F.col("2"), 6).alias("p95"), F.round("largest", 6).alias("largest"))


def cost_per_thousand(calls: Column, operations: Column, price: float = fixed.COST_PER_CALL) -> Column:
    return F.coalesce(F.try_divide(calls * F.lit(price), operations.cast("double")) * 1000, F.lit(0.0))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, least, largest and their distance over runs; nulls don't count."""
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("largest"), F.round(F.max(value) - F.min(value), 6).alias("spread"))
