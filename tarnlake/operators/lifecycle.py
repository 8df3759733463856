"""Decay, archiving and consolidation of memories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scope import alive, not_expired

_DAY = 86_400_000_000.0


def last_touch() -> Column:
    return F.coalesce("last_accessed", "created_at")


def decay(df: DataFrame, now: Column, rate: float = fixed.DECAY, floor: float = fixed.DECAY_FLOOR) -> DataFrame:
    """Lower the importance of rows not touched for a day, by the rate for each day since; adds decayed."""
    stale = (last_touch() < now - F.expr("INTERVAL 1 DAY")) & (F.col("importance") > floor) & not_expired(now)
    days = F.timestamp_diff("MICROSECOND", last_touch(), now) / F.lit(_DAY)
    lower = F.greatest(F.lit(floor), F.round(F.col("importance") * F.pow(F.lit(rate), days), 9))
    return df.withColumns({"decayed": F.coalesce(stale, F.lit(False)), "importance": F.when(stale, lower).otherwise(F.col("importance"))})


def archive(df: DataFrame, now: Column, floor: float = fixed.DECAY_FLOOR, days: int = fixed.ARCHIVE_DAYS) -> DataFrame:
    """Rows at the floor that would last longer expire so many days on; adds archived."""
    at = now + F.expr(f"INTERVAL {days} DAYS")
    due = (F.col("importance") <= floor) & (F.col("expires_at").isNull() | (F.col("expires_at") > at))
    return df.withColumns({"archived": due, "expires_at": F.when(due, at).otherwise(F.col("expires_at"))})


def run_decay(df: DataFrame, now: Column) -> DataFrame:
    return archive(decay(df, now), now)


def recent(df: DataFrame, now: Column, hours: int, most: int = 100, by: str | None = None, kind: str | None = None) -> DataFrame:
    """The newest rows of the last hours that haven't expired; with `by`, so many for each value of it."""
    df = df.where((F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOURS")) & not_expired(now))
    if kind is not None:
        df = df.where(F.col("memory_type") == kind)
    order = (F.desc("created_at"), "id")
    if by is None:
        return df.orderBy(*order).limit(most)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def low_importance(df: DataFrame, now: Column, most: float = 0.2, limit: int = 50) -> DataFrame:
    """The least important rows, those touched longest ago (or never) first."""
    return df.where((F.col("importance") <= most) & alive(now)).orderBy(F.asc("importance"), F.asc_nulls_first("last_accessed"), "id").limit(limit)


def themes(df: DataFrame, theme: str = "theme") -> DataFrame:
    """Themes that two or more rows share: theme, n, kinds, first three texts. df: id, ord, memory_type, content, theme."""
    g = df.groupBy(F.col(theme).alias("theme")).agg(F.count("*").alias("n"), F.collect_set("memory_type").alias("kinds"), F.min_by("content", "ord").alias("first"), F.max("ord").alias("last"))
    return g.where("n >= 2")


def greedy_groups(df: DataFrame) -> DataFrame:
    """user_id, theme, position, ids: in order of first sight a theme takes the rows that none has taken yet,
    if they are two at least. df: user_id, id, ord, themes (array). One user's rows of a lookback are
    bounded by its limit, so a task holds them whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[str, list[int]] = {}
        for i, ts in zip(pdf.sort_values("ord")["id"], pdf.sort_values("ord")["themes"], strict=True):
            for t in ts:
                by.setdefault(t, []).append(i)
        taken: set[int] = set()
        out = []
        for t, ids in by.items():
            own = [i for i in ids if i not in taken] if len(ids) > 1 else []
            if len(own) > 1:
                out.append((pdf["user_id"].iloc[0], t, len(out), own))
                taken.update(own)
        return pd.DataFrame(out, columns=["user_id", "theme", "position", "ids"])

    return df.groupBy("user_id").applyInPandas(run, "user_id long, theme string, position int, ids array<long>")


def insight(theme: Column, n: Column, kinds: Column, contents: Column) -> Column:
    """What a group says: by whether it has events, facts, or procedures alone. contents: texts in order."""
    def joined(by: str) -> Column:
        return F.array_join(F.slice(contents, 1, 3), by)

    name = F.concat(F.lit('"'), theme, F.lit('"'))
    return (
        F.when(n < 2, F.lit(None).cast("string"))
        .when(F.array_contains(kinds, "episodic"), F.concat(F.lit("Based on "), n.cast("string"), F.lit(" recent interactions related to "), name, F.lit(": "), joined(". "), F.lit(". This appears to be a recurring pattern.")))
        .when(F.array_contains(kinds, "semantic"), F.concat(F.lit("Consolidated knowledge about "), name, F.lit(": "), joined(". "), F.lit(".")))
        .otherwise(F.concat(F.lit("Refined procedure related to "), name, F.lit(": "), joined(" → "), F.lit(".")))
    )
