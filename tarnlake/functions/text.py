"""Text functions over columns. Everything stays in the JVM; patterns are made portable first."""

from __future__ import annotations

import re._parser as sre
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: A word boundary of ASCII word characters, as most engines mean it; Java's own counts accented letters.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def portable(pattern: str) -> str:
    """\\b as ASCII boundary, $ as the very end. At a pattern's start a word character follows, so looking
    back is enough."""
    flag, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    lead = "(?<![A-Za-z0-9_])" if body.startswith(r"\b") else ""
    return flag + lead + body.removeprefix(r"\b").replace(r"\b", BOUNDARY).replace("|$)", r"|\z)")


def _needed(parsed) -> list[list[str]]:
    """Lists of lower-case texts: every match of the parsed pattern holds one text of each list."""
    all_: list[list[str]] = []
    run = ""
    for op, arg in [*parsed, (None, None)]:
        if op == sre.LITERAL:
            run += chr(arg).lower()
            continue
        if len(run) > 1:
            all_.append([run])
        run = ""
        if op == sre.SUBPATTERN:
            all_ += _needed(arg[-1])
        elif op == sre.BRANCH:
            each = [max(_needed(x), key=lambda o: min(map(len, o)), default=None) for x in arg[1]]
            all_ += [] if None in each else [sorted({t for x in each for t in x})]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            all_ += _needed(arg[2])
    return all_


@lru_cache(maxsize=None)
def needed(pattern: str) -> list[list[str]]:
    """The lists of the pattern, the one with fewest texts first."""
    return sorted(_needed(sre.parse(pattern)), key=len)


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, case folded. Plain searches for the words that it needs come first: they
    are far cheaper than the pattern, and most texts lack them."""
    low = F.lower(c)
    has = [reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in some)) for some in needed(pattern)]
    return reduce(lambda a, b: a & b, [*has, c.rlike("(?i)" + portable(pattern))])


def hits(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns match, case folded."""
    return reduce(lambda a, b: a + b, (matches(c, p).cast("int") for p in patterns))


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches(c, p) for p in patterns))


def all_groups(c: Column, pattern: str) -> Column:
    """Group 1 of every match, in order."""
    return F.regexp_extract_all(c, F.lit(portable(pattern)), F.lit(1))


def words(c: Column) -> Column:
    """Pieces between white space, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.ceil(F.size(words(c)) * F.lit(fixed.TOKENS_PER_WORD)).cast("int")


def truncate_tokens(c: Column, tokens: Column | int) -> Column:
    """The first words that fit, with dots after them where some don't."""
    tokens = F.lit(tokens) if isinstance(tokens, int) else tokens
    pieces, most = F.split(c, r"\s+"), F.floor(tokens / F.lit(fixed.TOKENS_PER_WORD)).cast("int")
    return F.when(F.size(pieces) <= most, c).otherwise(F.concat(F.array_join(F.slice(pieces, F.lit(1), F.greatest(most, F.lit(0))), " "), F.lit("...")))


def tokens(c: Column, least: int, stop: list[str]) -> Column:
    """Lower-cased runs of ASCII word characters of at least that length, without the stop words; repeats stay."""
    out = F.filter(F.split(F.lower(c), r"\W+"), lambda w: F.length(w) >= least)
    return F.filter(out, lambda w: ~w.isin(stop)) if stop else out


def keywords(c: Column) -> Column:
    return F.array_distinct(tokens(c, 4, fixed.KEYWORD_STOPWORDS))


def lexemes(c: Column) -> Column:
    """Distinct lexemes for full text: runs of two or more word characters without stop words, not stemmed."""
    return F.array_distinct(tokens(c, 2, fixed.ENTITY_STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; null where both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.try_divide(common.cast("double"), (F.size(a) + F.size(b) - common).cast("double"))


def word_set(c: Column) -> Column:
    return F.array_distinct(words(F.lower(c)))


def relation_name(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9_]", "_")


def excerpt(c: Column, most: int = 60) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def answer_tokens(c: Column) -> Column:
    """Lower-cased, without punctuation and articles, cut at white space."""
    bare = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return words(F.regexp_replace(bare, portable(r"\b(a|an|the)\b"), " "))


def memory_type(c: Column) -> Column:
    """struct(memory_type, confidence) by counts of matching patterns."""
    s, e, p = hits(c, fixed.SEMANTIC), hits(c, fixed.EPISODIC), hits(c, fixed.PROCEDURAL)
    best = F.greatest(s, e, p)
    second = s + e + p - best - F.least(s, e, p)
    kind = F.when(best == second, F.lit("semantic")).when(s == best, F.lit("semantic")).when(e == best, F.lit("episodic")).otherwise(F.lit("procedural"))
    sure = F.when(best == 0, F.lit(0.5)).when(best == second, F.lit(0.4)).otherwise(F.least(F.lit(0.95), F.lit(0.6) + (best - second) * F.lit(0.1)))
    return F.struct(kind.alias("memory_type"), sure.alias("confidence"))


def route(c: Column) -> Column:
    return F.when(any_match(c, fixed.AGGREGATION), F.lit("AGGREGATION")).otherwise(F.lit("DIRECT"))


def is_temporal_query(c: Column) -> Column:
    return any_match(c, fixed.TEMPORAL_QUERY)


def is_recency_query(c: Column) -> Column:
    return matches(c, fixed.RECENCY_QUERY)


def has_date(c: Column) -> Column:
    return any_match(c, fixed.DATES)


def dated(c: Column) -> Column:
    """The first "D Month YYYY" as a date; a day past the month's end runs on into the next; else null."""
    part = [F.regexp_extract(c, "(?i)" + portable(fixed.DAY_MONTH_YEAR), i) for i in (1, 2, 3)]
    month = F.array_position(F.array(*map(F.lit, fixed.MONTHS)), F.lower(part[1])).cast("int")
    return F.when(part[0] != "", F.date_add(F.make_date(part[2].try_cast("int"), month, F.lit(1)), part[0].try_cast("int") - 1))


def query_entities(c: Column) -> Column:
    """Capitalised words that aren't stop words, each once whatever its case, first spelling kept."""
    names = F.filter(all_groups(c, fixed.QUERY_ENTITY), lambda w: ~w.isin(fixed.QUERY_STOPWORDS))
    return first_by_case(names)


def first_by_case(names: Column) -> Column:
    return let(names, lambda ns: let(F.transform(ns, F.lower), lambda low: F.filter(ns, lambda w, i: F.array_position(low, F.get(low, i)) == i + 1)))
