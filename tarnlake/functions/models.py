"""Where models plug in, and stand-ins that need none.

A model runs over Arrow batches on the executors (apply_embedder); structured answers of language models
come as columns of text that operators.extraction.card reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text, vector


class Embedder(Protocol):
    """Turns texts into vectors of one dimension; made anew in each worker."""

    name: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    """Scores (query, passage) pairs; larger is closer."""

    def logits(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def hashed_embedding(c: Column, dimension: int = 64) -> Column:
    """A bag of hashed words of unit length, in the JVM: the dimension of a word comes from its MD5.

    A text without words has no vector (null).
    """
    slots = F.transform(text.tokens(c, 2, []), lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(dimension)).cast("int"))

    def counted(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(ids, lambda x: x == i)).cast("double"))

    def unit(v: Column) -> Column:
        return text.let(vector.norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)))

    return text.let(slots, lambda ids: text.let(counted(ids), unit))


def apply_embedder(rows: DataFrame, make: type[Embedder], column: str = "content", batch: int = 64) -> DataFrame:
    """rows with an embedding by a model made once for each task; texts go to it in small batches. Null texts have none."""
    schema = rows.drop("embedding").schema.add("embedding", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts = b.column(column).to_pylist()
            out: list[list[float] | None] = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                for i, v in zip(part, model.embed([texts[i] for i in part]), strict=True):
                    out[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return rows.drop("embedding").mapInArrow(run, schema)
