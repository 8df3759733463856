"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table; shards take turns,
each claiming its first slot that is still free. A key hashes to a slot, so placing a row is one look
into a table whose size is a parameter: it is broadcast, whatever the number of rows. When a shard
goes, few slots outside its own change hands.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table; a prime well above the number of shards keeps shares within about 2 %.
SLOTS = 5003
SHARDS = 64


def preference(name: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's permutation of the slots, from its name."""
    h = hashlib.md5(name.encode()).hexdigest()
    return int(h[:8], 16) % slots, int(h[8:16], 16) % (slots - 1) + 1


def lookup_table(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the owning shard for each slot. slots must be prime and at least len(names)."""
    if slots < max(2, len(names)) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be given and distinct")
    owner = np.full(slots, -1, np.int32)
    prefs = [preference(x, slots) for x in names]
    turn, filled = [0] * len(names), 0
    while filled < slots:
        for s, (offset, step) in enumerate(prefs):
            while owner[slot := (offset + turn[s] * step) % slots] >= 0:
                turn[s] += 1
            owner[slot] = s
            turn[s] += 1
            filled += 1
            if filled == slots:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of its text's MD5, so that any engine can agree. Null: as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """df's rows, all of them, as (key, slot, shard). No shuffle: rows stay where they are.

    A null key goes where the empty text goes. Rows that repeat a key land in one shard. Columns beside
    the key are left out, so none can clash. The broadcast table has `slots` rows, a parameter.
    """
    spark, owner = df.sparkSession, lookup_table(names, slots)
    places = spark.createDataFrame([(i, names[s]) for i, s in enumerate(owner.tolist())], "slot int, shard string")
    return df.select(key).withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(places), "slot").select(key, "slot", "shard")
