"""Shard placement by a lookup table that shards fill in turns, each by its own permutation of the slots.

The table's size is a prime that the caller names, so every shard's (offset, skip) pair walks through all
slots. Filling takes time in proportion to that fixed size and nothing of the data; the finished table is a
constant of the plan, which Spark broadcasts to the executors with the stage. A row's placement is one hash
and one array access: no join, no shuffle, and no state that a lost executor could take away.

Null keys share the slot of the hash's seed; equal keys always share a shard. Keys are hashed as strings, so
2 and "2" agree. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.common import table

#: About 100 slots or more for each shard keep the shares within a percent of each other.
TABLE_SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, size: int) -> tuple[int, int]:
    """Where a shard's walk over the slots begins, and its step; the step is never 0, so the walk meets each slot once."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8]) % size, int.from_bytes(digest[8:16]) % (size - 1) + 1


def lookup_table(shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE) -> list[int]:
    """Shard number of each slot. A mapping gives how many slots a shard takes in each of its turns."""
    names = sorted(shards)
    if not names or not is_prime(size) or len(names) > size:
        raise ValueError("need one shard at least, and a prime number of slots, no less than shards")
    turns = [shards[x] for x in names] if isinstance(shards, Mapping) else [1] * len(names)
    if min(turns) < 1:
        raise ValueError("each shard must take one slot a turn at least")
    walks = [preference(x, size) for x in names]
    slots, at, free = [-1] * size, [start for start, _ in walks], size
    while free:
        for k, take in enumerate(turns):
            for _ in range(min(take, free)):
                while slots[at[k]] >= 0:
                    at[k] = (at[k] + walks[k][1]) % size
                slots[at[k]] = k
                free -= 1
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(size)).cast("int")


def shard_of(key: Column, shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE) -> Column:
    """Name of a key's shard; names may hold any character. The table stands in the plan as one text, folded to an array before the run."""
    names = sorted(shards)
    numbers = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    name = F.array(*map(F.lit, names))
    return F.element_at(name, F.element_at(numbers, slot_of(key, size) + 1) + 1)


def place(rows: DataFrame, key: str, shards: Sequence[str] | Mapping[str, int], size: int = TABLE_SIZE) -> DataFrame:
    """The rows with their ``slot`` and ``shard``; columns of these names are replaced."""
    found = rows[key]
    return rows.withColumns({"slot": slot_of(found, size), "shard": shard_of(found, shards, size)})


#: Shards of the registered query, and the one that leaves.
SHARDS, LEAVES = [f"shard-{i:03d}" for i in range(256)], "shard-017"


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, slot, shard, and the shard after one of the 256 shards has left."""
    docs = table(spark, folder, "documents").select("doc_id")
    rest = [x for x in SHARDS if x != LEAVES]
    return place(docs, "doc_id", SHARDS).withColumn("shard_after", shard_of(F.col("doc_id"), rest))
