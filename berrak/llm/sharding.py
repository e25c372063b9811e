"""Sharding by a permutation-filled lookup table.

Every shard has an order of preference over the slots of a prime-sized table, from two hashes of
its name: it starts at an offset and goes on by a skip. The shards take turns, and each claims
the next slot of its order that is still free, until the table is full. Shares differ by one
slot at most, and when a shard comes or goes few slots change hands. A document goes to the
shard of the slot that its key's hash falls on.

The table depends on the shards only, never on the data; it is broadcast whole (its size is a
parameter), and placing a row is one lookup without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berrak.llm.tables import quoted

SLOTS = 65_537
MOST_SLOTS = 1 << 20
SHARDS = {f"shard-{k:03d}": 1 for k in range(64)}


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill(shards: Mapping[str, int] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The shard of every slot. ``shards``: names and whole weights, the claims in a turn.

    The order in which shards are given does not matter.
    """
    if not _is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"the table's size must be a prime of at most {MOST_SLOTS}")
    names = sorted(n for n, w in shards.items() if w > 0)
    if not names or len(names) > slots:
        raise ValueError("there must be shards, and no more than slots")
    at = {n: _hash(n, "offset") % slots for n in names}
    skip = {n: _hash(n, "skip") % (slots - 1) + 1 for n in names}
    table: list[str | None] = [None] * slots
    free = slots
    while True:
        for n in names:
            for _ in range(shards[n]):
                while table[at[n]] is not None:
                    at[n] = (at[n] + skip[n]) % slots
                table[at[n]] = n
                free -= 1
                if not free:
                    return table  # type: ignore[return-value]


def lookup(spark: SparkSession, shards: Mapping[str, int] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table as rows of slot and shard."""
    names = sorted(shards)
    number = {n: k for k, n in enumerate(names)}
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(str(number[n]) for n in fill(shards, slots))), ",")).alias("slot", "k"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.array(*map(F.lit, names))[F.col("k").cast("int")].alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: a null key counts as the empty string."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("long")


def place(docs: DataFrame, key: str = "doc_id", shards: Mapping[str, int] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row with its ``slot`` and ``shard``; columns of these names are replaced, but for a key of such a name,
    which stays as ``slot_key`` or ``shard_key``.

    Rows of one key go to one shard; rows and their order within partitions stay as they are.
    """
    table = lookup(docs.sparkSession, shards, slots)
    rest = docs.drop("slot", "shard") if key not in ("slot", "shard") else docs.withColumnRenamed(key, f"{key}_key").drop("slot", "shard")
    key = key if key in rest.columns else f"{key}_key"
    return rest.withColumn("slot", slot_of(F.col(quoted(key)), slots)).join(F.broadcast(table), "slot").select(*map(quoted, rest.columns), "slot", "shard")
