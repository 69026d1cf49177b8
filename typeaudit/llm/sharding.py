"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in a preference order of its own, a step of constant length from an
offset of its own, and the shards take turns claiming the next free slot; a shard of weight w takes w turns of each
round. A shard that leaves or joins moves little more than its own share. The table's size is a parameter and the bound of what is
broadcast; a row finds its shard by one hash, one remainder and one lookup.

Keys are spread by a hash of the document's id, so neither a hot source nor a group of copies lands on one shard.

Cases: documents without id are placed by a hash of their other columns named in ``fallback``; repeated rows go together.
All columns stay in ``row``. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 65_537


def lookup_table(weights: dict[str, int], size: int = SIZE) -> np.ndarray:
    """Index of the shard (in sorted order) that owns each slot."""
    names = sorted(weights)
    if not names or min(weights.values()) < 1 or sum(weights.values()) > size:
        raise ValueError("shards need weights of at least 1, and fewer turns a round than slots")
    if any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at = [xxhash.xxh3_64_intdigest(name.encode(), seed=1) % size for name in names]
    step = [xxhash.xxh3_64_intdigest(name.encode(), seed=2) % (size - 1) + 1 for name in names]
    turns = [i for i, name in enumerate(names) for _ in range(weights[name])]
    owner = np.full(size, -1, np.int32)
    free = size
    while True:
        for shard in turns:
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            owner[at[shard]] = shard
            free -= 1
            if not free:
                return owner


def place(docs: DataFrame, weights: dict[str, int], fallback: list[str], size: int = SIZE) -> DataFrame:
    """``row, slot, shard`` of every row of ``docs``."""
    names, owner = sorted(weights), lookup_table(weights, size)
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, names[shard]) for i, shard in enumerate(owner.tolist())], "slot int, shard string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = F.when(F.col("row.doc_id").isNotNull(), F.xxhash64("row.doc_id")).otherwise(
        F.xxhash64(*(F.col(f"row.`{c}`") for c in fallback))
    )
    # Not more rows than slots.
    return rows.withColumn("slot", F.pmod(key, F.lit(size)).cast("int")).join(F.broadcast(table), "slot").select("row", "slot", "shard")
