"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size (an offset and a step from its name's MD5).
The shards take turns; at each turn a shard claims the first slot of its permutation that is still free. A row goes to
the shard in slot ``hash(key) mod size``. Adding or removing a shard moves few rows beyond that shard's own.

The table depends on nothing but the list of shards and the size, both parameters, so its size is bounded by
``size`` whatever the data holds. It travels inside the plan as one constant array, so each row is placed in constant
time by whole-stage generated code, with no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters of the registered query.
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
SIZE = 4099


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preferences(shard: str, size: int) -> tuple[int, int]:
    """(offset, step) of the shard's permutation: slot j of it is ``(offset + j * step) mod size``."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % size, int(digest[8:16], 16) % (size - 1) + 1


def fill(shards: tuple[str, ...], size: int) -> list[int]:
    """The lookup table: the index of the shard that holds each slot. Repeated or no shards and sizes that aren't prime
    or are below the number of shards raise ValueError."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the size must be a prime not below the number of shards")
    walks = [preferences(s, size) for s in shards]
    nexts, table, left = [w[0] for w in walks], [-1] * size, size
    while True:
        for i, (_, step) in enumerate(walks):
            slot = nexts[i]
            while table[slot] >= 0:
                slot = (slot + step) % size
            table[slot], nexts[i] = i, (slot + step) % size
            left -= 1
            if not left:
                return table


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: the first 15 hexadecimal digits of its text's MD5, modulo the size. A null key counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(size)


def assign(df: DataFrame, key: Column, shards: tuple[str, ...] = SHARDS, size: int = SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the columns ``slot`` (long) and ``shard`` (string).

    Equal keys go to one shard, so give a key that is unique or salted where one value may hold a large part of the
    rows. Null keys all go where '' goes. An empty table gives an empty one. Columns of ``df`` with the names of the
    new ones are replaced; others stay.
    """
    table = ",".join(map(str, fill(shards, size)))
    place = F.expr(f"from_json('[{table}]', 'array<int>')")
    names = F.expr("split('" + "\\u0001".join(s.replace("\\", "\\\\").replace("'", "\\'") for s in shards) + "', '\\u0001')")
    where = slot_of(key, size)
    return df.withColumns({slot: where, shard: F.get(names, F.get(place, where))})
