"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: offset, offset + skip,
offset + 2 skip and so on, from hashes of the shard's name.  Shards take turns; at its turn a shard
claims the first slot of its order that is still free.  A row's slot is a hash of its id, and a
broadcast of the table gives its shard.  Shards hold equal shares of slots (but for one slot), and
few slots change hands when a shard comes or goes.

All of it is DataFrame expressions.  The table has a fixed number of slots and is built once; the
broadcast join costs a row one probe.

Defined cases: a null id is placed as the empty text; repeated ids go to one shard; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 2039
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def _number(text: Column, start: int) -> Column:
    """32 bits of the text's MD5, from hex digit ``start``."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 8), 16, 10).cast("long")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for every slot."""
    if not is_prime(slots) or not 0 < len(shards) < slots or len(set(shards)) != len(shards):
        raise ValueError("slots must be prime and more than the shards, whose names differ")
    names = F.array(*(F.lit(s) for s in shards))
    order = F.transform(names, lambda n: F.struct((_number(n, 1) % slots).alias("offset"), (_number(n, 9) % (slots - 1) + 1).alias("skip")))
    base = spark.range(1).select(names.alias("names"), F.transform(order, lambda o: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda j: ((o["offset"] + j * o["skip"]) % slots).cast("int"))).alias("preference"))
    # The owner of each slot, -1 while it is free; one turn after the other.
    filled = F.expr(f"""
        aggregate(sequence(0, {slots - 1}), array_repeat(-1, {slots}), (owner, turn) ->
            transform(array(filter(preference[turn % {len(shards)}], x -> owner[x] = -1)[0]),
                claimed -> transform(owner, (x, at) -> if(at = claimed, turn % {len(shards)}, x)))[0])""")
    placed = base.select("names", F.posexplode(filled).alias("slot", "k"))
    return placed.select(F.col("slot").cast("long").alias("slot"), F.expr("names[k]").alias("shard"))


def place(rows: DataFrame, table: DataFrame, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """(id, slot, shard) of every row."""
    own = rows.select(F.col(id_col), (_number(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 1) % slots).alias("slot"))
    return own.join(F.broadcast(table), "slot", "left").select(id_col, "slot", "shard")


def oracle(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> str:
    """The same in DuckDB SQL over ``documents``."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    number = lambda x, a: f"('0x' || substr(md5({x}), {a}, 8))::BIGINT"
    return f"""
    WITH RECURSIVE names(i, name) AS (VALUES {names}),
    preference AS (SELECT i, list(((o + j * s) % {slots})::INT ORDER BY j) AS slots FROM
        (SELECT i, {number("name", 1)} % {slots} AS o, {number("name", 9)} % {slots - 1} + 1 AS s FROM names), range({slots}) AS r(j) GROUP BY i),
    fill(turn, owner, claimed) AS (
        SELECT 0, list_transform(range({slots}), lambda x: -1), -1
        UNION ALL
        SELECT turn + 1, list_transform(owner, lambda x, k: CASE WHEN k - 1 = c THEN turn % {len(shards)} ELSE x END), c FROM
            (SELECT turn, owner, list_filter(p.slots, lambda x: owner[x + 1] = -1)[1] AS c FROM fill JOIN preference p ON p.i = turn % {len(shards)} WHERE turn < {slots})),
    placed AS (SELECT claimed AS slot, name AS shard FROM fill JOIN names ON names.i = (turn - 1) % {len(shards)} WHERE turn > 0)
    SELECT d.doc_id, k.slot, p.shard FROM documents d, LATERAL (SELECT {number("coalesce(d.doc_id::VARCHAR, '')", 1)} % {slots} AS slot) k
    LEFT JOIN placed p ON p.slot = k.slot"""
