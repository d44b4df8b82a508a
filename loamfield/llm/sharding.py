"""Placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size (an offset and a skip, both from its
name). Shards take turns: each claims the first slot of its order that is still free, until the table is full.
A key goes to the shard at ``hash(key) mod size``. Tables of n and of n - 1 shards agree nearly everywhere, and
no shard has more than one slot over another.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters: 64 shards, about a hundred slots for each.
SHARDS = [f"shard-{i:02d}" for i in range(64)]
TABLE_SIZE = 6553
#: The lookup table is broadcast; it can't have more slots than this.
MAX_SLOTS = 1_000_003
HEX = 13


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HEX], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """The index of the shard that holds each slot.

    Shards repeat no name and are at most ``size``; ``size`` is a prime of at most :data:`MAX_SLOTS`.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if not _is_prime(size) or size > MAX_SLOTS:
        raise ValueError(f"size must be a prime of at most {MAX_SLOTS}")
    at = [_hash(f"{s}#offset") % size for s in shards]
    skip = [_hash(f"{s}#skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    held = [-1] * size
    left = size
    while True:
        for i in range(len(shards)):
            while held[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            held[at[i]] = i
            left -= 1
            if not left:
                return held


def place(df: DataFrame, key: str, shards: list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` long and ``shard`` string.

    The key is hashed as text; a null key is placed as the empty text. Equal keys share a shard, so repeated rows
    stay together. Columns named slot or shard that ``df`` has already are replaced. An empty table stays empty.
    The table that is broadcast has ``size`` rows, which :func:`lookup_table` bounds.
    """
    spark = df.sparkSession
    held = lookup_table(shards, size)
    table = spark.createDataFrame([(s, shards[i]) for s, i in enumerate(held)], "slot long, shard string")
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("long") % F.lit(size)
    rest = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*[F.col(f"`{c}`") for c in rest], slot.alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*[f"`{c}`" for c in rest], "slot", "shard")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id")


_H = f"('0x' || substr(md5({{}}), 1, {HEX}))::BIGINT"
OP1_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i)
), orders AS (
  SELECT list({_H.format("name || '#offset'")} % {TABLE_SIZE} ORDER BY i) AS off,
         list({_H.format("name || '#skip'")} % {TABLE_SIZE - 1} + 1 ORDER BY i) AS skip
  FROM shards
), turns(turn, slot, taken, nxt) AS (
  SELECT 0::BIGINT, NULL::BIGINT, list_transform(range({TABLE_SIZE}), lambda x: false), list_transform(range({len(SHARDS)}), lambda x: 0::BIGINT)
  UNION ALL
  SELECT turn + 1, s, list_concat(taken[1:s], [true], taken[s + 2:]), list_concat(nxt[1:i], [j + 1], nxt[i + 2:])
  FROM (
    SELECT turn, taken, nxt, i, j, (off[i + 1] + j * skip[i + 1]) % {TABLE_SIZE} AS s
    FROM (
      SELECT turn, taken, nxt, i, off, skip,
             list_filter(range(nxt[i + 1], least(nxt[i + 1] + w, {TABLE_SIZE})), lambda j: NOT taken[((off[i + 1] + j * skip[i + 1]) % {TABLE_SIZE}) + 1])[1] AS j
      FROM (SELECT *, turn % {len(SHARDS)} AS i, {TABLE_SIZE} AS w FROM turns, orders WHERE turn < {TABLE_SIZE})
    )
  )
)
SELECT d.doc_id, t.slot, s.name AS shard
FROM (SELECT doc_id, {_H.format("coalesce(doc_id::VARCHAR, '')")} % {TABLE_SIZE} AS slot FROM documents) d
JOIN turns t ON t.slot = d.slot JOIN shards s ON s.i = (t.turn - 1) % {len(SHARDS)}
"""
