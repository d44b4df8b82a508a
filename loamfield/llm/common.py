"""What the operators share: words, document keys, staged tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamfield.staging import fresh_dir, shared_dir, staged

__all__ = ["SPACE", "SPACES", "WORD", "documents", "fresh_dir", "read", "shared_dir", "slices", "split_by_partner", "staged", "text_key", "unsliced", "words"]

#: Code points that part words, in Java, RE2 and Python regular expressions alike.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: The same six characters, for translate().
SPACES = " \t\n\x0b\x0c\r"


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone, so that further columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_key() -> F.Column:
    """Tells apart rows that repeat a doc_id with another text."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def words(text) -> F.Column:
    """Words of a text (null: none), without Python."""
    return F.coalesce(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), F.array().cast("array<string>"))


#: Texts of an Arrow batch are worked on in slices of so many bytes (or one text).
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE):
    """Parts of a batch with about ``most`` bytes of text (or one row)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def unsliced(array: pa.Array) -> pa.Array:
    """A copy that starts at its buffers' start: some string functions of Arrow misread arrays that don't."""
    return array.take(pa.array(np.arange(len(array))))


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of the map that tells which rows may have a partner: 16 for each partner, up to 16 MB, which bounds what is broadcast.
MAP_BITS = (1 << 20, 1 << 27)


def split_by_partner(df: DataFrame, key: F.Column, partners: DataFrame, partner_key: F.Column, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose key may be among the partners' keys, and rows whose key surely isn't.

    The keys are hashed to a bitmap of bounded size, so only the first part has to be shuffled for a join. A full map
    merely leaves more rows in the first part; the join that follows is exact. ``n``: how many partners there are at most
    (absent: they are counted, so they should be a written table).
    """
    bits = min(MAP_BITS[1], max(MAP_BITS[0], 1 << (16 * (partners.count() if n is None else n)).bit_length()))
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)) + 1
    maps = partners.select(at(partner_key).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits_"))
    cols = [F.col(f"`{c}`") for c in df.columns]
    met = df.withColumn("h_", at(key)).withColumn("bucket_", F.bitmap_bucket_number("h_")).join(F.broadcast(maps), "bucket_", "left")
    byte = F.conv(F.hex(F.expr("substring(bits_, cast(bitmap_bit_position(h_) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce((F.call_function("shiftright", byte, F.expr("cast(bitmap_bit_position(h_) % 8 as int)")) % 2 == 1), F.lit(False))
    met = met.withColumn("may_", may)
    return met.filter("may_").select(*cols), met.filter("not may_").select(*cols)
