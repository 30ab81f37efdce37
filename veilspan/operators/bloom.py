"""A keyed Bloom filter over names. Positions come from one HMAC by double hashing; the pepper is never stored.

The filter is a table of set bit positions. Membership of many names is a join that counts hits; no bit array is collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.crypto import hmac_sha256


@dataclass(frozen=True)
class Sizing:
    capacity: int
    error_rate: float
    num_bits: int
    num_hashes: int


def sizing(pepper: str | bytes, capacity: int, error_rate: float = 0.01) -> Sizing:
    if not pepper:
        raise ValueError("an empty pepper makes the filter reversible")
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    if not 0 < error_rate < 1:
        raise ValueError("error_rate must lie between 0 and 1")
    bits = max(8, math.ceil(-(capacity * math.log(error_rate)) / math.log(2) ** 2))
    return Sizing(capacity, error_rate, bits, max(1, round(bits / capacity * math.log(2))))


def normalized(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+\z", ""), r"(?U)\s+", " "))


def _modulo(hex32: Column, modulus: int) -> Column:
    """A 128-bit number, as 32 hex digits, modulo ``modulus``: digit by digit to the base 65,536."""
    rest = F.lit(0).cast("bigint")
    for i in range(8):
        limb = F.conv(F.substring(hex32, 4 * i + 1, 4), 16, 10).cast("bigint")
        rest = F.pmod(rest * 65536 + limb, F.lit(modulus))
    return rest


def positions(name: Column, pepper: str | bytes, size: Sizing) -> Column:
    """array<bigint> of a name's bits, repeats included."""
    if size.num_bits >= 1 << 46:
        raise ValueError("too many bits for 64-bit arithmetic")
    digest = hmac_sha256(pepper, normalized(name))
    both = F.array(F.struct(_modulo(F.substring(digest, 1, 32), size.num_bits).alias("a"), _modulo(F.substring(digest, 33, 32), size.num_bits).alias("b")))
    return F.flatten(F.transform(both, lambda h: F.transform(F.sequence(F.lit(0), F.lit(size.num_hashes - 1)), lambda i: F.pmod(h["a"] + i * h["b"], F.lit(size.num_bits)))))


def build(names: DataFrame, pepper: str | bytes, size: Sizing, name: str = "name") -> DataFrame:
    """The set bits, as (bucket, bitmap): packed by Spark's bitmap functions."""
    bits = names.where(F.col(name).isNotNull()).select(F.explode(positions(F.col(name), pepper, size)).alias("bit"))
    return bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def might_contain(tokens: DataFrame, filter_: DataFrame, pepper: str | bytes, size: Sizing, token: str = "token") -> DataFrame:
    """Distinct ``tokens`` with might_contain: false is certain, true is probable."""
    asked = tokens.select(F.col(token).alias("token")).where("token is not null").distinct()
    bits = asked.select("token", F.explode(F.array_distinct(positions(F.col("token"), pepper, size))).alias("bit"))
    bits = bits.select("token", F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("place"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.pmod("place", F.lit(8)).cast("int")) == 1, F.lit(False))
    return bits.join(filter_, "bucket", "left").groupBy("token").agg(F.every(is_set).alias("might_contain"))


def estimated_error_rate(size: Sizing, added: int) -> float:
    return 0.0 if not added else (1 - math.exp(-size.num_hashes * added / size.num_bits)) ** size.num_hashes


def save(filter_: DataFrame, size: Sizing, path: str) -> None:
    """Parameters and bits as Parquet."""
    filter_.withColumns({k: F.lit(v) for k, v in vars(size).items()}).write.parquet(path)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Sizing]:
    stored = spark.read.parquet(path)
    row = stored.select("capacity", "error_rate", "num_bits", "num_hashes").first()
    if row is None:
        raise ValueError("the stored filter has no bits")
    return stored.select("bucket", "bitmap"), Sizing(**row.asDict())
