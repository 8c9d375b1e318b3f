"""Column statistics of a table or frame, and a small Bloom filter for driver-side membership tests."""

from __future__ import annotations

import hashlib
import math
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writer import stat_columns

if TYPE_CHECKING:
    from ..table import Table


def column_stats(table: Table) -> DataFrame:
    """One row per column that has an order: field_id, name, value_count, null_count, nan_count, lower, upper (as text).

    One aggregation over the live rows; the result is unpivoted in the JVM.
    """
    fields = stat_columns(table.schema)
    aggs = []
    for f in fields:
        c = F.col(f"`{f.name}`")
        nan = F.count_if(F.isnan(c)) if f.type["type"] in ("float", "double") else F.lit(0).cast("long")
        aggs.append(
            F.struct(
                F.lit(f.id).alias("field_id"),
                F.lit(f.name).alias("name"),
                F.count(c).alias("value_count"),
                F.count_if(c.isNull()).alias("null_count"),
                nan.alias("nan_count"),
                F.min(c).cast("string").alias("lower"),
                F.max(c).cast("string").alias("upper"),
            ).alias(f"s{f.id}")
        )
    one = table.scan().agg(*aggs)
    return one.select(F.explode(F.array(*(F.col(f"s{f.id}") for f in fields))).alias("s")).select("s.*")


class BloomFilter:
    """A bit set with k hashes, sized for n values at false-positive rate p."""

    def __init__(self, n: int, p: float = 0.01):
        n = max(1, n)
        self.bits = max(8, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / n * math.log(2)))
        self.data = bytearray((self.bits + 7) // 8)

    def _places(self, value: bytes):
        h = hashlib.blake2b(value, digest_size=16).digest()
        a, b = int.from_bytes(h[:8], "big"), int.from_bytes(h[8:], "big") | 1
        return ((a + i * b) % self.bits for i in range(self.hashes))

    def add(self, value: bytes) -> None:
        for i in self._places(value):
            self.data[i >> 3] |= 1 << (i & 7)

    def __contains__(self, value: bytes) -> bool:
        return all(self.data[i >> 3] >> (i & 7) & 1 for i in self._places(value))
