"""Bitmaps of hashed keys: a bounded filter ahead of a join.

A bitmap has at most ``MAX_BITS`` bits (16 MB) however many keys there are. It
lets every key pass that was put in and a few others, so the join that follows
decides; with very many keys it lets more pass and saves less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 15, 1 << 27
_PAGE = 1 << 15


class Bitmap:
    def __init__(self, pages: dict[int, bytes], bits: int):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8)
        for page, content in pages.items():
            self.data[page * _PAGE // 8:(page + 1) * _PAGE // 8] = np.frombuffer(content, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(keys: DataFrame, column: str) -> Bitmap:
    """The bitmap of a column of well-mixed longs (hashes)."""
    count = keys.count()
    bits = MIN_BITS
    while bits < min(MAX_BITS, 16 * count):
        bits *= 2
    # Spark numbers the places of a bitmap from one.
    place = keys.select((F.pmod(F.col(column), F.lit(bits).cast("long")) + 1).alias("p"))
    pages = place.groupBy(F.bitmap_bucket_number("p").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("content")
    )
    # At most MAX_BITS / 32,768 = 4,096 pages of 4 KB.
    return Bitmap({r["page"] - 1: bytes(r["content"]) for r in pages.collect()}, bits)
