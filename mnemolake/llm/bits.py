"""Sets of numbers as bits, built by Spark and held by tasks: a bounded number of bytes whatever the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits and bytes of a block that Spark's bitmap functions make.
BLOCK_BITS, BLOCK_BYTES = 32768, 4096


def width_for(members: int, each: int, fewest: int, most: int) -> int:
    """A power of two of at least each * members, within bounds that are powers of two."""
    return min(most, max(fewest, 1 << (each * members).bit_length()))


def collected_bits(numbers: DataFrame, width: int) -> np.ndarray:
    """The bits of the column `cell` (0 to width - 1): width / 8 bytes on the driver, blocks of them made by the tasks."""
    # Spark's buckets of bits begin at the number 1
    blocks = numbers.groupBy(F.expr("bitmap_bucket_number(cell + 1) - 1").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell + 1))").alias("bits"))
    out = np.zeros(-(-width // BLOCK_BITS) * BLOCK_BYTES, np.uint8)
    for r in blocks.collect():
        out[r["block"] * BLOCK_BYTES : (r["block"] + 1) * BLOCK_BYTES] = np.frombuffer(r["bits"], np.uint8)
    return out


def has(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether the bit of each cell is set."""
    cells = cells.astype(np.int64)
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)
