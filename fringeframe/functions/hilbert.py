"""Place of a cell along the Hilbert curve, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hilbert_index(y: Column, x: Column, bits: int) -> Column:
    """Index of (y, x) on the curve through a grid of 2^bits by 2^bits cells.

    Quadrant by quadrant from the largest: its digit is added, then the coordinates are turned into its frame.
    """
    at, row, col = F.lit(0).cast("long"), y.cast("long"), x.cast("long")
    for k in reversed(range(bits)):
        side = 1 << k
        right, up = F.floor(col / side) % 2, F.floor(row / side) % 2
        at = at + side * side * F.when(right == 1, F.when(up == 1, 2).otherwise(3)).otherwise(up)
        low_col, low_row = col % side, row % side
        turned_col = F.when(up == 0, F.when(right == 1, side - 1 - low_row).otherwise(low_row)).otherwise(low_col)
        turned_row = F.when(up == 0, F.when(right == 1, side - 1 - low_col).otherwise(low_col)).otherwise(low_row)
        col, row = turned_col, turned_row
    return at
