"""Image features of small grey grids (arrays of doubles, row by row) as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8


def minmax(grid: Column) -> Column:
    """Grid scaled to 0..1; all 0 if it is constant."""
    low, high = F.array_min(grid), F.array_max(grid)
    return F.transform(grid, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0)))


def mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)


def variance(xs: Column) -> Column:
    """Population variance, from the mean of squares."""
    m = mean(xs)
    return F.greatest(F.lit(0.0), F.aggregate(xs, F.lit(0.0), lambda s, x: s + x * x) / F.size(xs) - m * m)


def dhash(grid: Column, side: int = SIDE) -> Column:
    """Difference hash: a bit for each neighbour pair in a row, first pair highest."""
    places = [i for i in range(side * side) if i % side < side - 1]
    n = len(places)
    bit = lambda k, i: F.when(grid[i + 1] > grid[i], F.lit(1 << (n - 1 - k)).cast("long")).otherwise(F.lit(0).cast("long"))
    total = F.lit(0).cast("long")
    for k, i in enumerate(places):
        total = total + bit(k, i)
    return total


def hash_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hash_from_hex(text: Column) -> Column:
    """64-bit hash from hexadecimal text; base -10 gives the signed value."""
    return F.conv(text, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def hamming_arrays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``hamming`` of arrays of whole numbers."""
    return np.bitwise_count(np.bitwise_xor(a, b, dtype=np.int64).view(np.uint64))


def hex_distance(a: Column, b: Column) -> Column:
    """Hamming distance of hexadecimal hashes; each missing digit counts four bits."""
    return hamming(hash_from_hex(a), hash_from_hex(b)) + 4 * F.abs(F.length(a) - F.length(b))


def laplacian_variance(grid: Column, side: int = SIDE) -> Column:
    """Variance of the 4-neighbour Laplacian over the inner cells."""
    inner = [r * side + c for r in range(1, side - 1) for c in range(1, side - 1)]
    return variance(F.array(*[grid[i - 1] + grid[i + 1] + grid[i - side] + grid[i + side] - 4 * grid[i] for i in inner]))


def edge_density(grid: Column, least: float, side: int = SIDE) -> Column:
    """Share of cells whose right or lower neighbour differs by more than ``least``."""
    pairs = [(r * side + c, r * side + c + 1, (r + 1) * side + c) for r in range(side - 1) for c in range(side - 1)]
    hits = F.lit(0)
    for i, right, below in pairs:
        hits = hits + F.when((F.abs(grid[right] - grid[i]) > least) | (F.abs(grid[below] - grid[i]) > least), 1).otherwise(0)
    return hits / len(pairs)


def moving_share(a: Column, b: Column, least: float) -> Column:
    """Share of cells that changed by more than ``least``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(F.abs(x - y) > least, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_diff(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def histogram(grid: Column, bins: int = 32) -> Column:
    """Counts of 0..1 values in equal bins of 0..256 after scaling by 255."""
    cell = F.transform(grid, lambda x: F.floor(F.floor(x * 255) * bins / 256).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(cell, lambda x: x == b)).cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; 1 where either is constant."""
    ma, mb = mean(a), mean(b)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) / F.size(a) - ma * mb
    spread = F.sqrt(variance(a) * variance(b))
    return F.when(spread > 1e-12, cov / F.nullif(spread, F.lit(0.0))).otherwise(1.0)


def layout(grid: Column) -> Column:
    """0/1 cells darker than the grid's mean."""
    m = mean(grid)
    return F.transform(grid, lambda x: F.when(x < m, 1.0).otherwise(0.0))


def profiles(cells: Column, side: int = SIDE) -> tuple[Column, Column]:
    """Row means and column means."""
    rows = F.array(*[mean(F.array(*[cells[r * side + c] for c in range(side)])) for r in range(side)])
    cols = F.array(*[mean(F.array(*[cells[r * side + c] for r in range(side)])) for c in range(side)])
    return rows, cols
