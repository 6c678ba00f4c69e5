"""Sets of content keys: photo keys of adverts, hot tokens, and hashing of tokens in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a photo is its key of 16 hex digits in the address, in either case.
PHOTO_KEY = r"(?<![0-9a-fA-F])([0-9a-fA-F]{16})(?![0-9a-fA-F])"
#: Most tokens that count as hot (8 MB of numbers); more can't lie above the threshold that hot_tokens takes.
HOT_BOUND = 1_000_000


def photo_keys(photos: Column) -> Column:
    """Sorted distinct photo keys as 64-bit numbers; empty for NULL, an empty list, or addresses without a key."""
    key = lambda p: F.conv(F.regexp_extract(p, PHOTO_KEY, 1), 16, -10).cast("bigint")
    return F.coalesce(F.sort_array(F.array_distinct(F.filter(F.transform(photos, key), lambda k: k.isNotNull()))), F.array().cast("array<bigint>"))


def mix(tokens: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit mixing of numbers; each seed gives another global order."""
    x = tokens.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hot_tokens(sets: DataFrame, column: str, least: int = 64) -> np.ndarray:
    """Sorted tokens held by more than max(``least``, all tokens / HOT_BOUND) sets: never more than HOT_BOUND."""
    tokens = sets.select(F.explode(column).alias("t"))
    counts = tokens.groupBy("t").count()
    total = sets.agg(F.sum(F.size(column))).first()[0] or 0
    rows = counts.where(F.col("count") > max(least, total / HOT_BOUND)).select("t").collect()
    return np.sort(np.array([r["t"] for r in rows], dtype=np.int64))


def is_hot(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(tokens), dtype=bool)
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    return hot[at] == tokens


def positions(owner: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Rank of each token within its set (``owner`` ascending) when sorted by ``keys``, the first weighing most."""
    order = np.lexsort((*reversed(keys), owner))
    rank = np.empty(len(owner), dtype=np.int64)
    sizes = np.bincount(owner) if len(owner) else np.zeros(0, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    rank[order] = np.arange(len(owner)) - first[owner[order]]
    return rank


def flat_lists(column):
    """A list column of an Arrow batch as (values, owner of each value, sizes)."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), sizes
