"""How many files, and which rows in which: one shuffle to right-sized,
sorted files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bucket


def target_files(size: float, ratio: float = 1.1, target_mb: int = 128, least: int = 1) -> int:
    return max(least, math.ceil(size * ratio / (target_mb * 2**20)))


def shuffle_tasks(size: float, cores: int, expansion: float = 3.0, target_mb: int = 128) -> int:
    return max(cores, math.ceil(expansion * size / (target_mb * 2**20)))


def layout(df: DataFrame, files_per_day: int, *, day: str = "dt", key: str = "impression_id", order: tuple[str, ...] = ("campaign_id", "event_ts")) -> DataFrame:
    """Rows of a day go to `files_per_day` tasks by a hash of their key, each
    sorted so that files have narrow ranges."""
    return df.withColumn("_b", bucket(F.col(key), files_per_day)).repartition(day, "_b").drop("_b").sortWithinPartitions(day, *order)
