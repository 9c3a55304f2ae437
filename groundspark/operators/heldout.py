"""Bands, held-out sets and the guard that they are never touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import BANDS, band


def band_distribution(rows: DataFrame, fraction: Column) -> DataFrame:
    """band, n for all three bands; null fractions are in none."""
    counts = rows.groupBy(band(fraction).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(b,) for b in BANDS], "band string")
    return every.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def by_band(rows: DataFrame, fraction: Column, item: Column) -> DataFrame:
    """band, items: the bands with their items in order."""
    return rows.select(band(fraction).alias("band"), item.alias("item")).filter("band is not null").groupBy("band").agg(F.array_sort(F.collect_list("item")).alias("items"))


def heldout(samples: DataFrame) -> DataFrame:
    return samples.filter("in_eval_set")


def sample_band(stored: Column, fractions: Column) -> Column:
    """The stored band, else that of the largest region; without regions small."""
    return F.coalesce(stored, band(F.coalesce(F.array_max(fractions), F.lit(0.0))))


def touched(eval_ids: DataFrame, used_ids: DataFrame, key: str = "id") -> DataFrame:
    return eval_ids.select(key).distinct().join(used_ids.select(key), key, "left_semi")


class LeakError(ValueError):
    """Held-out rows were used."""


def assert_never_touched(eval_ids: DataFrame, used_ids: DataFrame, key: str = "id") -> None:
    hit = [str(r[0]) for r in touched(eval_ids, used_ids, key).orderBy(key).limit(20).collect()]
    if hit:
        raise LeakError("held-out ids were used: " + ", ".join(hit))
