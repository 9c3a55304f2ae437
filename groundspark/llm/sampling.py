"""Problem 6: samples that match target category proportions.

Categories are counted, quotas are allocated by largest remainder with floors and caps, and each category gives the regions
with its smallest random keys. The regions below a quota are found from counts of key ranges, so only the one range in which
the quota falls is ranked; a category that holds a third of all regions is never sorted as a whole.
"""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

RANGES_LOG2 = 12


def band_of(area_fraction: Column, area_band: Column) -> Column:
    """small, medium or large from the fraction if it lies in 0 to 1, else from the band, ignoring case and blanks; else null."""
    named = F.lower(F.regexp_replace(area_band, r"\s+", ""))
    return F.when(area_fraction.between(0, 1), F.when(area_fraction < 0.02, "small").when(area_fraction <= 0.05, "medium").otherwise("large")).otherwise(F.when(named.isin("small", "medium", "large"), named))


def regions(rois: DataFrame, ct: DataFrame) -> DataFrame:
    """sample_ord, roi_index, source, area_band: each region once (of repeated rows the first with a band), with the source of its sample."""
    r = rois.select("ord", "sample_ord", "roi_index", band_of(F.col("area_fraction"), F.col("area_band")).alias("band")).filter("band is not null and sample_ord is not null and roi_index is not null")
    once = r.groupBy("sample_ord", "roi_index").agg(F.min_by("band", "ord").alias("area_band"))
    return once.join(ct.select(F.col("ord").alias("sample_ord"), "source"), "sample_ord").filter("source is not null").select("sample_ord", "roi_index", "source", "area_band")


def available(targets: DataFrame, regs: DataFrame) -> DataFrame:
    """The rows of ``targets`` with the regions of their category (n_available) and of all sources of their plan (n_plan)."""
    counts = stage(regs.groupBy("source", "area_band").agg(F.count(F.lit(1)).alias("n")), "categories")
    t = targets.select("plan_id", "source", F.lower(F.trim("area_band")).alias("area_band"), "target_share", "min_rows", "sample_rate")
    plan = t.select("plan_id", "source").distinct().join(counts.groupBy("source").agg(F.sum("n").alias("n")), "source", "left").groupBy("plan_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_plan"))
    return t.join(counts.withColumnRenamed("n", "n_available"), ["source", "area_band"], "left").join(plan, "plan_id").withColumn("n_available", F.coalesce("n_available", F.lit(0)))


def sizes(avail: DataFrame) -> DataFrame:
    """Adds plan_size (sample_rate of n_plan, rounded down) and needed (share of the size, rounded up, or min_rows if more). Exact decimals."""
    dec = lambda c: F.coalesce(F.col(c).cast("decimal(18,9)"), F.lit(0).cast("decimal(18,9)"))
    size = F.floor(dec("sample_rate") * F.col("n_plan").cast("decimal(18,0)")).cast("long")
    out = avail.withColumn("plan_size", size)
    return out.withColumn("needed", F.greatest(F.ceil(dec("target_share") * F.col("plan_size").cast("decimal(18,0)")).cast("long"), F.coalesce(F.col("min_rows").cast("long"), F.lit(0).cast("long"))))


def allocate(shares: list[float], floors: list[int], caps: list[int], size: int) -> list[int]:
    """Integer quotas for ``size`` rows: at least the floors, at most the caps, the rest by largest remainder of the shares.

    Floors are kept even if they exceed the size. What a capped category cannot take is shared among the others in the same way.
    """
    exact = [Decimal(str(s or 0)) * size for s in shares]
    quota = [min(c, max(f or 0, int(e.to_integral_value(ROUND_FLOOR)))) for e, f, c in zip(exact, floors, caps, strict=True)]
    total = sum(Decimal(str(s or 0)) for s in shares)
    wanted = min(size, int((total * size).to_integral_value(ROUND_CEILING)))
    while (left := wanted - sum(quota)) > 0:
        open_ = [i for i, (q, c) in enumerate(zip(quota, caps, strict=True)) if q < c]
        if not open_:
            break
        # One row each to the categories furthest below their exact share; for a large rest, many at once by share.
        weight = sum(exact[i] for i in open_)
        bulk = {i: int((exact[i] / weight * left).to_integral_value(ROUND_FLOOR)) if weight else left // len(open_) for i in open_} if left > len(open_) else {}
        given = 0
        for i, b in bulk.items():
            g = min(b, caps[i] - quota[i])
            quota[i] += g
            given += g
        if not given:
            for i in sorted(open_, key=lambda i: (quota[i] - exact[i], i))[:left]:
                quota[i] += 1
    while (over := sum(quota) - max(wanted, sum(min(f or 0, c) for f, c in zip(floors, caps, strict=True)))) > 0:
        # Floors took more than their share: the others give back, those furthest above their exact share first.
        can = [i for i in range(len(quota)) if quota[i] > min(floors[i] or 0, caps[i])]
        for i in sorted(can, key=lambda i: (exact[i] - quota[i], i))[: min(over, len(can))]:
            quota[i] -= 1
    return quota


def allocated(targets: DataFrame, regs: DataFrame) -> DataFrame:
    """Adds quota and shortfall (rows that an allocation of the needs cannot give) to the targets. Plans are small: a row per category."""
    a = sizes(available(targets, regs)).select("plan_id", "source", "area_band", "target_share", "min_rows", "n_available", "plan_size", "needed")

    def each(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["source", "area_band"], na_position="last").reset_index(drop=True)
        number = lambda c: [0 if x is None or math.isnan(x) else x for x in p[c]]
        share, have, need, size = number("target_share"), [int(x) for x in p["n_available"]], [int(x) for x in p["needed"]], int(p["plan_size"].iloc[0])
        p["quota"] = allocate(share, [int(x) for x in number("min_rows")], have, size)
        # Quotas are rounded so that they sum to the size, needs are rounded up: with the needs as floors, what an allocation still
        # lacks is what does not exist.
        p["shortfall"] = [max(0, n - got) for n, got in zip(need, allocate(share, need, have, size), strict=True)]
        return p

    schema = "plan_id string, source string, area_band string, target_share double, min_rows int, n_available long, plan_size long, needed long, quota long, shortfall long"
    return a.groupBy("plan_id").applyInPandas(each, schema)


def unmet(targets: DataFrame, rois: DataFrame, ct: DataFrame) -> DataFrame:
    """plan_id, source, area_band: the targets that the allocation leaves short. Plans without regions need only their minimum rows."""
    return allocated(targets, regions(rois, ct)).filter("shortfall > 0").select("plan_id", "source", "area_band")


def sampled(targets: DataFrame, rois: DataFrame, ct: DataFrame, seed: int = 0) -> DataFrame:
    """plan_id, source, area_band, sample_ord, roi_index: the sample of each plan. The same seed gives the same sample, however data are split."""
    regs = regions(rois, ct)
    quota = stage(allocated(targets, regs).filter("quota > 0").select("plan_id", "source", "area_band", "quota"), "quotas")
    keyed = regs.join(quota, ["source", "area_band"]).withColumn("key", F.xxhash64(F.lit(seed), "plan_id", "sample_ord", "roi_index")).withColumn("range", F.shiftrightunsigned("key", 64 - RANGES_LOG2))
    cat = ["plan_id", "source", "area_band"]
    ranges = keyed.groupBy(*cat, "quota", "range").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy(*cat).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^12 rows
    cut = ranges.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0))).filter("below < quota").select(*cat, "range", "below", "n")
    near = keyed.join(cut, [*cat, "range"])
    inside = near.filter("below + n <= quota").select(*cat, "sample_ord", "roi_index")
    edge = near.filter("below + n > quota").withColumn("at", F.row_number().over(Window.partitionBy(*cat).orderBy(F.col("key"), "sample_ord", "roi_index"))).filter("at <= quota - below")
    return inside.unionByName(edge.select(*cat, "sample_ord", "roi_index"))
