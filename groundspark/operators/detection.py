"""Matching of boxes, free-response curves and average precision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import BANDS, band, box_iou
from ..session import block_starts, in_blocks, stage

FP_POINTS, IOU = (0.5, 1.0, 2.0, 4.0, 8.0), 0.3


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0.0


def match(preds: DataFrame, gts: DataFrame, iou: float = IOU) -> DataFrame:
    """image_id, ord, confidence, is_tp, gt_band: greedy by confidence within an image; a prediction takes the best free box.

    preds: image_id, ord, x1..y2, confidence; gts: image_id, ord, x1..y2, area_fraction. An image's boxes are few.
    """
    box = F.struct("x1", "y1", "x2", "y2")
    g = gts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", box.alias("b"), band(F.col("area_fraction")).alias("band")))).alias("g"))
    p = preds.groupBy("image_id").agg(F.collect_list(F.struct("ord", box.alias("b"), "confidence")).alias("p"))

    def each(batches):
        for b in batches:
            out = []
            for image, ps, gs in zip(b["image_id"], b["p"], b["g"], strict=True):
                gs = [] if gs is None else list(gs)
                free = [True] * len(gs)
                for x in sorted(ps, key=lambda x: (-x["confidence"], x["ord"])):
                    best, at = 0.0, -1
                    for i, y in enumerate(gs):
                        v = _iou(tuple(x["b"].values()), tuple(y["b"].values())) if free[i] else 0.0
                        if v >= iou and v > best:
                            best, at = v, i
                    if at >= 0:
                        free[at] = False
                    out.append((image, x["ord"], x["confidence"], at >= 0, gs[at]["band"] if at >= 0 else None))
            yield pd.DataFrame(out, columns=["image_id", "ord", "confidence", "is_tp", "gt_band"])

    kind = preds.schema["image_id"].dataType.simpleString()
    return p.join(g, "image_id", "left").mapInPandas(each, f"image_id {kind}, ord long, confidence double, is_tp boolean, gt_band string")


def match_single(preds: DataFrame, gts: DataFrame, iou: float = IOU) -> DataFrame:
    """match() for at most one box an image, without leaving the JVM: the first prediction by confidence that overlaps enough is right."""
    cols = ("x1", "y1", "x2", "y2")
    g = gts.select("image_id", *[F.col(c).alias(f"g_{c}") for c in cols], band(F.col("area_fraction")).alias("band"))
    j = preds.join(g, "image_id", "left").withColumn("iou", F.when(F.col("g_x1").isNull(), 0.0).otherwise(box_iou(tuple(F.col(c) for c in cols), tuple(F.col(f"g_{c}") for c in cols))))
    w = Window.partitionBy("image_id", F.col("iou") >= iou).orderBy(F.desc("confidence"), "ord")
    tp = (F.col("iou") >= iou) & (F.row_number().over(w) == 1)
    return j.withColumn("is_tp", tp).select("image_id", "ord", "confidence", "is_tp", F.when(F.col("is_tp"), F.col("band")).alias("gt_band"))


def _running(flags: DataFrame) -> DataFrame:
    """Flags in order of confidence with running counts, and the block of the order that each lies in. Sums over blocks of equal
    size come first, so no task sorts more than a block, however many confidences are equal."""
    order = [F.desc("confidence"), F.asc("image_id"), F.asc("ord")]
    rows = in_blocks(flags, order, "ordered")
    one = {"n": F.lit(1), "tp": F.col("is_tp").cast("long"), **{x: F.coalesce((F.col("gt_band") == x).cast("long"), F.lit(0)) for x in BANDS}}
    start = block_starts(rows.groupBy("_block").agg(*[F.sum(v).alias(k) for k, v in one.items()]), list(one))
    w = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(start, "_block")
    return run.select("image_id", "ord", "confidence", "is_tp", "_block", *[(F.col(f"s_{k}") + F.sum(v).over(w)).alias("k" if k == "n" else k) for k, v in one.items()])


def froc(flags: DataFrame, gts: DataFrame, n_images: int, run: DataFrame | None = None) -> DataFrame:
    """k, fp_per_image, sensitivity and that of each band, after the k most confident predictions; k = 0 is the origin. run: _running(flags), where it is there already."""
    counts = {r.b: r.n for r in gts.groupBy(band(F.col("area_fraction")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = lambda c, n: (F.col(c) / n if n else F.lit(0.0)).cast("double")
    r = _running(flags) if run is None else run
    rows = r.select("k", ((F.col("k") - F.col("tp")) / max(n_images, 1)).alias("fp_per_image"), share("tp", total).alias("sensitivity"), *[share(x, counts.get(x, 0)).alias(f"sens_{x}") for x in BANDS])
    origin = flags.sparkSession.range(1).select(F.lit(0).cast("long").alias("k"), *[F.lit(0.0).alias(c) for c in ("fp_per_image", "sensitivity", *(f"sens_{x}" for x in BANDS))])
    return origin.unionByName(rows)


def sensitivity_at(curve: DataFrame, points: tuple[float, ...] = FP_POINTS) -> DataFrame:
    """fp_point, sensitivity and that of each band: the best among the points of the curve with at most that many false positives an image."""
    at = F.explode(F.array(*[F.lit(float(p)) for p in points]))
    return curve.select(at.alias("fp_point"), "*").groupBy("fp_point").agg(*[F.coalesce(F.max(F.when(F.col("fp_per_image") <= F.col("fp_point") + 1e-9, F.col(c))), F.lit(0.0)).alias(c) for c in ("sensitivity", *(f"sens_{x}" for x in BANDS))])


def average_precision(flags: DataFrame, n_gt: int, run: DataFrame | None = None) -> DataFrame:
    """One row: ap, the area under the precision envelope. Without boxes or predictions 0."""
    r = (_running(flags) if run is None else run).select("k", "is_tp", "_block", (F.col("tp") / F.col("k")).alias("precision"))
    # The envelope is the highest precision from here on: within the block, or in a later one. The order is turned round, as a
    # frame that begins at the row and ends with the block would be gone through again for every row.
    tops = r.groupBy("_block").agg(F.max("precision").alias("m"))
    later = tops.select("_block", F.max("m").over(Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))  # a row a block
    own = F.max("precision").over(Window.partitionBy("_block").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    e = r.withColumn("own", own).join(later, "_block")
    return e.agg(F.coalesce(F.sum(F.when(F.col("is_tp"), F.greatest("own", "later"))) / (n_gt or 1), F.lit(0.0)).alias("ap"))


def detection_metrics(preds: DataFrame, gts: DataFrame, n_images: int, iou: float = IOU, points: tuple[float, ...] = FP_POINTS) -> DataFrame:
    """One row: metrics (sens@<point>fp and mAP), stratified (band to sens@<point>fp), n_images, total_gt; as a record takes them."""
    flags = stage(match(preds, gts, iou), "flags")
    n = gts.count()
    run = _running(flags)  # put in order once for both
    at = sensitivity_at(froc(flags, gts, n_images, run), points)
    name = F.concat(F.lit("sens@"), F.col("fp_point").cast("string"), F.lit("fp"))
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct(name, F.col(c))))
    rows = at.agg(entries("sensitivity").alias("m"), F.create_map(*[x for b in BANDS for x in (F.lit(b), entries(f"sens_{b}"))]).alias("stratified"))
    return rows.crossJoin(average_precision(flags, n, run)).select(F.map_concat("m", F.create_map(F.lit("mAP"), F.col("ap"))).alias("metrics"), "stratified", F.lit(n_images).cast("long").alias("n_images"), F.lit(n).cast("long").alias("total_gt"))  # rows of one
