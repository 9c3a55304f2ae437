"""Image kernels over binary or array columns, in numpy: coloured boxes, heat maps, and boxes of heat maps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROI = "array<struct<x1:double,y1:double,x2:double,y2:double,area_fraction:double,confidence:double>>"


@dataclass(frozen=True)
class GreenBoxConfig:
    low: tuple[int, int, int] = (35, 80, 80)
    high: tuple[int, int, int] = (85, 255, 255)
    min_area_fraction: float = 1e-4
    close: int = 3


def hsv(rgb: np.ndarray) -> np.ndarray:
    """Hue (0 to 179), saturation and value (0 to 255) of an 8-bit RGB image."""
    x = rgb.astype(np.float64)
    hi, lo = x.max(axis=2), x.min(axis=2)
    d = np.where(hi == lo, 1, hi - lo)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    h = np.where(hi == r, (g - b) / d, np.where(hi == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 30 % 180
    return np.stack([np.where(hi == lo, 0, np.round(h) % 180), np.where(hi == 0, 0, np.round(255 * (hi - lo) / np.maximum(hi, 1))), hi], axis=2)


def _spread(m: np.ndarray, k: int, grow: bool) -> np.ndarray:
    p = np.pad(m, k // 2, constant_values=not grow)
    views = [p[i : i + m.shape[0], j : j + m.shape[1]] for i in range(k) for j in range(k)]
    return np.any(views, axis=0) if grow else np.all(views, axis=0)


def green_mask(rgb: np.ndarray, config: GreenBoxConfig | None = None) -> np.ndarray:
    k = config or GreenBoxConfig()
    x = hsv(rgb)
    m = np.all((x >= np.array(k.low)) & (x <= np.array(k.high)), axis=2)
    return _spread(_spread(m, k.close, True), k.close, False)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of the 4-connected components, 0 outside: labels spread along rows and columns until nothing changes."""
    lab = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        old = lab
        p = np.pad(lab, 1)
        lab = np.where(mask, np.max([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]], axis=0), 0)
        if (lab == old).all():
            return lab


def _boxes(lab: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    out = []
    for v in np.unique(lab[lab > 0]).tolist():
        ys, xs = np.nonzero(lab == v)
        out.append((v, int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1))
    return out


def green_boxes(rgb: np.ndarray, config: GreenBoxConfig | None = None) -> list[dict]:
    """Boxes around coloured outlines, the largest first."""
    k, (h, w) = config or GreenBoxConfig(), rgb.shape[:2]
    out = [{"x1": x1, "y1": y1, "x2": x2, "y2": y2, "area_fraction": (x2 - x1) * (y2 - y1) / (h * w), "confidence": 1.0} for _, x1, y1, x2, y2 in _boxes(components(green_mask(rgb, k)))]
    return sorted((o for o in out if o["area_fraction"] >= k.min_area_fraction), key=lambda o: -o["area_fraction"])


def heatmap(boxes, width: int, height: int, scale: float = 0.1, least: float = 1.0, anneal: float = 1.0, out_size: tuple[int, int] | None = None, elliptical: bool = True) -> np.ndarray:
    """One Gaussian a box, in a window of three standard deviations (rounded up) around the cell of its centre; where they meet the
    larger counts. out_size (height, width) scales boxes to another grid; not elliptical: one deviation from the mean side.
    A window outside the grid leaves nothing."""
    rows, cols = out_size or (height, width)
    fx, fy = cols / width, rows / height
    out = np.zeros((rows, cols))
    for x1, y1, x2, y2 in boxes:
        cx, cy, w, h = (x1 + x2) / 2 * fx, (y1 + y2) / 2 * fy, (x2 - x1) * fx, (y2 - y1) * fy
        if not elliptical:
            w = h = (w + h) / 2
        sx, sy = max(least, scale * w * anneal), max(least, scale * h * anneal)
        rx, ry = int(np.ceil(3 * sx)), int(np.ceil(3 * sy))
        a, b = max(0, round(cx) - rx), min(cols, round(cx) + rx + 1)
        c, d = max(0, round(cy) - ry), min(rows, round(cy) + ry + 1)
        if a < b and c < d:
            g = np.exp(-((np.arange(c, d)[:, None] - cy) ** 2) / (2 * sy**2)) * np.exp(-((np.arange(a, b)[None] - cx) ** 2) / (2 * sx**2))
            out[c:d, a:b] = np.maximum(out[c:d, a:b], g)
    return out


def heatmap_boxes(m: np.ndarray, threshold: float = 0.3, min_area_fraction: float = 0.0, size: tuple[int, int] | None = None) -> list[dict]:
    """Boxes of the components above a threshold with their peak, scaled to (width, height); the most confident first."""
    h, w = m.shape
    sx, sy = (size[0] / w, size[1] / h) if size else (1.0, 1.0)
    lab = components(m >= threshold)
    out = [{"x1": x1 * sx, "y1": y1 * sy, "x2": x2 * sx, "y2": y2 * sy, "area_fraction": (x2 - x1) * (y2 - y1) / (h * w), "confidence": float(m[lab == v].max())} for v, x1, y1, x2, y2 in _boxes(lab)]
    return sorted((o for o in out if o["area_fraction"] >= min_area_fraction), key=lambda o: -o["confidence"])


@dataclass(frozen=True)
class InpaintConfig:
    dilate: int = 5
    decoys: int = 1
    line: int = 2
    tries: int = 20
    margin: int = 2


def inpaint_mask(rgb: np.ndarray, boxes: list[dict], rng: np.random.Generator, config: InpaintConfig | None = None, green: GreenBoxConfig | None = None) -> np.ndarray:
    """Where an image is to be filled: its coloured outlines and, for each box, outlines of the same size at random places that
    meet no box; all spread by the kernel. Boxes as large as the image have no decoy."""
    k, (h, w) = config or InpaintConfig(), rgb.shape[:2]
    mask = green_mask(rgb, green)
    for b in boxes:
        bw, bh = int(b["x2"] - b["x1"]), int(b["y2"] - b["y1"])
        if not (0 < bw < w and 0 < bh < h):
            continue
        for _ in range(k.decoys):
            for x, y in zip(rng.integers(0, w - bw, k.tries), rng.integers(0, h - bh, k.tries), strict=True):
                if all(x + bw + k.margin < o["x1"] or x - k.margin > o["x2"] or y + bh + k.margin < o["y1"] or y - k.margin > o["y2"] for o in boxes):
                    frame = np.zeros_like(mask)
                    frame[y : y + bh + 1, x : x + bw + 1] = True
                    frame[y + k.line : y + bh + 1 - k.line, x + k.line : x + bw + 1 - k.line] = False
                    mask |= frame
                    break
    return _spread(mask, k.dilate, True) if k.dilate > 1 else mask


def filled(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The image with masked pixels filled from the rim inwards by the mean of their known neighbours."""
    out, known = rgb.astype(np.float64), ~mask
    while not known.all() and known.any():
        p, q = np.pad(out * known[..., None], ((1, 1), (1, 1), (0, 0))), np.pad(known, 1).astype(np.float64)
        total = sum(p[i : i + out.shape[0], j : j + out.shape[1]] for i in range(3) for j in range(3))
        n = sum(q[i : i + out.shape[0], j : j + out.shape[1]] for i in range(3) for j in range(3))
        rim = ~known & (n > 0)
        out[rim] = total[rim] / n[rim][:, None]
        known |= rim
    return np.round(out).astype(np.uint8)


def inpainted(rgb: np.ndarray, rng: np.random.Generator, boxes: list[dict] | None = None, config: InpaintConfig | None = None) -> np.ndarray:
    """The image without its outlines; as it is where it has none."""
    found = green_boxes(rgb) if boxes is None else boxes
    return filled(rgb, inpaint_mask(rgb, found, rng, config)) if found else rgb.copy()


def crop(rgb: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    h, w = rgb.shape[:2]
    return rgb[max(0, int(y1)) : min(h, int(y2)), max(0, int(x1)) : min(w, int(x2))]


def with_green_boxes(images: DataFrame) -> DataFrame:
    """image_id, rois. images: image_id, pixels (binary, 8-bit RGB), height, width; null pixels have no region."""

    def part(batches):
        for b in batches:
            rois = [[] if p is None else green_boxes(np.frombuffer(p, np.uint8).reshape(h, w, 3)) for p, h, w in zip(b["pixels"], b["height"], b["width"], strict=True)]
            yield pd.DataFrame({"image_id": b["image_id"], "rois": rois})

    return images.select("image_id", "pixels", "height", "width").mapInPandas(part, f"image_id {images.schema['image_id'].dataType.simpleString()}, rois {ROI}")


def with_heatmap_boxes(maps: DataFrame, threshold: float = 0.3) -> DataFrame:
    """image_id, rois, abstained. maps: image_id, heatmap (array of rows)."""

    def part(batches):
        for b in batches:
            rois = [heatmap_boxes(np.array([list(r) for r in m], dtype=np.float64), threshold) if m is not None and len(m) else [] for m in b["heatmap"]]
            yield pd.DataFrame({"image_id": b["image_id"], "rois": rois, "abstained": [not r for r in rois]})

    return maps.select("image_id", "heatmap").mapInPandas(part, f"image_id {maps.schema['image_id'].dataType.simpleString()}, rois {ROI}, abstained boolean")


def heatmap_rows(boxes: DataFrame, width: int, height: int, scale: float = 0.1, least: float = 1.0, anneal: float = 1.0, out_size: tuple[int, int] | None = None, elliptical: bool = True) -> DataFrame:
    """image_id, y, x, value: heatmap() as rows, in the JVM. boxes: image_id, x1..y2; a box with a null side leaves nothing."""
    rows, cols = out_size or (height, width)
    fx, fy = cols / width, rows / height
    w, h = (F.col("x2") - F.col("x1")) * fx, (F.col("y2") - F.col("y1")) * fy
    if not elliptical:
        w = h = (w + h) / 2
    deviation = lambda side: F.greatest(F.lit(float(least)), scale * side * anneal)
    b = boxes.filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select(
        "image_id", ((F.col("x1") + F.col("x2")) / 2 * fx).alias("cx"), ((F.col("y1") + F.col("y2")) / 2 * fy).alias("cy"), deviation(w).alias("sx"), deviation(h).alias("sy")
    )

    def window(centre: str, sigma: str, cells: int):
        at, reach = F.bround(centre).cast("long"), F.ceil(3 * F.col(sigma))
        lo, hi = F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(cells - 1))
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    b = b.withColumn("y", F.explode(window("cy", "sy", rows))).withColumn("x", F.explode(window("cx", "sx", cols)))
    g = F.exp(-F.pow(F.col("y") - F.col("cy"), 2) / (2 * F.pow("sy", F.lit(2)))) * F.exp(-F.pow(F.col("x") - F.col("cx"), 2) / (2 * F.pow("sx", F.lit(2))))
    return b.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), g.alias("g")).groupBy("image_id", "y", "x").agg(F.max("g").alias("value"))


def losses(pixels: DataFrame, alpha: float = 2.0, beta: float = 4.0, eps: float = 1e-6) -> DataFrame:
    """One row: penalty-reduced focal loss and dice loss of rows (pred, target in 0 to 1)."""
    p, t = F.least(F.greatest(F.col("pred"), F.lit(eps)), F.lit(1 - eps)), F.col("target")
    focal = F.when(t >= 1, -F.pow(1 - p, F.lit(alpha)) * F.log(p)).otherwise(-F.pow(1 - t, F.lit(beta)) * F.pow(p, F.lit(alpha)) * F.log(1 - p))
    s = pixels.agg(F.sum(focal).alias("f"), F.count(F.when(t >= 1, 1)).alias("n"), F.sum(p * t).alias("i"), F.sum(p).alias("p"), F.sum(t).alias("t"))
    return s.select((F.col("f") / F.greatest("n", F.lit(1))).alias("focal"), (1 - (2 * F.col("i") + eps) / (F.col("p") + F.col("t") + eps)).alias("dice"))
