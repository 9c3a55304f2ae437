"""Coresets: strata by region size, k-means within a stratum, square-root quotas, and an order by representativeness."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import BANDS, band, resolve_k
from ..session import stage


@dataclass(frozen=True)
class CoresetConfig:
    budget: float = 0.3
    clusters: str | int = "sqrt"
    denoise_z: float = 3.0
    small_band_boost: float = 1.5
    random_state: int = 42


def rows_of(budget: float, n: int) -> int:
    """A budget above 1 is a number of rows, else a share (1 is all)."""
    return min(n, int(budget) if budget > 1 else round(budget * n))


def allocate_strata(sizes: dict[str, int], budget: int, boost: float = 1.5) -> dict[str, int]:
    """By size, with small regions boosted; rounded down, capped, the rest to the strata of the largest fraction first."""
    weight = {b: s * (boost if b == "small" else 1.0) for b, s in sizes.items()}
    total = sum(weight.values())
    if not total:
        return dict.fromkeys(sizes, 0)
    exact = {b: budget * w / total for b, w in weight.items()}
    out = {b: min(sizes[b], math.floor(x)) for b, x in exact.items()}
    left = min(budget, sum(sizes.values())) - sum(out.values())
    for b in sorted(sizes, key=lambda b: -(exact[b] - math.floor(exact[b]))):
        give = min(left, sizes[b] - out[b])
        out[b] += give
        left -= give
    return out


def sqrt_quota(sizes: list[int], budget: int, passes: int = 4) -> list[int]:
    """Largest remainder on the square roots of cluster sizes, capped by them."""
    out = [0] * len(sizes)
    for _ in range(passes):
        left = budget - sum(out)
        room = [i for i, s in enumerate(sizes) if out[i] < s]
        if left <= 0 or not room:
            break
        total = sum(math.sqrt(sizes[i]) for i in room)
        exact = {i: left * math.sqrt(sizes[i]) / total for i in room}
        add = {i: min(sizes[i] - out[i], math.floor(x)) for i, x in exact.items()}
        rest = left - sum(math.floor(x) for x in exact.values())
        for i in sorted(room, key=lambda i: (-(exact[i] - math.floor(exact[i])), i))[: max(rest, 0)]:
            add[i] = min(sizes[i] - out[i], add[i] + 1)
        for i, a in add.items():
            out[i] += a
    return out


def three_tiers(x: np.ndarray, centre: np.ndarray, n: int) -> list[int]:
    """The nearest to the centre, the one of median distance, then always the farthest from those taken."""
    d = np.linalg.norm(x - centre, axis=1)
    order = [int(d.argmin())]
    if len(x) > 1 and n > 1:
        m = int(np.argsort(d, kind="stable")[len(x) // 2])
        if m not in order:
            order.append(m)
    far = np.min([np.linalg.norm(x - x[i], axis=1) for i in order], axis=0)
    far[order] = -1
    while len(order) < min(n, len(x)):
        i = int(far.argmax())
        order.append(i)
        far = np.minimum(far, np.linalg.norm(x - x[i], axis=1))
        far[order] = -1
    return order[:n]


def nearest(x: np.ndarray, c: np.ndarray, rows: int = 500) -> np.ndarray:
    """The nearest of the centres, a few rows at a time."""
    return np.concatenate([((x[i : i + rows, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), rows)])


def kmeans(x: np.ndarray, k: int, seed: int, starts: int = 10, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of the best of several starts."""
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts):
        c = [x[rng.integers(len(x))]]
        for _ in range(1, k):
            d = np.min([((x - y) ** 2).sum(axis=1) for y in c], axis=0)
            c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(c)
        for _ in range(rounds):
            at = nearest(x, c)
            new = np.array([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[at]) ** 2).sum()
        if best is None or cost < best[0]:
            best = (cost, at, c)
    return best[1], best[2]


#: Rows of a stratum (at least, and for each cluster) from which its first centres are found; rounds over the whole stratum; parts of 1 in its sums.
SAMPLE, EACH, ROUNDS, UNIT = 5000, 4, 50, 1 << 30


def centres_of(rows: DataFrame, k: dict[str, int], seed: int) -> dict[str, np.ndarray]:
    """Centres of k-means over each whole band: first of a sample (all of a small band), then of rounds of assignment and sums over all rows.

    Sums are of integers, so they do not depend on how data are split.
    """
    size = F.create_map(*[F.lit(x) for b in k for x in (b, max(SAMPLE, EACH * k[b]))])
    order = Window.partitionBy("band").orderBy(F.xxhash64("id"), "id")
    some = rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= size[F.col("band")]).select("id", "vector", "band")

    def first(g: pd.DataFrame) -> pd.DataFrame:
        b, x = g["band"].iloc[0], np.array(g.sort_values("id")["vector"].tolist(), dtype=np.float64)
        _, c = kmeans(x, min(k[b], len(x)), seed)
        return pd.DataFrame({"band": b, "cluster": range(len(c)), "centre": c.tolist()})

    found: dict[str, list] = {}
    for r in some.groupBy("band").applyInPandas(first, "band string, cluster int, centre array<double>").orderBy("band", "cluster").collect():
        found.setdefault(r.band, []).append(r.centre)
    c = {b: np.array(x) for b, x in found.items()}
    for _ in range(ROUNDS):
        new = {b: x.copy() for b, x in c.items()}
        for r in _sums(rows, c).collect():
            new[r.band][r.cluster] = np.array(r.total, dtype=np.float64) / UNIT / r.n
        if all(np.allclose(new[b], c[b]) for b in c):
            break
        c = new
    return c


def _sums(rows: DataFrame, c: dict[str, np.ndarray]) -> DataFrame:
    def part(batches):
        for g in batches:
            out = []
            for b, x in g.groupby("band"):
                v = np.array(x["vector"].tolist(), dtype=np.float64)
                at, whole = nearest(v, c[b]), np.round(v * UNIT).astype(np.int64)
                out += [(b, int(j), int((at == j).sum()), whole[at == j].sum(axis=0).tolist()) for j in np.unique(at)]
            yield pd.DataFrame(out, columns=["band", "cluster", "n", "total"])

    some = rows.select("band", "vector").mapInPandas(part, "band string, cluster int, n long, total array<long>")
    total = some.select("band", "cluster", F.posexplode("total")).groupBy("band", "cluster", "pos").agg(F.sum("col").alias("s")).groupBy("band", "cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("x"))
    return total.select("band", "cluster", F.transform("x", lambda e: e["s"]).alias("total")).join(some.groupBy("band", "cluster").agg(F.sum("n").alias("n")), ["band", "cluster"])


def select(rows: DataFrame, config: CoresetConfig | None = None) -> DataFrame:
    """id, band, cluster, rank: the coreset. rows: id, vector, area_fraction. A budget of all rows returns all, without clusters.

    A band is clustered as a whole; a task orders one cluster.
    """
    k = config or CoresetConfig()
    rows = rows.select("id", "vector", F.coalesce(band(F.col("area_fraction")), F.lit("small")).alias("band"))
    sizes = {b: 0 for b in BANDS} | {r.band: r.n for r in rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    budget = rows_of(k.budget, n)
    if budget >= n:
        return rows.select("id", "band", F.lit(0).alias("cluster"), F.lit(0).alias("rank"))
    quota = allocate_strata(sizes, budget, k.small_band_boost)
    used = [b for b in sizes if quota[b]]
    kind = rows.schema["id"].dataType.simpleString()
    rows = stage(rows.filter(F.col("band").isin(used)), "rows")
    centre = centres_of(rows, {b: resolve_k(sizes[b], k.clusters) for b in used}, k.random_state) if used else {}

    def assign(batches):
        for g in batches:
            label = np.zeros(len(g), dtype=np.int64)
            for b in g["band"].unique():
                own = (g["band"] == b).to_numpy()
                label[own] = nearest(np.array(g["vector"][own].tolist(), dtype=np.float64), centre[b])
            yield g.assign(cluster=label)

    def denoised(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > 2:
            g = g.sort_values("id")
            d = np.linalg.norm(np.array(g["vector"].tolist(), dtype=np.float64) - centre[g["band"].iloc[0]][g["cluster"].iloc[0]], axis=1)
            g = g[d <= d.mean() + k.denoise_z * d.std()]
        return g

    form = f"id {kind}, vector array<double>, band string, cluster int"
    kept = rows.select("id", F.col("vector").cast("array<double>").alias("vector"), "band").mapInPandas(assign, form)
    kept = stage(kept.groupBy("band", "cluster").applyInPandas(denoised, form), "kept")
    count = {(r.band, r.cluster): r.n for r in kept.groupBy("band", "cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {(b, c): q for b in used for c, q in enumerate(sqrt_quota([count.get((b, c), 0) for c in range(len(centre[b]))], quota[b]))}

    def each(g: pd.DataFrame) -> pd.DataFrame:
        b, c = g["band"].iloc[0], int(g["cluster"].iloc[0])
        g, q = g.sort_values("id").reset_index(drop=True), want[b, c]
        top = three_tiers(np.array(g["vector"].tolist(), dtype=np.float64), centre[b][c], q) if q else []
        return pd.DataFrame([(g["id"][j], b, c, r) for r, j in enumerate(top)], columns=["id", "band", "cluster", "rank"])

    return kept.groupBy("band", "cluster").applyInPandas(each, f"id {kind}, band string, cluster int, rank int")
