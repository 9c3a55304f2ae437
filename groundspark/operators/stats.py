"""Resampling statistics, paired tests, gates and ablation tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AppConfig
from ..schemas import EVAL_RECORD


def bootstrap_ci(values: np.ndarray, statistic: Callable = np.mean, n: int = 10000, level: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """point, low, high. Draws are made in blocks of bounded memory and equal those of one stream."""
    v = np.asarray(values, dtype=np.float64)
    if not len(v):
        raise ValueError("no values")
    rng = np.random.default_rng(seed)
    step = max(1, 4_000_000 // len(v))
    if statistic is np.mean:
        stats = np.concatenate([v[rng.integers(0, len(v), (min(step, n - i), len(v)))].mean(axis=1) for i in range(0, n, step)])
    else:
        stats = np.array([statistic(v[rng.integers(0, len(v), len(v))]) for _ in range(n)])
    low, high = np.quantile(stats, [(1 - level) / 2, 1 - (1 - level) / 2])
    return float(statistic(v)), float(low), float(high)


def permutation_p(a: np.ndarray, b: np.ndarray, n: int = 10000, seed: int = 0) -> float:
    """Two-sided p of a paired difference of means by sign flips."""
    d = _paired(a, b)
    rng = np.random.default_rng(seed)
    seen, step, hits = abs(d.mean()), max(1, 4_000_000 // len(d)), 0
    for i in range(0, n, step):
        m = (rng.choice([-1, 1], (min(step, n - i), len(d))) * d).mean(axis=1)
        hits += int((np.abs(m) >= seen - 1e-12).sum())
    return (hits + 1) / (n + 1)


def _paired(a, b) -> np.ndarray:
    a, b = np.asarray(a, dtype=np.float64), np.asarray(b, dtype=np.float64)
    if a.shape != b.shape or not len(a):
        raise ValueError("pairs of one length are needed")
    return a - b


def mcnemar(b01: int, b10: int, exact_below: int = 25, compat: bool = False) -> float:
    """p of discordant counts: exact binomial for few, else chi-squared with one degree of freedom and continuity correction.

    compat uses the survival function of two degrees of freedom, for parity with results made that way.
    """
    n = b01 + b10
    if n == 0:
        return 1.0
    if n < exact_below:
        k = min(b01, b10)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    x = (abs(b01 - b10) - 1) ** 2 / n
    return math.exp(-x / 2) if compat else math.erfc(math.sqrt(x / 2))


def mcnemar_counts(rows: DataFrame) -> DataFrame:
    """rows: a, b booleans. b01: only b is right; b10: only a."""
    return rows.agg(F.count(F.when(F.expr("not a and b"), 1)).alias("b01"), F.count(F.when(F.expr("a and not b"), 1)).alias("b10"))


def significant(low: float, high: float) -> bool:
    return low > 0 or high < 0


@dataclass(frozen=True)
class GateConfig:
    require_significant: bool = True
    max_p: float = 0.05
    min_delta: float = 0.0
    higher_is_better: bool = True


class QualityGateError(AssertionError):
    """A gate did not pass."""


def gate(df: DataFrame, config: GateConfig | None = None) -> DataFrame:
    """Adds passed and reasons (joined by a semicolon) to rows of delta, ci_low, ci_high, p."""
    k = config or GateConfig()
    better = F.col("delta") if k.higher_is_better else -F.col("delta")
    clear = (F.col("ci_low") > 0) if k.higher_is_better else (F.col("ci_high") < 0)
    reasons = F.concat_ws(
        "；",
        F.when(~clear & F.lit(k.require_significant), "not significant"),
        F.when(F.col("p") > k.max_p, "p too high"),
        F.when(better < k.min_delta, "delta too small"),
    )
    return df.withColumn("reasons", reasons).withColumn("passed", F.col("reasons") == "")


def assert_gate(df: DataFrame, config: GateConfig | None = None) -> None:
    bad = gate(df, config).filter("not passed").limit(5).collect()
    if bad:
        raise QualityGateError("; ".join(str(r.reasons) for r in bad))


def check_scores(pairs: DataFrame, config: GateConfig | None = None, n: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: the gate's verdict on paired scores. pairs: sample_id, baseline, variant."""
    rows = pairs.select(F.lit("variant").alias("variant"), "sample_id", F.lit("overall").alias("band"), F.col("variant").alias("score"), F.col("baseline").alias("base"))
    return gate(_compared(rows, n, level, seed), config).select("n", "delta", "ci_low", "ci_high", "p", "passed", "reasons")


def ablation(scores: DataFrame, baseline: str, n: int = 2000, level: float = 0.95, seed: int = 0, bands: bool = True) -> DataFrame:
    """variant, band (overall or a band), n, delta, ci_low, ci_high, p, significant: paired comparisons with the baseline.

    scores: variant, sample_id, band, score. Samples are joined by id. Resamples are sums over rows, so no task holds a comparison:
    in each a row counts as often as a Poisson draw of mean 1 says, and a hash of its id, the seed and the resample makes the
    draw, so results depend on neither the order nor the splits of the data. Signs for the permutation test come from the same hash.
    """
    base = scores.filter(F.col("variant") == baseline).select("sample_id", F.col("score").alias("base"))
    pairs = scores.filter(F.col("variant") != baseline).join(base, "sample_id").select("variant", "sample_id", "band", "score", "base")
    rows = pairs.withColumn("band", F.lit("overall"))
    if bands:
        rows = rows.unionByName(pairs.filter("band is not null"))
    return _compared(rows, n, level, seed)


# The sum of the Poisson probabilities of mean 1 for 0, 1, 2 ... draws.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _compared(rows: DataFrame, n: int, level: float, seed: int) -> DataFrame:
    """rows: variant, band, sample_id, score, base."""
    cell = ["variant", "band"]

    def draws(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (h[:, None] ^ (at[None] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        weight = np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(np.float64) / (1 << 53), side="right")
        return weight.astype(np.float64), np.where(x & np.uint64(1), 1.0, -1.0)

    def part(batches):
        total: dict = {}
        at = np.arange(1, n + 1, dtype=np.uint64)
        for b in batches:
            for key, g in b.groupby(cell):
                d, h = g["d"].to_numpy(np.float64), g["h"].to_numpy(np.int64).view(np.uint64)
                sums = total.setdefault(key, np.zeros((3, n)))
                for i in range(0, len(d), 500):
                    weight, sign = draws(h[i : i + 500], at)
                    own = d[i : i + 500]
                    sums += np.stack([own @ weight, weight.sum(axis=0), own @ sign])
        for (variant, band), s in total.items():
            yield pd.DataFrame({"variant": variant, "band": band, "b": np.arange(n), "wd": s[0], "w": s[1], "sd": s[2]})

    x = rows.select(*cell, (F.col("score") - F.col("base")).cast("double").alias("d"), F.xxhash64(F.lit(seed), F.col("sample_id")).alias("h")).filter("d is not null")
    sums = x.mapInPandas(part, "variant string, band string, b int, wd double, w double, sd double").groupBy(*cell, "b").agg(F.sum("wd").alias("wd"), F.sum("w").alias("w"), F.sum("sd").alias("sd"))
    seen = x.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("delta"))
    both = sums.join(seen, cell)
    mean = F.when(F.col("w") > 0, F.col("wd") / F.col("w")).otherwise(F.col("delta"))
    out = both.groupBy(*cell).agg(
        F.first("n").alias("n"), F.first("delta").alias("delta"), F.percentile(mean, F.lit((1 - level) / 2)).alias("ci_low"), F.percentile(mean, F.lit((1 + level) / 2)).alias("ci_high"),
        ((F.count(F.when(F.abs(F.col("sd") / F.col("n")) >= F.abs("delta") - 1e-12, 1)) + 1) / (n + 1)).alias("p"),
    )
    return out.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def variants(base: dict, sweep: dict[str, Iterable]) -> list[tuple[str, dict]]:
    """One flag at a time; values equal to the base are skipped."""
    return [(f"{k}={v}", base | {k: v}) for k, values in sweep.items() for v in values if base.get(k) != v]


def ablation_table(cells: DataFrame, bands: tuple[str, ...] = ("overall", "small", "medium", "large")) -> DataFrame:
    """One row a variant: delta and significance of each band."""
    return cells.groupBy("variant").pivot("band", list(bands)).agg(F.first("delta").alias("delta"), F.first("significant").alias("significant"))


def blocked(cells: DataFrame) -> DataFrame:
    """The cells that a gate did not let pass. cells: as gate() gives them; without a verdict nothing is blocked."""
    return cells.filter("passed is not null and not passed")


def arm_report(cells: DataFrame) -> DataFrame:
    """variant, overall, small, others, gate_passed (null without a gate), small_concentrated: whether the gain in small regions is
    significant and larger than in all others."""
    pick = lambda band, c: F.max(F.when(F.col("band") == band, F.col(c)))
    a = cells.groupBy("variant").agg(
        pick("overall", "delta").alias("overall"), pick("overall", "significant").alias("overall_significant"), pick("small", "delta").alias("small"), pick("small", "significant").alias("small_significant"),
        F.max(F.when(~F.col("band").isin("overall", "small"), F.col("delta"))).alias("others"),
        (pick("overall", "passed") if "passed" in cells.columns else F.lit(None).cast("boolean")).alias("gate_passed"),
    )
    return a.withColumn("small_concentrated", F.coalesce("small_significant", F.lit(False)) & (F.col("others").isNull() | (F.col("small") > F.col("others"))))


def summary_lines(report: DataFrame) -> list[str]:
    """A report of arms in words: the best arms, those whose gain lies in small regions, and a line an arm. Arms are few."""
    arms = sorted(report.collect(), key=lambda r: r.variant)
    best = best_arms(report).first()
    number = lambda x: "none" if x is None else f"{x:+.4f}"
    head = [
        f"strongest overall: {best.best_overall or 'none significant'}; strongest in small regions: {best.best_small or 'none significant'}",
        "gain concentrated in small regions: " + (", ".join(r.variant for r in arms if r.small_concentrated) or "none"),
    ]
    return head + [f"{r.variant}: overall {number(r.overall)} ({'significant' if r.overall_significant else 'not significant'}), small {number(r.small)}, concentrated {'yes' if r.small_concentrated else 'no'}" for r in arms]


def arm_ablation(scores: DataFrame, baseline: str = "off", config: GateConfig | None = None, n: int = 2000, seed: int = 0) -> DataFrame:
    """arm_report of every variant against the baseline, with the gate's verdict on each."""
    return arm_report(gate(ablation(scores, baseline, n, seed=seed), config))


def best_arms(report: DataFrame) -> DataFrame:
    """One row: the significant arms with the largest overall and small deltas."""
    return report.agg(F.max_by("variant", F.when(F.col("overall_significant"), F.col("overall"))).alias("best_overall"), F.max_by("variant", F.when(F.col("small_significant"), F.col("small"))).alias("best_small"))


def flatten_records(records: DataFrame) -> DataFrame:
    """run_id, metric, value: metrics, and stratified ones as band/metric. records: run_id, metrics map, stratified map of maps."""
    flat = records.select("run_id", F.explode("metrics").alias("metric", "value"))
    deep = records.select("run_id", F.explode("stratified").alias("band", "m")).select("run_id", "band", F.explode("m").alias("k", "value"))
    return flat.unionByName(deep.select("run_id", F.concat_ws("/", "band", "k").alias("metric"), "value"))


def delta_records(flat: DataFrame, baseline_id: str) -> DataFrame:
    """run_id, metric, delta over the metrics that both have."""
    base = flat.filter(F.col("run_id") == baseline_id).select("metric", F.col("value").alias("b"))
    return flat.filter(F.col("run_id") != baseline_id).join(base, "metric").select("run_id", "metric", (F.col("value") - F.col("b")).alias("delta"))


@dataclass(frozen=True)
class EvalSpec:
    """A run's id, what makes its outputs (of a configuration) and what measures them (to metrics and stratified)."""

    run_id: str
    predict: Callable
    measure: Callable


def run_eval(spark: SparkSession, config: AppConfig, spec: EvalSpec, baseline_id: str | None = None) -> DataFrame:
    """One row, as records are stored: the flags of the configuration and the metrics of its outputs."""
    got = spec.measure(spec.predict(config))
    if "metrics" not in got:
        raise ValueError("metrics are needed")
    number = lambda m: {k: float(v) for k, v in m.items()}
    row = (spec.run_id, {k: str(v) for k, v in config.flags.items()}, number(got["metrics"]), {b: number(m) for b, m in got.get("stratified", {}).items()}, baseline_id, None)
    return spark.createDataFrame([row], EVAL_RECORD)
