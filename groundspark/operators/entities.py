"""Entities, their quality signals, filters and coverage guards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import detect_language, entity_norm, estimate_tokens, map_label

ENTITY = "struct<text:string,label:string,start:int,end:int,lang:string,cui:string,score:double>"
LOW = "low_coverage"


@dataclass(frozen=True)
class QualityConfig:
    min_entities: int = 1
    low_density: float = 0.02
    low_coverage_penalty: float = 0.5
    rare_df_ratio: float = 0.05
    w_density: float = 0.4
    w_linkable: float = 0.3
    w_rare: float = 0.3


def dictionary_backend(pattern: str, label: str = "drug", cui: Column | None = None) -> Callable[[Column], Column]:
    """An offline backend: every match of a pattern is an entity. start and end are those of its first occurrence."""

    def extract(text: Column) -> Column:
        row = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), detect_language(text).alias("lang"), text.alias("text")))

        def entities(r: Column) -> Column:
            at = lambda w: F.instr(r["text"], w) - 1
            return F.transform(
                r["found"],
                lambda w: F.struct(
                    w.alias("text"), map_label(F.lit(label), F.lit("en")).alias("label"), at(w).cast("int").alias("start"), (at(w) + F.length(w)).cast("int").alias("end"),
                    r["lang"].alias("lang"), (cui if cui is not None else F.lit(None).cast("string")).alias("cui"), F.lit(1.0).alias("score"),
                ),
            )

        # Matches and language are bound by a lambda, so they are worked out once for a row and not for every entity.
        return F.transform(row, entities)[0]

    return extract


def by_language(en: Callable[[Column], Column], zh: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A backend that gives Chinese texts to one backend and all others to another."""
    return lambda text: F.when(detect_language(text) == "zh", zh(text)).otherwise(en(text))


def extractor(backend: Callable[[Column], Column], typed: bool = True) -> Callable[[Column], Column]:
    """A backend as what metrics of reports take: (label, norm) of each entity, or the norm alone."""

    def items(text: Column) -> Column:
        ents = F.coalesce(backend(text), F.array().cast(f"array<{ENTITY}>"))
        return F.transform(ents, lambda e: F.struct(e["label"].alias("label"), entity_norm(e["text"]).alias("norm"))) if typed else norms(ents)

    return items


def annotated(nodes: DataFrame, backend: Callable[[Column], Column], column: str = "text") -> DataFrame:
    """Adds ents: array of entities. The backend runs once; null texts have none."""
    return nodes.withColumn("ents", F.coalesce(backend(F.col(column)), F.array().cast(f"array<{ENTITY}>")))


def norms(ents: Column) -> Column:
    return F.transform(ents, lambda e: entity_norm(e["text"]))


def document_frequency(rows: DataFrame, eval_mask: Column | None = None) -> DataFrame:
    """entity, df: in how many rows an entity occurs; masked rows are left out."""
    rows = rows if eval_mask is None else rows.filter(~eval_mask)
    return rows.select(F.explode(F.array_distinct(norms(F.col("ents")))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df"))


def with_signals(rows: DataFrame, df: DataFrame | None = None, n_docs: int = 0, config: QualityConfig | None = None) -> DataFrame:
    """Adds n_entities, density, linkable_rate, rare_rate, score, low_coverage. Without document frequencies rare_rate is 0."""
    k = config or QualityConfig()
    n = F.size("ents")
    rows = rows.withColumn("n_entities", n.cast("long")).withColumn("density", n / F.greatest(estimate_tokens(F.coalesce("text", F.lit(""))), F.lit(1)))
    linked = F.size(F.filter("ents", lambda e: F.coalesce(e["cui"], F.lit("")) != ""))
    rows = rows.withColumn("linkable_rate", F.when(n > 0, linked / n).otherwise(0.0))
    if df is None:
        rows = rows.withColumn("rare_rate", F.lit(0.0))
    else:
        each = rows.select("ord", F.explode(norms(F.col("ents"))).alias("entity")).join(df, "entity", "left")
        rare = each.groupBy("ord").agg(F.avg(F.when(F.coalesce("df", F.lit(0)) / max(n_docs, 1) <= k.rare_df_ratio, 1.0).otherwise(0.0)).alias("rare_rate"))
        rows = rows.join(rare, "ord", "left").withColumn("rare_rate", F.coalesce("rare_rate", F.lit(0.0)))
    low = F.col("density") < k.low_density
    score = k.w_density * F.least(F.col("density") / k.low_density, F.lit(1.0)) + k.w_linkable * F.col("linkable_rate") + k.w_rare * F.col("rare_rate")
    return rows.withColumn("low_coverage", low).withColumn("score", score * F.when(low, k.low_coverage_penalty).otherwise(1.0))


def filter_nodes(rows: DataFrame, df: DataFrame | None = None, n_docs: int = 0, config: QualityConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """kept (quality_score, entities and flags written) and dropped (ord, node_id): rows with too few entities go, thin ones are demoted."""
    k = config or QualityConfig()
    s = with_signals(rows, df, n_docs, k)
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    kept = s.filter(F.col("n_entities") >= k.min_entities).withColumns(
        {
            "quality_score": F.col("score"), "entities": norms(F.col("ents")),
            "flags": F.when(F.col("low_coverage"), F.array_union(flags, F.array(F.lit(LOW)))).otherwise(flags),
        }
    )
    return kept, s.filter(F.col("n_entities") < k.min_entities).select("ord", "node_id")


def collect_entities(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(norms(F.col("ents"))).alias("entity")).distinct()


def coverage_lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities of ``before`` that no row of ``after`` has."""
    return before.join(after, "entity", "left_anti")


class CoverageError(ValueError):
    """Entities were lost."""


def assert_coverage(before: DataFrame, after: DataFrame) -> None:
    lost = coverage_lost(before, after).orderBy("entity").limit(20).collect()
    if lost:
        raise CoverageError("lost: " + ", ".join(r.entity for r in lost))
