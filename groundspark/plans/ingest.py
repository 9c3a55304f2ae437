"""The corpus build: clean, deduplicate, filter by entities, guard coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import deidentify
from ..functions.text import NormalizeConfig, normalize_text
from ..operators import conflict, dedup, entities
from ..session import stage


@dataclass(frozen=True)
class IngestConfig:
    normalize: bool = True
    deidentify: bool = True
    exact_dedup: bool = True
    near_dedup: bool = False
    near_threshold: float = 0.85
    structured_key_fields: tuple[str, ...] = ()
    ner_filter: bool = True
    qa_conflict: bool = False
    text: NormalizeConfig | None = None
    quality: entities.QualityConfig = field(default_factory=entities.QualityConfig)


@dataclass(frozen=True)
class IngestResult:
    nodes: DataFrame
    dropped: DataFrame
    coverage_lost: DataFrame
    stats: DataFrame


def clean(df: DataFrame, column: str, config: IngestConfig) -> DataFrame:
    """Normalizes, then de-identifies; adds phi, the number of details found."""
    c = F.coalesce(F.col(column), F.lit(""))
    c = normalize_text(c, config.text) if config.normalize else c
    if not config.deidentify:
        return df.withColumn(column, c).withColumn("phi", F.lit(0).cast("long"))
    # Bound by a lambda, so the normalized text is worked out once and not for every pattern.
    return df.withColumn("_d", F.transform(F.array(c), lambda t: deidentify(t))[0]).withColumn(column, F.col("_d.text")).withColumn("phi", F.size("_d.found").cast("long")).drop("_d")


def _chain(nodes: DataFrame, config: IngestConfig, backend: Callable[[Column], Column] | None) -> IngestResult:
    spark = nodes.sparkSession
    # Texts are written once. What follows moves ids and labels; texts are joined to them when the nodes are read.
    cleaned = stage(nodes, "cleaned")
    out = cleaned
    gone = spark.createDataFrame([], cleaned.select("ord").schema)

    def merged(labels: DataFrame) -> None:
        nonlocal out, gone
        labels = stage(labels.filter("ord <> root"), "labels")
        out, gone = dedup.merge_labels(out, labels), gone.unionByName(labels.select("ord"))

    if config.structured_key_fields:
        merged(dedup.key_labels(out, dedup.structured_key(list(config.structured_key_fields))))
    if config.exact_dedup:
        merged(dedup.key_labels(out, dedup.text_key(config.text)))
    if config.near_dedup:
        merged(dedup.near_labels(cleaned, config.near_threshold, config=config.text, without=stage(gone, "gone")))
    survivors = out
    dropped = spark.createDataFrame([], "ord long, node_id string")
    lost = spark.createDataFrame([], "entity string")
    kept = survivors
    if config.ner_filter and backend is not None:
        # Extracted once, over all cleaned rows; survivors keep their text.
        marked = stage(entities.annotated(cleaned.select("ord", "text"), backend).select("ord", "ents"), "entities")
        kept, dropped = entities.filter_nodes(survivors.join(marked, "ord"), config=config.quality)
        lost = entities.coverage_lost(entities.collect_entities(marked), entities.collect_entities(kept))
        kept = kept.drop("ents", "n_entities", "density", "linkable_rate", "rare_rate", "score", "low_coverage")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    stats = n(cleaned, "n_in").crossJoin(n(survivors, "n_after_dedup")).crossJoin(n(dropped, "n_dropped_quality")).crossJoin(n(kept, "n_out")).crossJoin(cleaned.agg(F.coalesce(F.sum("phi"), F.lit(0)).alias("phi_found")))  # rows of one
    return IngestResult(kept.drop("phi"), dropped, lost, stats)


def ingest_documents(nodes: DataFrame, config: IngestConfig | None = None, backend: Callable[[Column], Column] | None = None) -> IngestResult:
    k = config or IngestConfig()
    return _chain(clean(nodes, "text", k), k, backend)


def ingest_qa(items: DataFrame, config: IngestConfig | None = None, backend: Callable[[Column], Column] | None = None, judge=None, merge=None, collection: str = "b_medqa") -> IngestResult:
    """items: ord, question, answer, source_id. Conflicts are resolved after cleaning; node ids come from the content."""
    k = config or IngestConfig()
    q = clean(items, "question", k).withColumnRenamed("phi", "phi_q")
    q = stage(clean(q, "answer", k).withColumn("phi", F.col("phi") + F.col("phi_q")).drop("phi_q"), "qa")
    r = conflict.resolved(q, judge, merge, enabled=k.qa_conflict, config=k.text)
    nodes = r.select(
        "ord", F.sha1(F.concat_ws("␟", "question", "answer", F.col("ord").cast("string"))).alias("node_id"), F.concat("question", F.lit("\n"), "answer").alias("text"), F.lit(collection).alias("collection"), F.lit(None).cast("string").alias("lang"),
        "source_ids", F.array().cast("array<string>").alias("entities"), F.lit(None).cast("double").alias("quality_score"), "flags", F.create_map(F.lit("question"), F.col("question")).alias("metadata"),
    )
    phi = q.groupBy().agg(F.sum("phi").alias("p"))
    first = nodes.agg(F.min("ord").alias("ord")).crossJoin(phi)
    nodes = nodes.join(F.broadcast(first), "ord", "left").withColumn("phi", F.coalesce("p", F.lit(0))).drop("p")
    return _chain(nodes, k, backend)
