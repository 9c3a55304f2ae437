"""Stores: vectors partitioned by collection, chunks, records; and the writers that fill them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import ChunkConfig, chunk_qa
from ..operators.retrieval import embed, embed_images
from ..schemas import VECTOR, validate_collection


class VectorStore:
    """Parquet under one path, a partition for each collection; readers prune to the collection they ask for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, collection: str) -> DataFrame:
        validate_collection(collection)
        try:
            return self.spark.read.schema(VECTOR).parquet(self.path).filter(F.col("collection") == collection)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], VECTOR)

    def add(self, collection: str, rows: DataFrame) -> None:
        """rows: id, embedding, and optionally metadata and document."""
        validate_collection(collection)
        for c, t in (("metadata", "map<string,string>"), ("document", "string")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(t))
        rows.select(F.col("id").cast("string").alias("id"), F.lit(collection).alias("collection"), F.col("embedding").cast("array<float>").alias("embedding"), "metadata", "document").write.mode("append").partitionBy("collection").parquet(self.path)

    def count(self, collection: str) -> int:
        return self.read(collection).count()

    def reset(self, collection: str) -> None:
        validate_collection(collection)
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/collection={collection}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def leaf_metadata(source_ids: str = "source_ids") -> Column:
    """Plain values only: nulls are dropped and source ids joined by a bar."""
    m = F.create_map(F.lit("parent_id"), F.col("parent_id"), F.lit("kind"), F.col("kind"), F.lit("doc_id"), F.col("doc_id").cast("string"), F.lit("source_ids"), F.concat_ws("|", F.col(source_ids)))
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def index_chunks(store: VectorStore, collection: str, chunks: DataFrame, encoder, source_ids=None) -> DataFrame:
    """Embeds the leaves' embed_text, stores their display text and metadata, and returns all chunks for the node store."""
    c = chunks.withColumn("source_ids", source_ids if source_ids is not None else F.array().cast("array<string>"))
    leaves = embed(c.filter("is_leaf"), "embed_text", encoder, "embedding")
    store.add(collection, leaves.select(F.col("chunk_id").alias("id"), "embedding", leaf_metadata().alias("metadata"), F.col("text").alias("document")))
    return chunks


def index_qa(store: VectorStore, collection: str, items: DataFrame, encoder, config: ChunkConfig | None = None) -> DataFrame:
    return index_chunks(store, collection, chunk_qa(items, config), encoder)


def ct_vectors(cases: DataFrame, text_encoder=None) -> DataFrame:
    """id, kind, case_id, area_band, text: the rows that a case is indexed by: its text, its whole image and each region. Held-out cases have none.

    cases: case_id, report_text, rois (array of struct with area_band), in_eval_set.
    """
    c = cases.filter(~F.coalesce("in_eval_set", F.lit(False)))
    none = F.lit(None).cast("string")
    text = c.filter("report_text is not null and report_text <> ''").select(F.concat("case_id", F.lit(":text")).alias("id"), F.lit("text").alias("kind"), "case_id", none.alias("area_band"), F.col("report_text").alias("text"))
    whole = c.select(F.concat("case_id", F.lit(":whole")).alias("id"), F.lit("whole").alias("kind"), "case_id", none.alias("area_band"), none.alias("text"))
    roi = c.select("case_id", F.posexplode("rois").alias("i", "r")).select(F.concat("case_id", F.lit(":roi"), F.col("i").cast("string")).alias("id"), F.lit("roi").alias("kind"), "case_id", F.col("r.area_band").alias("area_band"), none.alias("text"))
    return text.unionByName(whole).unionByName(roi)


def index_ct(store: VectorStore, cases: DataFrame, text_encoder, image_encoder) -> DataFrame:
    """Embeds and stores the text, the whole image and each region of every case that is not held out; returns the rows of ct_vectors().

    cases: case_id, report_text, rois (with x1..y2, area_band), in_eval_set, pixels (8-bit RGB), height, width. image_encoder takes a
    list of arrays; cases without pixels have no image vectors.
    """
    rows = ct_vectors(cases)
    meta = F.map_filter(F.create_map(F.lit("case_id"), F.col("case_id"), F.lit("area_band"), F.col("area_band")), lambda k, v: v.isNotNull())
    store.add("c_text", embed(rows.filter("kind = 'text'"), "text", text_encoder, "embedding").select("id", "embedding", meta.alias("metadata"), F.col("text").alias("document")))
    c = cases.filter(~F.coalesce("in_eval_set", F.lit(False)) & F.col("pixels").isNotNull())
    none = F.lit(None)
    whole = c.select(F.concat("case_id", F.lit(":whole")).alias("id"), "case_id", none.cast("string").alias("area_band"), "pixels", "height", "width", *[none.cast("double").alias(x) for x in ("x1", "y1", "x2", "y2")])
    parts = c.select("case_id", "pixels", "height", "width", F.posexplode("rois").alias("i", "r")).select(
        F.concat("case_id", F.lit(":roi"), F.col("i").cast("string")).alias("id"), "case_id", F.col("r.area_band").alias("area_band"), "pixels", "height", "width", *[F.col(f"r.{x}").cast("double").alias(x) for x in ("x1", "y1", "x2", "y2")]
    )
    for name, df in (("c_img_whole", whole), ("c_img_roi", parts)):
        store.add(name, embed_images(df, image_encoder).select("id", "embedding", meta.alias("metadata")))
    return rows


def save_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(path)


def save_record(record: dict, runs_dir: str) -> Path:
    p = Path(runs_dir) / f"{record['run_id']}.json"
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(record, ensure_ascii=False, indent=2), encoding="utf-8")
    return p
