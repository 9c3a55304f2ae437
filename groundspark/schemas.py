"""Schemas of the tables and the invariants of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "0.1.0"
COLLECTIONS = ("a_drug", "b_medqa", "c_text", "c_img_whole", "c_img_roi")
RAW_RECORD = "ord bigint, record_id string, text string, question string, answer string, lang string, metadata map<string,string>"
KNOWLEDGE_NODE = "ord bigint, node_id string, text string, collection string, lang string, source_ids array<string>, entities array<string>, quality_score double, flags array<string>, metadata map<string,string>"
QA_ITEM = "ord bigint, question string, answer string, source_id string"
CT_SAMPLE = "ord bigint, case_id string, image_path string, report_text string, rois array<struct<x1:double,y1:double,x2:double,y2:double,area_fraction:double,confidence:double,label:string>>, area_band string, in_eval_set boolean, metadata map<string,string>"
CHUNK = "chunk_id string, doc_id string, text string, embed_text string, level int, is_leaf boolean, parent_id string, kind string, pos int"
VECTOR = "id string, collection string, embedding array<float>, metadata map<string,string>, document string"
EVAL_RECORD = "run_id string, flags map<string,string>, metrics map<string,double>, stratified map<string,map<string,double>>, baseline_id string, significant boolean"

#: Name of an invariant, and the condition that breaks it.
INVARIANTS = {
    "box": ("x2 < x1 or y2 < y1", ("x1", "y1", "x2", "y2")),
    "fraction": ("area_fraction < 0 or area_fraction > 1", ("area_fraction",)),
    "confidence": ("confidence < 0 or confidence > 1", ("confidence",)),
    "abstain": ("abstain <> (abstain_reason <> 'none')", ("abstain", "abstain_reason")),
    "grounded": ("not uncertain and size(evidence) = 0", ("uncertain", "evidence")),
    "collection": ("collection not in (" + ", ".join(f"'{c}'" for c in COLLECTIONS) + ")", ("collection",)),
}


class ContractError(ValueError):
    """Rows break an invariant."""


def violations(df: DataFrame, *names: str) -> DataFrame:
    """Rows that break one of the named invariants (default: all whose columns exist), with column ``violated``."""
    use = [n for n, (_, cols) in INVARIANTS.items() if (not names or n in names) and set(cols) <= set(df.columns)]
    broken = F.array_compact(F.array(*[F.when(F.expr(INVARIANTS[n][0]), n) for n in use])) if use else F.array().cast("array<string>")
    return df.withColumn("violated", broken).filter(F.size("violated") > 0)


def validate(df: DataFrame, *names: str) -> DataFrame:
    bad = violations(df, *names).select("violated").limit(1).collect()
    if bad:
        raise ContractError(f"broken: {', '.join(bad[0].violated)}")
    return df


def validate_collection(name: str) -> str:
    if name not in COLLECTIONS:
        raise ValueError(f"unknown collection: {name}")
    return name
