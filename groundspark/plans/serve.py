"""The pipeline over whole tables: detect, retrieve, answer and report, each by the implementation that a flag names.

Stubs are deterministic and stand for implementations that are not given; answers that cite their evidence are built from hits,
an injected scorer and an injected draft function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AppConfig
from ..functions.math import band
from ..functions.text import detection_to_query, first_filled, qa_prompt
from ..operators import report, retrieval

EVIDENCE = "array<struct<source_id:string,citation:string,score:double,modality:string,text:string>>"
# The region and the number of pieces of evidence that the stubs give.
STUB_BOX = {"x1": 20.0, "y1": 30.0, "x2": 40.0, "y2": 50.0, "area_fraction": 0.015, "confidence": 0.8}
STUB_EVIDENCE = 3


def stub_detect(images: DataFrame) -> DataFrame:
    """image_id, rois, abstained: one small region for every image."""
    roi = F.struct(*[F.lit(v).alias(k) for k, v in STUB_BOX.items()], band(F.lit(STUB_BOX["area_fraction"])).alias("area_band"))
    return images.select("image_id", F.array(roi).alias("rois"), F.lit(False).alias("abstained"))


def stub_retrieve(queries: DataFrame, top_k: int = 5) -> DataFrame:
    """query_id, text, evidence, abstain, abstain_reason: up to three pieces of falling score; blank queries abstain."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    quote = F.when(F.contains("text", F.lit("'")) & ~F.contains("text", F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(max(min(top_k, STUB_EVIDENCE), 1) - 1)),
        lambda i: F.struct(
            F.concat(F.lit("stub-src-"), i.cast("string")).alias("source_id"), F.concat(F.lit("[stub] source "), i.cast("string"), F.lit(" for query="), quote, "text", quote).alias("citation"),
            (1.0 - 0.1 * i).alias("score"), F.lit("text").alias("modality"), F.concat(F.lit("stub evidence snippet "), i.cast("string")).alias("text"),
        ),
    )
    none = F.array().cast(EVIDENCE)
    return queries.select("query_id", "text", F.when(blank | F.lit(top_k < 1), none).otherwise(pieces.cast(EVIDENCE)).alias("evidence"), blank.alias("abstain"), F.when(blank, "no_evidence").otherwise("none").alias("abstain_reason"))


def stub_report(found: DataFrame) -> DataFrame:
    """query_id, findings, abstain, abstain_reason, summary. found: query_id, rois, evidence, abstain, abstain_reason.

    A finding for every region, with the first piece of evidence, and one for the evidence as a whole; without either it abstains.
    """
    sources = F.transform("evidence", lambda e: e["source_id"])
    of_region = F.transform("rois", lambda r, i: F.struct(F.concat(F.lit("[stub] suspected lesion at "), r["area_band"], F.lit(" band")).alias("text"), F.slice(sources, 1, 1).alias("sources"), (i + 1).alias("roi")))
    note = F.when(F.size("evidence") > 0, F.array(F.struct(F.lit("[stub] knowledge-grounded note").alias("text"), sources.alias("sources"), F.lit(None).cast("int").alias("roi"))))
    kind = "array<struct<text:string,sources:array<string>,roi:int>>"
    empty = F.array().cast(kind)
    stop = F.when(F.col("abstain"), F.col("abstain_reason")).when((F.size("evidence") <= 0) & (F.size("rois") <= 0), F.lit("no_evidence"))
    out = found.withColumn("stop", stop).withColumn("findings", F.when(stop.isNotNull(), empty).otherwise(F.concat(of_region.cast(kind), F.coalesce(note.cast(kind), empty))))
    summary = F.concat(F.lit("[stub] report with "), F.size("findings").cast("string"), F.lit(" grounded finding(s)"))
    return out.select("query_id", "findings", F.col("stop").isNotNull().alias("abstain"), F.coalesce("stop", F.lit("none")).alias("abstain_reason"), F.when(F.col("stop").isNull(), summary).otherwise("").alias("summary"))


@dataclass(frozen=True)
class CitedQA:
    """Answers of a table of questions: hits, reranking with a gate, a prompt of numbered evidence, a draft, and findings tied to it.

    retrieve(queries) gives hits (query_id, id, score, rank); score(question, passage) is a Column; draft(prompt) one of text. Questions
    without evidence or of low confidence abstain, and no draft is asked for.
    """

    retrieve: Callable[[DataFrame], DataFrame]
    records: DataFrame
    score: Callable[[Column, Column], Column]
    draft: Callable[[Column], Column]
    top_k: int = 5
    min_score: float = 0.5
    logistic: bool = True
    max_evidence: int = 3

    def ranked(self, queries: DataFrame) -> DataFrame:
        """query_id, evidence, abstain, abstain_reason."""
        passages = self.records.select("id", first_filled(F.col("text"), F.col("citation")).alias("passage"))
        asked = queries.select("query_id", F.col("text").alias("question"))
        hits = self.retrieve(queries).join(passages, "id", "left").join(asked, "query_id")
        best = retrieval.rerank(hits, self.score(F.col("question"), F.coalesce("passage", F.lit(""))), self.top_k, self.min_score, self.logistic)
        low = best.groupBy("query_id").agg(F.max("abstain").alias("low"))
        e = retrieval.evidence(queries, best, self.records).join(low, "query_id", "left")
        weak = F.coalesce("low", F.lit(False))
        return e.select("query_id", "evidence", (F.col("abstain") | weak).alias("abstain"), F.when(weak, "low_confidence").otherwise(F.col("abstain_reason")).alias("abstain_reason"))

    def answer(self, queries: DataFrame) -> DataFrame:
        """query_id, findings, abstain, abstain_reason, summary. queries: query_id, text, and what retrieve needs."""
        r = self.ranked(queries).join(queries.select("query_id", "text"), "query_id")
        prompts = r.select("query_id", qa_prompt(F.coalesce("text", F.lit("")), F.col("evidence")).alias("prompt"), "evidence", F.lit(0).alias("n_rois"), "abstain", "abstain_reason")
        return report.generated(prompts, self.draft, self.max_evidence)


@dataclass(frozen=True)
class Pipeline:
    """What the flags name: ``stub``, or an implementation of that name given in ``implementations`` (a flag to name to function)."""

    config: AppConfig = field(default_factory=AppConfig)
    qa: CitedQA | None = None
    implementations: dict[str, dict[str, Callable]] = field(default_factory=dict)

    def _chosen(self, flag: str, stub: Callable) -> Callable:
        name = self.config.flags.get(flag, "stub")
        given = {"stub": stub} | self.implementations.get(flag, {})
        if name not in given:
            raise NotImplementedError(f"no implementation of {flag} is called {name!r}")
        return given[name]

    def detect(self, images: DataFrame) -> DataFrame:
        return self._chosen("detect", stub_detect)(images)

    def retrieve(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        return self._chosen("retrieve", stub_retrieve)(queries, top_k)

    def answer(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """Answers without an image: by the given service, else from what retrieve finds."""
        if self.qa is not None:
            return self.qa.answer(queries)
        none = F.array().cast("array<struct<area_band:string>>")
        return self._chosen("report", stub_report)(self.retrieve(queries, top_k).withColumn("rois", none))

    def generate_report(self, images: DataFrame, top_k: int = 5) -> DataFrame:
        """Reports of images: what is detected makes the query. query_id is the image's id."""
        found = self.detect(images).select(F.col("image_id").alias("query_id"), "rois", "abstained")
        asked = found.select("query_id", F.when(F.col("abstained"), "").otherwise(detection_to_query(F.col("rois"))).alias("text"))
        return self._chosen("report", stub_report)(self.retrieve(asked, top_k).join(found.drop("abstained"), "query_id"))


TOOLS = ("detect_lesions", "retrieve_evidence", "medical_qa", "generate_report")


def tool_results(pipeline: Pipeline, tool: str, rows: DataFrame, top_k: int = 5) -> DataFrame:
    """The envelope of one of TOOLS over a table of requests: images (image_id) or queries (query_id, text)."""
    call = {"detect_lesions": lambda: pipeline.detect(rows), "retrieve_evidence": lambda: pipeline.retrieve(rows, top_k), "medical_qa": lambda: pipeline.answer(rows, top_k), "generate_report": lambda: pipeline.generate_report(rows, top_k)}
    if tool not in call:
        raise ValueError(f"unknown tool: {tool}")
    out = call[tool]()
    stopped = F.col("abstained" if tool == "detect_lesions" else "abstain")
    return report.envelope(out, tool, F.when(stopped, "abstained").otherwise("ok"), F.struct(*out.columns))
