"""Reports and answers whose every finding is tied to evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_tags, tags

REASONS = ("none", "no_evidence", "low_confidence", "uncertain")


def findings(lines: DataFrame, max_evidence: int = 3, drop_ungrounded: bool = False) -> DataFrame:
    """One row per line: query_id, pos, text (tags gone), sources (ids of the first valid [S n]), roi (first valid [ROI n]), uncertain.

    lines: query_id, pos, line, evidence (array of struct with source_id), n_rois. Tags of what does not exist are ignored; a line
    that cites nothing valid is uncertain, or dropped. Blank lines are no findings.
    """
    s, r = F.filter(tags(F.col("line"), "S"), lambda i: (i >= 1) & (i <= F.size("evidence"))), F.filter(tags(F.col("line"), "ROI"), lambda i: (i >= 1) & (i <= F.col("n_rois")))
    out = lines.filter("line is not null and trim(line) <> ''").select(
        "query_id", "pos", strip_tags(F.col("line")).alias("text"), F.transform(F.slice(s, 1, max_evidence), lambda i: F.element_at(F.col("evidence"), i)["source_id"]).alias("sources"), F.when(F.size(r) > 0, r[0]).alias("roi")
    )
    out = out.withColumn("uncertain", (F.size("sources") == 0) & F.col("roi").isNull())
    return out.filter("not uncertain") if drop_ungrounded else out


def assembled(drafts: DataFrame, max_evidence: int = 3, drop_ungrounded: bool = False) -> DataFrame:
    """query_id, findings (in order), abstain, abstain_reason, summary: one row per draft.

    drafts: query_id, lines (array), evidence, n_rois, abstain, abstain_reason (of the retrieval). A draft abstains if the retrieval
    did, if there is neither evidence nor a region, or if nothing grounded is left.
    """
    d = drafts.withColumn("stop", F.when(F.col("abstain"), F.col("abstain_reason")).when((F.size("evidence") <= 0) & (F.col("n_rois") <= 0), F.lit("no_evidence")))
    lines = d.filter("stop is null").select("query_id", "evidence", "n_rois", F.posexplode("lines").alias("pos", "line"))
    f = findings(lines, max_evidence, drop_ungrounded)
    per = f.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "sources", "roi", "uncertain"))).alias("findings"))
    out = d.select("query_id", "stop").join(per, "query_id", "left")
    empty = F.expr("cast(array() as array<struct<pos:int,text:string,sources:array<string>,roi:int,uncertain:boolean>>)")
    none = F.col("findings").isNull()
    reason = F.coalesce("stop", F.when(none, F.lit("no_evidence")), F.lit("none"))
    return out.select(
        "query_id", F.coalesce("findings", empty).alias("findings"), (reason != "none").alias("abstain"), reason.alias("abstain_reason"),
        F.coalesce(F.array_join(F.transform("findings", lambda x: x["text"]), " "), F.lit("")).alias("summary"),
    )


def generated(prompts: DataFrame, draft: Callable[[Column], Column] | None, max_evidence: int = 3, drop_ungrounded: bool = False) -> DataFrame:
    """prompts: query_id, prompt, evidence, n_rois, abstain, abstain_reason. The draft function sees only rows that do not abstain."""
    go = prompts.filter("not abstain and (size(evidence) > 0 or n_rois > 0)")
    stop = prompts.filter("abstain or (size(evidence) <= 0 and n_rois <= 0)").withColumn("lines", F.array().cast("array<string>"))
    if draft is None:
        raise RuntimeError("a draft function is needed")
    lines = F.filter(F.split(draft(F.col("prompt")), "\n"), lambda x: F.trim(x) != "")
    return assembled(go.withColumn("lines", lines).unionByName(stop), max_evidence, drop_ungrounded)


def traceability(rows: DataFrame) -> DataFrame:
    """One row over all findings (grounded, uncertain, n_evidence): rates of grounded ones, with and without the uncertain, and evidence each."""
    g, sure = F.count(F.when(F.col("grounded"), 1)), F.count(F.when(~F.col("uncertain"), 1))
    return rows.agg(
        F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(g / F.count(F.lit(1))).alias("traceability"),
        F.when(sure == 0, 1.0).otherwise(F.count(F.when(F.col("grounded") & ~F.col("uncertain"), 1)) / sure).alias("traceability_certain"),
        F.coalesce(F.avg("n_evidence"), F.lit(0.0)).alias("avg_evidence"), F.count(F.lit(1)).alias("n_findings"),
    )


def abstention(rows: DataFrame) -> DataFrame:
    """One row over (pred, gold) booleans: precision, recall, f1, accuracy of abstaining."""
    c = lambda e: F.count(F.when(F.expr(e), 1))
    n = rows.agg(c("pred and gold").alias("tp"), c("pred and not gold").alias("fp"), c("not pred and gold").alias("fn"), c("not pred and not gold").alias("tn"))
    from ..functions.math import prf

    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return n.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), f.alias("f1"), F.when(total > 0, (F.col("tp") + F.col("tn")) / total).alias("accuracy"))


def multiset_prf(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1, summed over pairs (micro). Both: pair_id, item; repeats count."""
    from ..functions.math import prf

    a = pred.groupBy("pair_id", "item").agg(F.count(F.lit(1)).alias("cp"))
    b = gold.groupBy("pair_id", "item").agg(F.count(F.lit(1)).alias("cr"))
    both = a.join(b, ["pair_id", "item"], "full").select(F.coalesce("cp", F.lit(0)).alias("cp"), F.coalesce("cr", F.lit(0)).alias("cr"))
    s = both.agg(F.coalesce(F.sum(F.least("cp", "cr")), F.lit(0)).alias("tp"), F.coalesce(F.sum("cp"), F.lit(0)).alias("np"), F.coalesce(F.sum("cr"), F.lit(0)).alias("nr"))
    s = s.select("tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("nr") - F.col("tp")).alias("fn"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def extracted_prf(pairs: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """multiset_prf of what ``extract`` finds in predicted and reference texts: entities, or relations as structs of subject,
    relation and object. pairs: pair_id, pred, ref; extract gives an array a text, of which null texts have none."""
    items = lambda c: pairs.select("pair_id", F.explode(extract(F.coalesce(F.col(c), F.lit("")))).alias("item")).withColumn("item", F.to_json(F.struct("item")))
    return multiset_prf(items("pred"), items("ref"))


def report_metrics(pairs: DataFrame, entities: Callable[[Column], Column], relations: Callable[[Column], Column] | None = None) -> DataFrame:
    """metric, value: entity_precision, entity_recall, entity_f1 and, with an extractor of relations, the same of these."""
    out = None
    for name, extract in (("entity", entities), ("relation", relations)):
        if extract is not None:
            r = extracted_prf(pairs, extract)
            each = r.select(F.explode(F.create_map(*[x for c in ("precision", "recall", "f1") for x in (F.lit(f"{name}_{c}"), F.col(c).cast("double"))])).alias("metric", "value"))
            out = each if out is None else out.unionByName(each)
    return out


def e2e_metrics(reports: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """metric, value: traceability over all findings of reports (query_id, findings, abstain) and, with gold (query_id, abstain), how
    well they abstain."""
    f = reports.select(F.explode("findings").alias("f")).select(
        ((F.size("f.sources") > 0) | F.col("f.roi").isNotNull()).alias("grounded"), F.col("f.uncertain").alias("uncertain"), F.size("f.sources").alias("n_evidence")
    )
    rows = lambda df, names: df.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(names[c]), F.col(c).cast("double"))])).alias("metric", "value"))
    out = rows(traceability(f), {c: c for c in ("traceability", "traceability_certain", "avg_evidence", "n_findings")})
    if gold is not None:
        both = reports.select("query_id", F.col("abstain").alias("pred")).join(gold.select("query_id", F.col("abstain").alias("gold")), "query_id")
        out = out.unionByName(rows(abstention(both), {c: f"abstain_{c}" for c in ("precision", "recall", "f1", "accuracy")}))
    return out


def judged(samples: DataFrame, judges: dict[str, Callable[..., Column]]) -> DataFrame:
    """metric, value: the mean of each judge over samples (question, answer, contexts, reference). A judge is an injected function of
    these four columns that gives a number; no model is called from here."""
    cols = [F.col(c) for c in ("question", "answer", "contexts", "reference")]
    means = samples.agg(*[F.avg(j(*cols).cast("double")).alias(k) for k, j in judges.items()])
    return means.select(F.explode(F.create_map(*[x for k in judges for x in (F.lit(k), F.col(k))])).alias("metric", "value"))


def envelope(df: DataFrame, tool: str, status: Column, payload: Column, message: Column | None = None, version: str = "0.1.0") -> DataFrame:
    """tool, status (ok, abstained, error), payload as JSON, schema_version, message."""
    return df.select(F.lit(tool).alias("tool"), status.alias("status"), F.to_json(payload).alias("payload"), F.lit(version).alias("schema_version"), (message if message is not None else F.lit(None).cast("string")).alias("message"))
