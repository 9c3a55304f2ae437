"""Further registered queries: functions, guards, stores and small operators, each with the SQL that states its result."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import math as fm
from ..functions import text as ft
from ..functions.privacy import DeidConfig, violations
from ..operators import chunking, conflict, coreset, heldout, retrieval, stats, vision
from ..schemas import violations as broken
from ..session import shared_dir, stage, table, texts
from ..sources import readers, store
from . import queries as q
from .queries import query

_LF = "chr(10)"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- functions


@query(
    f"""select ord, sha1(case when coalesce(question, '') = '' then answer else question || {_LF} || answer end) as contextual, sha1('Instruct: find' || {_LF} || 'Query: ' || question) as asked,
    coalesce(nullif(question, ''), nullif(source_id, ''), ord::varchar) as cited,
    sha1('{ft.QA_INSTRUCTION}' || {_LF} || {_LF} || 'Question: ' || question || {_LF} || {_LF} || 'Evidence:' || {_LF} || '  [S1] ' || coalesce(nullif(answer, ''), nullif(source_id, ''), '') || {_LF} || {_LF} || 'Answer (cite [S<n>] inline, one sentence per line):') as prompt from qa_items"""
)
def text_forms(spark, d):
    c = F.col
    evidence = F.array(F.struct(c("answer").alias("text"), c("source_id").alias("citation")))
    return texts(spark, d, "qa_items").select(
        "ord", F.sha1(ft.contextualize(c("answer"), c("question"))).alias("contextual"), F.sha1(ft.format_query(ft.format_document(c("question")), "find")).alias("asked"),
        ft.citation(c("question"), c("source_id"), c("ord").cast("string")).alias("cited"), F.sha1(ft.qa_prompt(c("question"), evidence)).alias("prompt"),
    )


@query(
    f"""with r as (select sample_ord, list({{'b': area_band, 'c': confidence}} order by ord) as l from rois where area_band is not null and confidence is not null group by 1)
    select sample_ord, 'lesion findings in bands: ' || array_to_string(list_transform(l, lambda x: x.b), ', ') as query,
    sha1('{ft.REPORT_INSTRUCTION}' || {_LF} || {_LF} || 'Detected regions:' || {_LF} || array_to_string(list_transform(l, lambda x, i: '  [ROI' || i || '] ' || x.b || ' band, conf ' || format('{{:.2f}}', x.c)), {_LF}) || {_LF} || {_LF} || 'Findings (one per line, each with citations):') as prompt from r"""
)
def report_prompts(spark, d):
    r = table(spark, d, "rois").filter("area_band is not null and confidence is not null")
    g = r.groupBy("sample_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "area_band", "confidence"))).alias("l"))
    none = F.array().cast("array<struct<text:string,citation:string>>")
    return g.select("sample_ord", ft.detection_to_query(F.col("l")).alias("query"), F.sha1(ft.report_prompt(F.col("l"), none)).alias("prompt"))


_STEP = "least(greatest((ord % 120) / 100, 0), 1)"


@query(
    f"""select ord, round(greatest(x2 - x1, 0) * greatest(y2 - y1, 0), 6) as area, not (x2 + 2 < x1 + 30 or x2 + 30 + 2 < x1 or y2 + 2 < y1 or y2 + 2 < y1) as touches,
    round(x1 / greatest(sqrt(x1 * x1 + y1 * y1), 1e-12), 9) as unit, round(x1 * y1 + x2 * y2, 6) as product, round(0.25 + 0.75 * 0.5 * (1 + cos(pi() * {_STEP})), 9) as cosine, round(1 - 0.75 * {_STEP}, 9) as linear from rois where x1 is not null and x2 is not null and y1 is not null and y2 is not null"""
)
def geometry(spark, d):
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2")}
    step, total = (F.col("ord") % 120).cast("double"), F.lit(100.0)
    r = table(spark, d, "rois").filter("x1 is not null and x2 is not null and y1 is not null and y2 is not null")
    return r.select(
        "ord", F.round(fm.box_area(*c.values()), 6).alias("area"), fm.overlaps(tuple(c.values()), (c["x1"] + 30, c["y1"], c["x2"] + 30, c["y2"])).alias("touches"),
        F.round(fm.l2_normalize(F.array(c["x1"], c["y1"]))[0], 9).alias("unit"), F.round(fm.dot(F.array(c["x1"], c["x2"]), F.array(c["y1"], c["y2"])), 6).alias("product"),
        F.round(fm.anneal_factor(step, total), 9).alias("cosine"), F.round(fm.anneal_factor(step, total, schedule="linear"), 9).alias("linear"),
    )


@query("with r as (select least(greatest(confidence, 1e-6), 1 - 1e-6) as p, least(greatest(area_fraction * 20, 0), 1) as t from rois where confidence is not null and area_fraction is not null) select round(sum(case when t >= 1 then -power(1 - p, 2) * ln(p) else -power(1 - t, 4) * power(p, 2) * ln(1 - p) end) / greatest(count(*) filter (t >= 1), 1), 6) as focal, round(1 - (2 * sum(p * t) + 1e-6) / (sum(p) + sum(t) + 1e-6), 6) as dice from r")
def losses(spark, d):
    r = table(spark, d, "rois").filter("confidence is not null and area_fraction is not null")
    out = vision.losses(r.select(F.col("confidence").alias("pred"), F.least(F.greatest(F.col("area_fraction") * 20, F.lit(0.0)), F.lit(1.0)).alias("target")))
    return out.select(F.round("focal", 6).alias("focal"), F.round("dice", 6).alias("dice"))


# -- guards


@query("select count(*) as n from documents where regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+')")
def phi_violations(spark, d):
    return violations(q.docs(spark, d), "text", DeidConfig(id_card=False, phone=False)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "select violated, count(*) as n from (select unnest(list_filter([case when x2 < x1 or y2 < y1 then 'box' end, case when area_fraction < 0 or area_fraction > 1 then 'fraction' end, case when confidence < 0 or confidence > 1 then 'confidence' end], lambda x: x is not null)) as violated from rois) group by 1 "
    "union all select 'collection', count(*) from knowledge_nodes where collection not in ('a_drug', 'b_medqa', 'c_text', 'c_img_whole', 'c_img_roi') having count(*) > 0"
)
def contract_violations(spark, d):
    each = broken(table(spark, d, "rois")).select(F.explode("violated").alias("violated")).unionByName(broken(texts(spark, d, "knowledge_nodes"), "collection").select(F.explode("violated").alias("violated")))
    return each.groupBy("violated").agg(F.count(F.lit(1)).alias("n"))


@query(f"with r as (select {q._BAND.format('area_fraction')} as band from rois where confidence is not null and area_fraction is not null), x as (select band, case when band = 'small' then 0.2 else 0.05 end as d from r), c as (select 'overall' as band, avg(d) as m from x union all select band, avg(d) from x group by band) select 'add' as variant, band from c where m < 0.1")
def ablation_blocked(spark, d):
    cells = stats.gate(stats.ablation(q._scores(spark, d), "off", n=200), stats.GateConfig(min_delta=0.1))
    return stats.blocked(cells).select("variant", "band")


@query(f"with r as (select case when area_fraction < 0.02 then 0.2 else 0.05 end as d from rois where confidence is not null and area_fraction is not null) select count(*) as n, round(avg(d)::double, 6) as delta, true as passed from r")
def gate_scores(spark, d):
    s = q._scores(spark, d)
    pairs = s.filter("variant = 'off'").select("sample_id", F.col("score").alias("baseline")).join(s.filter("variant = 'add'").select("sample_id", F.col("score").alias("variant")), "sample_id")
    return stats.check_scores(pairs, n=200).select("n", F.round("delta", 6).alias("delta"), "passed")


@query("with r as (select confidence >= 0.5 as a, area_fraction >= 0.02 as b from rois where confidence is not null and area_fraction is not null), c as (select count(*) filter (not a and b) as x, count(*) filter (a and not b) as y from r) select round(case when x + y = 0 then 1 else exp(-power(abs(x - y) - 1, 2) / (x + y) / 2) end, 9) as p from c")
def mcnemar_p(spark, d):
    c = q.QUERIES["mcnemar_counts"](spark, d).first()
    return spark.createDataFrame([(round(stats.mcnemar(c.b01, c.b10, exact_below=0, compat=True), 9),)], "p double")


@query(f"with r as (select {q._BAND.format('area_fraction')} as band from rois where confidence is not null and area_fraction is not null), c as (select count(*) as n, count(*) filter (band = 'small') as s, count(*) filter (band = 'medium') as m, count(*) filter (band = 'large') as l from r) select 'add' as variant, round((0.2 * s + 0.05 * (m + l))::double / n, 6) as overall, case when s > 0 then 0.2 end::double as small, case when m > 0 then 0.05 end::double as medium, case when l > 0 then 0.05 end::double as large from c")
def ablation_deltas(spark, d):
    t = stats.ablation_table(stats.ablation(q._scores(spark, d), "off", n=50))
    return t.select("variant", *[F.round(f"{b}_delta", 6).alias(b) for b in ("overall", "small", "medium", "large")])


# -- bands, conflicts, strata


@query(f"select band, string_agg(ord::varchar, ',' order by ord) as items from (select ord, {q._BAND.format('area_fraction')} as band from rois) where band is not null group by 1")
def items_by_band(spark, d):
    return heldout.by_band(table(spark, d, "rois"), F.col("area_fraction"), F.col("ord")).select("band", F.array_join("items", ",").alias("items"))


@query("select ord, coalesce(source_id, '') as sources, '' as flags from qa_items")
def qa_passthrough(spark, d):
    r = conflict.resolved(texts(spark, d, "qa_items"), enabled=False)
    return r.select("ord", F.array_join(F.transform("source_ids", lambda x: F.coalesce(x, F.lit(""))), "|").alias("sources"), F.array_join("flags", "|").alias("flags"))


@query(
    f"""with s as (select b.band, count(r.band) as n from (values ('small'), ('medium'), ('large')) b(band) left join (select {q._BAND.format('area_fraction')} as band from rois) r on r.band = b.band group by 1), w as (select band, n, n * case when band = 'small' then 1.5 else 1.0 end as w from s),
    e as (select band, n, 300 * w / sum(w) over () as x from w), f as (select band, n, least(n, floor(x)) as q, x - floor(x) as frac from e), g as (select *, least(300, sum(n) over ()) - sum(q) over () as rest, coalesce(sum(n - q) over (order by frac desc, band rows between unbounded preceding and 1 preceding), 0) as before from f)
    select band, (q + greatest(0, least(n - q, rest - before)))::bigint as quota from g"""
)
def strata_quota(spark, d):
    sizes = {r.band: r.n for r in heldout.band_distribution(table(spark, d, "rois"), F.col("area_fraction")).collect()}
    return spark.createDataFrame(list(coreset.allocate_strata(sizes, 300).items()), "band string, quota long")


# -- retrieval


@query(q._SIM.replace("{0}", "") + q._TOP + " select query_id, string_agg(id::varchar || ' c' || id, '|' order by rank) as evidence, false as abstain from t where rank < 4 group by 1")
def evidence_rows(spark, d):
    hits = retrieval.knn(q._asked(spark, d), q._vectors(spark, d), 4)
    records = q._vectors(spark, d).select("id", F.lit(None).cast("string").alias("text"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("citation"))
    e = retrieval.evidence(q._asked(spark, d), hits, records)
    return e.select("query_id", F.array_join(F.transform("evidence", lambda x: F.concat(x["source_id"], F.lit(" "), x["citation"])), "|").alias("evidence"), "abstain")


@query("select doc_id, round(length(text) / greatest(sqrt(length(text)::double * length(text) + 1), 1e-12), 9) as first from documents where text is not null union all select doc_id, null from documents where text is null")
def embedded_texts(spark, d):
    out = retrieval.embed(texts(spark, d, "documents").select("doc_id", "text"), "text", lambda ts: np.array([[len(t), 1.0] for t in ts]))
    return out.select("doc_id", F.round(F.col("vector")[0], 9).alias("first"))


# -- chunks


@query(q.SQL["chunk_leaves"].replace("select doc_id, pos::int as pos, kind, sha1(t) as h,", "select doc_id, pos::int as pos, kind <> 'qa_short' as has_parent, sha1(t) as h,"))
def chunk_nodes(spark, d):
    c = q._chunks(spark, d)
    n = chunking.to_nodes(c, "b_medqa").join(c.select(F.col("chunk_id").alias("node_id"), "doc_id", "pos"), "node_id")
    return n.select("doc_id", "pos", F.col("metadata")["parent_id"].isNotNull().alias("has_parent"), F.sha1("text").alias("h"), F.sha1(F.col("metadata")["embed_text"]).alias("e"))


@query(f"select ord as doc_id, sha1(answer) as parent from qa_items where len(regexp_extract_all(coalesce(answer, ''), '[A-Za-z0-9]+|[一-鿿]')) > 60 and len(list_filter(regexp_extract_all(answer, '[^。！？.!?\\n]+[。！？.!?]?'), lambda x: {q.sql_strip('x')} <> '')) > 0")
def chunk_parent_texts(spark, d):
    c = stage(q._chunks(spark, d), "chunks")
    kids = chunking.with_parent(c).filter("is_leaf and parent_id is not null")
    return kids.join(chunking.children_count(c).select("parent_id"), "parent_id").select("doc_id", F.sha1("parent_text").alias("parent")).distinct()


@query("select doc_id, case when doc_id % 3 = 0 then 'new' else 'old' end as state from documents union all select doc_id + 10000000, 'new' from documents where doc_id % 3 = 1")
def upserted_rows(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    new = t.filter("doc_id % 3 = 0").unionByName(t.filter("doc_id % 3 = 1").select((F.col("doc_id") + 10000000).alias("doc_id"))).withColumn("state", F.lit("new"))
    return chunking.upserted(t.withColumn("state", F.lit("old")), new, "doc_id")


# -- sources and stores


@query("select ord, record_id as node_id, coalesce(text, '') as text, 'a_drug' as collection, record_id as source from raw_records")
def drug_nodes(spark, d):
    return readers.drug_records_to_nodes(texts(spark, d, "raw_records")).select("ord", "node_id", "text", "collection", F.col("source_ids")[0].alias("source"))


@query("select ord, record_id as case_id, '' as image_path, coalesce(nullif(answer, ''), nullif(text, '')) as report_text from raw_records")
def ct_records(spark, d):
    return readers.ct_records_to_samples(texts(spark, d, "raw_records")).select("ord", "case_id", "image_path", "report_text")


@query("select row_number() over (order by ord) - 1 as line, case when ord % 2 = 0 then 'q' || ord else (row_number() over (order by ord) - 1)::varchar end as record_id, coalesce(question, '') as question, coalesce(source_id, '') as source_id from qa_items")
def jsonl_rows(spark, d):
    """qa_items written as JSON lines in their order, every other one without an id, and read again."""
    path = _folder(spark, "jsonl")
    t = texts(spark, d, "qa_items").select("ord", F.to_json(F.struct(F.when(F.col("ord") % 2 == 0, F.concat(F.lit("q"), F.col("ord").cast("string"))).alias("id"), "question", "source_id")).alias("value"))
    t.repartitionByRange(3, "ord").sortWithinPartitions("ord").select("value").write.text(path)
    r = readers.load_jsonl(spark, path)
    named = F.col("record_id").startswith("q")
    return r.select(F.col("ord").alias("line"), F.when(named, F.col("record_id")).otherwise(F.col("ord").cast("string")).alias("record_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce(F.col("metadata")["source_id"], F.lit("")).alias("source_id"))


@query("select node_id, coalesce(text, '') as text from knowledge_nodes")
def nodes_saved(spark, d):
    path = _folder(spark, "nodes")
    store.save_nodes(texts(spark, d, "knowledge_nodes").select("node_id", "text"), path)
    return readers.load_nodes(spark, path).select("node_id", F.coalesce(F.get_json_object("record", "$.text"), F.lit("")).alias("text"))


@query("select 'a_drug' as collection, 2 * (select count(*) from embeddings) as n union all select 'b_medqa', count(*) from qa_items where len(regexp_extract_all(coalesce(answer, ''), '[A-Za-z0-9]+|[一-鿿]')) <= 100000 union all select 'c_text', 0")
def vector_store(spark, d):
    """What is left in a store after appending twice, indexing answers, and resetting a collection."""
    s = store.VectorStore(spark, _folder(spark, "vectors"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    s.add("a_drug", v)
    s.add("a_drug", v)
    s.add("c_text", v)
    store.index_qa(s, "b_medqa", texts(spark, d, "qa_items").select(F.col("ord").alias("doc_id"), "question", "answer"), lambda ts: np.array([[len(t), 1.0] for t in ts]), chunking.ChunkConfig(short_qa_tokens=100000))
    s.reset("c_text")
    return spark.createDataFrame([(c, s.count(c)) for c in ("a_drug", "b_medqa", "c_text")], "collection string, n long")
