"""The registered queries of the core operators over whole tables, and the SQL that states the same result.

Queries without SQL are those that SQL cannot state (resampling, k-means, greedy matching, folds) or would state too slowly; they
are tested against brute force on small fixtures. Compatibility normalization has no SQL here, so queries with SQL switch it off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import math as fm
from ..functions import text as ft
from ..functions.privacy import DeidConfig, deidentify, has_phi
from ..operators import chunking, conflict, coreset, dedup, detection, entities, heldout, report, retrieval, stats, vision
from ..session import numbered, stage, table, texts
from ..sources import readers, store
from ..streaming import ingest as stream
from . import serve
from .ingest import IngestConfig, ingest_documents, ingest_qa

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLAIN = ft.NormalizeConfig(nfkc=False)

# Expected results are stated in SQL of their own, not by the patterns of the functions: white space and line ends as Unicode has
# them, the boilerplate lines, and the steps of normalization without the compatibility forms.
_BLANK = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BREAK = r"\r\n|[\x{a}-\x{d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_BOILERPLATE = "|".join(
    p.replace("~", _BLANK + "*")
    for p in ("^~(disclaimer|免责声明)[:：]", "^~(copyright|版权所有|©)", "^~(page~[0-9]+|第~[0-9]+~页)~$", "^~[-=*_]{3,}~$")
)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def sql_normalize(x: str) -> str:
    kept = f"array_to_string(list_filter(regexp_split_to_array({x}, '{_BREAK}'), lambda l: not regexp_matches(l, '(?i){_BOILERPLATE}')), chr(10))"
    for mark in "。！？!?.,，；;":
        kept = f"regexp_replace({kept}, '[{mark}]{{2,}}', '{mark}', 'g')"
    spaced = f"regexp_replace({kept}, '[ \\t\\x{{3000}}]+', ' ', 'g')"
    lines = f"regexp_replace({spaced}, '\\n{_BLANK}*\\n{_BLANK}*\\n+', chr(10) || chr(10), 'g')"
    return sql_strip(f"array_to_string(list_transform(regexp_split_to_array({lines}, '{_BREAK}'), lambda l: {sql_strip('l')}), chr(10))")


NORM = sql_normalize("coalesce(text, '')")
ENTITY = "[A-Z][a-z]{6,}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as knowledge nodes."""
    return texts(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("node_id"), "text", "collection", "lang",
        F.array(F.coalesce("source", F.lit("?"))).alias("source_ids"), F.array().cast("array<string>").alias("entities"), F.lit(None).cast("double").alias("quality_score"),
        F.array().cast("array<string>").alias("flags"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"),
    )


def plain_docs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("ord", ft.normalize_text(F.coalesce("text", F.lit("")), PLAIN).alias("text"))


# -- text functions


@query()
def normalize_text(spark, d):
    n = ft.normalize_text(F.col("text"))
    return docs(spark, d).select(F.col("ord").alias("doc_id"), F.sha1(n).alias("h"), F.length(n).alias("n"))


@query(f"select doc_id, sha1(n) as h, length(n)::int as n from (select doc_id, {NORM} as n from documents)")
def normalize_fold(spark, d):
    return plain_docs(spark, d).select(F.col("ord").alias("doc_id"), F.sha1("text").alias("h"), F.length("text").alias("n"))


_BOILED = "'Disclaimer: x' || chr(10) || coalesce(text, '') || chr(10) || 'Page 3' || chr(10) || '----'"


@query(f"select doc_id, sha1(array_to_string(list_filter(regexp_split_to_array({_BOILED}, '{_BREAK}'), lambda l: not regexp_matches(l, '(?i){_BOILERPLATE}')), chr(10))) as h from documents")
def strip_boilerplate(spark, d):
    c = F.concat(F.lit("Disclaimer: x\n"), F.coalesce("text", F.lit("")), F.lit("\nPage 3\n----"))
    return docs(spark, d).select(F.col("ord").alias("doc_id"), F.sha1(ft.strip_boilerplate(c)).alias("h"))


@query(
    "select doc_id, 'tel [PHONE], id [ID], mail [EMAIL]; Name: [REDACTED] ok' as text, 'phone,id_card,email,labeled' as kinds from documents"
    .replace("phone,id_card,email,labeled", "id_card,phone,email,labeled")
)
def deid_fields(spark, d):
    n = F.col("ord").cast("string")
    c = F.concat(F.lit("tel 138"), F.lpad(n, 8, "0"), F.lit(", id 11"), F.lpad(n, 16, "0"), F.lit(", mail x"), n, F.lit("@b-c.org; Name: X"), n, F.lit(" ok"))
    return docs(spark, d).select("ord", deidentify(c).alias("x")).select(F.col("ord").alias("doc_id"), F.col("x.text").alias("text"), F.array_join(F.transform("x.found", lambda e: e["category"]), ",").alias("kinds"))


@query()
def deid_texts(spark, d):
    """deid_fields over the whole text of every document, and whether a value of any kind is left."""
    n = F.col("ord").cast("string")
    c = F.concat(F.coalesce("text", F.lit("")), F.lit("\ntel 138"), F.lpad(n, 8, "0"), F.lit(", id 11"), F.lpad(n, 16, "0"), F.lit(", mail x"), n, F.lit("@b-c.org; Name: X"), n, F.lit(" ok"))
    x = docs(spark, d).select("ord", deidentify(c).alias("x")).select("ord", "x.*")
    return x.select(F.col("ord").alias("doc_id"), F.sha1("text").alias("h"), F.length("text").alias("n"), F.array_join(F.transform("found", lambda e: e["category"]), ",").alias("kinds"), has_phi(F.col("text")).alias("left"))


@query("select count(*) as n, count(*) filter (regexp_matches(t, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+')) as n_phi from (select coalesce(text, '') || case when doc_id % 3 = 0 then ' a' || doc_id || '@b.org' else '' end as t from documents)")
def phi_stats(spark, d):
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("ord") % 3 == 0, F.concat(F.lit(" a"), F.col("ord").cast("string"), F.lit("@b.org"))).otherwise(""))
    return docs(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(has_phi(t, DeidConfig(id_card=False, phone=False)), 1)).alias("n_phi"))


@query("select doc_id, case when len(regexp_extract_all(t, '[一-鿿]')) > len(regexp_extract_all(t, '[A-Za-z]+')) then 'zh' else 'en' end as lang, len(regexp_extract_all(t, '[A-Za-z0-9]+|[一-鿿]'))::bigint as n_tokens from (select doc_id, coalesce(text, '') as t from documents)")
def language_and_tokens(spark, d):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select(F.col("ord").alias("doc_id"), ft.detect_language(t).alias("lang"), ft.estimate_tokens(t).alias("n_tokens"))


_SENTENCES = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{ft.SENTENCE}'), lambda s: {sql_strip('s')}), lambda s: s <> '')"


@query(f"select doc_id, len({_SENTENCES})::int as n, sha1(array_to_string({_SENTENCES}, '|')) as h from documents")
def split_sentences(spark, d):
    s = ft.split_sentences(F.coalesce("text", F.lit("")))
    return docs(spark, d).select(F.col("ord").alias("doc_id"), F.size(s).alias("n"), F.sha1(F.array_join(s, "|")).alias("h"))


@query("select w as token, count(*) as tf, count(distinct doc_id) as df from (select doc_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[一-鿿]'), lambda x: lower(x))) as w from documents) group by w")
def tokenize_tf(spark, d):
    w = docs(spark, d).select("ord", F.explode(ft.tokenize(F.coalesce("text", F.lit("")))).alias("token"))
    per = w.groupBy("token", "ord").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


@query("select ord, case when label is null then 'other' when lower(trim(label)) in ('finding', 'symptom') then 'finding' when lower(trim(label)) in ('drug', 'chemical') then 'drug' when lower(trim(label)) in ('disease', 'disorder') then 'disease' when lower(trim(label)) in ('organ', 'anatomy') then 'anatomy' else 'other' end as mapped from rois")
def map_label(spark, d):
    return table(spark, d, "rois").select("ord", ft.map_label(F.col("label"), F.lit("en")).alias("mapped"))


_WORDS = f"list_filter(regexp_split_to_array({sql_strip('n')}, '{_BLANK}+'), lambda x: x <> '')"


@query(f"select doc_id, case when len(w) = 0 then 0 when len(w) < 3 then 1 else len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))) end::int as n from (select doc_id, {_WORDS} as w from (select doc_id, {NORM} as n from documents))")
def shingle_stats(spark, d):
    return plain_docs(spark, d).select(F.col("ord").alias("doc_id"), F.size(ft.shingles(F.col("text"))).alias("n"))


# -- deduplication

_KEYED = f"select doc_id as ord, coalesce(source, '?') as source, sha1({NORM}) as k from documents"
_EXACT = f"with k as ({_KEYED}), r as (select *, min(ord) over (partition by k) as root from k)"


@query(
    _EXACT
    + """, s as (select a.ord as survivor, 0 as step, a.ord as o, 0 as i, a.source as s from r a where a.ord = a.root
    union all select b.root, 1, b.ord, 0, b.source from r b where b.ord <> b.root union all select b.root, 1, b.ord, 1, 'd' || b.ord from r b where b.ord <> b.root),
    u as (select survivor, s, step, o, i, row_number() over (partition by survivor, s order by step, o, i) as n from s)
    select 'd' || survivor as node_id, string_agg(s, '|' order by step, o, i) as source_ids, case when max(step) = 1 then 'dedup' else '' end as flags from (select survivor, s, step, o, i from u where n = 1 union all select survivor, null, max(step), max(o), 2 from s group by survivor) group by survivor"""
)
def exact_dedup(spark, d):
    out = dedup.exact_dedup(docs(spark, d), PLAIN)
    return out.select("node_id", F.array_join("source_ids", "|").alias("source_ids"), F.array_join("flags", "|").alias("flags"))


@query(_EXACT + " select 'd' || root as survivor_id, 'd' || ord as removed_id, ord from r where ord <> root")
def exact_dedup_merges(spark, d):
    n = docs(spark, d)
    return dedup.merge_map(n, dedup.key_labels(n, dedup.text_key(PLAIN)))


@query("select min(p_partkey) as ord, count(*) - 1 as n_removed from part group by coalesce(p_brand, ''), coalesce(p_type, '')")
def structured_dedup(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("node_id"), F.array().cast("array<string>").alias("source_ids"), F.array().cast("array<string>").alias("flags"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("metadata"))
    return dedup.structured_dedup(p, ["brand", "type"]).select("ord", F.size("source_ids").cast("long").alias("n_removed"))


_SETS = f"with w as (select doc_id, {_WORDS} as w from (select doc_id, {NORM} as n from documents)), s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as g from w), n as (select doc_id, count(*) as n from s group by doc_id)"
_PAIRS = _SETS + ", c as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2), p as (select x, y, i / (na.n + nb.n - i) as j from c join n na on na.doc_id = x join n nb on nb.doc_id = y where i / (na.n + nb.n - i) >= 0.85)"
_EMPTY = "e as (select doc_id from w where len(w) = 0), edges as (select x, y from p union all select (select min(doc_id) from e), doc_id from e where doc_id <> (select min(doc_id) from e)), sym as materialized (select x, y from edges union select y, x from edges)"
_CLOSED = "with recursive " + _PAIRS[5:] + ", " + _EMPTY + ", reach(a, b) as (select distinct x, x from sym union select r.a, s.y from reach r join sym s on r.b = s.x), roots as (select a as ord, min(b) as root from reach group by a)"


@query(_PAIRS + " select x as ord_a, y as ord_b, round(j, 9) as jaccard from p")
def near_dup_pairs(spark, d):
    every = table(spark, d, "documents").select(F.col("doc_id").alias("ord"))
    return dedup.all_pairs(every, dedup.near_pairs(plain_docs(spark, d), blanks=False)).select("ord_a", "ord_b", F.round("jaccard", 9).alias("jaccard"))


@query(_CLOSED + " select ord, root from roots")
def near_dup_clusters(spark, d):
    return dedup.components(dedup.near_pairs(plain_docs(spark, d)))


@query(_CLOSED + " select 'd' || doc_id as node_id from documents where doc_id not in (select ord from roots where ord <> root)")
def near_dedup(spark, d):
    return dedup.near_dedup(docs(spark, d), config=PLAIN).select("node_id")


@query()
def ingest_stats(spark, d):
    return ingest_documents(docs(spark, d), IngestConfig(near_dedup=True), entities.dictionary_backend(ENTITY)).stats


@query()
def ingest_qa_stats(spark, d):
    conf = IngestConfig(qa_conflict=True)
    return ingest_qa(texts(spark, d, "qa_items").select("ord", "question", "answer", "source_id"), conf, entities.dictionary_backend(ENTITY), judge=lambda q, a: F.lit("conflicting")).stats


@query(
    f"""with d as (select doc_id, {NORM} as t from documents), k as (select t, min(doc_id) as ord from d group by t), e as (select ord, len(regexp_extract_all(t, '{ENTITY}')) as n from k)
    select (select count(*) from documents) as n_in, count(*) as n_after_dedup, count(*) filter (n < 1) as n_dropped_quality, count(*) filter (n >= 1) as n_out, 0 as phi_found from e"""
)
def ingest_stats_exact(spark, d):
    conf = IngestConfig(text=PLAIN, deidentify=False)
    return ingest_documents(docs(spark, d), conf, entities.dictionary_backend(ENTITY)).stats


# -- questions and answers


@query("select ord, question, answer, record_id as source_id from raw_records where question <> '' and answer <> ''")
def qa_pairs(spark, d):
    return readers.qa_records_to_items(texts(spark, d, "raw_records"))


_Q, _A = sql_normalize("coalesce(question, '')"), sql_normalize("coalesce(answer, '')")
_GROUPS = f"with i as (select ord, question, answer, source_id, {_Q} as q, {_A} as a from qa_items), g as (select q, count(distinct a) as n_answers, min(ord) as ord, count(distinct source_id) as n_sources from i group by q)"


@query(_GROUPS + " select sha1(q) as q_key, ord as first_ord, n_answers::int as n_answers from g")
def qa_group(spark, d):
    g = conflict.grouped(texts(spark, d, "qa_items"), PLAIN)
    return g.select(F.sha1("q_key").alias("q_key"), "first_ord", F.size("answers").alias("n_answers"))


def _resolve(spark, d, verdict, merge=None):
    r = conflict.resolved(texts(spark, d, "qa_items"), lambda q, a: F.lit(verdict), merge, config=PLAIN)
    return r.select("ord", F.size(F.array_compact("source_ids")).alias("n_sources"), F.array_join("flags", "|").alias("flags"))


@query(_GROUPS + " select ord, n_sources::int as n_sources, case when n_answers > 1 then 'equivalent' else '' end as flags from g")
def qa_resolve_equivalent(spark, d):
    return _resolve(spark, d, "equivalent")


@query(_GROUPS + " select ord, n_sources::int as n_sources, case when n_answers > 1 then 'llm_merged' else '' end as flags from g")
def qa_resolve_complementary(spark, d):
    return _resolve(spark, d, "complementary", lambda q, a: F.array_join(a, "\n"))


_APART = _GROUPS + ", x as (select min(i.ord) as ord, case when max(g.n_answers) = 1 then count(distinct source_id) else count(source_id) end as n, max(g.n_answers) as k from i join g using (q) group by q, a) select ord, n::int as n_sources, case when k > 1 then 'VERDICT' else '' end as flags from x"


@query(_APART.replace("VERDICT", "conflict"))
def qa_resolve_conflicting(spark, d):
    return _resolve(spark, d, "conflicting")


@query(_APART.replace("VERDICT", ""))
def qa_resolve_unrelated(spark, d):
    return _resolve(spark, d, "unrelated")


_NUMBERS = "select 2 * ord as ord, 'Is ' || ord // 2 || ' right? Tel 1380013' || lpad((ord // 2 % 10000)::varchar, 4, '0') as question, 'answer ' || ord % 2 as answer, 's' || ord as source_id from qa_items"


@query(f"with i as ({_NUMBERS}), g as (select question, count(distinct answer) as n from i group by 1) select i.ord, i.question, i.answer, case when n > 1 then 'conflict' else '' end as flags from i join g using (question)")
def qa_resolve_masked(spark, d):
    """Questions that differ only in a number that is masked before a judge sees them."""
    half = F.floor(F.col("ord") / 2)
    n = F.concat(F.lit("Is "), half.cast("string"), F.lit(" right? Tel 1380013"), F.lpad((half % 10000).cast("string"), 4, "0"))
    i = texts(spark, d, "qa_items").select((2 * F.col("ord")).alias("ord"), n.alias("question"), F.concat(F.lit("answer "), (F.col("ord") % 2).cast("string")).alias("answer"), F.concat(F.lit("s"), F.col("ord").cast("string")).alias("source_id"))
    return conflict.resolved(i, lambda q, a: F.lit("conflicting"), config=PLAIN).select("ord", "question", "answer", F.array_join("flags", "|").alias("flags"))


# -- entities

_ENTS = f"with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{ENTITY}') as e, greatest(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[一-鿿]')), 1) as t from documents)"


def _annotated(spark, d):
    return entities.annotated(docs(spark, d), entities.dictionary_backend(ENTITY))


@query(_ENTS + " select lower(x) as entity, count(distinct doc_id) as df from (select doc_id, unnest(e) as x from d) group by 1")
def entity_df(spark, d):
    return entities.document_frequency(_annotated(spark, d))


@query(_ENTS + " select lower(x) as entity, count(distinct doc_id) as df from (select doc_id, unnest(e) as x from d where doc_id not in (select doc_id from reading_labels where doc_id is not null)) group by 1")
def entity_df_excl_eval(spark, d):
    graded = table(spark, d, "reading_labels").select(F.col("doc_id").alias("ord")).distinct()
    return entities.document_frequency(_annotated(spark, d).join(graded, "ord", "left_anti"))


_SIGNALS = _ENTS + ", f as (select lower(x) as en, count(distinct doc_id) as df from (select doc_id, unnest(e) as x from d) group by 1), n as (select count(*) as n from documents), r as (select doc_id, avg(case when f.df / n.n <= 0.05 then 1.0 else 0.0 end) as rare from (select doc_id, lower(unnest(e)) as en from d) join f using (en), n group by doc_id), s as (select doc_id, len(e) as k, len(e) / t as density, coalesce(rare, 0) as rare from d left join r using (doc_id))"


def _signals(spark, d):
    # The frequencies need the entities too: they are found once.
    rows = stage(_annotated(spark, d), "annotated")
    return entities.with_signals(rows, entities.document_frequency(rows), rows.count())


@query(_SIGNALS + " select doc_id, k::bigint as n_entities, round(density, 9) as density, round(rare::double, 9) as rare_rate, round(((0.4 * least(density / 0.02, 1) + 0.3 * rare) * case when density < 0.02 then 0.5 else 1 end)::double, 6) as score from s")
def quality_signals(spark, d):
    return _signals(spark, d).select(F.col("ord").alias("doc_id"), "n_entities", F.round("density", 9).alias("density"), F.round("rare_rate", 9).alias("rare_rate"), F.round("score", 6).alias("score"))


@query(_ENTS + " select doc_id as ord, len(e)::int as n_entities, case when len(e) / t < 0.02 then 'low_coverage' else '' end as flags from d where len(e) >= 2")
def filter_nodes(spark, d):
    kept, _ = entities.filter_nodes(_annotated(spark, d), config=entities.QualityConfig(min_entities=2))
    return kept.select("ord", F.size("entities").alias("n_entities"), F.array_join("flags", "|").alias("flags"))


@query(_ENTS + " select distinct lower(x) as entity from (select unnest(e) as x from d) where lower(x) not in (select lower(y) from (select unnest(e) as y from d where len(e) >= 30))")
def coverage_lost(spark, d):
    rows = stage(_annotated(spark, d), "annotated")
    kept, _ = entities.filter_nodes(rows, config=entities.QualityConfig(min_entities=30))
    return entities.coverage_lost(entities.collect_entities(rows), entities.collect_entities(kept))


_ZH_ENTITY = "[一-鿿]{2}(?:症|炎|病)"


@query(
    f"select doc_id, zh, len(case when zh then regexp_extract_all(t, '{_ZH_ENTITY}') else regexp_extract_all(t, '{ENTITY}') end) as n from (select doc_id, t, "
    "len(regexp_extract_all(t, '[一-鿿]')) > len(regexp_extract_all(t, '[A-Za-z]+')) as zh from (select doc_id, coalesce(text, '') as t from documents))"
)
def ner_by_language(spark, d):
    backend = entities.by_language(entities.dictionary_backend(ENTITY), entities.dictionary_backend(_ZH_ENTITY, "disease"))
    rows = entities.annotated(docs(spark, d).withColumn("text", F.coalesce("text", F.lit(""))), backend)
    return rows.select(F.col("ord").alias("doc_id"), (ft.detect_language(F.col("text")) == "zh").alias("zh"), F.size("ents").cast("long").alias("n"))


# -- bands and held-out sets

_BAND = "case when {0} < 0.02 then 'small' when {0} <= 0.05 then 'medium' when {0} > 0.05 then 'large' end"


@query(f"select b.band, count(r.band) as n from (values ('small'), ('medium'), ('large')) b(band) left join (select {_BAND.format('area_fraction')} as band from rois) r on r.band = b.band group by 1")
def band_distribution(spark, d):
    return heldout.band_distribution(table(spark, d, "rois"), F.col("area_fraction"))


@query(f"with m as (select sample_ord, max(area_fraction) as f from rois where area_fraction between 0 and 1 group by 1), s as (select coalesce(c.area_band, {_BAND.format('coalesce(m.f, 0.0)')}) as band from ct_samples c left join m on m.sample_ord = c.ord where c.in_eval_set) select band, count(*) as n from s group by 1")
def heldout_bands(spark, d):
    m = table(spark, d, "rois").filter("area_fraction between 0 and 1").groupBy(F.col("sample_ord").alias("ord")).agg(F.max("area_fraction").alias("f"))
    s = heldout.heldout(table(spark, d, "ct_samples")).join(m, "ord", "left")
    return s.groupBy(heldout.sample_band(F.col("area_band"), F.array("f")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("select distinct case_id as id from ct_samples where split <> 'train' and case_id in (select case_id from ct_samples where split = 'train')")
def heldout_guard(spark, d):
    c = table(spark, d, "ct_samples").select(F.col("case_id").alias("id"), "split")
    return heldout.touched(c.filter("split <> 'train'"), c.filter("split = 'train'")).filter("id is not null")


# -- chunks

_CONF = chunking.ChunkConfig(short_qa_tokens=60, child_tokens=40, min_chunk_tokens=8)


def _chunks(spark, d):
    return chunking.chunk_qa(texts(spark, d, "qa_items").select(F.col("ord").alias("doc_id"), "question", "answer"), _CONF)


_TOKENS = "len(regexp_extract_all({0}, '[A-Za-z0-9]+|[一-鿿]'))"


def _packed_sql(text: str, target: int, least: int) -> str:
    """The chunks of a text, as a list of (text, tokens): a fold over its sentences, and the rule for a short last one."""
    s = f"list_filter(list_transform(regexp_extract_all({text}, '[^。！？.!?\\n]+[。！？.!?]?'), lambda x: {sql_strip('x')}), lambda x: x <> '')"
    t = f"list_transform({s}, lambda x: {{'done': []::struct(text varchar, tokens bigint)[], 'text': x, 'tokens': {_TOKENS.format('x')}::bigint}})"
    full = f"(a.text <> '' and a.tokens + b.tokens > {target})"
    fold = f"list_reduce({t}, lambda a, b: {{'done': case when {full} then list_append(a.done, {{'text': a.text, 'tokens': a.tokens}}) else a.done end, 'text': case when {full} or a.text = '' then b.text else a.text || ' ' || b.text end, 'tokens': case when {full} then b.tokens else a.tokens + b.tokens end}}, {{'done': []::struct(text varchar, tokens bigint)[], 'text': '', 'tokens': 0::bigint}})"
    last = "{'text': s.text, 'tokens': s.tokens}"
    joined = "{'text': s.done[-1].text || ' ' || s.text, 'tokens': s.done[-1].tokens + s.tokens}"
    return f"list_transform([{fold}], lambda s: case when s.text = '' then s.done when len(s.done) > 0 and s.tokens < {least} then list_append(s.done[:-2], {joined}) else list_append(s.done, {last}) end)[1]"


@query(
    f"""with i as (select ord as doc_id, coalesce(question, '') as q, coalesce(answer, '') as ans from qa_items), s as (select *, {_TOKENS.format('ans')} <= 60 as short from i),
    c as (select doc_id, q, unnest(list_transform(range(len(p)), lambda i: {{'pos': i, 'text': p[i + 1].text}})) as x from (select doc_id, q, {_packed_sql('ans', 40, 8)} as p from s where not short)),
    l as (select doc_id, q, 0 as pos, 'qa_short' as kind, ans as t from s where short union all select doc_id, q, x.pos, 'qa_child', x.text from c)
    select doc_id, pos::int as pos, kind, sha1(t) as h, sha1(case when q = '' then t else q || chr(10) || t end) as e from l"""
)
def chunk_leaves(spark, d):
    return chunking.leaves(_chunks(spark, d)).select("doc_id", "pos", "kind", F.sha1("text").alias("h"), F.sha1("embed_text").alias("e"))


@query("select ord as doc_id, case when len(regexp_extract_all(coalesce(answer, ''), '[A-Za-z0-9]+|[一-鿿]')) <= 60 then 'qa_short' else 'qa_parent' end as kind, sha1(coalesce(answer, '')) as h from qa_items")
def chunk_parents(spark, d):
    return _chunks(spark, d).filter("kind in ('qa_short', 'qa_parent')").select("doc_id", "kind", F.sha1("text").alias("h"))


@query(
    f"""with p as (select doc_id, unnest(list_transform({_packed_sql("coalesce(text, '')", 1024, 16)}, lambda c: c.text)) as t from documents), k as (select doc_id, len({_packed_sql('t', 256, 16)}) as n from p)
    select doc_id, sum(n)::bigint as n_leaves, count(*) as n_parents from k where n > 0 group by 1"""
)
def doc_children(spark, d):
    c = chunking.hierarchical(texts(spark, d, "documents").select("doc_id", "text"))
    return chunking.with_parent(c).filter("is_leaf").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_leaves"), F.countDistinct("parent_id").alias("n_parents"))


@query(
    "select case_id || ':text' as id, 'text' as kind from ct_samples where not coalesce(in_eval_set, false) and report_text <> '' and case_id is not null union all select case_id || ':whole', 'whole' from ct_samples where not coalesce(in_eval_set, false) and case_id is not null "
    "union all select c.case_id || ':roi' || (row_number() over (partition by c.ord order by r.ord) - 1), 'roi' from ct_samples c join rois r on r.sample_ord = c.ord where not coalesce(c.in_eval_set, false) and c.case_id is not null"
)
def index_ct(spark, d):
    r = table(spark, d, "rois").groupBy(F.col("sample_ord").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "area_band"))).alias("rois"))
    c = table(spark, d, "ct_samples").filter("case_id is not null").join(r, "ord", "left")
    return store.ct_vectors(c).select("id", "kind")


# -- retrieval: the queries are the rows whose id is divisible by 50

_UNIT = "list_transform(embedding, lambda x: x::double)"
_SIM = f"with v as (select vec_id, label, {_UNIT} as e from embeddings), s as (select q.vec_id as query_id, r.vec_id as id, round(list_cosine_similarity(q.e, r.e), 12) as score from v q, v r where q.vec_id % 50 = 0 {{0}})"
_TOP = ", t as (select *, row_number() over (partition by query_id order by score desc, id) - 1 as rank from s)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _asked(spark, d):
    return _vectors(spark, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", "label")


@query(_SIM.replace("{0}", "") + _TOP + " select query_id, id, round(score, 6) as score, rank::int as rank from t where rank < 10")
def knn_cosine(spark, d):
    return retrieval.knn(_asked(spark, d), _vectors(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_SIM.replace("{0}", "and r.label = 3") + _TOP + " select query_id, id, round(score, 6) as score, rank::int as rank from t where rank < 5")
def knn_where(spark, d):
    return retrieval.knn(_asked(spark, d), _vectors(spark, d), 5, F.col("label") == 3).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def knn_ivf(spark, d):
    cells, centres = retrieval.ivf(_vectors(spark, d))
    cells = stage(cells, "cells")
    return retrieval.ann(_asked(spark, d), cells, centres, 10, retrieval.probes_for(_asked(spark, d), cells, centres, 10))


@query("select true as enough")
def knn_ivf_recall(spark, d):
    """Whether the approximate search finds at least nine tenths of the exact neighbours."""
    exact = retrieval.knn(_asked(spark, d), _vectors(spark, d), 10)
    return spark.range(1).select((F.lit(retrieval.recall_of(QUERIES["knn_ivf"](spark, d), exact)) >= 0.9).alias("enough"))


_BM25 = """with tok as (select doc_id as id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[一-鿿]'), lambda x: lower(x))) as w from documents),
 dl as (select doc_id as id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[一-鿿]')) as dl from documents), st as (select count(*) as n, avg(dl) as avgdl from dl),
 tf as (select id, w, count(*) as tf from tok group by 1, 2), df as (select w, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tf, st group by w, n),
 idf as (select w, case when raw < 0 then 0.25 * (select avg(raw) from df) else raw end as idf from df),
 q as (select ord as query_id, w, count(*) as qn from (select ord, unnest(list_transform(regexp_extract_all(coalesce(question, ''), '[A-Za-z0-9]+|[一-鿿]'), lambda x: lower(x))) as w from qa_items where ord % 50 = 0) group by 1, 2),
 h as (select query_id, id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from q join idf using (w) join tf using (w) join dl using (id), st group by 1, 2),
 s as (select a.ord as query_id, b.doc_id as id, round(coalesce(h.score, 0.0), 9) as score from (select ord from qa_items where ord % 50 = 0) a cross join documents b left join h on h.query_id = a.ord and h.id = b.doc_id)"""


def _bm25(spark, d, k=10):
    q = texts(spark, d, "qa_items").filter("ord % 50 = 0").select(F.col("ord").alias("query_id"), F.col("question").alias("text"))
    return retrieval.bm25(q, texts(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), k)


@query(_BM25 + _TOP + " select query_id, count(*) as n, round(sum(score), 4) as total, round(max(score), 6) as best from t where rank < 10 group by 1")
def bm25_topk(spark, d):
    return _bm25(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))


_TWO = _SIM.replace("{0}", "") + _TOP + ", a as (select query_id, id, rank from t where rank < 20), b as (select query_id, id, row_number() over (partition by query_id order by id) - 1 as rank from a), f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 12) as score, min(seen) as seen from (select *, rank as seen from a union all select *, 1000000000 + rank from b) group by 1, 2), fr as (select query_id, id, score, row_number() over (partition by query_id order by score desc, seen) - 1 as rank from f)"


def _fused(spark, d):
    a = stage(retrieval.knn(_asked(spark, d), _vectors(spark, d), 20), "dense")
    b = retrieval.ranked(a.drop("rank"), [F.asc("id")])
    return retrieval.rrf([a, b])


@query(_TWO + " select query_id, id, round(score, 9) as score, rank::int as rank from fr")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


_MERGE = _TWO + ", k as (select vec_id as id, vec_id // 4 + 1000000 as parent_id from embeddings), tot as (select parent_id, count(*) as total from k group by 1), h as (select * from fr join k using (id)), g as (select query_id, parent_id, count(*) as hit, max(score) as score, min(rank) as pos from h group by 1, 2), full_ as (select query_id, g.parent_id as id, score, pos from g join tot using (parent_id) where hit / total >= 0.5), m as (select * from full_ union all select h.query_id, h.id, h.score, h.rank from h where not exists (select 1 from full_ x where x.query_id = h.query_id and x.id = h.parent_id))"


@query(_MERGE + " select query_id, id, round(score, 9) as score, (row_number() over (partition by query_id order by score desc, pos) - 1)::int as rank from m")
def automerge(spark, d):
    kids = _vectors(spark, d).select("id", (F.floor(F.col("id") / 4) + 1000000).cast("long").alias("parent_id"))
    return retrieval.automerge(_fused(spark, d), kids).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query()
def hybrid_retrieve(spark, d):
    # The n-th document has the n-th vector; documents beyond the vectors are found by their words.
    t = table(spark, d, "documents").select("doc_id", "text")
    v = numbered(_vectors(spark, d).select("id"), [F.asc("id")], "n").join(_vectors(spark, d), "id")
    rows = numbered(t.select("doc_id"), [F.asc("doc_id")], "n").join(v, "n", "full").join(t, "doc_id", "left")
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    parent = F.concat(F.lit("p"), F.floor(F.coalesce("id", F.col("n") - 1) / 4).cast("string"))
    chunks = stage(rows.select(name.alias("id"), parent.alias("parent_id"), F.lit(True).alias("is_leaf"), "text", "vector", F.col("id").alias("vec_id")), "chunks")
    asked = chunks.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "text", "vector")
    return retrieval.hybrid(asked, chunks)


_CASE = _SIM.replace("{0}", "") + _TOP + ", h as (select query_id, (id % 40)::varchar as id, min(rank) as first from t where rank < 30 group by 1, 2), c as (select query_id, id, row_number() over (partition by query_id order by first) - 1 as rank from h), f as (select query_id, id, round(2 * (1.0::double / (60 + rank)), 12) as score, rank as seen from c), r as (select *, row_number() over (partition by query_id order by score desc, seen) - 1 as rank from f)"


@query(_CASE + " select query_id, id, round(score / max(score) over (partition by query_id), 9) as score, rank::int as rank from r where rank < 10")
def visual_cascade(spark, d):
    hits = retrieval.knn(_asked(spark, d), _vectors(spark, d), 30).withColumn("id", F.concat((F.col("id") % 40).cast("string"), F.lit(":roi"), F.col("id").cast("string")))
    hits = stage(hits, "hits")
    return retrieval.visual_cascade([hits, hits]).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(_SIM.replace("{0}", "") + _TOP + ", k as (select query_id, id, 1 / (1 + exp(-(1 - 2 * score))) as score, rank from t where rank < 10), r as (select *, row_number() over (partition by query_id order by score desc, rank) - 1 as nr from k) select query_id, id, round(score, 6) as score, nr::int as rank, max(score) over (partition by query_id) < 0.5 as abstain from r where nr < 5")
def rerank_gate(spark, d):
    hits = retrieval.knn(_asked(spark, d), _vectors(spark, d), 10)
    return retrieval.rerank(hits, 1 - 2 * F.col("score")).withColumn("score", F.round("score", 6))


@query(
    _SIM.replace("{0}", "") + _TOP + """, q as (select vec_id as query_id, label from v where vec_id % 50 = 0), rel as (select q.query_id, v.vec_id as id from q join v using (label)), n as (select query_id, count(*) as n from rel group by 1),
    g as (select t.query_id, t.rank from t join rel using (query_id, id) where t.rank < 10), m as (select n.query_id, n.n, coalesce(max(1.0 / (g.rank + 1)), 0) as mrr, count(g.rank) filter (g.rank < 5) as h5, coalesce(sum(1 / log2(g.rank + 2)) filter (g.rank < 5), 0) as d5 from n left join g using (query_id) group by 1, 2)
    select round(avg(mrr)::double, 9) as mrr, round(avg(h5 / n), 9) as recall_at_5, round(avg(d5 / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1)))), 9) as ndcg_at_5 from m"""
)
def retrieval_metrics(spark, d):
    hits = retrieval.knn(_asked(spark, d), _vectors(spark, d), 10)
    qrels = _asked(spark, d).select("query_id", "label").join(_vectors(spark, d).select("id", "label"), "label").select("query_id", "id")
    return retrieval.retrieval_metrics(hits, qrels, (5,)).select(*[F.round(c, 9).alias(c) for c in ("mrr", "recall_at_5", "ndcg_at_5")])


# -- reports and extraction metrics

_ITEMS = "with a as (select sample_ord as p, lower(trim(label)) as item, count(*) as c from rois where label is not null group by 1, 2), b as (select sample_ord as p, lower(trim(label)) as item, count(*) as c from rois where label is not null and roi_index < 2 group by 1, 2), j as (select coalesce(a.c, 0) as cp, coalesce(b.c, 0) as cr from a full join b on a.p = b.p and a.item = b.item), s as (select sum(least(cp, cr))::bigint as tp, (sum(cp) - sum(least(cp, cr)))::bigint as fp, (sum(cr) - sum(least(cp, cr)))::bigint as fn from j)"


@query(_ITEMS + " select tp, fp, fn, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall, round(2 * tp / (2 * tp + fp + fn), 9) as f1 from s")
def entity_prf(spark, d):
    r = table(spark, d, "rois").filter("label is not null").select(F.col("sample_ord").alias("pair_id"), F.lower(F.trim("label")).alias("item"), "roi_index")
    out = report.multiset_prf(r.select("pair_id", "item"), r.filter("roi_index < 2").select("pair_id", "item"))
    return out.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("select round(count(*) filter (label is not null) / count(*), 9) as traceability, round(count(*) filter (label is not null and confidence >= 0.5) / count(*) filter (confidence >= 0.5), 9) as traceability_certain, round(avg(roi_index), 9) as avg_evidence, count(*) as n_findings from rois where confidence is not null")
def traceability(spark, d):
    r = table(spark, d, "rois").filter("confidence is not null").select(F.col("label").isNotNull().alias("grounded"), (F.col("confidence") < 0.5).alias("uncertain"), F.col("roi_index").alias("n_evidence"))
    out = report.traceability(r)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns[:3]], "n_findings")


@query("with s as (select report_text is null as p, area_band is null as g from ct_samples), c as (select count(*) filter (p and g) as tp, count(*) filter (p and not g) as fp, count(*) filter (not p and g) as fn, count(*) filter (not p and not g) as tn from s) select tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy from c")
def abstention(spark, d):
    s = table(spark, d, "ct_samples").select(F.col("report_text").isNull().alias("pred"), F.col("area_band").isNull().alias("gold"))
    out = report.abstention(s)
    return out.select(*out.columns[:4], *[F.round(c, 9).alias(c) for c in out.columns[4:]])


@query("with e as (select c.ord, count(r.ord) as n from ct_samples c left join rois r on r.sample_ord = c.ord group by 1) select ord as query_id, case when n = 0 then 0 else 3 end as n_findings, case when n = 0 then 0 else 1 + (n < 2)::int end as n_uncertain, n = 0 as abstain, case when n = 0 then 'no_evidence' else 'none' end as abstain_reason from e")
def assemble_report(spark, d):
    out = _reports(spark, d)
    return out.select("query_id", F.size("findings").alias("n_findings"), F.size(F.filter("findings", lambda x: x["uncertain"])).alias("n_uncertain"), "abstain", "abstain_reason")


def _reports(spark, d):
    r = table(spark, d, "rois").groupBy(F.col("sample_ord").alias("ord")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("string").alias("source_id")))).alias("evidence"))
    c = table(spark, d, "ct_samples").select("ord").join(r, "ord", "left")
    drafts = c.select(F.col("ord").alias("query_id"), F.array(F.lit("a [S1][ROI1]"), F.lit("b [S2]"), F.lit("c [S99]")).alias("lines"), F.coalesce("evidence", F.expr("cast(array() as array<struct<source_id:string>>)")).alias("evidence"), F.lit(0).alias("n_rois"), F.lit(False).alias("abstain"), F.lit("none").alias("abstain_reason"))
    return report.assembled(drafts)


def _prf_sql(name: str, item: str) -> str:
    side = lambda cond: f"select sample_ord as p, {item} as item, count(*) as c from rois where label is not null {cond} group by 1, 2"
    sums = f"select sum(least(coalesce(a.c, 0), coalesce(b.c, 0))) as tp, sum(coalesce(a.c, 0)) as n, sum(coalesce(b.c, 0)) as m from ({side('')}) a full join ({side('and roi_index < 2')}) b on a.p = b.p and a.item = b.item"
    return " union all ".join(f"select '{name}_{k}' as metric, round({v}, 9) as value from ({sums})" for k, v in (("precision", "tp / n"), ("recall", "tp / m"), ("f1", "2 * tp / (n + m)")))


@query(_prf_sql("entity", "lower(trim(label))") + " union all " + _prf_sql("relation", "lower(trim(label)) || '|' || coalesce(area_band, '')"))
def report_metrics(spark, d):
    """Entities and relations of two texts a sample, drawn from its regions: what an extractor finds are the lines of the text."""
    r = table(spark, d, "rois").filter("label is not null").select("sample_ord", "roi_index", F.lower(F.trim("label")).alias("l"), F.coalesce("area_band", F.lit("")).alias("b"))
    line = F.concat("l", F.lit("|"), "b")
    t = r.groupBy(F.col("sample_ord").alias("pair_id")).agg(F.array_join(F.collect_list(line), "\n").alias("pred"), F.array_join(F.collect_list(F.when(F.col("roi_index") < 2, line)), "\n").alias("ref"))
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: x != "")
    out = report.report_metrics(t, lambda c: F.transform(lines(c), lambda x: F.substring_index(x, "|", 1)), lambda c: F.transform(lines(c), lambda x: F.struct(F.substring_index(x, "|", 1).alias("s"), F.lit("in").alias("r"), F.substring_index(x, "|", -1).alias("o"))))
    return out.select("metric", F.round("value", 9).alias("value"))


_DRAFTED = "with e as (select c.ord, count(r.ord) as n, c.report_text is null as gold from ct_samples c left join rois r on r.sample_ord = c.ord group by 1, 3), f as (select 3 * count(*) filter (n > 0) as k, count(*) filter (n > 0) + count(*) filter (n > 1) as g, count(*) filter (n > 0) + count(*) filter (n > 1) as ev from e), c as (select count(*) filter (n = 0 and gold) as tp, count(*) filter (n = 0 and not gold) as fp, count(*) filter (n > 0 and gold) as fn, count(*) filter (n > 0 and not gold) as tn from e)"


@query(_DRAFTED + " select metric, round(value, 9) as value from (select 'traceability' as metric, g / k as value from f union all select 'traceability_certain', 1 from f union all select 'avg_evidence', ev / k from f union all select 'n_findings', k from f union all select 'abstain_precision', coalesce(tp / nullif(tp + fp, 0), 0) from c union all select 'abstain_recall', coalesce(tp / nullif(tp + fn, 0), 0) from c union all select 'abstain_f1', coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) from c union all select 'abstain_accuracy', (tp + tn) / (tp + fp + fn + tn) from c)")
def e2e_metrics(spark, d):
    gold = table(spark, d, "ct_samples").select(F.col("ord").alias("query_id"), F.col("report_text").isNull().alias("abstain"))
    return report.e2e_metrics(_reports(spark, d), gold).select("metric", F.round("value", 9).alias("value"))


@query("select 'length' as metric, round(avg(length(answer) / (1 + length(question))), 6) as value from qa_items where question is not null and answer is not null union all select 'filled', round(avg((answer <> '')::int), 6) from qa_items where question is not null and answer is not null")
def judge_scores(spark, d):
    s = texts(spark, d, "qa_items").filter("question is not null and answer is not null").select("question", "answer", F.array().cast("array<string>").alias("contexts"), F.lit(None).cast("string").alias("reference"))
    return report.judged(s, {"length": lambda q, a, c, r: F.length(a) / (1 + F.length(q)), "filled": lambda q, a, c, r: (a != "").cast("int")}).select("metric", F.round("value", 6).alias("value"))


@query("select ord as query_id, 2 as n_findings, false as abstain, '[stub] report with 2 grounded finding(s)' as summary from ct_samples")
def stub_reports(spark, d):
    out = serve.Pipeline().generate_report(table(spark, d, "ct_samples").select(F.col("ord").alias("image_id")))
    return out.select("query_id", F.size("findings").alias("n_findings"), "abstain", "summary")


@query("select ord as query_id, case when trim(coalesce(question, ''), ' ') = '' then 'abstained' else 'ok' end as status from qa_items")
def stub_answers(spark, d):
    asked = texts(spark, d, "qa_items").select(F.col("ord").alias("query_id"), F.col("question").alias("text"))
    out = serve.tool_results(serve.Pipeline(), "medical_qa", asked)
    return out.select(F.get_json_object("payload", "$.query_id").cast("long").alias("query_id"), "status")


@query(_SIM.replace("{0}", "") + _TOP + ", k as (select query_id, id, 1 / (1 + exp(-(8 * score - 7))) as s, rank from t where rank < 10), r as (select *, row_number() over (partition by query_id order by s desc, rank) as nr from k), b as (select query_id, max(s) as best, max(case when nr = 1 then id end)::varchar as first, max(case when nr = 2 then id end)::varchar as second from r group by 1) select query_id, best < 0.5 as abstain, case when best < 0.5 then 'low_confidence' else 'none' end as abstain_reason, case when best < 0.5 then '' else first || '|' || second || '|' end as sources from b")
def cited_qa(spark, d):
    """Questions answered in three lines, of which the last cites nothing: vectors as records, their similarity as the scorer."""
    records = _vectors(spark, d).select("id", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("text"), F.col("id").cast("string").alias("citation"))
    asked = _asked(spark, d).select("query_id", F.lit("which is near?").alias("text"), "vector")
    qa = serve.CitedQA(lambda q: retrieval.knn(q, _vectors(spark, d), 10), records, lambda q, p: 8 * F.col("score") - 7, lambda p: F.lit("near [S1]\nalso [S2][S9]\nperhaps"))
    out = qa.answer(asked)
    return out.select("query_id", "abstain", "abstain_reason", F.array_join(F.transform("findings", lambda f: F.coalesce(F.array_join(f["sources"], ","), F.lit(""))), "|").alias("sources"))


# -- detection

_IOU = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_AREA = "greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0)"
_IOUF = f"({_IOU}) / nullif({_AREA.format('a')} + {_AREA.format('b')} - ({_IOU}), 0)"


@query(f"select a.ord as ord_a, b.ord as ord_b, round({_IOUF}, 9) as iou from rois a join rois b on a.sample_ord = b.sample_ord and a.ord < b.ord where ({_IOU}) > 0")
def iou_pairs(spark, d):
    r = table(spark, d, "rois").select("ord", "sample_ord", "x1", "y1", "x2", "y2")
    b = r.select(F.col("ord").alias("ord_b"), "sample_ord", *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    box = ("x1", "y1", "x2", "y2")
    j = r.join(b, "sample_ord").filter("ord < ord_b")
    return j.select(F.col("ord").alias("ord_a"), "ord_b", F.round(fm.box_iou(tuple(F.col(c) for c in box), tuple(F.col(f"b_{c}") for c in box)), 9).alias("iou")).filter("iou > 0")


def _boxes(spark, d):
    r = table(spark, d, "rois").filter("confidence is not null and x1 is not null").select("ord", F.col("sample_ord").alias("image_id"), "x1", "y1", "x2", "y2", "area_fraction", "confidence")
    first = r.groupBy("image_id").agg(F.min_by(F.struct("ord", "x1", "y1", "x2", "y2", "area_fraction"), "ord").alias("g"))
    gts = first.select("image_id", "g.ord", (F.col("g.x1") + F.col("g.ord") % 40).alias("x1"), "g.y1", (F.col("g.x2") + F.col("g.ord") % 40).alias("x2"), "g.y2", "g.area_fraction").filter("area_fraction is not null")
    return r, gts


_FLAGS = f"with a as (select ord, sample_ord as image_id, x1, y1, x2, y2, area_fraction, confidence from rois where confidence is not null and x1 is not null), g0 as (select image_id, min(ord) as ord from a group by 1), b as (select a.image_id, a.x1 + a.ord % 40 as x1, a.y1, a.x2 + a.ord % 40 as x2, a.y2, a.area_fraction from a join g0 using (image_id, ord) where a.area_fraction is not null), i as (select a.ord, a.image_id, a.confidence, coalesce({_IOUF}, 0) >= 0.3 as near, b.area_fraction as f from a left join b on a.image_id = b.image_id), fl as (select *, near and row_number() over (partition by image_id, near order by confidence desc, ord) = 1 as tp from i), c as (select *, row_number() over w as k, sum(tp::int) over w as tps, sum((tp and f < 0.02)::int) over w as sm from fl window w as (order by confidence desc, image_id, ord)), t as (select count(*) as n, count(*) filter (area_fraction < 0.02) as ns from b), im as (select count(distinct image_id) as m from a)"


def _curve(spark, d):
    preds, gts = _boxes(spark, d)
    gts = stage(gts, "gts")
    flags = stage(detection.match_single(preds, gts), "flags")
    return flags, gts, preds.select("image_id").distinct().count()


@query(_FLAGS + " select k, round((k - tps) / m, 9) as fp_per_image, round(tps / n, 9) as sensitivity, round(coalesce(sm / nullif(ns, 0), 0), 9) as sens_small from c, t, im union all select 0, 0, 0, 0")
def froc_curve(spark, d):
    c = detection.froc(*_curve(spark, d))
    return c.select("k", *[F.round(x, 9).alias(x) for x in ("fp_per_image", "sensitivity", "sens_small")])


@query(_FLAGS + ", p as (select unnest([0.5, 1.0, 2.0, 4.0, 8.0])::double as fp_point) select fp_point, round(coalesce(max(tps / n) filter ((k - tps) / m <= fp_point + 1e-9), 0), 9) as sensitivity from p, c, t, im group by 1")
def sens_at_fp(spark, d):
    return detection.sensitivity_at(detection.froc(*_curve(spark, d))).select("fp_point", F.round("sensitivity", 9).alias("sensitivity"))


@query(_FLAGS + ", e as (select tp, max(tps / k) over (order by k rows between current row and unbounded following) as env from c) select round(coalesce(sum(env) filter (tp), 0) / max(n), 9) as ap from e, t")
def average_precision(spark, d):
    flags, gts, _ = _curve(spark, d)
    return detection.average_precision(flags, gts.count()).select(F.round("ap", 9).alias("ap"))


@query(_FLAGS + ", e as (select tp, max(tps / k) over (order by k rows between current row and unbounded following) as env from c), p as (select unnest([0.5, 1.0, 2.0, 4.0, 8.0])::double as fp_point) select 'sens@' || fp_point || 'fp' as metric, round(coalesce(max(tps / n) filter ((k - tps) / m <= fp_point + 1e-9), 0), 9) as value from p, c, t, im group by fp_point union all select 'mAP', round(coalesce(sum(env) filter (tp), 0) / max(n), 9) from e, t")
def detection_metrics(spark, d):
    preds, gts = _boxes(spark, d)
    out = detection.detection_metrics(preds, stage(gts, "gts"), preds.select("image_id").distinct().count())
    return out.select(F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 9))


_GREEDY = f"""with recursive a as (select ord, sample_ord as image_id, x1, y1, x2, y2, area_fraction, confidence from rois where confidence is not null and x1 is not null),
    p as (select *, row_number() over (partition by image_id order by confidence desc, ord) as k from a), b as (select ord, image_id, x1 + 3 as x1, y1, x2, y2, area_fraction from a where area_fraction is not null),
    i as (select a.ord, b.ord as g, {_IOUF} as iou, {_BAND.format('b.area_fraction')} as band from a join b on a.image_id = b.image_id where {_IOUF} >= 0.3),
    r as (select image_id, 0::bigint as k, null::bigint as ord, null::double as confidence, null::varchar as band, null::bigint as g, []::bigint[] as taken from (select distinct image_id from p)
    union all select image_id, k, ord, confidence, band, g, taken from (select p.image_id, p.k, p.ord, p.confidence, i.band, i.g, case when i.g is null then r.taken else list_append(r.taken, i.g) end as taken,
    row_number() over (partition by p.image_id order by i.iou desc nulls last, i.g) as n from r join p on p.image_id = r.image_id and p.k = r.k + 1 left join i on i.ord = p.ord and not list_contains(r.taken, i.g)) where n = 1)
    select image_id, ord, confidence, g is not null as is_tp, band as gt_band from r where k > 0"""


@query(_GREEDY)
def greedy_match(spark, d):
    preds, _ = _boxes(spark, d)
    gts = preds.filter("area_fraction is not null").withColumn("x1", F.col("x1") + 3)
    return detection.match(preds, gts)


# -- statistics


def _scores(spark, d):
    r = table(spark, d, "rois").filter("confidence is not null and area_fraction is not null")
    base = r.select("ord", F.col("confidence").alias("s"), fm.band(F.col("area_fraction")).alias("band"))
    rows = base.select(F.explode(F.array(F.struct(F.lit("off").alias("variant"), F.col("s").alias("score")), F.struct(F.lit("add").alias("variant"), (F.col("s") + F.when(F.col("band") == "small", 0.2).otherwise(0.05)).alias("score")))).alias("x"), "ord", "band")
    return rows.select("x.variant", F.col("ord").alias("sample_id"), "band", "x.score")


@query(f"with r as (select {_BAND.format('area_fraction')} as band from rois where confidence is not null and area_fraction is not null), x as (select band, case when band = 'small' then 0.2 else 0.05 end as d from r) select 'overall' as band, count(*) as n, round(avg(d)::double, 6) as delta from x union all select band, count(*), round(avg(d)::double, 6) from x group by band")
def paired_delta_by_band(spark, d):
    return stats.ablation(_scores(spark, d), "off", n=200).select("band", "n", F.round("delta", 6).alias("delta"))


@query()
def ablation_cells(spark, d):
    return stats.gate(stats.ablation(_scores(spark, d), "off"))


@query()
def ablation_arms(spark, d):
    return stats.arm_report(stats.ablation(_scores(spark, d), "off"))


@query("select count(*) filter (not a and b) as b01, count(*) filter (a and not b) as b10 from (select confidence >= 0.5 as a, area_fraction >= 0.02 as b from rois where confidence is not null and area_fraction is not null)")
def mcnemar_counts(spark, d):
    return stats.mcnemar_counts(table(spark, d, "rois").filter("confidence is not null and area_fraction is not null").select((F.col("confidence") >= 0.5).alias("a"), (F.col("area_fraction") >= 0.02).alias("b")))


@query("with s as (select source as run, avg(length(report_text)) as a, count(*)::double as n from ct_samples group by 1) select run as run_id, 'chars' as metric, round(a, 6) as value from s where a is not null union all select run, 'small/rows', n from s")
def record_flatten(spark, d):
    return _records(spark, d).withColumn("value", F.round("value", 6))


def _records(spark, d):
    s = table(spark, d, "ct_samples").groupBy(F.col("source").alias("run_id")).agg(F.avg(F.length("report_text")).alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    recs = s.select("run_id", F.map_filter(F.create_map(F.lit("chars"), F.col("a")), lambda k, v: v.isNotNull()).alias("metrics"), F.create_map(F.lit("small"), F.create_map(F.lit("rows"), F.col("n"))).alias("stratified"))
    return stats.flatten_records(recs)


@query("with s as (select source as run, avg(length(report_text)) as a, count(*)::double as n from ct_samples group by 1), b as (select * from s where run = 'ct-harbour') select s.run as run_id, 'chars' as metric, round(s.a - b.a, 6) as delta from s, b where s.run <> b.run and s.a is not null union all select s.run, 'small/rows', s.n - b.n from s, b where s.run <> b.run")
def record_delta(spark, d):
    return stats.delta_records(_records(spark, d), "ct-harbour").withColumn("delta", F.round("delta", 6))


@query()
def coreset_select(spark, d):
    v = _vectors(spark, d).withColumn("area_fraction", F.when(F.col("label") < 4, 0.01).when(F.col("label") < 7, 0.03).otherwise(0.2))
    return coreset.select(v.select("id", "vector", "area_fraction"), coreset.CoresetConfig(budget=0.25))


# -- heat maps and streams

_G = "exp(-power(y - cy, 2) / (2 * power(sy, 2))) * exp(-power(x - cx, 2) / (2 * power(sx, 2)))"


@query(
    "with b as (select sample_ord as image_id, (x1 / 16 + x2 / 16) / 2 as cx, (y1 / 16 + y2 / 16) / 2 as cy, greatest(1.0, 0.1 * (x2 / 16 - x1 / 16)) as sx, greatest(1.0, 0.1 * (y2 / 16 - y1 / 16)) as sy from rois where x1 is not null), "
    f"p as (select image_id, y, x, max({_G}) as v from b, range(0, 32) yy(y), range(0, 32) xx(x) where y between round_even(cy, 0) - ceil(3 * sy) and round_even(cy, 0) + ceil(3 * sy) and x between round_even(cx, 0) - ceil(3 * sx) and round_even(cx, 0) + ceil(3 * sx) group by 1, 2, 3) select image_id, count(*) as n, round(sum(v), 4) as total from p group by 1"
)
def heatmap_render(spark, d):
    r = table(spark, d, "rois").filter("x1 is not null").select(F.col("sample_ord").alias("image_id"), *[(F.col(c) / 16).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return vision.heatmap_rows(r, 32, 32).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "with recursive b as (select sample_ord as image_id, (x1 / 16 + x2 / 16) / 2 as cx, (y1 / 16 + y2 / 16) / 2 as cy, greatest(1.0, 0.1 * (x2 / 16 - x1 / 16)) as sx, greatest(1.0, 0.1 * (y2 / 16 - y1 / 16)) as sy from rois where x1 is not null), "
    f"p as (select image_id, y * 32 + x as c, max({_G}) as v from b, range(0, 32) yy(y), range(0, 32) xx(x) where y between round_even(cy, 0) - ceil(3 * sy) and round_even(cy, 0) + ceil(3 * sy) and x between round_even(cx, 0) - ceil(3 * sx) and round_even(cx, 0) + ceil(3 * sx) group by 1, 2), "
    "hot as materialized (select image_id, c from p where v >= 0.5), e as materialized (select a.image_id, a.c as x, b.c as y from hot a join hot b on a.image_id = b.image_id and (abs(a.c - b.c) = 32 or abs(a.c - b.c) = 1 and a.c // 32 = b.c // 32)), "
    "r(image_id, a, b) as (select image_id, c, c from hot union select r.image_id, r.a, e.y from r join e on e.image_id = r.image_id and e.x = r.b), roots as (select image_id, a, min(b) as root from r group by 1, 2), "
    "n as (select image_id, count(distinct root) as n from roots group by 1) select i.image_id, coalesce(n.n, 0)::int as n_rois, coalesce(n.n, 0) = 0 as abstained from (select distinct image_id from p) i left join n using (image_id)"
)
def heatmap_components(spark, d):
    r = table(spark, d, "rois").filter("x1 is not null").select(F.col("sample_ord").alias("image_id"), *[(F.col(c) / 16).alias(c) for c in ("x1", "y1", "x2", "y2")])
    cells = vision.heatmap_rows(r, 32, 32).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("y") * 32 + F.col("x"), "value"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: F.coalesce(F.try_element_at("m", y * 32 + x), F.lit(0.0))))
    out = vision.with_heatmap_boxes(cells.select("image_id", grid.alias("heatmap")), 0.5)
    return out.select("image_id", F.size("rois").alias("n_rois"), "abstained")


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark, d):
    return stream.counts(table(spark, d, "events"), "ts", "event_type")


@query()
def clean_records(spark, d):
    return stream.cleaned(texts(spark, d, "raw_records").select("ord", "text", "ingested_at")).select("text_key")
