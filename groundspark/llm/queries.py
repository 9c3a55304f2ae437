"""The registered queries of problems 1 to 10, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table as whole
from ..session import texts as table
from . import encode, lookalikes, near_dups, packing, pii, qa_defects, reading, sampling, split_overlap, token_budget

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return qa_defects.found(table(spark, d, "qa_items"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.found(table(spark, d, "ct_samples"))


@query
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.report(table(spark, d, "ct_samples"))


@query
def p2_fractions(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.fractions(table(spark, d, "ct_samples"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.found(lookalikes.texts(table(spark, d, "raw_records"), table(spark, d, "qa_items")))


@query
def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical(lookalikes.texts(table(spark, d, "raw_records"), table(spark, d, "qa_items")))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dups.found(table(spark, d, "raw_records"), table(spark, d, "knowledge_nodes"))


@query
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dups.groups(table(spark, d, "raw_records"), table(spark, d, "knowledge_nodes"))


@query
def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.totals(table(spark, d, "raw_records"), table(spark, d, "knowledge_nodes"), whole(spark, d, "sources"))


@query
def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_budget.budget(table(spark, d, "raw_records"), table(spark, d, "knowledge_nodes")).drop("sources")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.unmet(whole(spark, d, "sample_targets"), whole(spark, d, "rois"), table(spark, d, "ct_samples"))


@query
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.allocated(whole(spark, d, "sample_targets"), sampling.regions(whole(spark, d, "rois"), table(spark, d, "ct_samples")))


@query
def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sampled(whole(spark, d, "sample_targets"), whole(spark, d, "rois"), table(spark, d, "ct_samples"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "raw_records"), table(spark, d, "qa_items"))


@query
def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.replaced(table(spark, d, "raw_records"), table(spark, d, "qa_items"))


@query
def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"))


@query
def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), whole(spark, d, "pack_capacities"))


@query
def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.packed(table(spark, d, "documents"), whole(spark, d, "pack_capacities")), whole(spark, d, "pack_capacities"))


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.graded(table(spark, d, "documents"), whole(spark, d, "reading_labels"))


SQL["p6_found"] = r"""
with r as (
    select sample_ord, roi_index, ord, case when area_fraction between 0 and 1 then case when area_fraction < 0.02 then 'small' when area_fraction <= 0.05 then 'medium' else 'large' end
        when lower(regexp_replace(area_band, '\s+', '', 'g')) in ('small', 'medium', 'large') then lower(regexp_replace(area_band, '\s+', '', 'g')) end as band
    from rois where sample_ord is not null and roi_index is not null),
o as (select sample_ord, arg_min(band, ord) as band from r where band is not null group by sample_ord, roi_index),
g as (select c.source, o.band, count(*) as n from o join ct_samples c on c.ord = o.sample_ord where c.source is not null group by 1, 2),
p as (select t.plan_id, sum(g.n) as n from (select distinct plan_id, source from sample_targets) t join g using (source) group by 1)
select t.plan_id, t.source, t.area_band from sample_targets t left join g on g.source = t.source and g.band = t.area_band left join p on p.plan_id = t.plan_id
where coalesce(g.n, 0) < greatest(ceil(t.target_share::decimal(18, 9) * floor(t.sample_rate::decimal(18, 9) * coalesce(p.n, 0))), coalesce(t.min_rows, 0))
"""
