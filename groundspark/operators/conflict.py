"""Questions with several answers: grouped, judged, merged or kept apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import Deidentified, DeidConfig, assert_no_phi, deidentify, guarded
from ..functions.text import NormalizeConfig, normalize_text

VERDICTS = ("equivalent", "complementary", "conflicting", "unrelated")


def grouped(items: DataFrame, config: NormalizeConfig | None = None) -> DataFrame:
    """q_key, first_ord, question (the first as written), answers: array of (first_ord, answer, source_ids) in order of appearance.

    items: ord, question, answer, source_id. Answers are first aggregated by their normalized form, so a hot question shuffles one
    row per distinct answer.
    """
    norm = lambda c: normalize_text(F.coalesce(F.col(c), F.lit("")), config)
    each = items.select("ord", "question", "answer", "source_id", norm("question").alias("q_key"), norm("answer").alias("a_key"))
    answers = each.groupBy("q_key", "a_key").agg(
        F.min("ord").alias("first_ord"), F.min_by("question", "ord").alias("question"), F.min_by("answer", "ord").alias("answer"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_id"))), lambda x: x["source_id"]).alias("source_ids"),
    )
    return answers.groupBy("q_key").agg(
        F.min("first_ord").alias("first_ord"), F.min_by("question", "first_ord").alias("question"), F.array_sort(F.collect_list(F.struct("first_ord", "answer", "source_ids"))).alias("answers")
    )


def _sources(answers: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(answers, lambda a: a["source_ids"])))


def resolved(
    items: DataFrame, judge: Callable[[Column, Column], Column] | None = None, merge: Callable[[Column, Column], Column] | None = None, enabled: bool = True,
    config: NormalizeConfig | None = None, deid: DeidConfig | None = None,
) -> DataFrame:
    """ord, question, answer, source_ids, flags.

    judge(question, answers) is a Column of verdicts, merge(question, answers) one of texts; both see only de-identified text, and
    only groups with more than one distinct answer. Equivalent keeps the first answer as written, complementary the merged text,
    conflicting and unrelated every answer.
    """
    none = F.array().cast("array<string>")
    if not enabled:
        return items.select("ord", "question", "answer", F.array("source_id").alias("source_ids"), none.alias("flags"))
    g = grouped(items, config)
    single = g.filter(F.size("answers") == 1).select(F.col("first_ord").alias("ord"), "question", F.col("answers")[0]["answer"].alias("answer"), _sources(F.col("answers")).alias("source_ids"), none.alias("flags"))
    several = g.filter(F.size("answers") > 1)
    if judge is None:
        raise RuntimeError("several answers to a question need a judge")
    # What leaves is the group's own text, masked and checked: questions that only then become equal stay apart.
    mask = lambda c: guarded(deidentify(F.coalesce(c, F.lit("")), deid)["text"], deid)
    seen = several.select("first_ord", "question", "answers", mask(F.col("question")).alias("q"), F.transform("answers", lambda a: mask(a["answer"])).alias("a"))
    judged = seen.withColumn("verdict", judge(F.col("q"), F.col("a")))
    out = [single]
    equal = judged.filter("verdict = 'equivalent'")
    out.append(equal.select(F.col("first_ord").alias("ord"), "question", F.col("answers")[0]["answer"].alias("answer"), _sources(F.col("answers")).alias("source_ids"), F.array(F.lit("equivalent")).alias("flags")))
    both = judged.filter("verdict = 'complementary'")
    if merge is not None:
        out.append(both.select(F.col("first_ord").alias("ord"), "question", merge(F.col("q"), F.col("a")).alias("answer"), _sources(F.col("answers")).alias("source_ids"), F.array(F.lit("llm_merged")).alias("flags")))
    else:
        out.append(both.select(F.col("first_ord").alias("ord"), "question", F.raise_error(F.lit("complementary answers need a merge function")).cast("string").alias("answer"), none.alias("source_ids"), none.alias("flags")))
    apart = judged.filter("verdict in ('conflicting', 'unrelated')").select("question", "verdict", F.explode("answers").alias("x"))
    out.append(apart.select(F.col("x.first_ord").alias("ord"), "question", "x.answer", "x.source_ids", F.when(F.col("verdict") == "conflicting", F.array(F.lit("conflict"))).otherwise(none).alias("flags")))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def for_judge(items: DataFrame, deid: DeidConfig | None = None) -> DataFrame:
    """De-identified questions and answers, checked before they leave."""
    safe = Deidentified.of(items, "question", "answer", config=deid).df
    for c in ("question", "answer"):
        assert_no_phi(safe, c, deid)
    return safe
