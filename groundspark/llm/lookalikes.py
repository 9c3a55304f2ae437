"""Problem 4: the consistent form of every text, and the pairs of rows whose strings differ but look the same."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .canon import Canonical, fit


def texts(raw: DataFrame, qa: DataFrame) -> DataFrame:
    """tbl, ord, text: raw_records.text and qa_items.question."""
    pick = lambda df, name, c: df.select(F.lit(name).alias("tbl"), F.col("ord").cast("long").alias("ord"), F.col(c).alias("text"))
    return pick(raw, "raw_records", "text").unionByName(pick(qa, "qa_items", "question"))


def canonical(df: DataFrame) -> DataFrame:
    """tbl, ord, form: null for null, '' for blank texts. Texts that look the same have equal forms."""
    counts = df.sparkSession.sparkContext.broadcast(fit(df, "text"))

    def part(batches):
        model = Canonical(counts.value)
        for b in batches:
            yield pd.DataFrame({"tbl": b["tbl"], "ord": b["ord"], "form": [model(t) for t in b["text"]]})

    return df.select("tbl", "ord", "text").mapInPandas(part, "tbl string, ord long, form string")


def keys(df: DataFrame) -> DataFrame:
    """tbl, ord, form, raw: 128-bit digests of the form and of the string. Null and blank texts have nothing to look at and are left out."""
    counts = df.sparkSession.sparkContext.broadcast(fit(df, "text"))

    def part(batches):
        model = Canonical(counts.value)
        for b in batches:
            rows = [(t, o, xxhash.xxh128_digest(form.encode("utf-8", "surrogatepass")), xxhash.xxh128_digest(s.encode("utf-8", "surrogatepass"))) for t, o, s in zip(b["tbl"], b["ord"], b["text"], strict=True) if (form := model(s))]
            yield pd.DataFrame(rows, columns=["tbl", "ord", "form", "raw"])

    return stage(df.filter("text is not null").select("tbl", "ord", "text").mapInPandas(part, "tbl string, ord long, form binary, raw binary"), "forms")


def found(df: DataFrame) -> DataFrame:
    """tbl, ord_a, ord_b; ord_a < ord_b: rows of one table whose strings differ and whose forms are equal.

    Distinct strings of a form are paired, and only such pairs are spread to their rows: rows of one string never meet. A hot
    string is split by the adaptive skew join.
    """
    k = keys(df)
    mixed = k.groupBy("tbl", "form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).filter("x <> y").select("tbl", "form")
    few = stage(k.join(mixed, ["tbl", "form"], "left_semi"), "mixed")
    strings = few.select("tbl", "form", "raw").distinct()
    pairs = strings.withColumnRenamed("raw", "raw_a").join(strings.withColumnRenamed("raw", "raw_b"), ["tbl", "form"]).filter("raw_a < raw_b").select("tbl", "raw_a", "raw_b")
    side = lambda raw, ord_: few.select("tbl", F.col("raw").alias(raw), F.col("ord").alias(ord_))
    rows = pairs.join(side("raw_a", "x"), ["tbl", "raw_a"]).join(side("raw_b", "y"), ["tbl", "raw_b"])
    return rows.select("tbl", F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"))
