"""Problem 3: tokens of each text under a public tokenizer, and their totals by source, language, domain and collection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .lang import detect, even
from .tokenizers import FOLDER
from .trie import TrieCounter

NONE = "(none)"


def collection_of(c: Column) -> Column:
    """a_drug, b_medqa, c_text and the like, ignoring case, blanks and the kind of separator."""
    form = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_./]+", "_")
    return F.when(form != "", form)


def counted(df: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """tbl, ord, text -> tbl, ord, n_tokens, said: exact counts, and the language that the text itself shows.

    The pieces of a batch of texts form prefix tries (trie.py), partition by partition; terminal counts are joined back to the
    texts there, so pieces are never shuffled. Null and empty texts have 0 tokens.
    """

    def part(batches):
        model = TrieCounter(tokenizer, folder)
        for b in batches:
            texts = list(b["text"])
            yield pd.DataFrame({"tbl": b["tbl"], "ord": b["ord"], "n_tokens": model.counts(texts), "said": [detect(t) if unsure else None for t, unsure in zip(texts, b["unsure"], strict=True)]})

    return df.select("tbl", "ord", "text", "unsure").mapInPandas(part, "tbl string, ord long, n_tokens long, said string")


def _inputs(raw: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    r = raw.select(F.lit("raw_records").alias("tbl"), F.col("ord").cast("long").alias("ord"), "text", even(F.col("lang")).alias("lang"), F.array("source").alias("sources"), F.lit(None).cast("string").alias("collection"))
    # A record may be delivered twice: the later delivery gives its source.
    of = raw.select("record_id", "source", "ingested_at", "ord").filter("record_id is not null").groupBy("record_id").agg(F.max_by("source", F.struct("ingested_at", "ord")).alias("source"))
    ids = nodes.select(F.col("ord").cast("long").alias("ord"), F.explode("source_ids").alias("record_id"))
    sources = ids.join(of, "record_id").groupBy("ord").agg(F.array_sort(F.collect_set("source")).alias("sources"))  # a node has few source ids
    n = nodes.select(F.lit("knowledge_nodes").alias("tbl"), F.col("ord").cast("long").alias("ord"), "text", even(F.col("lang")).alias("lang"), collection_of(F.col("collection")).alias("collection"))
    return r, n.join(sources, "ord", "left").select(*r.columns)


def budget(raw: DataFrame, nodes: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """tbl, ord, n_tokens, lang, collection, sources: one row per row of both tables. Where lang says nothing, the text does; else und."""
    r, n = _inputs(raw, nodes)
    slim = lambda df, name: df.select(F.lit(name).alias("tbl"), F.col("ord").cast("long").alias("ord"), "text", even(F.col("lang")).isNull().alias("unsure"))
    counts = counted(slim(raw, "raw_records").unionByName(slim(nodes, "knowledge_nodes")), tokenizer, folder)
    facts = r.unionByName(n).drop("text")
    return counts.join(facts, ["tbl", "ord"]).select("tbl", "ord", "n_tokens", F.coalesce("lang", "said", F.lit("und")).alias("lang"), "collection", "sources")


def totals(raw: DataFrame, nodes: DataFrame, sources: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """tbl, source, domain, lang, collection, n_docs, n_tokens: how much usable text each slice has.

    A node counts once for each of its distinct sources; (none) stands for a missing source, domain or collection. Sum over the
    columns of interest; for nodes, totals over sources count shared nodes once per source.
    """
    b = stage(budget(raw, nodes, tokenizer, folder), "tokens")
    each = b.select("tbl", "n_tokens", "lang", F.coalesce("collection", F.lit(NONE)).alias("collection"), F.explode_outer("sources").alias("source"))
    sums = each.groupBy("tbl", "source", "lang", "collection").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.join(sources.select("source", "domain"), "source", "left").select(
        "tbl", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("domain", F.lit(NONE)).alias("domain"), "lang", "collection", "n_docs", "n_tokens"
    )
