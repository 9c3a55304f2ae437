"""Parent and child chunks of answers and documents, as row generators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contextualize, estimate_tokens, split_sentences

CHUNK = "array<struct<text:string,tokens:bigint>>"


@dataclass(frozen=True)
class ChunkConfig:
    chunk_sizes: tuple[int, ...] = (1024, 256)
    short_qa_tokens: int = 256
    child_tokens: int = 256
    contextual: bool = True
    min_chunk_tokens: int = 16


def packed(sentences: Column, target: int, least: int) -> Column:
    """Sentences packed greedily to at most ``target`` tokens; a short last chunk joins the one before. array of (text, tokens).

    One fold per row inside the JVM: the state is the finished chunks and the open one.
    """
    start = F.struct(F.array().cast(CHUNK).alias("done"), F.lit("").alias("text"), F.lit(0).cast("bigint").alias("tokens"))

    def step(s: Column, x: Column) -> Column:
        t = estimate_tokens(x)
        full = (s["text"] != "") & (s["tokens"] + t > target)
        closed = F.concat(s["done"], F.array(F.struct(s["text"].alias("text"), s["tokens"].alias("tokens"))))
        return F.struct(
            F.when(full, closed).otherwise(s["done"]).alias("done"),
            F.when(full | (s["text"] == ""), x).otherwise(F.concat(s["text"], F.lit(" "), x)).alias("text"),
            F.when(full, t).otherwise(s["tokens"] + t).alias("tokens"),
        )

    def finish(s: Column) -> Column:
        last = F.struct(s["text"].alias("text"), s["tokens"].alias("tokens"))
        n = F.size(s["done"])
        tail = F.element_at(s["done"], -1)
        merged = F.concat(F.slice(s["done"], F.lit(1), n - 1), F.array(F.struct(F.concat(tail["text"], F.lit(" "), s["text"]).alias("text"), (tail["tokens"] + s["tokens"]).alias("tokens"))))
        return F.when(s["text"] == "", s["done"]).when((n > 0) & (s["tokens"] < least), merged).otherwise(F.concat(s["done"], F.array(last)))

    return F.aggregate(sentences, start, step, finish)


def chunk_qa(items: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """doc_id, question, answer -> chunk_id, doc_id, text, embed_text, level, is_leaf, parent_id, kind, pos.

    A short answer is one leaf; a longer one a parent with leaves. An answer without sentences has a parent and no leaf. Ids come
    from the content's place, so they are the same in every run.
    """
    k = config or ChunkConfig()
    answer = F.coalesce("answer", F.lit(""))
    rows = items.select("doc_id", F.coalesce("question", F.lit("")).alias("question"), answer.alias("answer"), (estimate_tokens(answer) <= k.short_qa_tokens).alias("short"))
    embed = lambda text: contextualize(text, F.col("question")) if k.contextual else text
    cid = lambda *parts: F.sha1(F.concat_ws("␟", F.col("doc_id").cast("string"), *parts))
    short = rows.filter("short").select(
        cid(F.lit("s")).alias("chunk_id"), "doc_id", F.col("answer").alias("text"), embed(F.col("answer")).alias("embed_text"), F.lit(0).alias("level"), F.lit(True).alias("is_leaf"), F.lit(None).cast("string").alias("parent_id"), F.lit("qa_short").alias("kind"), F.lit(0).alias("pos")
    )
    long_ = rows.filter("not short")
    parents = long_.select(cid(F.lit("p")).alias("chunk_id"), "doc_id", F.col("answer").alias("text"), embed(F.col("answer")).alias("embed_text"), F.lit(1).alias("level"), F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("parent_id"), F.lit("qa_parent").alias("kind"), F.lit(0).alias("pos"))
    kids = long_.select("doc_id", "question", F.posexplode(packed(split_sentences(F.col("answer")), k.child_tokens, k.min_chunk_tokens)).alias("pos", "c"))
    leaves = kids.select(cid(F.lit("c"), F.col("pos").cast("string")).alias("chunk_id"), "doc_id", F.col("c.text").alias("text"), embed(F.col("c.text")).alias("embed_text"), F.lit(0).alias("level"), F.lit(True).alias("is_leaf"), cid(F.lit("p")).alias("parent_id"), F.lit("qa_child").alias("kind"), "pos")
    return short.unionByName(parents).unionByName(leaves)


def hierarchical(docs: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """doc_id, text -> chunks in two levels of the configured sizes (an approximation of sentence-window parsers, without their tokenizer)."""
    k = config or ChunkConfig()
    big, small = k.chunk_sizes[0], k.chunk_sizes[-1]
    top = docs.select("doc_id", F.posexplode(packed(split_sentences(F.coalesce("text", F.lit(""))), big, k.min_chunk_tokens)).alias("p", "c"))
    pid = F.sha1(F.concat_ws("␟", F.col("doc_id").cast("string"), F.lit("p"), F.col("p").cast("string")))
    parents = top.select(pid.alias("chunk_id"), "doc_id", F.col("c.text").alias("text"), F.col("c.text").alias("embed_text"), F.lit(1).alias("level"), F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("parent_id"), F.lit("doc_parent").alias("kind"), F.col("p").alias("pos"))
    kids = top.select("doc_id", "p", F.posexplode(packed(split_sentences(F.col("c.text")), small, k.min_chunk_tokens)).alias("pos", "x"))
    leaves = kids.select(F.sha1(F.concat_ws("␟", F.col("doc_id").cast("string"), F.lit("c"), F.col("p").cast("string"), F.col("pos").cast("string"))).alias("chunk_id"), "doc_id", F.col("x.text").alias("text"), F.col("x.text").alias("embed_text"), F.lit(0).alias("level"), F.lit(True).alias("is_leaf"), pid.alias("parent_id"), F.lit("doc_child").alias("kind"), "pos")
    return parents.unionByName(leaves)


def leaves(chunks: DataFrame) -> DataFrame:
    return chunks.filter("is_leaf")


def to_nodes(chunks: DataFrame, collection: str, lang: str | None = None, source_ids: Column | None = None) -> DataFrame:
    """Leaves as knowledge nodes; embed_text and parent_id go to the metadata."""
    meta = F.map_filter(F.create_map(F.lit("embed_text"), F.col("embed_text"), F.lit("parent_id"), F.col("parent_id")), lambda k, v: v.isNotNull())
    return leaves(chunks).select(F.col("chunk_id").alias("node_id"), "text", F.lit(collection).alias("collection"), F.lit(lang).cast("string").alias("lang"), (source_ids if source_ids is not None else F.array().cast("array<string>")).alias("source_ids"), meta.alias("metadata"))


def upserted(store: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The store with rows of ``new`` replacing those of the same id."""
    return store.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def children_count(chunks: DataFrame) -> DataFrame:
    return chunks.filter("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"))


def with_parent(chunks: DataFrame) -> DataFrame:
    parents = chunks.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return chunks.join(parents, "parent_id", "left")
