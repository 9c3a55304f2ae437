"""Vector and lexical search, rank fusion, parent merging, cascades and reranking; all queries of a table at once.

Results are rows (query_id, id, score, rank), rank from 0, ordered by score and then by the row order of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.math import sigmoid
from ..functions.text import tokenize
from ..session import stage
from .vision import crop

#: Queries and rows that one task compares at once.
QUERY_BLOCK, ROW_BLOCK = 2000, 20000
#: Documents that one task scores at once by their words.
DOC_BLOCK = 4000


@dataclass(frozen=True)
class RetrieveConfig:
    top_n: int = 10
    rrf_k: int = 60
    dense_top: int = 50
    bm25_top: int = 50
    merge_ratio: float = 0.5
    normalize_scores: bool = True


def ranked(df: DataFrame, order: list[Column], k: int | None = None, by: str = "query_id") -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    return out if k is None else out.filter(F.col("rank") < k)


def knn(queries: DataFrame, rows: DataFrame, k: int = 5, where: Column | None = None) -> DataFrame:
    """Exact cosine neighbours. queries: query_id, vector; rows: id, vector (ids order ties). where filters rows before the search.

    Blocks of queries meet blocks of rows; each pair of blocks is one matrix product that keeps its k best per query, so what
    is shuffled and ranked is k per query and block, never all pairs. Null and empty vectors match nothing.
    """
    rows = (rows if where is None else rows.filter(where)).select("id", "vector").filter("size(vector) > 0")
    queries = queries.select("query_id", "vector").filter("size(vector) > 0")
    nq, nr = queries.count(), rows.count()
    qb, rb = max(1, -(-nq // QUERY_BLOCK)), max(1, -(-nr // ROW_BLOCK))
    # Every query block is paired with every row block: the fewer blocks of the two sides are spread.
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1)))).select(F.col("qb").alias("qb"), F.col("rb").alias("rb"), F.col("query_id").alias("query_id"), F.col("vector").alias("query_vector"))
    r = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(rb))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).select("qb", "rb", "id", "vector")
    both = lambda df: df.withColumn("qb", F.col("qb").cast("int")).withColumn("rb", F.col("rb").cast("int"))
    q, r = both(q), both(r)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype=object), "id": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        unit = lambda s: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))(np.array(s.tolist(), dtype=np.float64))
        b = b.sort_values("id", kind="stable")
        ids, m, out = b["id"].to_numpy(), unit(b["vector"]), []
        u = unit(a["query_vector"])
        for i in range(0, len(a), 256):
            s = np.round(u[i : i + 256] @ m.T, 12)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            for j, t in enumerate(top):
                out.append(pd.DataFrame({"query_id": a["query_id"].iloc[i + j], "id": ids[t], "score": s[j, t]}))
        return pd.concat(out)

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    part = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(best, f"query_id {kind(queries, 'query_id')}, id {kind(rows, 'id')}, score double")
    return ranked(part, [F.desc("score"), F.asc("id")], k)


def ivf(rows: DataFrame, cells: int = 64, seed: int = 42, sample: int = 20000) -> tuple[DataFrame, np.ndarray]:
    """id, vector, cell: rows assigned to the nearest of ``cells`` centres, which k-means finds on a bounded sample; and the centres."""
    x = np.array([r.vector for r in rows.select("vector", F.xxhash64("id").alias("h")).filter("size(vector) > 0").orderBy("h").limit(sample).collect()], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(15):
        at = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (at == c).any():
                centres[c] = x[at == c].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return rows.filter("size(vector) > 0").withColumn("cell", _nearest(centres, 1)(F.col("vector"))[0]), centres


def _nearest(centres: np.ndarray, n: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells(v: pd.Series) -> pd.Series:
        m = np.array(v.tolist(), dtype=np.float64)
        return pd.Series(list(np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

    return cells


def ann(queries: DataFrame, cells: DataFrame, centres: np.ndarray, k: int = 5, probes: int = 8) -> DataFrame:
    """Approximate neighbours: each query visits its nearest cells (cells as given by ivf). Rows of other cells are missed."""
    q = queries.select("query_id", "vector").withColumn("cell", F.explode(_nearest(centres, probes)(F.col("vector"))))
    joined = q.withColumnRenamed("vector", "qv").join(cells.select("id", "cell", "vector"), "cell")

    @F.pandas_udf(T.DoubleType())
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.array(a.tolist(), dtype=np.float64), np.array(b.tolist(), dtype=np.float64)
        return pd.Series((x * y).sum(axis=1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-12))

    return ranked(joined.select("query_id", "id", cosine("qv", "vector").alias("score")), [F.desc("score"), F.asc("id")], k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 50, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, drop_zero: bool = False) -> DataFrame:
    """Okapi BM25. queries: query_id, text; docs: id, text (ids order ties). Repeated query words add their score again.

    Of the documents only words of the queries are scored. Documents that share no word score 0: the first of them fill up to k,
    unless drop_zero.
    """
    asked = queries.select("query_id", F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("w")).groupBy("query_id", "w").agg(F.count(F.lit(1)).alias("qn"))
    split = docs.select("id", tokenize(F.coalesce("text", F.lit(""))).alias("ws"))
    split = stage(split.select("id", F.size("ws").alias("dl"), F.array_join("ws", " ").alias("ws")), "split")
    n, avg = split.agg(F.count(F.lit(1)), F.avg("dl")).first()
    freq = stage(split.filter("dl > 0").select(F.explode(F.array_distinct(F.split("ws", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "words")
    mean = freq.agg(F.avg("raw")).first()[0] or 0.0
    idf = freq.select("w", F.when(F.col("raw") < 0, F.lit(epsilon * mean)).otherwise(F.col("raw")).alias("idf"))
    weighed = asked.join(idf, "w").select("query_id", "w", "qn", "idf")
    saturate = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (avg or 1.0)))
    scored = stage(_scored(weighed, split, k, saturate, max(1, -(-n // DOC_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))), "scored")
    if not drop_zero:
        # At most k documents are missing, and they are among the first 2 k by id that have no hit.
        fill = queries.select("query_id").crossJoin(F.broadcast(docs.select("id").orderBy("id").limit(2 * k))).join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti")
        scored = scored.unionByName(fill.select("query_id", "id", F.lit(0.0).alias("score")))
    return ranked(scored.withColumn("score", F.round("score", 12)), [F.desc("score"), F.asc("id")], k)


def _scored(asked: DataFrame, docs: DataFrame, k: int, saturate: Callable, rb: int, qb: int) -> DataFrame:
    """query_id, id, score: sums over the words that a query (query_id, w, qn, idf) and a document (id, ws) share.

    As in knn, blocks meet blocks, so no row a shared word is shuffled: of a block the k best documents of a query are kept, and
    the first 2 k by id that have a hit, by which bm25 tells those without.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = f"query_id {kind(asked, 'query_id')}, id {kind(docs, 'id')}, score double"
    q = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"), F.col("query_id").alias("query_id"), F.col("w").alias("w"), F.col("qn").alias("qn"), F.col("idf").alias("idf"))
    r = docs.select(F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(rb)).cast("int").alias("rb"), F.col("id").alias("id"), F.col("ws").alias("ws"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(a) and len(b):
            a, b = a.sort_values(["query_id", "w"]), b.sort_values("id")
            code, words = pd.factorize(a["w"])
            idf = np.zeros(len(words))
            idf[code] = a["idf"]
            of, ids = {w: i for i, w in enumerate(words)}, b["id"].to_numpy()
            doc, word, tf, dl = [], [], [], []
            for i, t in enumerate(b["ws"]):
                ws = t.split()
                c, m = np.unique(np.array([of[w] for w in ws if w in of], dtype=np.int64), return_counts=True)
                doc.append(np.full(len(c), i))
                word.append(c)
                tf.append(m)
                dl.append(np.full(len(c), len(ws)))
            doc, word, tf, dl = (np.concatenate(x) for x in (doc, word, tf, dl))
            at = np.argsort(word, kind="stable")
            doc, word, s = doc[at], word[at], (idf[word] * saturate(tf, dl))[at]
            lo, hi = np.searchsorted(word, np.arange(len(words))), np.searchsorted(word, np.arange(len(words)), side="right")
            for query, g in a.assign(code=code).groupby("query_id", sort=False):
                c = g["code"].to_numpy()
                at = np.concatenate([np.arange(x, y) for x, y in zip(lo[c], hi[c], strict=True)])
                score = np.round(np.bincount(doc[at], s[at] * np.repeat(g["qn"].to_numpy(), hi[c] - lo[c]), len(ids)), 12)
                hit = np.unique(doc[at])
                keep = np.union1d(hit[np.argsort(-score[hit], kind="stable")[:k]], hit[: 2 * k]).astype(np.int64)
                found.append(pd.DataFrame({"query_id": query, "id": ids[keep], "score": score[keep]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype=object), "id": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})

    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(best, out)


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, id, rank): sum of 1 / (k + rank); ties in the order of first sight."""
    every = None
    for i, r in enumerate(rankings):
        x = r.select("query_id", "id", (1.0 / (k + F.col("rank"))).alias("s"), (F.lit(i) * 1_000_000_000 + F.col("rank")).alias("seen"))
        every = x if every is None else every.unionByName(x)
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum("s"), 12).alias("score"), F.min("seen").alias("seen"))
    return ranked(fused, [F.desc("score"), F.asc("seen")]).select("query_id", "id", "score", "rank")


def automerge(fused: DataFrame, chunks: DataFrame, ratio: float = 0.5) -> DataFrame:
    """Replaces hits by their parent where the share of its children that were hit reaches ``ratio``. One level.

    The parent has the best score of its hit children, at the place of the first. chunks: id, parent_id.
    """
    kids = chunks.filter("parent_id is not null").select("id", "parent_id")
    total = kids.groupBy("parent_id").agg(F.count(F.lit(1)).alias("total"))
    hit = fused.join(kids, "id", "left")
    groups = hit.filter("parent_id is not null").groupBy("query_id", "parent_id").agg(F.count(F.lit(1)).alias("hit"), F.max("score").alias("score"), F.min("rank").alias("pos")).join(total, "parent_id", "left")
    full = groups.filter(F.col("hit") / F.coalesce("total", F.col("hit")) >= ratio).select("query_id", F.col("parent_id").alias("id"), "score", "pos")
    gone = full.select("query_id", F.col("id").alias("parent_id"), F.lit(True).alias("gone"))
    rest = hit.join(gone, ["query_id", "parent_id"], "left").filter("gone is null").select("query_id", "id", "score", F.col("rank").alias("pos"))
    # A parent that was itself a hit is one row.
    both = rest.unionByName(full).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    return ranked(both, [F.desc("score"), F.asc("pos")]).select("query_id", "id", "score", "rank")


def hybrid(queries: DataFrame, chunks: DataFrame, config: RetrieveConfig | None = None) -> DataFrame:
    """Dense and lexical search over the leaves, fused, merged to parents, cut and normalised.

    queries: query_id, text, vector; chunks: id, parent_id, is_leaf, text, vector.
    """
    k = config or RetrieveConfig()
    leaf = chunks.filter("is_leaf")
    dense = knn(queries, leaf, k.dense_top)
    lexical = bm25(queries, leaf, k.bm25_top)
    merged = automerge(rrf([dense, lexical], k.rrf_k), chunks, k.merge_ratio).filter(F.col("rank") < k.top_n)
    if k.normalize_scores:
        merged = normalized(merged)
    return merged


def normalized(hits: DataFrame) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.col("score") / F.when(top == 0, 1.0).otherwise(top))


def case_ranking(hits: DataFrame) -> DataFrame:
    """Hits on vectors (case:kind) to a ranking of cases by their first hit."""
    first = hits.groupBy("query_id", F.substring_index(F.col("id").cast("string"), ":", 1).alias("id")).agg(F.min("rank").alias("first"))
    return ranked(first, [F.asc("first")]).select("query_id", "id", "rank")


def visual_cascade(channels: list[DataFrame], top_n: int = 10, rrf_k: int = 60, normalize: bool = True) -> DataFrame:
    """channels: hits (query_id, id, rank) on text, whole-image and region vectors. Cases fused over the channels."""
    out = rrf([case_ranking(c) for c in channels], rrf_k).filter(F.col("rank") < top_n)
    return normalized(out) if normalize else out


def evidence(queries: DataFrame, hits: DataFrame, records: DataFrame, modality: str = "text") -> DataFrame:
    """query_id, evidence (array in rank order), abstain, abstain_reason: one row per query; without hits it abstains for no evidence.

    records: id, text, citation; a hit without a record keeps its id.
    """
    rich = hits.join(records.select("id", "text", "citation"), "id", "left")
    item = F.struct("rank", F.struct(F.col("id").cast("string").alias("source_id"), F.coalesce("citation", F.col("id").cast("string")).alias("citation"), "score", F.lit(modality).alias("modality"), "text").alias("e"))
    arr = rich.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("evidence"))
    out = queries.select("query_id").join(arr, "query_id", "left")
    none = F.col("evidence").isNull()
    return out.select("query_id", F.coalesce("evidence", F.expr("cast(array() as array<struct<source_id:string,citation:string,score:double,modality:string,text:string>>)")).alias("evidence"), none.alias("abstain"), F.when(none, "no_evidence").otherwise("none").alias("abstain_reason"))


def rerank(hits: DataFrame, scorer: Column, top_k: int = 5, min_score: float = 0.5, logistic: bool = True) -> DataFrame:
    """query_id, id, score, rank, abstain: hits rescored by ``scorer`` (a Column over hits), cut to top_k.

    Where the best score of a query is below min_score the query abstains (low confidence); its evidence is kept.
    """
    s = hits.withColumn("old", F.col("rank")).withColumn("score", sigmoid(scorer.cast("double")) if logistic else scorer.cast("double"))
    out = ranked(s, [F.desc("score"), F.asc("old")], top_k)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return out.withColumn("abstain", best < min_score).select("query_id", "id", "score", "rank", "abstain")


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: recall@k, ndcg@k for each k, mrr; means over the queries of ``qrels`` (query_id, id; a null id: nothing is relevant).

    Without relevant ids recall and ndcg are 1 and mrr is 0.
    """
    rel = qrels.filter("id is not null").distinct()
    n = qrels.select("query_id").distinct().join(rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    good = hits.select("query_id", "id", "rank").join(rel, ["query_id", "id"], "left_semi")
    per = n.join(good, "query_id", "left")
    aggs = [F.coalesce(F.max(1.0 / (F.col("rank") + 1)), F.lit(0.0)).alias("mrr")]
    for k in ks:
        aggs.append(F.count(F.when(F.col("rank") < k, 1)).alias(f"h{k}"))
        aggs.append(F.coalesce(F.sum(F.when(F.col("rank") < k, 1.0 / F.log2(F.col("rank") + 2.0))), F.lit(0.0)).alias(f"d{k}"))
    q = per.groupBy("query_id", "n").agg(*aggs)
    out = [F.avg("mrr").alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
        out.append(F.avg(F.when(F.col("n") == 0, 1.0).otherwise(F.col(f"h{k}") / F.col("n"))).alias(f"recall_at_{k}"))
        out.append(F.avg(F.when(F.col("n") == 0, 1.0).otherwise(F.col(f"d{k}") / ideal)).alias(f"ndcg_at_{k}"))
    return q.agg(*out)


def embed(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "vector", normalize: bool = True) -> DataFrame:
    """An injected encoder (list of texts to an array of rows) as a vectorised UDF; null texts have null vectors."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vectors(s: pd.Series) -> pd.Series:
        some = s.dropna()
        m = np.asarray(encoder(some.tolist()), dtype=np.float64) if len(some) else np.zeros((0, 1))
        if normalize and len(some):
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        rows = iter(m.tolist())
        return pd.Series([None if t is None or t != t else next(rows) for t in s], index=s.index, dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def embed_images(df: DataFrame, encoder: Callable[[list[np.ndarray]], np.ndarray], out: str = "embedding") -> DataFrame:
    """An injected encoder (list of pixel arrays to an array of rows) over images (pixels, height, width), or over the region x1..y2
    of each where that is given; vectors have length 1, empty regions and null images null vectors."""

    def part(batches):
        for b in batches:
            some, at = [], []
            for k, r in enumerate(b.itertuples(index=False)):
                if r.pixels is not None:
                    image = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
                    image = image if r.x1 is None or r.x1 != r.x1 else crop(image, r.x1, r.y1, r.x2, r.y2)
                    if image.size:
                        some.append(image)
                        at.append(k)
            vectors: list = [None] * len(b)
            if some:
                m = np.asarray(encoder(some), dtype=np.float64)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                for k, v in zip(at, m.tolist(), strict=True):
                    vectors[k] = v
            yield b[["id", "case_id", "area_band"]].assign(**{out: vectors})

    return df.select("id", "case_id", "area_band", "pixels", "height", "width", "x1", "y1", "x2", "y2").mapInPandas(part, f"id string, case_id string, area_band string, {out} array<double>")


def recall_of(near: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, id) that an approximate search found."""
    n = exact.select("query_id", "id").distinct()
    total = n.count()
    return n.join(near.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").count() / total if total else 1.0


def probes_for(queries: DataFrame, cells: DataFrame, centres: np.ndarray, k: int = 5, least: float = 0.95, most: int = 200) -> int:
    """The smallest number of cells to visit at which a bounded sample of the queries finds at least this share of its exact
    neighbours: a measured choice, not a guess. least is above the recall that is wanted, as the sample is small."""
    some = stage(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most), "asked")
    exact = stage(knn(some, cells, k), "exact")
    n, step = len(centres), max(1, len(centres) // 8)
    for probes in range(step, n, step):
        if recall_of(ann(some, cells, centres, k, probes), exact) >= least:
            return probes
    return n
