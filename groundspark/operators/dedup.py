"""Exact, structured and near deduplication with merged provenance.

Tables carry ``ord``: of a group of duplicates the smallest survives. Survivors get the removed rows' source ids and node ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NormalizeConfig, normalize_text, sha1_key, shingles
from ..session import stage

FLAG = "dedup"


def merge_map(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """survivor_id, removed_id, ord (of the removed): who took in whom. labels: ord, root."""
    removed = nodes.select("ord", F.col("node_id").alias("removed_id")).join(labels.filter("ord <> root"), "ord")
    return removed.join(nodes.select(F.col("ord").alias("root"), F.col("node_id").alias("survivor_id")), "root").select("survivor_id", "removed_id", "ord")


def merge_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Keeps the rows that are their own root. labels: ord, root (one row per row of nodes that is in a group; others stay).

    A survivor's source ids are followed by those of the removed rows in order, each followed by its node id, without repeats;
    its own list stays as it is. Only the columns that are merged are shuffled.
    """
    extra = (
        nodes.select("ord", "node_id", "source_ids").join(labels.filter("ord <> root"), "ord")
        .groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.coalesce("source_ids", F.array().cast("array<string>")), F.array("node_id")).alias("s")))).alias("x"))
        .select(F.col("root").alias("ord"), F.array_distinct(F.flatten(F.transform("x", lambda e: e["s"]))).alias("more"))
    )
    kept = nodes.join(labels.filter("ord <> root").select("ord"), "ord", "left_anti").join(extra, "ord", "left")
    own = F.coalesce("source_ids", F.array().cast("array<string>"))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return kept.withColumns(
        {
            "source_ids": F.when(F.col("more").isNull(), F.col("source_ids")).otherwise(F.concat(own, F.array_except("more", own))),
            "flags": F.when(F.col("more").isNull(), F.col("flags")).otherwise(F.when(F.array_contains(flags, FLAG), flags).otherwise(F.concat(flags, F.array(F.lit(FLAG))))),
        }
    ).drop("more")


def key_labels(nodes: DataFrame, key: Column) -> DataFrame:
    """ord, root for rows that share a key. Keys are counted first, so only repeated ones are joined, and no window sorts a hot key."""
    keyed = stage(nodes.select("ord", key.alias("k")), "keys")  # a key may be costly, and is used twice
    roots = keyed.groupBy("k").agg(F.min("ord").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(roots, keyed["k"].eqNullSafe(roots["k"])).select("ord", "root")


def dedup_by_key(nodes: DataFrame, key: Column) -> DataFrame:
    return merge_labels(nodes, key_labels(nodes, key))


def text_key(config: NormalizeConfig | None = None, column: str = "text") -> Column:
    return sha1_key(normalize_text(F.coalesce(F.col(column), F.lit("")), config))


def exact_dedup(nodes: DataFrame, config: NormalizeConfig | None = None) -> DataFrame:
    """Rows whose normalized texts are equal; null counts as empty."""
    return dedup_by_key(nodes, text_key(config))


def structured_key(fields: list[str]) -> Column:
    return F.to_json(F.array(*[F.coalesce(F.col("metadata")[f], F.lit("")) for f in fields]))


def structured_dedup(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that agree in all metadata fields; a missing field counts as empty."""
    return dedup_by_key(nodes, structured_key(fields))


#: The constants by which hashes are mixed.
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[k]
    return h ^ (h >> np.uint64(29))


class _WordHashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[w] = xxhash.xxh64_intdigest(w)
        return v


def _grams(texts: list[str], n: int, known: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of words, as functions.text.shingles() has them but with repeats, and the row of each."""
    split = [t.split() for t in texts]  # Python's white space is that of functions.text.WS
    size = np.array([len(u) for u in split], dtype=np.int64)
    flat = np.array([known[w] for u in split for w in u], dtype=np.uint64)
    row = np.repeat(np.arange(len(split)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # words from here on to the end of the row
    short = np.repeat(size, size) < n  # these give one shingle of all words
    first = np.ones(len(flat), dtype=bool)
    first[1:] = row[1:] != row[:-1]
    at = np.flatnonzero(np.where(short, first, left >= n))
    h, many = flat[at], np.minimum(left[at], n)
    for j in range(1, n):
        more = many > j
        h[more] = _mixed(h[more], 0) + flat[at[more] + j]
    return _mixed(h ^ _mixed(many.astype(np.uint64), 1), 2), row[at]


#: Words of 64 bits in the parity sketches of a set: those that go with every shingle of a prefix, and those of candidates.
SKETCH, LONG_SKETCH = 2, 16


def _parities(u: np.ndarray, start: np.ndarray, words: int) -> list[np.ndarray]:
    """By word, for the elements from each start to the next one."""
    bit, word = np.uint64(1) << (u & np.uint64(63)), (u >> np.uint64(6)) % np.uint64(words)
    return [np.bitwise_xor.reduceat(np.where(word == np.uint64(i), bit, np.uint64(0)), start) if len(start) else np.zeros(0, dtype=np.uint64) for i in range(words)]


def _sketches(sets: DataFrame) -> DataFrame:
    """ord, size, x: long sketches of sets (ord, size, s), none of them empty."""

    def part(batches):
        for b in batches:
            s = b.column("s")
            size = s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.stack(_parities(s.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(size) - size, LONG_SKETCH), axis=1).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("ord"), b.column("size"), pa.ListArray.from_arrays(np.arange(0, len(x) + 1, LONG_SKETCH, dtype=np.int32), pa.array(x))], ["ord", "size", "x"])

    return sets.filter("size > 0").mapInArrow(part, f"ord {sets.schema['ord'].dataType.simpleString()}, size int, x array<long>")


def _sets(docs: DataFrame, n: int, char: bool, column: str) -> DataFrame:
    """ord, size, h1, h2, x0, x1, s: the set of a row's shingles as sorted hashes, two hashes of the set, and its sketch: bit b of it
    is the parity of the elements with that place, so two sketches differ in no more bits than the sets in elements."""
    c = F.coalesce(F.col(column), F.lit(""))
    of = docs.select("ord", F.transform(shingles(c, n, True), lambda s: F.xxhash64(s)).alias("t") if char else c.alias("t"))
    kind = of.schema["ord"].dataType.simpleString()

    def part(batches):
        known = _WordHashes()
        for b in batches:
            t = b.column("t")
            if char:
                h, row = t.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(t)), t.value_lengths().to_numpy(zero_copy_only=False))
            else:
                h, row = _grams(t.to_pylist(), n, known)
            h = h.view(np.int64)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[new], row[new]
            size = np.bincount(row, minlength=len(t))
            some, u = size > 0, h.view(np.uint64)
            start = (np.cumsum(size) - size)[some]
            own = [np.add.reduceat(_mixed(u, k), start) if len(start) else np.zeros(0, dtype=np.uint64) for k in (0, 1)] + _parities(u, start, SKETCH)
            cols = [b.column("ord"), pa.array(size.astype(np.int32))]
            for v in own:
                out = np.zeros(len(t), dtype=np.uint64)
                out[some] = v
                cols.append(pa.array(out.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(h))], ["ord", "size", "h1", "h2", "x0", "x1", "s"])

    return of.mapInArrow(part, f"ord {kind}, size int, h1 long, h2 long, x0 long, x1 long, s array<long>")


def near_pairs(docs: DataFrame, threshold: float = 0.85, n: int = 3, char: bool = False, column: str = "text", blanks: bool = True, without: DataFrame | None = None) -> DataFrame:
    """ord_a < ord_b, jaccard: all pairs of rows whose shingle sets have at least this similarity; exact.

    Prefix filtering: with shingles in one order, similar sets share one among their first size - ceil(t * size) + 1; the order is
    from rare to frequent, by counts in a table of fixed size (any order is exact, this one keeps the join small).
    So frequent shingles never meet in the join. Rows with equal sets are joined once, through their first row. Rows without any
    shingle are similar to each other (1.0); they are linked to the first of them (with blanks=False to none). without: ord of rows
    that are left aside.

    The sets are written once and never shuffled as a whole: what moves are prefixes. Whether a pair can be similar is told in the
    join, by where in the order it meets and by the sketches; the sets of what is left alone are fetched and compared.
    """
    sets = stage(_sets(docs, n, char, column), "shingles")
    left = (lambda df: df) if without is None else (lambda df: df.join(without, "ord", "left_anti"))
    ids = left(sets.select("ord", "size", "h1", "h2"))
    heads = ids.groupBy("size", "h1", "h2").agg(F.min("ord").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    equal = stage(ids.join(heads, ["size", "h1", "h2"]).filter("ord <> head").select("head", "ord", "size"), "equal")
    prefix = left(_prefixes(sets, threshold, ["x0", "x1"]).join(equal.select("ord"), "ord", "left_anti"))
    prefix = stage(prefix, "prefixes")
    a, b = (prefix.select("g", *[F.col(c).alias(f"{c}_{x}") for c in ("ord", "size", "at", "x0", "x1")]) for x in "ab")
    both, shared = F.col("size_a") + F.col("size_b"), threshold / (1 + threshold)
    # The first shingle that two sets share in the order has all others behind it in both.
    first = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= shared * both - 1e-9
    bits = F.bit_count(F.col("x0_a").bitwiseXOR(F.col("x0_b"))) + F.bit_count(F.col("x1_a").bitwiseXOR(F.col("x1_b")))
    length = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9
    cand = stage(a.join(b, "g").filter((F.col("ord_a") < F.col("ord_b")) & length & first & (bits <= (1 - 2 * shared) * both + 1e-9)).select("ord_a", "ord_b").distinct(), "candidates")
    # Sets of a few hundred shingles fill the short sketches; what is left is told by long ones.
    long_ = _sketches(_among(sets.select("ord", "size", "s"), cand.select(F.explode(F.array("ord_a", "ord_b")).alias("ord"))))
    of = lambda x: long_.select(*[F.col(c).alias(f"{c}_{x}") for c in ("ord", "size", "x")])
    differ = F.aggregate(F.zip_with("x_a", "x_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    cand = stage(cand.join(of("a"), "ord_a").join(of("b"), "ord_b").filter(differ <= (1 - 2 * shared) * both + 1e-9).select("ord_a", "ord_b"), "candidates")
    inter = F.size(F.array_intersect("sa", "sb"))
    some = _among(sets.select("ord", "s"), cand.select(F.explode(F.array("ord_a", "ord_b")).alias("ord")))
    near = (
        cand.join(some.select(F.col("ord").alias("ord_a"), F.col("s").alias("sa")), "ord_a").join(some.select(F.col("ord").alias("ord_b"), F.col("s").alias("sb")), "ord_b")
        .select("ord_a", "ord_b", (inter / (F.size("sa") + F.size("sb") - inter)).alias("jaccard")).filter(F.col("jaccard") >= threshold)
    )
    same = equal.filter("true" if blanks else "size > 0").select(F.col("head").alias("ord_a"), F.col("ord").alias("ord_b"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(same)


#: Counters (as a power of two) by which shingles are ordered.
COUNTERS_LOG2 = 20


def _among(rows: DataFrame, ords: DataFrame) -> DataFrame:
    """Rows whose ord is in ords, and a few others that share a place with one in a table of fixed size: for a join that would else
    shuffle all of them."""
    slot = F.pmod(F.hash("ord"), F.lit(1 << COUNTERS_LOG2))
    table = np.zeros(1 << COUNTERS_LOG2, dtype=bool)
    table[ords.select(slot.alias("slot")).distinct().toPandas()["slot"]] = True
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(table))

    def part(batches):
        seen = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            yield b.filter(pa.array(seen[b.column("_slot").to_numpy()])).drop_columns("_slot")

    return rows.withColumn("_slot", slot).mapInArrow(part, rows.schema)


def _prefixes(sets: DataFrame, threshold: float, also: list[str] | None = None) -> DataFrame:
    """ord, size, g, at: of each set (ord, s) the shingles among which a similar set must share one, and their place in the order.
    Those seen once match nothing. also: columns of longs that are taken along."""
    slot = F.pmod(F.col("g"), F.lit(1 << COUNTERS_LOG2)).cast("int")
    counts = sets.select(F.explode("s").alias("g")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # a table of fixed size
    table = np.zeros(1 << COUNTERS_LOG2, dtype=np.int64)
    table[counts["slot"]] = counts["n"]
    shared = sets.sparkSession.sparkContext.broadcast(np.minimum(table, np.iinfo(np.int32).max).astype(np.int32))
    also = also or []

    def part(batches):
        seen = shared.value
        for b in batches:
            s = b.column("s")
            size, flat = s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), s.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(s)), size)
            n = seen[flat & ((1 << COUNTERS_LOG2) - 1)]
            order = np.lexsort((flat, n, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            keep = place < np.repeat(size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, size)
            keep &= n[order] > 1
            at = order[keep]
            of = pa.array(row[at])
            cols = [b.column("ord").take(of), pa.array(size[row[at]].astype(np.int32)), pa.array(flat[at]), pa.array(place[keep].astype(np.int32)), *[b.column(c).take(of) for c in also]]
            yield pa.RecordBatch.from_arrays(cols, ["ord", "size", "g", "at", *also])

    kind = sets.schema["ord"].dataType.simpleString()
    return sets.select("ord", "s", *also).mapInArrow(part, f"ord {kind}, size int, g long, at int" + "".join(f", {c} long" for c in also))


def all_pairs(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Spreads links of near_pairs() over equal sets: ord_a < ord_b, jaccard for all pairs of rows with any shingle."""
    same = links.filter("jaccard = 1.0").select(F.col("ord_b").alias("ord"), F.col("ord_a").alias("head"))
    every = docs.select("ord").join(same, "ord", "left").select("ord", F.coalesce("head", "ord").alias("head"))
    a, b = every.select(F.col("head").alias("ha"), F.col("ord").alias("x")), every.select(F.col("head").alias("hb"), F.col("ord").alias("y"))
    cross = links.filter("jaccard < 1.0").select(F.col("ord_a").alias("ha"), F.col("ord_b").alias("hb"), "jaccard").join(a, "ha").join(b, "hb").select("x", "y", "jaccard")
    within = a.join(b, F.col("ha") == F.col("hb")).filter("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return cross.unionByName(within).select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"), "jaccard")


def components(edges: DataFrame, a: str = "ord_a", b: str = "ord_b", max_rounds: int = 60) -> DataFrame:
    """ord, root: connected components by their smallest member, for all rows that have an edge.

    Alternating large-star and small-star steps: each round sends a node's neighbours to the smallest of them, which halves
    distances, so the rounds grow with the logarithm of the diameter. Every round is written out; only a count comes to the driver.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = stage(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = stage(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("ord"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("ord"), "root").distinct())


def near_labels(nodes: DataFrame, threshold: float = 0.85, n: int = 3, char: bool = False, config: NormalizeConfig | None = None, without: DataFrame | None = None) -> DataFrame:
    """ord, root of the rows of nodes that have near duplicates (transitively). without: ord of rows that are left aside."""
    docs = nodes.select("ord", normalize_text(F.coalesce(F.col("text"), F.lit("")), config).alias("text"))
    return components(near_pairs(docs, threshold, n, char, without=without))


def near_dedup(nodes: DataFrame, threshold: float = 0.85, n: int = 3, char: bool = False, config: NormalizeConfig | None = None) -> DataFrame:
    """Clusters of near duplicates (transitively) keep their first row."""
    return merge_labels(nodes, near_labels(nodes, threshold, n, char, config))
