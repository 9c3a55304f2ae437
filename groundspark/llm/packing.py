"""Problem 9: documents into containers of fixed capacity, by bulk-synchronous best-fit.

A document larger than the capacity fills containers of its own; only its last part is an item. Items and gaps are integers up
to the capacity, so both are first summed to size classes: at most ``capacity`` of each, however large the corpus, which is what
the rounds exchange. In each round the open sizes, largest first, sweep over the sorted gaps for their successors (the smallest
gap that holds them); where classes meet at a gap the larger size ranks first; gaps are updated, and the rounds repeat until
nothing fits, when the largest size opens containers. A round settles runs of containers at once. Every document then finds its
container from its rank within its size class, which is worked out in salted parts, so no task sorts a hot size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .tokenizers import FOLDER, counter

#: Parts (at least) in which the documents of one size are ranked, documents of a part, and ranks of a size that meet their runs in one task.
SALTS, PART, RANKS = 64, 50_000, 4096


def plan(sizes: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """sizes: (size, number of items), 0 < size <= capacity. Returns runs (size, first rank, items, first container, items a container).

    Ranks and containers count from 0. Best-fit decreasing over size classes: the result is that of placing each item alone.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, number)
    order: list[int] = []  # the gaps, sorted
    out, fresh = [], 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    for size, items in sorted(sizes, reverse=True):
        rank = 0
        while items:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                # Filling a container on is the best fit as long as it holds another item: what is left is smaller than any other fitting gap.
                per = min(gap // size, items)
            else:
                gap, first, per = capacity, fresh, min(capacity // size, items)
                number = -(-items // per)
                fresh += number if items >= per * number else items // per + (items % per > 0)
            full = min(number, items // per)
            out.append((size, rank, full * per, first, per))
            put(gap - size * per, first, full)
            rank, items = rank + full * per, items - full * per
            if number > full:
                if items and at >= len(order) and gap == capacity:
                    out.append((size, rank, items, first + full, items))
                    put(gap - size * items, first + full, 1)
                    put(gap, first + full + 1, number - full - 1)
                    rank, items = rank + items, 0
                else:
                    put(gap, first + full, number - full)
    return out


def sized(docs: DataFrame, tokenizers: list[str], folder: str = FOLDER) -> DataFrame:
    """doc_id, tokenizer, tokens; null and empty texts have 0 tokens."""

    def part(batches):
        counters = [(t, counter(t, folder)) for t in tokenizers]
        for whole in batches:
            for i in range(0, len(whole), 1000):
                b = whole.iloc[i : i + 1000]
                for name, c in counters:
                    yield pd.DataFrame({"doc_id": b["doc_id"], "tokenizer": name, "tokens": [c.count(t) for t in b["text"]]})

    return docs.select("doc_id", "text").mapInPandas(part, "doc_id long, tokenizer string, tokens long")


def packed(docs: DataFrame, capacities: DataFrame, folder: str = FOLDER) -> DataFrame:
    """capacity_id, doc_id, part, container_id, tokens: one row per document and capacity, more for documents larger than the capacity.

    part counts from 0. container_id counts from 0 per capacity: first those of split documents, numbered by the document, then the
    packed ones. Documents without tokens take no space and go to container 0. Capacities that are null or not positive, or
    have no tokenizer, pack nothing.
    """
    spark = docs.sparkSession
    caps = capacities.filter("capacity_tokens > 0 and tokenizer is not null and capacity_id is not null").select("capacity_id", "capacity_tokens", "tokenizer")
    wanted = [tuple(r) for r in caps.distinct().collect()]  # a table of fixed size
    if not wanted:
        return spark.createDataFrame([], "capacity_id int, doc_id long, part long, container_id long, tokens long")
    sizes = stage(sized(docs, sorted({t for *_, t in wanted}), folder), "sizes")
    salts = max(SALTS, -(-sizes.count() // PART))
    work = sizes.join(spark.createDataFrame(wanted, "capacity_id int, capacity long, tokenizer string"), "tokenizer")
    work = work.select(
        "capacity_id", "capacity", "doc_id", "tokens", F.expr("tokens div capacity").alias("whole"), F.expr("tokens % capacity").alias("rest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    )
    counts = stage(work.groupBy("capacity_id", "capacity", "rest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("w")), "sizeclasses")
    before = Window.partitionBy("capacity_id", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("capacity_id").orderBy("rest", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("capacity_id", "rest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("w").over(along), F.lit(0)).alias("wstart"))
    runs = []
    classes: dict[int, list[tuple[int, int]]] = {}
    wholes: dict[int, int] = {}
    for r in counts.groupBy("capacity_id", "rest").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():  # at most the sum of the capacities
        wholes[r.capacity_id] = wholes.get(r.capacity_id, 0) + r.w
        if r.rest:
            classes.setdefault(r.capacity_id, []).append((r.rest, r.n))
    for cid, capacity, _ in wanted:
        runs += [(cid, size, rank, rank + items, wholes.get(cid, 0) + first, per) for size, rank, items, first, per in plan(classes.get(cid, []), capacity)]
    run = spark.createDataFrame(runs, "capacity_id int, rest long, lo long, hi long, first long, per long") if runs else spark.createDataFrame([], "capacity_id int, rest long, lo long, hi long, first long, per long")
    own = Window.partitionBy("capacity_id", "rest", "salt").orderBy("doc_id")
    ranked = (
        work.withColumn("at", F.row_number().over(own) - 1)
        .withColumn("wat", F.coalesce(F.sum("whole").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(starts, ["capacity_id", "rest", "salt"])
        .select("capacity_id", "capacity", "doc_id", "tokens", "whole", "rest", (F.col("start") + F.col("at")).alias("rank"), (F.col("wstart") + F.col("wat")).alias("wfirst"))
    )
    # Runs are cut at blocks of ranks, so a hot size is joined block by block, and a document meets only the runs of its own block.
    run = run.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / RANKS), F.floor((F.col("hi") - 1) / RANKS))))
    items = (
        ranked.filter("rest > 0").withColumn("block", F.floor(F.col("rank") / RANKS)).join(run, ["capacity_id", "rest", "block"]).filter("rank >= lo and rank < hi")
        .select("capacity_id", "doc_id", F.col("whole").alias("part"), (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("long").alias("container_id"), F.col("rest").alias("tokens"))
    )
    split = ranked.filter("whole > 0").select("capacity_id", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("part"), "wfirst", "capacity").select("capacity_id", "doc_id", "part", (F.col("wfirst") + F.col("part")).alias("container_id"), F.col("capacity").alias("tokens"))
    empty = ranked.filter("tokens = 0").select("capacity_id", "doc_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("container_id"), "tokens")
    return items.unionByName(split).unionByName(empty)


def fill(packed_rows: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the least number of containers that the tokens need, and the share of space unused."""
    c = packed_rows.groupBy("capacity_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_items"))
    return c.join(capacities.select("capacity_id", "capacity_tokens", "tokenizer"), "capacity_id").select(
        "capacity_id", "tokenizer", "capacity_tokens", "n_items", "n_tokens", "n_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )
