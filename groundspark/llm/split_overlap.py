"""Problem 2: records of the held-out splits that recur in the training split, by content-defined chunks.

The words of a normalised report are cut where a rolling hash over two words hits a fixed residue, so an edit moves only the
cuts beside it; a third cutting takes the words in the order of their hashes, so it does not see in which order they stand. Chunk digests are joined across the splits; the shared lengths are summed to overlap fractions, and pairs above
a low fraction take the exact test for near texts. A digest that too many records share (a stock phrase) is not joined: all near pairs of records
that hold such a digest are searched by the fingerprints of problem 5 instead, whose radius is a true bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .canon import Canonical, fit
from .near import SHARE, Bags, bag_id, fingerprints, long_enough, verified
from .near_dups import searched

#: Mean and least words of a chunk (twice as many for Chinese, whose words are single characters), pairs that one digest may
#: give before its records are searched by fingerprints, and the fraction of shared words from which a pair takes the exact test.
MEAN, LEAST, HOT, FRACTION = 8, 3, 1000, 0.04
#: The same for the cutting of words in the order of their hashes, in which every edit falls somewhere else.
SORTED_MEAN, SORTED_LEAST = 4, 2
#: Two independent cuttings of each record in reading order: a pair whose edits fall into most chunks of the one keeps chunks of the other.
SALTS = (0, 0x5851F42D4C957F2D)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def chunks(h: np.ndarray, mean: int, least: int, salt: int | None = 0) -> list[tuple[int, int]]:
    """(digest, words) of the content-defined chunks of a sequence of hashed words. Without a salt a word alone decides on the cut."""
    before = np.r_[np.uint64(0), h[:-1]] if salt is not None else np.uint64(0)
    rolled = ((h ^ np.uint64(salt or 0)) * _A + before * _B) * np.uint64(0xD6E8FEB86659FD93)
    ends = (np.nonzero((rolled >> np.uint64(40)) % np.uint64(mean) == 0)[0] + 1).tolist()
    out, start = [], 0
    for end in [*ends, len(h)]:
        if end - start >= least or (end == len(h) and end > start):
            out.append((xxhash.xxh64_intdigest(h[start:end].tobytes()) - (1 << 63), end - start))
            start = end
    return out


def study(case_id: Column) -> Column:
    """Letters, year and number of a case id, however written; null where it has none of that form."""
    form = r"^\s*([A-Za-z]+)[^A-Za-z0-9:]*([0-9]{4})[^A-Za-z0-9:]*0*([0-9]+)\s*(?::.*)?$"
    return F.when(
        case_id.rlike(form),
        F.concat_ws("-", F.upper(F.regexp_extract(case_id, form, 1)), F.regexp_extract(case_id, form, 2), F.regexp_extract(case_id, form, 3)),
    )


def prepared(ct: DataFrame) -> DataFrame:
    """ord, split, source, train, key, cid, n, els, cuts: one row per row; cid and the following are null without a long enough report."""
    ct = ct.select(F.col("ord").cast("long").alias("ord"), "case_id", "report_text", "split", "source")
    counts = ct.sparkSession.sparkContext.broadcast(fit(ct, "report_text"))

    def part(batches):
        model = Canonical(counts.value)
        bags = Bags(model)
        for b in batches:
            for i in range(0, len(b), 2000):
                some = b.iloc[i : i + 2000].reset_index(drop=True)
                h, n, han = bags.hashed(some["report_text"].fillna(""))
                keep = long_enough(n, han)
                e, ends = bags.elements(h, n), np.cumsum(n)
                rows = []
                for k, (end, size) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
                    if keep[k]:
                        own, bag = h[end - size : end], e[end - size : end]
                        mean = MEAN * (2 if 2 * han[k] > size else 1)
                        cuts = [chunks(own, mean, LEAST, s) for s in SALTS] + [chunks(bag.astype(np.uint64), SORTED_MEAN, SORTED_LEAST, None)]
                        rows.append((bag_id(bag), size, bag.tobytes(), [[{"d": d, "w": w} for d, w in c] for c in cuts]))
                    else:
                        rows.append((None, None, None, None))
                forms = pd.DataFrame({"ord": some["ord"], "split": some["split"], "source": some["source"], "case_form": [model(c) for c in some["case_id"]]})
                yield pd.concat([forms, pd.DataFrame(rows, columns=["cid", "n", "els", "cuts"]).astype({"n": "Int32"})], axis=1)

    out = ct.mapInPandas(part, "ord long, split string, source string, case_form string, cid binary, n int, els binary, cuts array<array<struct<d:long,w:int>>>")
    return stage(out.select("ord", "split", "source", (F.col("split") == "train").alias("train"), study(F.col("case_form")).alias("key"), "cid", "n", "els", "cuts"), "reports")


def _close(classes: DataFrame) -> DataFrame:
    """Pairs a < b of classes (c, n, els) whose bags can be near by their fingerprints: all that are, whatever they share."""

    def part(batches):
        for b in batches:
            n = b["n"].to_numpy(np.int64)
            fp = fingerprints(np.frombuffer(b"".join(b["els"]), dtype=np.uint32), n)
            yield pd.DataFrame({"tbl": "ct", "script": np.int8(0), "n": n, "cid": b["c"], "fp": [x.tobytes() for x in fp]})

    reps = stage(classes.select("c", "n", "els").mapInPandas(part, "tbl string, script byte, n int, cid long, fp binary"), "hot")
    return stage(searched(reps), "close").select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def candidates(classes: DataFrame) -> DataFrame:
    """classes: c (id), n, t (has training rows), h (has held-out rows), els, cuts. Pairs a (held-out), b (training) of different classes."""
    keys = classes.select("c", "n", "t", "h", F.explode("cuts").alias("chunks")).select("c", "n", "t", "h", F.explode("chunks").alias("x")).select("c", "n", "t", "h", "x.d", "x.w")
    keys = stage(keys.groupBy("c", "n", "t", "h", "d").agg(F.max("w").alias("w")), "chunks")
    busy = keys.groupBy("d").agg(F.sum(F.col("t").cast("long")).alias("nt"), F.sum(F.col("h").cast("long")).alias("nh")).filter("nt > 0 and nh > 0 and nt + nh > 1")
    busy = stage(busy.select("d", (F.col("nt") * F.col("nh") > HOT).alias("hot")), "busy")
    use = keys.join(busy.filter("not hot").select("d"), "d", "left_semi")
    a = use.filter("h").select(F.col("c").alias("a"), F.col("n").alias("na"), "d", "w")
    b = use.filter("t").select(F.col("c").alias("b"), F.col("n").alias("nb"), "d")
    met = a.join(b, "d").filter(f"a <> b and least(na, nb) >= {SHARE} * greatest(na, nb) - 1e-9")
    cold = met.groupBy("a", "b", "na", "nb").agg(F.sum("w").alias("words")).filter(F.col("words") >= FRACTION * F.greatest("na", "nb")).select("a", "b")
    # Two records that share a hot chunk both hold one.
    holds = keys.join(busy.filter("hot").select("d"), "d", "left_semi").select("c").distinct()
    close = _close(classes.join(holds, "c", "left_semi"))
    sides = lambda x: classes.select(F.col("c").alias(x), F.col("t").alias(f"t{x}"), F.col("h").alias(f"h{x}"))
    cross = close.join(sides("a"), "a").join(sides("b"), "b")
    hot = cross.filter("ha and tb").select("a", "b").unionByName(cross.filter("ta and hb").select(F.col("b").alias("a"), F.col("a").alias("b")))
    return cold.unionByName(hot).distinct()


def overlaps(rows: DataFrame) -> DataFrame:
    """All cross-split pairs (held, train, by_case, by_text) of rows as in prepared()."""
    held, train = rows.filter("not train"), rows.filter("train")
    h, t = held.filter("key is not null").select("key", F.col("ord").alias("held")), train.filter("key is not null").select("key", F.col("ord").alias("train"))
    by_case = h.join(t, "key").select("held", "train", F.lit(True).alias("by_case"))

    texts = rows.filter("cid is not null")
    heads = texts.groupBy("cid").agg(F.min("ord").alias("c"), F.max("train").alias("t"), F.max(~F.col("train")).alias("h"))
    classes = stage(texts.select("cid", "n", "els", "cuts", F.col("ord").alias("c")).join(heads, ["cid", "c"]), "classes")
    pairs = candidates(classes)
    bags = classes.select(F.lit("ct").alias("tbl"), F.col("c").alias("cid"), "els")
    # One exact test per unordered pair.
    tested = verified(stage(pairs.select(F.lit("ct").alias("tbl"), F.least("a", "b").alias("cid_a"), F.greatest("a", "b").alias("cid_b")).distinct(), "candidates"), bags)
    links = tested.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(heads.filter("t and h").select(F.col("c").alias("a"), F.col("c").alias("b")))
    members = texts.join(heads.select("cid", "c"), "cid").select("ord", "c", "train")
    by_text = (
        both.join(members.filter("not train").select(F.col("c").alias("a"), F.col("ord").alias("held")), "a")
        .join(members.filter("train").select(F.col("c").alias("b"), F.col("ord").alias("train")), "b")
        .select("held", "train", F.lit(True).alias("by_text"))
    )
    return by_case.join(by_text, ["held", "train"], "full").select("held", "train", F.coalesce("by_case", F.lit(False)).alias("by_case"), F.coalesce("by_text", F.lit(False)).alias("by_text"))


def found(ct: DataFrame) -> DataFrame:
    """ord_a < ord_b: one row in train, the other in val or test, of one study or with near reports. Null ids and reports match nothing."""
    return overlaps(prepared(ct)).select(F.least("held", "train").alias("ord_a"), F.greatest("held", "train").alias("ord_b"))


def report(ct: DataFrame) -> DataFrame:
    """Per held-out split and source: rows, rows that overlap with train by case, by text, by either, and their pairs."""
    rows = prepared(ct)
    hits = overlaps(rows).groupBy(F.col("held").alias("ord")).agg(F.count(F.lit(1)).alias("pairs"), F.max("by_case").alias("by_case"), F.max("by_text").alias("by_text"))
    flag = lambda c: F.count(F.when(F.col(c), 1))
    return (
        rows.filter("not train").select("ord", "split", "source").join(hits, "ord", "left").groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("pairs").alias("n_overlapping"), flag("by_case").alias("n_by_case"), flag("by_text").alias("n_by_text"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )


def fractions(ct: DataFrame) -> DataFrame:
    """Per held-out row with a long enough report: the share of its words in chunks that some training report holds too."""
    rows = prepared(ct).filter("cid is not null")
    each = rows.select("ord", "split", "source", "train", "n", F.explode(F.col("cuts")[0]).alias("x")).select("ord", "split", "source", "train", "n", "x.d", "x.w")
    seen = each.filter("train").select("d").distinct().withColumn("seen", F.lit(True))
    return (
        each.filter("not train").join(seen, "d", "left").groupBy("ord", "split", "source", "n")
        .agg(F.sum(F.when(F.col("seen"), F.col("w")).otherwise(0)).alias("words"))
        .select("ord", "split", "source", F.col("n").alias("n_words"), (F.col("words") / F.col("n")).alias("overlap_fraction"))
    )
