"""Problem 5: near-duplicate records with small edits, by vantage-point trees over fingerprints.

Rows with one bag of words are one class. Each class has a 1024-bit fingerprint whose Hamming distance never exceeds the size
of the symmetric difference of the bags. Near texts of a and b words (a <= b) differ in at most a - 0.6 b elements, which bounds
their Hamming distance: the search radius is exact, so no near pair can be lost.

The tree: the first vantage point is the empty text, from which the distance is the length (bands of ratio 1.25, so partners
lie in the same or the next band); below it, vantage points from a bounded sample of fingerprints split at the median
distance. A class has one home leaf and queries every leaf that the triangle bounds cannot rule out. Leaves are held in blocks
and queries come in parts, so that every task compares at most BLOCK homes with about as many queries, whatever the size of a band. Within a block a product
of projected fingerprints rules out most pairs: a projection never lengthens a distance, so it loses none either.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import components
from ..session import stage
from .canon import Canonical, fit
from .near import BITS, SHARE, Bags, bag_id, expanded, fingerprints, long_enough, own_bits, script, verified
from .sample import bounded

#: Fingerprints from which vantage points are chosen (a bound, whatever the corpus), classes wanted in a leaf, classes that a
#: task holds at once.
SAMPLE, LEAF, BLOCK = 3000, 30000, 30000
#: Bits of the bitmap that tells which rows take the exact test (a fixed size; bits set in vain only cost a comparison).
FILTER_BITS = 1 << 23
WORDS = BITS // 64
#: Homes from which a task rules pairs out by axes, axes at most, queries and homes that are multiplied at once, pairs tested at once.
MANY, AXES, ROWS, COLUMNS, TESTED = 2000, 128, 512, 1024, 4096


def _place() -> Column:
    return F.pmod(F.xxhash64("tbl", "ord"), F.lit(FILTER_BITS))


def placed(df: DataFrame, model: Canonical) -> np.ndarray:
    """The bits of elements from a bounded sample of texts."""
    bags, groups = Bags(model), [[], []]
    texts = [r.text for r in bounded(df.filter("length(text) >= 50"), SAMPLE, "text", keys=("tbl", "ord"))]
    h, n, han = bags.hashed(texts)
    e, ends = bags.elements(h, n), np.cumsum(n).tolist()
    for x, y, own in zip([0, *ends], ends, (2 * han > n).tolist(), strict=False):
        groups[own].append(e[x:y])
    return own_bits(groups)


def bagged(df: DataFrame, model: Canonical, wanted: np.ndarray | None = None, places: np.ndarray | None = None) -> DataFrame:
    """tbl, ord, text -> tbl, ord, cid, n, script, fp, els for the rows long enough to be near another. els is the bag.

    wanted: a bitmap of FILTER_BITS bits; only rows whose place is set are treated, and only they have els.
    places: the bits of elements, as of placed().
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.counts, wanted, places))

    def part(batches):
        counts, bitmap, bits = shared.value
        bags = Bags(Canonical(counts))
        for whole in batches:
            if bitmap is not None:
                at = whole["place"].to_numpy()
                whole = whole[(bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            for i in range(0, len(whole), 2000):
                some = whole.iloc[i : i + 2000]
                h, n, han = bags.hashed(some["text"])
                keep = long_enough(n, han)
                h, n, han = h[np.repeat(keep, n)], n[keep], han[keep]
                if not len(n):
                    continue
                e = bags.elements(h, n)
                ends = np.cumsum(n).tolist()
                els = [e[x:y] for x, y in zip([0, *ends], ends, strict=False)]
                out = {"tbl": some["tbl"].to_numpy()[keep], "ord": some["ord"].to_numpy()[keep]}
                if bitmap is None:
                    yield pd.DataFrame(out | {"cid": [bag_id(x) for x in els], "n": n.astype(np.int32), "script": script(n, han), "fp": [x.tobytes() for x in fingerprints(e, n, bits)]})
                else:
                    yield pd.DataFrame(out | {"els": [x.tobytes() for x in els]})

    # A text with too few characters cannot have enough words.
    rows = df.filter("length(text) >= 50").select("tbl", "ord", "text", *([] if wanted is None else [_place().cast("long").alias("place")]))
    return rows.mapInPandas(part, "tbl string, ord long, cid binary, n int, script byte, fp binary" if wanted is None else "tbl string, ord long, els binary")


def band(n: int) -> int:
    """Near texts lie in one band or in neighbouring ones: b <= 1.25 a."""
    return int(math.log(n) / math.log(1 / SHARE) + 1e-9)


def radius(n: int) -> int:
    """Bound of the symmetric difference of a text of n words and any longer near one."""
    return int((2 - 2 * SHARE) * n + 1e-9)


def distances(fps: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps ^ to).sum(axis=-1, dtype=np.int32)


def plant(fps: np.ndarray, leaves: int, seed: int) -> list:
    """A vantage-point tree of about ``leaves`` leaves from sampled fingerprints: [vantage point, median, inside, outside] or a leaf's number."""
    count = [0]

    def grow(rows: np.ndarray, want: int, rng) -> list | int:
        if want <= 1 or len(rows) < 8:
            count[0] += 1
            return count[0] - 1
        # Of a few candidates take the one whose distances spread most.
        some = rows[rng.choice(len(rows), min(5, len(rows)), replace=False)]
        vp = max(some, key=lambda v: float(np.std(distances(rows, v))))
        d = distances(rows, vp)
        mid = int(np.median(d))
        near, far = rows[d <= mid], rows[d > mid]
        if not len(near) or not len(far):
            count[0] += 1
            return count[0] - 1
        return [vp, mid, grow(near, (want + 1) // 2, rng), grow(far, want // 2, rng)]

    return grow(fps, leaves, np.random.default_rng(seed))


def count_leaves(tree: list | int) -> int:
    return 1 if isinstance(tree, int) else count_leaves(tree[2]) + count_leaves(tree[3])


def leaves_of(tree, fp: np.ndarray, r: int) -> tuple[int, list[int]]:
    """The home leaf of a fingerprint, and all leaves that can hold one within ``r`` of it."""
    home, found, todo = -1, [], [(tree, True)]
    while todo:
        t, at_home = todo.pop()
        if isinstance(t, int):
            found.append(t)
            home = t if at_home else home
            continue
        d = int(np.bitwise_count(t[0] ^ fp).sum())
        if d - r <= t[1]:
            todo.append((t[2], at_home and d <= t[1]))
        if d + r > t[1]:
            todo.append((t[3], at_home and d > t[1]))
    return home, found


def _sampled(reps: DataFrame) -> list:
    return bounded(reps, SAMPLE, "tbl", "script", "n", "fp", keys=("tbl", "cid"))


def shards(reps: DataFrame) -> tuple[DataFrame, list[str]]:
    """For every class its home rows (kind 0) and the rows with which it queries (kind 1): shard, block, part, kind, n, cid, fp; and
    the table of each shard. A home is repeated for every part of the queries of its shard, a query for every block of homes."""
    of_band = F.expr(f"cast(floor(ln(n) / ln({1 / SHARE}) + 1e-9) as int)")
    sizes = {(r.tbl, r.script, r.b): r.c for r in reps.groupBy("tbl", "script", of_band.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}
    by: dict = {}
    for r in _sampled(reps):
        by.setdefault((r.tbl, r.script, band(r.n)), []).append(np.frombuffer(r.fp, dtype=np.uint64))
    trees, tables = {}, []
    for k in sorted(sizes):
        tbl, own_script, b = k
        own = np.array(by.get(k, [])).reshape(-1, WORDS)
        want = -(-sizes[k] // LEAF)
        tree = plant(own, want, 7)
        leaves = count_leaves(tree)
        asking = sum(sizes.get((tbl, s, x), 0) for s in range(3) if abs(s - own_script) < 2 for x in (b, b - 1))
        trees[k] = (len(tables), tree, max(1, -(-sizes[k] // (BLOCK * leaves))), max(1, -(-asking // BLOCK)))
        tables += [tbl] * leaves
    shared = reps.sparkSession.sparkContext.broadcast(trees)  # at most SAMPLE vantage points

    def part(batches):
        for batch in batches:
            out = []
            for tbl, own, n, cid, raw in zip(batch.tbl, batch.script, batch.n, batch.cid, batch.fp, strict=True):
                fp = np.frombuffer(raw, dtype=np.uint64)
                for other in range(3):
                    for step in (0, 1):
                        got = shared.value.get((tbl, other, band(n) + step)) if abs(own - other) < 2 else None
                        if got is None:
                            continue
                        start, tree, blocks, parts = got
                        home, found = leaves_of(tree, fp, radius(n))
                        if step == 0 and other == own:
                            out += [(start + home, cid % blocks, k, 0, n, cid, raw) for k in range(parts)]
                        out += [(start + leaf, k, cid // blocks % parts, 1, n, cid, raw) for leaf in found for k in range(blocks)]
            if out:
                yield pd.DataFrame(out, columns=["shard", "block", "part", "kind", "n", "cid", "fp"])

    return reps.select("tbl", "script", "n", "cid", "fp").mapInPandas(part, "shard int, block int, part int, kind byte, n int, cid long, fp binary"), tables


def folded(fps: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints (words x fingerprints) folded by exclusive or: still parity bits, so the bound of the distance holds."""
    return np.bitwise_xor.reduce(fps.reshape(WORDS // words, words, -1), axis=0)


def within(h: np.ndarray, folds: dict[int, np.ndarray], lo: int, hi: int, q: np.ndarray, n: int, most: np.ndarray) -> np.ndarray:
    """Columns lo to hi of h whose distance to q is at most ``most``. A folded fingerprint first rules out almost all:
    256 bits tell short texts apart, 512 longer ones."""
    r, words = radius(n), 4 if n <= 200 else 8 if n <= 450 else WORDS
    if words not in folds:
        folds[words] = np.ascontiguousarray(folded(h, words))
    own = folded(q[:, None], words)
    c = np.bitwise_count(folds[words][:, lo:hi] ^ own)
    if words == 4:
        d = c[0] + c[1]
        d += c[2]
        d += c[3]  # 256 would wrap to 0, which the second test catches
    else:
        d = c.sum(axis=0, dtype=np.uint16)
    some = np.nonzero(d <= r)[0]
    if len(some):
        d = np.bitwise_count(h[:, lo + some] ^ q[:, None]).sum(axis=0, dtype=np.int64)
        some = some[d <= n - most[lo + some]]
    return some + lo


def unpacked(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8), axis=1).astype(np.float32)


def axes(fps: np.ndarray, n: np.ndarray) -> np.ndarray | None:
    """Orthonormal axes (bits x axes) along which sampled fingerprints (a row each, ordered by n) differ most: along them no two are
    further apart than their distance. As many as cost least by the pairs that they leave in the other half of the sample; None if comparing words of bits does."""
    at = np.linspace(0, len(fps) - 1, min(len(fps), 2 * MANY)).astype(np.int64)
    x = unpacked(fps[at])
    x -= x.mean(axis=0)
    x, at, judged = x[::2], at[1::2], x[1::2]
    rng = np.random.default_rng(7)
    v = rng.standard_normal((BITS, AXES), dtype=np.float32)
    for _ in range(4):
        v = np.linalg.qr(x.T @ (x @ v))[0]
    v = v @ np.linalg.eigh(v.T @ (x.T @ (x @ v)))[1][:, ::-1]
    v = np.ascontiguousarray(np.linalg.qr(v)[0])
    # Pairs of like length: places in the order of n that are not far apart.
    i = rng.integers(0, len(at), 4000)
    j = np.minimum(i + rng.integers(1, max(2, len(at) // 4), len(i)), len(at) - 1)
    i, j = i[i < j], j[i < j]
    z = judged @ v
    d = np.cumsum((z[i] - z[j]) ** 2, axis=1)
    left = (d <= (n[at[i]] - (2 * SHARE - 1) * n[at[j]])[:, None]).mean(axis=0)
    # In ns a pair, as measured: what a product has besides, an axis, a test of all bits; a comparison of words.
    cost = 1 + 0.03 * np.arange(1, AXES + 1) + 120 * left
    k = int(cost.argmin())
    return np.ascontiguousarray(v[:, : k + 1]) if cost[k] < 12 else None


def where(b: np.ndarray) -> np.ndarray:
    """The places of the few that are true, eight looked at together."""
    b = b.reshape(-1)
    if len(b) % 8:
        return np.flatnonzero(b)
    at = np.flatnonzero(np.packbits(b))
    k = np.flatnonzero(b.reshape(-1, 8)[at])
    return at[k >> 3] * 8 + (k & 7)


class Homes:
    """The homes of a block, ordered by n, and the pairs of queries and homes whose fingerprints are as close as those of near texts."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda x: x[:2])
        self.n = np.array([x[0] for x in rows], dtype=np.int64)
        self.most = np.floor((2 * SHARE - 1) * self.n - 1e-9).astype(np.int64)
        self.id = np.array([x[1] for x in rows], dtype=np.int64)
        self.fp = np.frombuffer(b"".join(x[2] for x in rows), dtype=np.uint64).reshape(-1, WORDS)
        self.columns, self.folds = None, {}
        self.axes = axes(self.fp, self.n) if len(rows) >= MANY else None
        if self.axes is not None:
            # -2 xy + (xx - n) + (yy + most) <= 0 is one product; the middle of the axes is put to 0, so that values are small.
            self.middle = unpacked(self.fp[:: max(1, len(rows) // MANY)]).mean(axis=0) @ self.axes
            self.right = np.empty((self.axes.shape[1] + 2, len(rows)), dtype=np.float32)
            for i in range(0, len(rows), COLUMNS):
                y = self.along(self.fp[i : i + COLUMNS])
                self.right[:-2, i : i + COLUMNS] = y.T
                self.right[-1, i : i + COLUMNS] = (y * y).sum(axis=1) + self.most[i : i + COLUMNS]
            self.right[-2] = 1

    def along(self, fps: np.ndarray) -> np.ndarray:
        return unpacked(fps) @ self.axes - self.middle

    def close(self, n: np.ndarray, fps: np.ndarray):
        """Per few queries (n, and fingerprints, a row each): places among the queries and among the homes. Each pair is found from
        the shorter text."""
        lo, hi = np.searchsorted(self.n, n), np.searchsorted(self.n, (n / SHARE + 1e-9).astype(np.int64), side="right")
        if self.axes is None:
            if self.columns is None:
                self.columns = np.ascontiguousarray(self.fp.T)
            for i in np.nonzero(lo < hi)[0].tolist():
                k = within(self.columns, self.folds, int(lo[i]), int(hi[i]), fps[i], int(n[i]), self.most)
                yield np.full(len(k), i), k
            return
        order = np.argsort(n, kind="stable")
        for at in range(0, len(order), ROWS):
            q = order[at : at + ROWS]
            x = self.along(fps[q])
            left = np.column_stack([-2 * x, (x * x).sum(axis=1) - n[q], np.ones(len(q), dtype=np.float32)]).astype(np.float32)
            # Rounding: of sums of at most AXES + 2 values of 32 bits.
            slack = np.float32(0.1 + 4e-5 * (BITS + n[q[-1]] / SHARE))
            for c in range(int(lo[q].min()), int(hi[q].max()), COLUMNS):
                end = min(c + COLUMNS, int(hi[q].max()))
                i, j = np.divmod(where(left @ self.right[:, c:end] <= slack), end - c)
                i, j = q[i], j + c
                fit = (j >= lo[i]) & (j < hi[i])
                i, j = i[fit], j[fit]
                for s in range(0, len(i), TESTED):
                    a, b = i[s : s + TESTED], j[s : s + TESTED]
                    d = self.fp.take(b, axis=0)
                    d ^= fps.take(a, axis=0)
                    near = np.bitwise_count(d).sum(axis=1, dtype=np.int64) <= n[a] - self.most[b]
                    yield a[near], b[near]


def _searching(tables: list[str]):
    def search(batches):
        """Rows sorted by shard, block, part, kind: the homes of a block are held, the queries stream past them."""
        at, rows, homes = None, [], None
        for batch in batches:
            keys = batch[["shard", "block", "part", "kind"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for x, y in zip(starts, [*starts[1:], len(keys)], strict=True):
                *key, kind = keys[x].tolist()
                n, cid, raw = (batch[c].iloc[x:y] for c in ("n", "cid", "fp"))
                if key != at:
                    at, rows, homes = key, [], None
                if kind == 0:
                    rows += zip(n.tolist(), cid.tolist(), raw, strict=True)
                    continue
                if not rows:
                    continue
                homes = homes or Homes(rows)
                n, cid = n.to_numpy(np.int64), cid.to_numpy(np.int64)
                for i, k in homes.close(n, np.frombuffer(b"".join(raw), dtype=np.uint64).reshape(-1, WORDS)):
                    # Of texts of one length the pair is found from the smaller id.
                    keep = (homes.n[k] > n[i]) | (homes.id[k] > cid[i])
                    if keep.any():
                        yield pd.DataFrame({"tbl": tables[key[0]], "cid_a": cid[i[keep]], "cid_b": homes.id[k[keep]]})

    return search


def searched(reps: DataFrame) -> DataFrame:
    """reps: tbl, script, n, cid, fp. Pairs (tbl, cid_a, cid_b) whose fingerprints are as close as those of near texts."""
    rows, tables = shards(reps)
    key = ("shard", "block", "part")
    return rows.repartition(*key).sortWithinPartitions(*key, "kind").mapInPandas(_searching(tables), "tbl string, cid_a long, cid_b long")


def bitmap(pairs: DataFrame) -> np.ndarray:
    """The places of both sides of candidate pairs (tbl, cid_a, cid_b) in a bitmap of fixed size."""
    place = pairs.select("tbl", F.explode(F.array("cid_a", "cid_b")).alias("ord")).select(_place().alias("p"))
    parts = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(bigint(1), cast(p & 63 as int))")).alias("b")).collect()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for w, b in parts:
        out[w] = b
    return out.view(np.uint8)


def near_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df: tbl, ord, text. Returns members (tbl, ord, cid) and links (tbl, cid_a, cid_b) between different classes.

    The id of a class is the smallest ord of its rows. Rows without text or with too few words belong to no class. Equal texts
    share a class, whatever their number.
    """
    model = Canonical(fit(df, "text"))
    rows = stage(bagged(df, model, places=placed(df, model)), "bags")
    heads = rows.groupBy("tbl", "cid").agg(F.min("ord").alias("head"))
    members = rows.select("tbl", "ord", "cid").join(heads, ["tbl", "cid"]).select("tbl", "ord", F.col("head").alias("cid"))
    reps = stage(rows.join(heads.select("tbl", "cid", F.col("head").alias("ord")), ["tbl", "cid", "ord"], "left_semi").select("tbl", F.col("ord").alias("cid"), "n", "script", "fp"), "classes")
    pairs = stage(searched(reps), "candidates")
    bags = bagged(df, model, bitmap(pairs)).withColumnRenamed("ord", "cid")
    return stage(members, "members"), stage(verified(pairs, bags), "links")


def texts(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    pick = lambda df, name: df.select(F.lit(name).alias("tbl"), F.col("ord").cast("long").alias("ord"), "text").filter("text is not null")
    return pick(raw, "raw_records").unionByName(pick(nodes, "knowledge_nodes"))


def found(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of rows of one table with near texts: tbl, ord_a, ord_b."""
    df = texts(raw, nodes)
    return expanded(*near_classes(df))


def groups(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per row that has a class: tbl, ord, class_ord (smallest ord of its equal texts), n_copies, n_links (classes near to its
    own), group_ord (smallest ord of all rows that links between classes connect with it)."""
    df = texts(raw, nodes)
    members, links = near_classes(df)
    degree = links.select("tbl", F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("tbl", "cid").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = members.groupBy("tbl", "cid").agg(F.count(F.lit(1)).alias("n_copies"))
    # A class is named by its smallest ord; one number tells class and table.
    node = lambda c: (F.col(c) * 2 + (F.col("tbl") == "knowledge_nodes").cast("long"))
    linked = components(links.select(node("cid_a").alias("ord_a"), node("cid_b").alias("ord_b")))
    root = linked.select(F.when(F.pmod("ord", F.lit(2)) == 1, "knowledge_nodes").otherwise("raw_records").alias("tbl"), F.floor(F.col("ord") / 2).alias("cid"), F.floor(F.col("root") / 2).alias("group_ord"))
    heads = sizes.join(degree, ["tbl", "cid"], "left").join(root, ["tbl", "cid"], "left")
    return members.join(heads, ["tbl", "cid"]).select("tbl", "ord", F.col("cid").alias("class_ord"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group_ord", "cid").alias("group_ord"))
