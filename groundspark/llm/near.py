"""What problems 2 and 5 share: the words of a text, its bag of words, and the exact test for near texts.

Two texts are near if the words they share, counted with repeats, are at least 0.8 of the words of the longer one, and each
has at least 50 words, or 90 if more than half of its words are Chinese characters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .canon import Canonical

SHARE, LEAST, LEAST_HAN = 0.8, 50, 90
HAN = "㐀-䶿一-鿿豈-﫿𠀀-𲎯"
_WORD = re.compile(rf"[{HAN}]|[^\W_{HAN}]+")
_IS_HAN = re.compile(rf"[{HAN}]")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a fingerprint, and of an element those that tell its bit.
BITS, CELLS = 1024, 18


def words(form: str) -> list[str]:
    return _WORD.findall(form.lower())


class _Known(dict):
    """48-bit hashes of words; the lowest bit tells whether the word is a Chinese character."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = (xxhash.xxh64_intdigest(word) >> 16) & ~1 | bool(_IS_HAN.match(word))
        return h


class Bags:
    """Turns texts into hashed words and bags. The n-th repeat of a word is an element of its own, so a bag is a set."""

    def __init__(self, model: Canonical):
        self.model, self.known = model, _Known()

    def hashed(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in order, the number of words of each, and of those that are Chinese characters."""
        flat: list[int] = []
        sizes = []
        get, model = self.known.__getitem__, self.model
        for t in texts:
            w = words(model(t))
            sizes.append(len(w))
            flat += map(get, w)
        h, n = np.array(flat, dtype=np.uint64), np.array(sizes, dtype=np.int64)
        han = np.bincount(np.repeat(np.arange(len(n)), n), weights=(h & np.uint64(1)).astype(float), minlength=len(n))
        return h, n, han.astype(np.int64)

    @staticmethod
    def elements(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sorted bags of many texts as 32-bit hashes, one after the other. Two words meet in one hash with a chance of about
        1 to 4 billion a pair."""
        row = np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(48)
        s = np.sort(row | h)
        start = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, dtype=bool)
        place = np.arange(len(s))
        nth = (place - np.maximum.accumulate(np.where(start, place, 0))).astype(np.uint64)
        e = ((s & np.uint64((1 << 48) - 1)) * _GOLD + nth * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        e ^= e >> np.uint64(29)
        e = (e * _GOLD) >> np.uint64(32)
        return np.sort(row >> np.uint64(16) | e).astype(np.uint32)


def long_enough(n, han):
    return n >= np.where(2 * han > n, LEAST_HAN, LEAST)


def script(n, han):
    """0: at most a quarter of the words are Chinese characters, 2: at least three quarters, 1: between. Texts of 0 and 2 are
    never near: they would differ in more than half of the words of the longer one."""
    return np.where(4 * han <= n, 0, np.where(4 * han >= 3 * n, 2, 1)).astype(np.int8)


def fingerprints(e: np.ndarray, n: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """Parity bits of bags, a row of bytes each: every element flips one bit, so the Hamming distance of two fingerprints is at
    most the size of the symmetric difference of the bags, whatever bit an element has. places: see own_bits()."""
    bit = e & np.uint32(BITS - 1) if places is None else places[e >> np.uint32(32 - CELLS)]
    at = np.repeat(np.arange(len(n), dtype=np.int64) * BITS, n) + bit
    return np.packbits((np.bincount(at, minlength=len(n) * BITS) & 1).astype(np.uint8).reshape(len(n), BITS), axis=1)


def own_bits(groups: list[list[np.ndarray]]) -> np.ndarray:
    """The bit of every cell of elements (their first CELLS bits). The most frequent elements of the sampled bags have bits of
    their own, which keeps unrelated fingerprints further apart; those of one group (a script) share none. As many are given out
    as leave four bits for each other element of a mean bag, or the most bits for each."""
    ranked, own = [], BITS
    for bags in groups:
        if not bags:
            continue
        cell, times = np.unique(np.concatenate(bags) >> np.uint32(32 - CELLS), return_counts=True)
        order = np.lexsort((cell, -times))
        ranked.append(cell[order])
        k = np.arange(BITS - 63)
        other = (times.sum() - np.r_[0, np.cumsum(times[order]), np.full(BITS, times.sum())][: len(k)]) / len(bags)
        room = (BITS - k) / np.maximum(other, 1e-9)
        own = min(own, int(k[room >= 4].max() if (room >= 4).any() else room.argmax()))
    own = own if ranked else 0
    out = (own + (np.arange(1 << CELLS, dtype=np.uint64) * _GOLD >> np.uint64(40)) % np.uint64(BITS - own)).astype(np.uint16)
    for cells in ranked:
        out[cells[:own]] = np.arange(len(cells[:own]))
    return out


def bag_id(e: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(e.tobytes())


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted bags share; equal hashes within a bag count as often as both have them."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    same = both[1:] == both[:-1]
    if not (a[1:] == a[:-1]).any() and not (b[1:] == b[:-1]).any():
        return int(same.sum())
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[i], cb[j]).sum())


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
        out.append(shared(x, y) >= SHARE * max(len(x), len(y)) - 1e-9)
    return pd.Series(out, dtype=bool)


def near(a: Column, b: Column) -> Column:
    """The exact test on two bags."""
    return _near(a, b)


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Of candidate pairs (tbl, cid_a, cid_b) those that are near. bags: tbl, cid, els; one row per class."""
    used = pairs.select("tbl", F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
    few = stage(bags.join(used, ["tbl", "cid"], "left_semi").select("tbl", "cid", "els"), "few")
    return (
        pairs.join(few.select("tbl", F.col("cid").alias("cid_a"), F.col("els").alias("els_a")), ["tbl", "cid_a"])
        .join(few.select("tbl", F.col("cid").alias("cid_b"), F.col("els").alias("els_b")), ["tbl", "cid_b"])
        .filter(near(F.col("els_a"), F.col("els_b")))
        .select("tbl", "cid_a", "cid_b")
    )


def expanded(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of rows (tbl, ord_a, ord_b; ord_a < ord_b) that links between classes and membership in one class stand for.

    members: tbl, ord, cid; one row per row of the table. Members of a class are joined by its id; a hot class is split by
    the adaptive skew join, and every pair is written once.
    """
    a = members.select("tbl", F.col("cid").alias("cid_a"), F.col("ord").alias("x"))
    b = members.select("tbl", F.col("cid").alias("cid_b"), F.col("ord").alias("y"))
    multiple = members.groupBy("tbl", "cid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tbl", F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"), F.lit(True).alias("same"))
    both = multiple.unionByName(links.withColumn("same", F.lit(False)))
    return (
        both.join(a, ["tbl", "cid_a"])
        .join(b, ["tbl", "cid_b"])
        .filter("not same or x < y")
        .select("tbl", F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"))
    )
