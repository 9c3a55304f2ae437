"""Problem 10: the reading level of each document of English or Chinese prose, on the scale of graded examples.

For each language and level an interpolated bigram model is trained on the graded documents. The surprisals of all sentences of
a document under the four models are its distribution: their quantiles, under each model against the mean of all, and the mean
of the levels that the sentences speak for. A ridge regression of these is the difficulty, which isotonic regression (fitted on
documents that neither models nor regression had seen) maps to the graded levels.

All graded documents are learned from, in the cluster: counts, products of features and bins of difficulty are sums of integers
over rows, of a fixed size whatever the corpus, so the model does not depend on how the data are split.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .canon import Canonical, fit
from .lang import FUNCTION_WORDS

#: Levels, hash sizes, and the weight of bigrams against single words.
LEVELS, UNI, BI, LAMBDA = 4, 1 << 15, 1 << 18, 0.7
#: Parts of the graded documents that are judged by models of the others.
FOLDS = 5
#: Units in which counts, features and difficulties are integers, and counts that are summed in one task.
UNIT, FINE, BINS, SLICE = 2520, 4096, 1024, 1 << 16
#: Quantiles of a document's sentences, and the weight that holds their influence down.
QUANTILES, RIDGE = (0.1, 0.3, 0.5, 0.7, 0.9), 3.0
#: Characters of prose that a document must have, tokens after which a sentence is cut where marks are missing.
LEAST, LONG = 60, 40
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[.!?;\n]|\d+")
_ZH = re.compile(r"[㐀-鿿]|[。！？；!?;\n]|[A-Za-z]+|\d+")
_STOP = frozenset(".!?;\n。！？；")
_LANG = ("en", "zh")
_HAN = re.compile(r"[㐀-鿿]")
_OTHERS = re.compile(r"[äöüßñáíóú¿¡ÄÖÜ]")


class Reader:
    """Token ids and sentence numbers of running prose; ids are hashes, so no vocabulary is kept."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.speaks = np.zeros((UNI, len(FUNCTION_WORDS)), dtype=np.int8)
        for k, words in enumerate(FUNCTION_WORDS.values()):
            self.speaks[[self._id(w) for w in words.split()], k] = 1

    @staticmethod
    def _id(t: str) -> int:
        return 0 if t in _STOP else 1 if t[0].isdigit() else 2 + zlib.crc32(t.lower().encode()) % (UNI - 2)

    def _ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        try:
            return np.array([known[t] for t in tokens], dtype=np.int64)
        except KeyError:
            known.update({t: self._id(t) for t in set(tokens) if t not in known})
            return np.array([known[t] for t in tokens], dtype=np.int64)

    def read(self, form: str) -> tuple[str, np.ndarray, np.ndarray] | None:
        """Language, ids and sentences of a text; None if it is too short, or no running prose of English or Chinese.

        English needs at least eight words and function words of its own, more than those of other languages; Chinese needs
        40 Chinese characters that are two fifths of the text. Titles, dumps of values or code and other languages have neither.
        """
        if len(form) < LEAST:
            return None
        han = 0 if form.isascii() else len(_HAN.findall(form))
        if han >= 40 and han >= 0.4 * len(form):
            lang, ids = "zh", self._ids(_ZH.findall(form))
        else:
            lang, ids = "en", self._ids(_WORD.findall(form.lower()))
            spoken = self.speaks[ids].sum(axis=0)
            en, others = spoken[0], max(spoken[1:]) + (0 if form.isascii() else len(_OTHERS.findall(form)) / 3)
            words = int((ids > 1).sum())
            if words < 8 or en < max(2, 0.06 * words) or en < others or words < 0.5 * len(ids) or han > 0.3 * words:
                return None
        stop = ids == 0
        sentence = np.cumsum(stop) - stop
        start = np.maximum.accumulate(np.where(np.r_[True, sentence[1:] != sentence[:-1]], np.arange(len(ids)), 0))
        cut = (np.arange(len(ids)) - start) // LONG
        return lang, ids, np.cumsum(np.r_[0, (sentence[1:] != sentence[:-1]) | (cut[1:] != cut[:-1])])


def pairs(ids: np.ndarray) -> np.ndarray:
    return (np.r_[0, ids[:-1]] * 40503 + ids * 2654435761) % BI


def counted(ids: np.ndarray, level: float, flat: np.ndarray) -> None:
    """Adds a document to the counts (words, contexts, bigrams; by level) in units. A level between two grades counts for both."""
    at = np.concatenate([ids, UNI + np.r_[0, ids[:-1]], 2 * UNI + pairs(ids)]) * LEVELS
    for k in {int(np.floor(level)), int(np.ceil(level))}:
        np.add.at(flat, at + (k - 1), round((1 - abs(level - k)) * UNIT))


class Levels:
    """Probabilities of words and bigrams at each level of one language, from counts as counted() makes them."""

    def __init__(self, flat: np.ndarray):
        uni, ctx, bi = np.split(flat.reshape(-1, LEVELS) / UNIT, [UNI, 2 * UNI])
        self.single = ((1 - LAMBDA) * (uni + 0.05) / (uni.sum(axis=0) + 0.05 * UNI)).astype(np.float32)
        self.context, self.pair = np.maximum(ctx, 1e-9).astype(np.float32), bi.astype(np.float32)

    def distribution(self, ids: np.ndarray, sentence: np.ndarray) -> np.ndarray | None:
        """The distribution of surprisals over the whole document, as FEATURES numbers; None without a word."""
        if not len(ids):
            return None
        # Bigrams may share a place of the table, but none is more frequent than its context.
        s = np.log(LAMBDA * np.minimum(self.pair[pairs(ids)] / self.context[np.r_[0, ids[:-1]]], 1) + self.single[ids])
        s[ids < 2] = 0
        starts = np.nonzero(np.r_[True, sentence[1:] != sentence[:-1]])[0]
        total = np.add.reduceat(s, starts, axis=0)
        n = np.diff(np.r_[starts, len(ids)])
        e = np.exp(total - total.max(axis=1, keepdims=True))
        mean = (e / e.sum(axis=1, keepdims=True)) @ np.arange(1, LEVELS + 1)
        each = -total / n[:, None]
        each -= each.mean(axis=1, keepdims=True)
        each.sort(axis=0)
        at = np.minimum((np.array(QUANTILES) * len(each)).astype(int), len(each) - 1)
        return np.r_[1.0, (mean * n).sum() / n.sum(), each[at].ravel()]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums from which ridge() works: features with features and with the levels, as integers (in units of FINE)."""
    xy = np.rint(np.c_[x, y] * FINE).astype(np.int64)
    return xy.T @ xy


def ridge(sums: np.ndarray) -> np.ndarray:
    """Weights of the features; what is known of the mean level is kept before the rest is learned."""
    z = sums / FINE**2
    scale = np.r_[0.0, 0.0, np.full(len(z) - 3, RIDGE)]
    return np.linalg.solve(z[:-1, :-1] + np.diag(scale + 1e-6), z[:-1, -1])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least squares fit by pooling adjacent violators: block ends of x and their values. w: weights."""
    order = np.argsort(x, kind="stable")
    w = np.ones(len(x)) if w is None else w
    blocks: list[list[float]] = []  # sum, weight, last x
    for i in order.tolist():
        blocks.append([y[i] * w[i], w[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, n, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + n, last]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def difficulty(d: np.ndarray, weights: np.ndarray) -> float:
    return float(np.rint(np.clip(d @ weights, -LEVELS, 2 * LEVELS) * BINS) / BINS)


class Grader:
    """level(text) is 1 to 4, or None where the text is no prose of a known language. By language: models, weights of the features
    and the curve from difficulty to level."""

    def __init__(self, canon: dict[str, int], levels: dict[str, Levels], weights: dict[str, np.ndarray], curve: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.canon, self.levels, self.weights, self.curve = canon, levels, weights, curve
        self.model, self.reader = Canonical(canon), Reader()

    def __reduce__(self):
        return Grader, (self.canon, self.levels, self.weights, self.curve)

    def level(self, text: str | None) -> int | None:
        if not text or len(text) < LEAST:
            return None
        form = self.model(text)
        got = self.reader.read(form)
        if got is None or got[0] not in self.levels:
            return None
        lang, *tokens = got
        d = self.levels[lang].distribution(*tokens)
        if d is None:
            return None
        ends, values = self.curve[lang]
        at = min(int(np.searchsorted(ends, difficulty(d, self.weights[lang]))), len(ends) - 1)
        return int(np.clip(np.floor(values[at] + 0.5), 1, LEVELS))


def _tokens(docs: DataFrame, grades: DataFrame, canon: dict[str, int]) -> DataFrame:
    """lang, fold, level, ids, sentences of every graded document that can be read."""
    shared = docs.sparkSession.sparkContext.broadcast(canon)

    def part(batches):
        model, reader = Canonical(shared.value), Reader()
        for b in batches:
            rows = [(fold, level, reader.read(model(t))) for t, fold, level in zip(b["text"], b["fold"], b["level"], strict=True)]
            yield pd.DataFrame(
                [(got[0], fold, level, got[1].astype(np.uint16).tobytes(), got[2].astype(np.int32).tobytes()) for fold, level, got in rows if got],
                columns=["lang", "fold", "level", "ids", "sentences"],
            )

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = docs.select("doc_id", "text").filter(f"length(text) >= {LEAST}").join(grades, "doc_id").select("text", "level", fold)
    return stage(rows.mapInPandas(part, "lang string, fold int, level double, ids binary, sentences binary"), "graded")


def _read(b: pd.DataFrame):
    for lang, fold, level, ids, sentences in zip(b["lang"], b["fold"], b["level"], b["ids"], b["sentences"], strict=True):
        yield lang, fold, level, np.frombuffer(ids, dtype=np.uint16).astype(np.int64), np.frombuffer(sentences, dtype=np.int32)


def _counts(tokens: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The counts of each language and fold. A task sends what it saw in slices, which are added up in the cluster."""

    def part(batches):
        flat: dict = {}
        for b in batches:
            for lang, fold, level, ids, _ in _read(b):
                if (lang, fold) not in flat:
                    flat[lang, fold] = np.zeros((2 * UNI + BI) * LEVELS, np.int64)
                counted(ids, level, flat[lang, fold])
        for (lang, fold), n in flat.items():
            at = np.nonzero(n)[0]
            cut = np.searchsorted(at, np.arange(0, len(n) + SLICE, SLICE))
            own = [(lang, fold, k, at[x:y].astype(np.int32).tobytes(), n[at[x:y]].tobytes()) for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if x < y]
            yield pd.DataFrame(own, columns=["lang", "fold", "slice", "at", "n"])

    def summed(b):
        first = int(b["slice"].iloc[0]) * SLICE
        total = np.zeros(SLICE, np.int64)
        for at, n in zip(b["at"], b["n"], strict=True):
            total[np.frombuffer(at, dtype=np.int32) - first] += np.frombuffer(n, dtype=np.int64)
        at = np.nonzero(total)[0]
        return b.iloc[:1].assign(at=[(at + first).astype(np.int32).tobytes()], n=[total[at].tobytes()])

    kind = "lang string, fold int, slice int, at binary, n binary"
    out: dict = {}
    for r in tokens.mapInPandas(part, kind).groupBy("lang", "fold", "slice").applyInPandas(summed, kind).collect():
        flat = out.setdefault((r.lang, r.fold), np.zeros((2 * UNI + BI) * LEVELS, np.int64))
        flat[np.frombuffer(r.at, dtype=np.int32)] = np.frombuffer(r.n, dtype=np.int64)
    return out


def _features(tokens: DataFrame, models: dict[tuple[str, int], Levels]) -> DataFrame:
    """lang, fold, level, x: the features of graded documents under models (of their language and fold) that have not seen them."""
    shared = tokens.sparkSession.sparkContext.broadcast(models)  # tables of fixed size for each language and fold

    def part(batches):
        m = shared.value
        for b in batches:
            rows = [(lang, fold, level, m[lang, fold].distribution(ids, s)) for lang, fold, level, ids, s in _read(b) if (lang, fold) in m]
            yield pd.DataFrame([(a, f, v, x.tobytes()) for a, f, v, x in rows if x is not None], columns=["lang", "fold", "level", "x"])

    return stage(tokens.mapInPandas(part, "lang string, fold int, level double, x binary"), "features")


def _matrix(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), dtype=np.float64).reshape(len(x), -1)


def _products(features: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """products() of each language and fold."""

    def part(batches):
        total: dict = {}
        for b in batches:
            for key, some in b.groupby(["lang", "fold"]):
                total[key] = total.get(key, 0) + products(_matrix(some["x"]), some["level"].to_numpy())
        yield pd.DataFrame([(*k, i, n) for k, z in total.items() for i, n in enumerate(z.ravel().tolist())], columns=["lang", "fold", "i", "n"])

    out: dict = {}
    for r in features.mapInPandas(part, "lang string, fold int, i int, n long").groupBy("lang", "fold", "i").agg(F.sum("n").alias("n")).collect():
        out.setdefault((r.lang, r.fold), {})[r.i] = r.n
    size = 3 + LEVELS * len(QUANTILES)
    return {k: np.array([z[i] for i in range(size * size)], dtype=np.int64).reshape(size, size) for k, z in out.items()}


def _curves(features: DataFrame, weights: dict[tuple[str, int], np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The isotonic map of each language, from sums over bins of difficulty."""
    shared = features.sparkSession.sparkContext.broadcast(weights)

    def part(batches):
        for b in batches:
            b = b[[k in shared.value for k in zip(b["lang"], b["fold"], strict=True)]]
            d = [difficulty(x, shared.value[k]) for k, x in zip(zip(b["lang"], b["fold"], strict=True), _matrix(b["x"]) if len(b) else [], strict=True)]
            yield pd.DataFrame({"lang": b["lang"].to_numpy(), "d": np.array(d, dtype=float), "y": np.rint(b["level"].to_numpy() * UNIT).astype(np.int64)})

    sums = features.mapInPandas(part, "lang string, d double, y long").groupBy("lang", "d").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
    by: dict = {}
    for r in sorted(sums, key=lambda r: (r.lang, r.d)):
        by.setdefault(r.lang, []).append((r.d, r.y / UNIT / r.n, r.n))
    return {lang: isotonic(*np.array(rows, dtype=float).T) for lang, rows in by.items()}


def trained(docs: DataFrame, labels: DataFrame) -> Grader:
    """Grades of one document are averaged; null and impossible grades are left out. Every graded document is learned from."""
    grades = labels.filter(F.col("reading_level").between(1, LEVELS)).groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    canon = fit(docs, "text")
    tokens = _tokens(docs, grades, canon)
    counts = _counts(tokens)
    total = {lang: sum(n for (x, _), n in counts.items() if x == lang) for lang in _LANG if any(x == lang for x, _ in counts)}
    rest = {k: total[k[0]] - n for k, n in counts.items()}
    features = _features(tokens, {k: Levels(n) for k, n in rest.items() if n.any()})
    sums = _products(features)
    every = {lang: sum(z for (x, _), z in sums.items() if x == lang) for lang in {x for x, _ in sums}}
    # The regression, too, is judged on documents that it has not seen.
    curve = _curves(features, {k: ridge(every[k[0]] - z) for k, z in sums.items() if (every[k[0]] - z).any()})
    plain = np.r_[0.0, 1.0, np.zeros(LEVELS * len(QUANTILES))], (np.arange(1.0, LEVELS + 1), np.arange(1.0, LEVELS + 1))
    return Grader(
        canon, {lang: Levels(n) for lang, n in total.items()}, {lang: ridge(every[lang]) if lang in curve else plain[0] for lang in total}, {lang: curve.get(lang, plain[1]) for lang in total}
    )


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, reading_level (1 to 4) of each document that is English or Chinese prose. Null, blank and short texts, titles, dumps and
    texts in other languages are left out; without any usable grade nothing is returned."""
    grader = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(grader)  # hash tables of fixed size

    def part(batches):
        g = shared.value
        for b in batches:
            out = pd.DataFrame({"doc_id": b["doc_id"], "reading_level": [g.level(t) for t in b["text"]]})
            yield out.dropna().astype({"reading_level": "int64"})

    return docs.select("doc_id", "text").mapInPandas(part, "doc_id long, reading_level long")
