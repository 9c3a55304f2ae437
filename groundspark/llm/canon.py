"""Problem 4: one consistent form for texts that look alike but differ in their characters.

1. Compatibility normalization, character by character: full-width forms, ligatures, radicals, exotic spaces and hyphens are
   folded; raised, lowered and fraction figures are kept, because a reader sees the difference.
2. Ignorable characters (zero width, soft hyphen, directional marks, variation selectors) are deleted.
3. Every maximal run of letters is a lattice: each position may be any member of its look-alike class. Viterbi finds the best
   path under character bigram scores of the corpus and a penalty for changing script. The lattice depends only on the
   look-alike classes, never on which member was written, so equal-looking tokens always get the same reading. Where Latin is
   the most usual script, a lattice that has a path of Latin letters throughout is read as that path, so that plain Latin tokens,
   which are left as they are, and those that look like them meet in one form.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of letters that look the same; the Latin letter first.
LOOKALIKES = (
    "aаɑ eе oоοօ pрρ cсϲ yуү xх sѕ iіı jјϳ hһհ dԁ qԛ wԝ vѵν lӏ gɡ uս "
    "AАΑ BВΒ EЕΕ KКΚ MМΜ HНΗ OОΟՕ PРΡ CСϹ TТΤ YҮΥ XХΧ SЅՏ IІΙӀ JЈ ZΖ NΝ GԌ WԜ QԚ"
).split()
# Radical forms that compatibility normalization leaves alone, and the characters they look like.
RADICALS = dict(zip("⺟⺠⻅⻉⻋⻓⻔⻙⻚⻛⻜⻝⻢⻤⻥⻦⻨⻩⻬⻮⻰⻳⻘⺝⺫⻄⻁⻆⻌⺼", "母民见贝车长门韦页风飞食马鬼鱼鸟麦黄齐齿龙龟青月目西虎角辶肉", strict=True))
# Hyphens that look like the plain one.
HYPHENS = "‐‑﹣－"

CLASS = {c: g for g in LOOKALIKES for c in g}
_KEEP = {"<super>", "<sub>", "<fraction>", "<circle>"}
_IGNORABLE = set(range(0x180B, 0x180F)) | set(range(0xFE00, 0xFE10)) | set(range(0xE0100, 0xE01F0)) | {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}
_SWITCH = -12.0


def _folding() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cf" or code in _IGNORABLE:
            table[code] = ""
        elif kind in ("Zs", "Zl", "Zp"):
            table[code] = "\n" if kind != "Zs" else " "
        elif (d := unicodedata.decomposition(c)).startswith("<") and d.split(" ", 1)[0] not in _KEEP:
            if (n := unicodedata.normalize("NFKC", c)) != c:
                table[code] = n
    table |= {ord(a): b for a, b in RADICALS.items()} | {ord(c): "-" for c in HYPHENS}
    return table | {0x85: "\n", 0x0B: "\n", 0x0C: "\n", 0x0D: "\n", 0x09: " "}


_FOLD = _folding()
# Full-width punctuation is usual in Chinese text: it is folded first, so that a text without other rare characters needs no more.
_USUAL = tuple((c, _FOLD[ord(c)]) for c in "，？（）：；！" if ord(c) in _FOLD)
_ODD = re.compile("[^ -~\n、。《》“”‘’—¿¡À-ÖØ-öø-ÿμ一-鿿]")
_SPACES = re.compile(r" +")
_LINES = re.compile(r" ?\n[ \n]*")
_FOREIGN = "".join(c for g in LOOKALIKES for c in g if ord(c) > 127)
_TOKEN = re.compile(rf"[A-Za-z̀-ͯÀ-ɏͰ-֏]*[{_FOREIGN}Ͱ-֏][A-Za-z̀-ͯÀ-ɏͰ-֏]*")
_LATIN = re.compile(r"[A-Za-z̀-ͯÀ-ɏ]*")
_WORDS = re.compile(r"[A-Za-zÀ-ɏͰ-֏]+")


def _script(c: str) -> str:
    o = ord(c)
    return "L" if o < 0x370 else "G" if o < 0x400 else "C" if o < 0x530 else "A"


def bigrams(texts: Iterable[str | None]) -> Counter:
    """Character bigrams of the words of ``texts``, with ``^`` and ``$`` for the ends of a word."""
    words: Counter = Counter()
    for t in texts:
        if t:
            words.update(_WORDS.findall(t))
    out: Counter = Counter()
    for w, n in words.items():
        w = f"^{w}$"
        for i in range(len(w) - 1):
            out[w[i : i + 2]] += n
    return out


def fit(df: DataFrame, column: str) -> dict[str, int]:
    """Bigram counts over every row. Each partition sends its sums; the result has at most (letters of three scripts)^2 entries."""

    def part(batches):
        total: Counter = Counter()
        for b in batches:
            total.update(bigrams(b[column]))
        if total:
            import pandas as pd

            yield pd.DataFrame({"gram": list(total), "n": list(total.values())})

    counts = df.select(column).where(F.col(column).isNotNull()).mapInPandas(part, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counts.collect()}


class Canonical:
    """``model(text)``: the consistent form of a text. None stays None; blank text becomes ''."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.first: Counter = Counter()
        scripts: Counter = Counter()
        for g, n in counts.items():
            self.first[g[0]] += n
            if g[0] not in "^$":
                scripts[_script(g[0])] += n
        total = sum(scripts.values()) + 4
        self.prior = {s: math.log((scripts[s] + 1) / total) for s in "LGCA"}
        # Where Latin is the most usual script, a token with a letter outside the look-alike classes, or of plain Latin
        # letters only, already is its own best reading.
        self.latin = max(self.prior, key=self.prior.get) == "L"
        self.known: dict[str, str] = {}

    def __reduce__(self):
        return Canonical, (self.counts,)

    def _score(self, a: str, b: str) -> float:
        return math.log((self.counts.get(a + b, 0) + 0.01) / (self.first.get(a, 0) + 5.0))

    def _viterbi(self, token: str) -> str:
        best = {"^": (0.0, "")}
        for c in token:
            if unicodedata.combining(c):
                best = {k: (s, p + c) for k, (s, p) in best.items()}
                continue
            nxt = {}
            for x in CLASS.get(c, c):
                options = []
                for y, (s, path) in best.items():
                    step = self.prior[_script(x)] if y == "^" else (_SWITCH if _script(y) != _script(x) else 0.0)
                    options.append((s + step + self._score(y, x), path + x))
                nxt[x] = max(options)
            best = nxt
        return max((s + self._score(k, "$"), p) for k, (s, p) in best.items())[1]

    def token(self, token: str) -> str:
        if (got := self.known.get(token)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            # Equal lattices have equal keys: the first member of each class.
            key = "".join(CLASS.get(c, c)[0] for c in token)
            if self.latin and _LATIN.fullmatch(key):
                got = self.known[token] = key
            else:
                got = self.known[token] = self.known.get("\0" + key) or self.known.setdefault("\0" + key, self._viterbi(key))
        return got

    def folded(self, text: str) -> str:
        """Steps 1 and 2, and the lattice search, without the joining of spaces."""
        if text.isascii() and self.latin:
            return text if text.isprintable() else text.translate(_FOLD)
        for a, b in _USUAL:
            text = text.replace(a, b)
        if self.latin and not _ODD.search(text):
            return text
        t = unicodedata.normalize("NFD", text.translate(_FOLD))
        if not t.isascii() or not self.latin:
            t = _TOKEN.sub(lambda m: self.token(m[0]), t) if self.latin else re.sub(r"[^\W\d_]+", lambda m: self.token(m[0]), t)
            t = unicodedata.normalize("NFC", t)
        return t

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        t = self.folded(text)
        if "  " in t:
            t = _SPACES.sub(" ", t)
        if "\n" in t:
            t = _LINES.sub("\n", t)
        return t.strip()


def with_form(df: DataFrame, model: Canonical, source: str, target: str) -> DataFrame:
    """Adds column ``target``: the consistent form of column ``source``."""
    shared = df.sparkSession.sparkContext.broadcast(model.counts)  # at most (letters of three scripts)^2 entries
    box: dict = {}

    @F.pandas_udf("string")
    def form(s):
        if "m" not in box:
            box["m"] = Canonical(shared.value)
        m = box["m"]
        return s.map(m, na_action="ignore")

    return df.withColumn(target, form(F.col(source)))
