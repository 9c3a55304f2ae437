"""Problem 7: personal details in free text, found by a character-level BiLSTM-CRF and replaced by typed placeholders.

Training: a bounded sample of texts is labelled by seed patterns; names are bootstrapped, from those that stand beside a cue to
all places where a part of them stands again. The network learns the spans from their surroundings.
Inference: the network reads every character of every text, in overlapping windows that are reconciled in one path. Spans that
cannot be what they were tagged as are dropped by an exact check.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .canon import _FOLD, _ODD, _TOKEN, _USUAL, CLASS, Canonical
from .sample import bounded
from .tagger import KINDS, Tagger

#: Texts to learn from (a bound, whatever the corpus), training steps, windows a step, characters of a window to learn from.
SAMPLE, STEPS, WINDOWS, LENGTH = 20000, 2500, 64, 96
#: Variations of a text with details that are learned from beside the text itself.
VARIED = 3
#: Characters that are treated at once.
AT_ONCE = 4_000_000
#: Bits (as a power of two) of the filter that tells usual words: a fixed size, whatever the vocabulary.
USUAL_LOG2 = 24
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

# Seed patterns and cues, in English, Chinese, German and Spanish.
_AT, _DOT = r" ?(?:@|[(\[] ?at ?[)\]]) ?", r" ?(?:\.|[(\[] ?dot ?[)\]]) ?"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+\-]*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)+", re.I)
PHONE = re.compile(
    r"(?<![A-Za-z0-9\-/])(?:\+\d{1,3}[ \-]?)?(?:\(\d{1,4}\) ?(?:/ ?)?)?\d{2,5}(?:[ \-./]{1,3}\d{3,8}){1,3}(?![A-Za-z0-9\-/]|\.\d)"
    r"|(?<!\d)(?:\+?86[ \-]?)?1[3-9]\d(?:[ \-]?\d{4}){2}(?!\d)|(?<!\d)\(0\)\d{3} / \d{6,8}(?!\d)"
)
ID = re.compile(r"(?<!\d)(?:\d{17}[\dXx]|\d{15})(?!\d)|(?<![A-Za-z0-9\-])\d{3}[ \-]\d{2}[ \-]\d{4}(?![A-Za-z0-9\-])|(?<![A-Za-z0-9\-])\d{3} \d{3} \d{4}(?![A-Za-z0-9\-])|(?<![A-Za-z0-9])[A-Z]{2} \d\d \d\d \d\d [A-Z](?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]\d{8}(?![A-Za-z0-9])")
_STREETS = "Lane|Ln|Street|St|Road|Rd|Avenue|Ave|Terrace|Drive|Dr|Close|Crescent|Court|Way|Place|Square|Boulevard|Row|Walk|Hill|Gardens|Grove|Mews|Parade"
_STREET = rf"(?:{_STREETS}|{_STREETS.upper()})"
_CAP = r"[A-ZÄÖÜ][A-Za-zäöüßáéíóúñ'’]+"
ADDRESS = re.compile(
    rf"(?:(?i:Apt|Flat|Unit|Suite)\.? \d+[A-Za-z]?, )?\d+[A-Za-z]? (?:{_CAP} ){{1,3}}{_STREET}\b\.?(?:, {_CAP}(?: {_CAP})?(?: (?:\d{{5}}|[A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}}))?)?"
    r"|(?:[一-鿿]{2}[市区县镇乡省岭])?[一-鿿]{1,3}[路街道巷里弄]\d+号(?:\d+(?:号|栋|幢|楼|单元|室|层|座))*",
)
_GOODS = re.compile(r"(?:\b(?:lot|batch|code|invoice|order|register entry|trial|shelf|sheet|range|scored|isbn|item|serial|barcode|charge|lote|rechnung|factura)\b|批号|条形码|编号|货号|发票|订货|登记试验|生产)[^\n.。;；]{0,14}$", re.I)
_PERSONAL = re.compile(r"(?:tel|telefon|telefono|teléfono|phone|mobile|call|ring|reach|llame|rückruf|on|caller|number|unter|al|电话|号码|来电|联系|手机|\(|（|/)[^\n.。]{0,12}$", re.I)
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|señor|señora|Sr|Sra)\.?"
_CUES = re.compile(
    rf"(?:\b{_TITLE} (?P<a>{_CAP}))|(?:(?:Patient(?:in)?|Paciente|Next of kin|Contact details|Registered as|Regards|Name|Ask|Signed|Written by|Dear)[:,]? (?P<b>{_CAP}(?: [A-Z]\.)?(?:,? {_CAP})?))"
    rf"|(?P<c>{_CAP}(?: [A-Z]\.)?,? {_CAP})(?=,? (?:phone |of \d|of (?:Apt|Flat)|<|\(ID|/ [\d(+]|, number|number ))"
)
_NOT_NAME = re.compile(r"\s+(?:test|scale|syndrome|disease|sign|score|index|criteria|method|reaction|classification|manoeuvre|procedure|stage|unit|ward|hospital|Street|Lane|Road|Avenue|Terrace|Drive|Close|Crescent|综合征|试验|征|病)\b", re.I)
SURNAMES = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏窦章苏潘葛范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于傅皮卞齐康伍余元卜顾孟黄穆萧尹姚邵汪祁毛禹狄米贝明臧计成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯管卢莫房裘解应宗丁宣邓郁单洪包左石崔吉龚程邢裴陆荣翁荀羊惠甄曲封芮储靳汲段焦巴弓侯蓬全郗班仰秋仲伊宫宁仇栾暴甘厉戎祖武符刘景詹束龙叶幸司韶黎薄印宿白怀蒲从鄂索咸籍赖卓蔺屠蒙池乔阴佘冉"
DOUBLE = "欧阳|尉迟|司徒|司马|上官|诸葛|夏侯|皇甫|东方|公孙|慕容|令狐|长孙|宇文|独孤|南宫|端木|轩辕"
_ZH = rf"(?:{DOUBLE}|[{SURNAMES}])"
_ZH_AFTER = r"(?=[,，]?(?:身份证|电话)|住在|家住|女士|先生|小姐|医生|护士|大夫|主任|自述|表示|来电|签字|\(1|（1|\(0|\(\+)"
ZH_NAME = re.compile(
    rf"(?P<a>{_ZH}[一-鿿]{{1,2}}?){_ZH_AFTER}|(?:联系人?[:：]?|请联系|家属|病人|记录人|签名[:：]?|我叫|我是|姓名[:：]\s*|本人)(?P<b>{_ZH}[一-鿿]{{1,2}})(?=[,，。、(（\s]|自述|表示|[:：]|$|[一-鿿])"
)


_HOMES = frozenset(("Apt", "Flat", "Unit", "Suite"))
# Words that are no part of a name.
_NO_PART = _HOMES | frozenset(
    "Ask Dear Signed Regards Patient Patientin Paciente Tel Phone Mobile Contact Name Registered Next Written Reply Invoice Lot Batch Order Trial National Passport Insured Address Email".split()
)


def _cap_words(t: str) -> list[str]:
    return re.findall(r"[A-Z][A-Za-zÀ-ɏ'’\-]+", t)


_NO_ONE = frozenset(("none", "yes", "no", "never"))


class Usual:
    """A filter of fixed size over the usual words: each sets two bits. A few other words are taken for usual, never the reverse."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << (USUAL_LOG2 - 3), dtype=np.uint8) if bits is None else bits

    @staticmethod
    def places(word: Column) -> Column:
        h, most = F.xxhash64(word), F.lit((1 << USUAL_LOG2) - 1)
        return F.array(h.bitwiseAND(most), F.shiftrightunsigned(h, USUAL_LOG2).bitwiseAND(most))

    @staticmethod
    def of(words: Iterable[str]) -> Usual:
        out = Usual()
        for w in words:
            for at in out._at(w):
                out.bits[at >> 3] |= 1 << (at & 7)
        return out

    @staticmethod
    def _at(word: str) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)  # as in Spark
        return h & ((1 << USUAL_LOG2) - 1), h >> USUAL_LOG2 & ((1 << USUAL_LOG2) - 1)

    def __contains__(self, word: str) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._at(word))


def known_word(w: str, usual: Usual) -> bool:
    return w in usual or w.capitalize() in usual


class Names:
    """Parts of names bootstrapped from cues."""

    def __init__(self, texts: Iterable[str], usual: Usual):
        parts, zh = Counter(), Counter()
        for t in texts:
            for m in _CUES.finditer(t):
                for w in re.findall(_CAP, m["a"] or m["b"] or m["c"] or ""):
                    parts[w.capitalize()] += 1
            for m in ZH_NAME.finditer(t):
                if m["a"]:
                    zh[m["a"]] += 1
        self.usual = usual
        self.parts = {w for w, n in parts.items() if n >= 2 and w not in usual and w not in _NO_PART}
        self.zh = {w for w, n in zh.items() if n >= 2}
        self.given = {re.sub(f"^{_ZH}", "", w) for w in self.zh} - {""}
        long_ = sorted((g for g in self.given if len(g) > 1), key=lambda g: (-len(g), g))
        # A usual surname before a given name of two characters needs no cue.
        self.whole = re.compile(f"{_ZH}(?:{'|'.join(long_)})") if long_ else None
        name = rf"(?:{_CAP}|[A-Z]{{2,}})"
        self.latin = re.compile(rf"\b{name}(?:(?: [A-Z]\.)?,? {name})*")

    def spans(self, t: str) -> list[tuple[int, int]]:
        out = []
        for m in self.latin.finditer(t):
            # The longest run of words that are parts of names, or unusual words beside such.
            run: list[tuple[int, int]] = []
            sure = False
            for w in [*re.finditer(r"[A-Z]\.|[A-Za-zÀ-ɏ'’]+", m[0]), None]:
                part = w is not None and w[0].capitalize() in self.parts
                if part or w is not None and w[0].capitalize() not in _NO_PART and (run and re.fullmatch(r"[A-Z]\.", w[0]) or len(w[0]) > 3 and not known_word(w[0], self.usual) and w[0].lower() not in self.usual):
                    run.append((m.start() + w.start(), m.start() + w.end()))
                    sure |= part
                    continue
                while run and re.fullmatch(r"[A-Z]\.", t[run[-1][0] : run[-1][1]]):
                    run.pop()
                if run and sure:
                    out.append((run[0][0], run[-1][1]))
                run, sure = [], False
        # Behind a title any word is a name.
        out += [m.span("a") for m in _CUES.finditer(t) if m["a"] and all(m.end("a") <= a or m.start("a") >= b for a, b in out)]
        out = [(a, b) for a, b in out if not _NOT_NAME.match(t[b:]) and t[a:b].lower() not in _NO_ONE]
        for m in ZH_NAME.finditer(t):
            a, b = m.span("a" if m["a"] else "b")
            if m["b"] and re.sub(f"^{_ZH}", "", m["b"]) not in self.given:
                if re.sub(f"^{_ZH}", "", m["b"])[:1] not in self.given:
                    continue
                b -= 1
            out.append((a, b))
        if self.whole:
            out += [m.span() for m in self.whole.finditer(t)]
        return out


def seed_spans(t: str, names: Names) -> list[tuple[int, int, str]]:
    """Labelled spans of a text by the seed patterns; of overlapping ones the first in the order of their reliability."""
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if a < b and all(b <= x or a >= y for x, y, _ in found):
            found.append((a, b, kind))

    for m in EMAIL.finditer(t):
        add(*m.span(), "email")
    for m in ADDRESS.finditer(t):
        add(*m.span(), "address")
    for m in ID.finditer(t):
        if not _GOODS.search(t[max(0, m.start() - 30) : m.start()]):
            add(*m.span(), "id_number")
    for m in PHONE.finditer(t):
        digits = sum(c.isdigit() for c in m[0])
        if 9 <= digits <= 15 and not _GOODS.search(t[max(0, m.start() - 30) : m.start()]) or digits >= 7 and _PERSONAL.search(t[max(0, m.start() - 16) : m.start()]):
            add(*m.span(), "phone")
    for a, b in names.spans(t):
        add(a, b, "name")
    return sorted(found)


# -- one form of a text with the place of every character in it


def aligned(text: str, model: Canonical) -> tuple[str, np.ndarray | None]:
    """The text in its consistent form, character by character, and the place of each character in the text (None: the same)."""
    if text.isascii():
        return text, None
    usual = text
    for a, b in _USUAL:
        usual = usual.replace(a, b)
    if not _ODD.search(usual):
        return usual, None
    chars, places = [], []
    for i, c in enumerate(text):
        for x in _FOLD.get(ord(c), c):
            chars.append(x)
            places.append(i)
    form = _TOKEN.sub(lambda m: model.token(m[0]), "".join(chars))
    return form, np.array(places, dtype=np.int64)


def reading() -> dict[int, str]:
    """How the network reads characters, one by one: folded ones as what they fold to, look-alikes as the first of their class."""
    fold = {code: to[:1] for code, to in _FOLD.items()}
    return {code: CLASS.get(to, to)[:1] for code, to in fold.items()} | {ord(c): g[0] for c, g in CLASS.items()}


# -- words of the corpus


# What stands before a span that is the name of a person however usual its words are.
_BEHIND_TITLE = re.compile(rf"\b{_TITLE}\s+(?:{_CAP},? |[A-Z]\. )*$|\b(?:Next of kin|Contact details|Registered as|Regards|Signed|Written by)[:,]?\s+$|\b(?:Patient(?:in)?|Paciente|Name)[:,]\s+$|\b(?:Ask|Dear)\s+$")
# Words that are no part of an address for mail; capitalised ones before and behind lower case.
_SURVEYED = re.compile(r"(?<![@._+\-A-Za-z0-9À-ɏͰ-֏])[A-Za-zÀ-ɏͰ-֏]++(?![@_+0-9]|\.[A-Za-z]| ?[@(\[] ?at)")
_BESIDE = re.compile(r"(?<![@._+\-A-Za-z0-9À-ɏͰ-֏])(?:(?<=[a-zß-ÿ] )()|)([A-ZÄÖÜ][A-Za-zÀ-ɏ]+)(?=( [a-zß-ÿ])?)")


def word_counts(texts: Iterable[str]) -> dict[str, list[int]]:
    """Uses of each word: all, before a lower-case word, and behind one."""
    total: Counter = Counter()
    beside: Counter = Counter()
    for t in texts:
        total.update(_SURVEYED.findall(t))
        beside.update(m.group(2, 3) if m.start(1) < 0 else (m[2], m[3], "") for m in _BESIDE.finditer(t))
    out = {w: [n, 0, 0] for w, n in total.items()}
    for (w, follows, *behind), n in beside.items():
        if w in out:
            out[w][1] += n if follows else 0
            out[w][2] += n if behind else 0
    return out


def survey(df: DataFrame, column: str, goods: DataFrame | None = None) -> tuple[dict[str, int], Usual]:
    """Character bigrams of the words seen at least three times, and the usual words, over every row.

    A capitalised word is usual if it also occurs in lower case (three times, and a twentieth of its uses), or if a lower-case word
    almost always follows it (as at the start of sentences) or precedes it (as with German nouns). goods: words (word) that name
    goods. Words are counted and judged in the cluster; the driver gets the bigrams (at most the square of the letters) and a
    filter of fixed size.
    """

    def part(batches):
        n = word_counts(t for b in batches for t in b[column])
        if n:
            yield pd.DataFrame({"word": list(n), **{c: [v[i] for v in n.values()] for i, c in enumerate("nfp")}})

    def grams(batches):
        total: Counter = Counter()
        for b in batches:
            for word, n in zip(b["word"], b["n"].tolist(), strict=True):
                w = f"^{word}$"
                for i in range(len(w) - 1):
                    total[w[i : i + 2]] += n
        if total:
            yield pd.DataFrame({"gram": list(total), "n": list(total.values())})

    counts = df.select(column).filter(F.col(column).isNotNull()).mapInPandas(part, "word string, n long, f long, p long").groupBy("word").agg(*[F.sum(c).alias(c) for c in "nfp"])
    words = stage(counts.filter("n >= 3"), "words")
    low = words.filter("word = lower(word)")
    high = words.filter("word <> lower(word)").join(low.select(F.col("word").alias("lw"), F.col("n").alias("ln")), F.expr("lower(word) = lw"), "left")
    usual = low.select("word").unionByName(high.filter("ln >= 0.05 * n or n >= 8 and greatest(f, p) >= 0.93 * n").select("word"))
    if goods is not None:
        usual = usual.unionByName(goods.select(F.trim("word").alias("word"))).unionByName(goods.select(F.expr("concat(upper(substring(trim(word), 1, 1)), lower(substring(trim(word), 2)))").alias("word")))
    place = usual.select(F.explode(Usual.places(F.col("word"))).alias("p"))
    bits = np.zeros(1 << (USUAL_LOG2 - 6), dtype=np.int64)
    for w, b in place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(bigint(1), cast(p & 63 as int))")).alias("b")).collect():
        bits[w] = b
    found = words.mapInPandas(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in found.collect()}, Usual(bits.view(np.uint8))


_EDGE = " ,;:/.<>()\n，。：；（）、"


def varied(form: str, spans: Sequence[tuple[int, int, str]], parts: Sequence[str], r: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with other figures from the third of a run on, and other words in half of the Latin names; and its spans."""
    out, own, at = [], [], 0
    digits = lambda m: m[0][:2] + "".join(map(str, r.integers(0, 10, len(m[0]) - 2)))

    def other(m: re.Match) -> str:
        w = parts[int(r.integers(len(parts)))]
        return w.upper() if m[0].isupper() else w

    size = 0
    for a, b, kind in [*spans, (len(form), len(form), "")]:
        for text, k in ((form[at:a], ""), (form[a:b], kind)):
            text = re.sub(r"\d{3,}", digits, text)
            if k == "name" and parts and r.random() < 0.5:
                text = re.sub(r"[A-ZÄÖÜ][A-Za-zÀ-ɏ'’]{2,}", other, text)
            out.append(text)
            if k:
                own.append((size, size + len(text), k))
            size += len(text)
        at = b
    return "".join(out), own


class Finder:
    """A trained model: spans(texts) gives the personal details of each text, as places in the text itself."""

    def __init__(self, grams: dict[str, int], usual: Usual, sample: Sequence[str], steps: int = STEPS, seed: int = 0):
        self.grams, self.usual = grams, usual
        self.canon = Canonical(grams)
        forms = [aligned(t, self.canon)[0] for t in sample if t]
        names = Names(forms, usual)
        texts, tags, seen, r = [], [], set(), np.random.default_rng(seed)
        parts = sorted(names.parts)
        for f in forms:
            spans = seed_spans(f, names)
            # As written, and with other figures and other parts of names: the surroundings tell, not the value.
            for g, own in [(f, spans)] + ([varied(f, spans, parts, r) for _ in range(VARIED)] if spans else []):
                y = np.zeros(len(g), np.int8)
                for a, b, kind in own:
                    y[a:b] = KINDS.index(kind) + 1
                # A window around each span, and one anywhere: what is no detail is learned as it occurs.
                for a in [*(a for a, *_ in own), *([None] if g is f else [])]:
                    s = int(r.integers(0, max(1, len(g) - LENGTH + 1))) if a is None else max(0, a - int(r.integers(4, LENGTH // 2)))
                    piece = g[s : s + LENGTH]
                    if piece not in seen:
                        seen.add(piece)
                        texts.append(piece)
                        tags.append(y[s : s + LENGTH])
        self.tagger = Tagger(Tagger.letters(texts), seed, fold=reading())
        self.loss = self.tagger.train(texts, tags, steps, WINDOWS, seed=seed) if texts else 0.0
        self.examples = len(texts)

    def __getstate__(self):
        return {"grams": self.grams, "usual": self.usual, "tagger": self.tagger}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.canon = Canonical(self.grams)

    def spans(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, str]]]:
        distinct = list(dict.fromkeys(t for t in texts if t))
        found = {t: self._placed(t, y) for t, y in zip(distinct, self.tagger.paths(distinct), strict=True) if y is not None}
        return [list(found.get(t, ())) if t else [] for t in texts]

    def _placed(self, text: str, y: np.ndarray) -> list[tuple[int, int, str]]:
        form, where = aligned(text, self.canon)
        if where is None:
            return self._read(form, y)
        return [(int(where[x]), int(where[z - 1]) + 1, kind) for x, z, kind in self._read(form, y[where])]

    def _read(self, form: str, y: np.ndarray) -> list[tuple[int, int, str]]:
        """The spans of one path of tags, from edge to edge of their words, that can be what they were tagged as."""
        found: list[tuple[int, int, str]] = []
        edge = np.nonzero(np.r_[True, y[1:] != y[:-1]])[0].tolist() + [len(y)]
        for x, z in zip(edge, edge[1:], strict=False):
            if not y[x]:
                continue
            kind = KINDS[y[x] - 1]
            while x < z and form[x] in _EDGE:
                x += 1
            while z > x and form[z - 1] in _EDGE:
                z -= 1
            if x == z or found and x < found[-1][1]:
                continue
            if kind == "phone" and form[x - 1 : x] == "(" and ")" in form[x:z]:
                x -= 1
            if kind in ("phone", "id_number"):
                while z < len(form) and form[z].isdigit():
                    z += 1
                while x and form[x - 1].isdigit():
                    x -= 1
                kind = "id_number" if ID.fullmatch(form[x:z]) else kind
            elif kind == "email":
                # An address for mail ends where its pattern ends.
                if m := next((m for m in EMAIL.finditer(form, max(0, x - 40), z + 40) if m.start() < z and m.end() > x), None):
                    x, z = m.span()
                    if tail := re.search(r"\. [A-Z][\w'’]*$", form[x:z]):
                        z = x + tail.start()
            elif kind == "name" and form[x].isascii():
                while z < len(form) and form[z].isalpha() and form[z] < "㐀":
                    z += 1
                while x and form[x - 1].isalpha() and form[x - 1] < "㐀":
                    x -= 1
            if possible(kind, form[x:z], form[max(0, x - 30) : x], form[z : z + 24], self.usual) and not (found and x < found[-1][1]):
                found.append((x, z, kind))
        return found


def possible(kind: str, span: str, before: str, after: str, usual: Usual) -> bool:
    """The exact check: whether a span can be what it was tagged as."""
    digits = sum(c.isdigit() for c in span)
    if "[" in span and re.fullmatch(r"\[?[A-Z_]+\]?", span):
        return False
    if kind == "email":
        return bool(EMAIL.search(span))
    if kind in ("phone", "id_number"):
        if kind == "phone" and re.search(r"(?:SSN|\bID|identity card|[Pp]atient no|[Pp]assport|[Ii]nsured|证)\D{0,14}$", before):
            return False
        return digits >= (6 if kind == "id_number" else 7) and not _GOODS.search(before)
    if kind == "address":
        if digits < 1 or len(span) < 6 or _GOODS.search(before) or _GOODS.search(span):
            return False
        return bool(re.search(r"[一-鿿].*\d", span)) or ADDRESS.search(span) is not None or any(not known_word(w, usual) for w in _cap_words(span) if w not in _HOMES)
    if re.search("[一-鿿]", span):
        return 2 <= len(span) <= 5 and bool(re.match(_ZH, span)) and not _NOT_NAME.match(" " + after)
    words = _cap_words(span)
    if span.lower() in _NO_ONE or not words or digits or _NOT_NAME.match(after) or len(words) == 1 and re.match(r" (?:[A-Z]{0,2}-?)\d", after):
        return False
    return bool(_BEHIND_TITLE.search(before)) or re.match(rf"{_TITLE} ", span) is not None or any(not known_word(w, usual) for w in words)


def redacted(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The text with each span replaced by the placeholder of its kind; all else unchanged."""
    for a, b, kind in sorted(spans, reverse=True):
        text = text[:a] + PLACEHOLDER[kind] + text[b:]
    return text


# -- tables


def fields(raw: DataFrame, qa: DataFrame) -> DataFrame:
    """tbl, ord, field_name, text of the three fields; null and empty texts hold nothing and are left out."""
    pick = lambda df, tbl, c: df.select(F.lit(tbl).alias("tbl"), F.col("ord").cast("long").alias("ord"), F.lit(c).alias("field_name"), F.col(c).alias("text"))
    return pick(raw, "raw_records", "text").unionByName(pick(raw, "raw_records", "question")).unionByName(pick(qa, "qa_items", "answer")).filter("text is not null and text <> ''")


def trained(df: DataFrame, raw: DataFrame) -> Finder:
    """A model for the texts of ``df``: found() and replaced() take it, so it need be trained once only."""
    goods = raw.select(F.col("metadata")["drug"].alias("word")).filter("word is not null").distinct()
    grams, usual = survey(df, "text", goods)
    return Finder(grams, usual, [r.text for r in bounded(df, SAMPLE, "text", keys=("tbl", "field_name", "ord"))])


def _detected(df: DataFrame, finder: Finder, redact: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(finder)  # weights, bigrams and a filter of fixed size

    def part(batches):
        f = shared.value
        for whole in batches:
            ends = whole["text"].str.len().cumsum() // AT_ONCE
            for _, b in whole.groupby(ends, sort=False):
                spans = f.spans(list(b["text"]))
                if redact:
                    yield b.assign(text=[redacted(t, s) for t, s in zip(b["text"], spans, strict=True)], n_found=[len(s) for s in spans])[["tbl", "ord", "field_name", "text", "n_found"]]
                else:
                    rows = [(t, o, c, k) for t, o, c, s in zip(b["tbl"], b["ord"], b["field_name"], spans, strict=True) for k in sorted({k for *_, k in s})]
                    yield pd.DataFrame(rows, columns=["tbl", "ord", "field_name", "kind"])

    return df.mapInPandas(part, "tbl string, ord long, field_name string, " + ("text string, n_found long" if redact else "kind string"))


def found(raw: DataFrame, qa: DataFrame, finder: Finder | None = None) -> DataFrame:
    """tbl, ord, field_name, kind: one row per field that holds a detail of the kind."""
    df = fields(raw, qa)
    return _detected(df, finder or trained(df, raw), False)


def replaced(raw: DataFrame, qa: DataFrame, finder: Finder | None = None) -> DataFrame:
    """tbl, ord, field_name, text, n_found: every text with its details replaced by placeholders, and their number."""
    df = fields(raw, qa)
    return _detected(df, finder or trained(df, raw), True)
