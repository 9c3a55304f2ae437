"""Problem 1: broken question-answer pairs with the type of their defect.

Refusals are found by clustering response openings: distinct openings become sets of five-word shingles, MinHash bands propose
neighbours, the Jaccard similarity (0.8) is verified, and connected openings are a cluster; similar openings that no link connects
yet are then searched by their rarest shingles, which is exact. A cluster that recurs across unrelated
prompts is a template; it declines if most of its answers do. An answer that opens with such a template and otherwise says only
what also recurs across prompts is a refusal, whatever its length. Checks for stand-ins, copies of the question, language and
termination label the remaining defects. Whether an answer breaks off is judged by where sentences of the whole table end.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.dedup import SKETCH, _parities, _prefixes, components
from ..session import stage
from .canon import Canonical, fit
from .lang import detect, scores
from .near import words

N, SIMILARITY, BANDS, ROWS = 5, 0.8, 8, 4
#: Prompts are unrelated if they share less than this part of their words.
UNRELATED = 0.5
#: A context counts if it was seen so often, and ends sentences if at least this share of its uses does.
SEEN, ENDS = 12, 0.02

# Stand-ins for a missing answer, as forms and exports leave them, in the languages of the tables.
STAND_INS = frozenset({
    "n/a", "na", "n.a.", "none", "null", "nil", "nan", "tbd", "tba", "todo", "to be added", "to follow", "to be confirmed", "answer",
    "no answer", "no data", "empty", "blank", "pending", "missing", "unknown", "see above", "text to follow", "not available",
    "not applicable", "undefined", "xxx", "placeholder", "insert answer here", "none given",
    "暂无", "空", "无", "待补充", "未填写", "待定", "略", "无内容", "暂缺", "无答案", "暂无答案",
    "sin respuesta", "pendiente", "keine angabe", "k.a.", "k. a.",
})
# How one declines to do something, in general (cannot, unable, not allowed, decline), in the same languages. They are
# counted over the answers of a cluster, which decides as a whole; alone they make no refusal.
DECLINES = re.compile(
    r"\b(cannot|can't|can not|unable|not able|not allowed|not permitted|won't|decline|refuse|no answer can|do not answer|don't answer|beyond what|against (our|my) policy|must not (answer|comment))\b"
    r"|无法|不能(回答|提供)|不便|恕不|恕难|超出了?我|没有办法|不予回答|拒绝回答|不回答"
    r"|\bno (puedo|podemos|estoy|me es posible)\b|\bno se me permite\b|\bleider\b|\btut mir leid\b|\bdarf ich\b|\bkann ich\b.*\bnicht\b|\bnicht (beantworten|erlaubt)\b",
    re.I,
)
# Words before a question that is given back.
LABELS = re.compile(r"^(q|question|query|frage|pregunta|prompt|问题|问|提问|a|answer|antwort|respuesta|答|回答)?$")
_TAGS = re.compile(r"<[^<>]{0,40}>")
_EDGE = "[](){}<>（）【】「」『』《》\"'“”‘’*_ \n\t:：-"
_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？]+|[^.!?。！？\n]+")
_END = re.compile(r"[.!?。！？:]$")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:[-'’][^\W\d_㐀-鿿]+)*|\d+|[^\w\s]")
_BRACKET_END = re.compile(r"\s*[(（][^()（）]{0,80}[)）]\s*$")
_CAP = r"[A-ZÄÖÜÁÉÍÓÚÑ][\w'’\-]+"
_NAME = rf"{_CAP}(?:,? (?:[A-Z]\.|{_CAP})){{0,3}}"
# An answer that ends with a contact detail as a whole: mail, placeholder, figures, signed or labelled name, address.
_CONTACT_END = re.compile(
    r"(?:(?:@| ?[(\[] ?(?i:at) ?[)\]] ?)[\w\-]+(?: ?(?:\.|[(\[] ?(?i:dot) ?[)\]]) ?[\w\-]+)+|\[[A-Z_]+\]|(?<!\w)[A-Z]?(?:\d[ ()/.\-]*){6,}[\dXx]|\b[A-Z]{2} \d\d \d\d \d\d [A-Z]"
    rf"|\b(?i:regards|saludos|grüßen),?\s+{_NAME}|\b(?i:patient(?:in)?|paciente|(?:patient |full )?name|nombre|contact(?: details)?|contacto|kontakt|next of kin|registered as|signed)\s*[:：]\s*{_NAME}"
    r"|\b(?i:address|domicilio|adresse|anschrift|wohnhaft)(?: in)?[:：]? (?=[^\n]*\d)(?:(?:[A-ZÄÖÜÁÉÍÓÚÑ\d][\w'’\-]*|de|del|la|der|am|an)[,.]? ?){2,10}"
    rf"|\b\d+[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Lane|Ln|Street|St|Road|Rd|Avenue|Ave|Terrace|Drive|Dr|Close|Crescent|Court|Way|Place|Square|Row|Walk|Hill|Gardens|Grove|Mews|Parade)\b\.?(?:, {_CAP}(?: {_CAP})?(?: \d{{5}})?)?"
    r"|(?:姓名|患者|病人|联系人|家属)[:：]\s*[一-鿿]{2,4}|[路街道巷里弄]\d+号(?:\d+(?:号|栋|幢|楼|单元|室|层|座))*)$"
)

def plain(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.lower())


def is_empty(form: str) -> bool:
    t = _TAGS.sub(" ", form).strip(_EDGE).lower()
    return not re.search(r"\w", t) or t.rstrip(".!。…") in STAND_INS or t in STAND_INS


def is_copy(question: str, form: str) -> bool:
    q, a = plain(question), plain(form)
    if len(q) < 4 or len(a) < 0.8 * len(q):
        return False
    rest = a.replace(q, "")
    if rest != a:
        return bool(LABELS.match(rest))
    # A copy with an edit or two, in another order of marks, or cut by a character.
    a = re.sub(r"^(question|frage|pregunta|问题)", "", a)
    wq, wa = Counter(words(question)), Counter(words(form))
    n = max(sum(wq.values()), sum(wa.values()))
    return n >= 5 and sum((wq & wa).values()) >= 0.9 * n


def sentences(form: str) -> list[str]:
    """The words of the first sentence (with what follows, until it has two words or five Chinese characters), and of each other."""
    out: list[str] = []
    for m in _SENTENCE.finditer(form):
        w = words(m[0])
        if not w:
            continue
        if len(out) == 1 and len(out[0].split(" ")) < (5 if re.search("[㐀-鿿]", out[0]) else 2):
            out[0] += " " + " ".join(w)
        else:
            out.append(" ".join(w))
    return out


def says(sentence: str) -> bool:
    """Whether a sentence (its words, with blanks between) is long enough to say something: not "Please ask." alone."""
    return sentence.count(" ") >= (5 if re.search("[㐀-鿿]", sentence) else 2)


def opening(form: str) -> str:
    return next(iter(sentences(form)), "")


def shingles(open_: str) -> list[str]:
    w = open_.split(" ")
    return [" ".join(w[i : i + N]) for i in range(max(1, len(w) - N + 1))]


def _bands(open_: str) -> list[int]:
    h = np.array([xxhash.xxh64_intdigest(s) & ((1 << 61) - 1) for s in set(shingles(open_))], dtype=np.uint64)
    k = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)[:, None]
    sig = (((h[None, :] ^ (k * np.uint64(0x9E3779B97F4A7C15))) * (k * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1))) >> np.uint64(3)).min(axis=1)
    return [xxhash.xxh64_intdigest(sig[i : i + ROWS].tobytes(), seed=i) - (1 << 63) for i in range(0, len(sig), ROWS)]


def contexts(tokens: list[str], i: int) -> list[str]:
    """What precedes place i, from the closest to the widest context: with figures, names and rare words as classes."""
    kind = lambda t: "0" if t[0].isdigit() else "Aa" if t[0].isupper() and len(t) > 1 else t
    a = tokens[i - 1]
    b = kind(tokens[i - 2]) if i > 1 else "^"
    if re.match("[㐀-鿿]", a):
        c = kind(tokens[i - 3]) if i > 2 else "^"
        return [f"{c}{b}{a}", f"{b}{a}"]
    a = kind(a)
    return [f"{b} {a}", a] if a in ("0", "Aa") else [f"{b} {a}", a, f"-{a[-4:]}" if len(a) >= 7 else a]


class _Kinds(dict):
    """What contexts() takes of a token: whether it counts, whether it is Chinese, its class, and its ending (None for classes)."""

    def __missing__(self, x: str) -> tuple:
        if len(self) > 200_000:
            self.clear()
        k = "0" if x[0].isdigit() else "Aa" if x[0].isupper() and len(x) > 1 else x
        v = self[x] = (x[0].isalnum(), bool(re.match("[㐀-鿿]", x)), k, None if k in ("0", "Aa") else f"-{k[-4:]}" if len(k) >= 7 else k)
        return v


def cleaned_end(form: str) -> str:
    t = form.strip()
    while (s := _BRACKET_END.sub("", t)) != t and s:
        t = s
    return t.rstrip(" \"'”’»*")


def forms(qa: DataFrame) -> DataFrame:
    """ord, q, a (consistent forms), checked by row: empty, copy, language; the opening, whether it declines, and hashes of the other sentences."""
    qa = qa.select(F.col("ord").cast("long").alias("ord"), "question", "answer")
    counts = qa.sparkSession.sparkContext.broadcast(fit(qa, "question"))

    def part(batches):
        model = Canonical(counts.value)
        for b in batches:
            rows = []
            for o, q, a in zip(b["ord"], b["question"], b["answer"], strict=True):
                q, a = model(q) or "", model(a) or ""
                label = "empty" if is_empty(a) else "copy" if is_copy(q, a) else None
                if not label and q:
                    said = detect(a)
                    asked = detect(q)
                    if said and asked and said != asked and (s := scores(a))[said] >= 2 and s[said] > 1.5 * s.get(asked, 0):
                        label = "other_language"
                first, *rest = sentences(a) or [None]
                rows.append((o, q, a, label, None if label in ("empty", "copy") else first, bool(DECLINES.search(a)), [xxhash.xxh64_intdigest(s) - (1 << 63) for s in dict.fromkeys(rest) if says(s)]))
            yield pd.DataFrame(rows, columns=["ord", "q", "a", "label", "opening", "declines", "rest"])

    return stage(qa.mapInPandas(part, "ord long, q string, a string, label string, opening string, declines boolean, rest array<long>"), "answers")


def _similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (ord_a, ord_b) those whose sets (ord, s) are alike."""
    both = F.size(F.array_intersect("sa", "sb"))
    of = lambda x: sets.select(F.col("ord").alias(f"ord_{x}"), F.col("s").alias(f"s{x}"))
    return pairs.join(of("a"), "ord_a").join(of("b"), "ord_b").filter(both >= SIMILARITY * (F.size("sa") + F.size("sb") - both)).select("ord_a", "ord_b")


def _links(open_: DataFrame) -> DataFrame:
    """ord_a, ord_b: ids of openings that are alike; any two alike openings are connected.

    First MinHash proposes: in a bucket every member meets the most frequent one and the one before it, so a hot bucket costs two
    comparisons a member. What is alike and still apart shares one of its rarest shingles (prefix filtering): only shingles that
    stand in several components are joined, so openings that are connected already never meet again.
    """

    def bands(batches):
        for b in batches:
            out = [(i, o, n, k) for i, o, n in zip(b["id"], b["opening"], b["n_rows"], strict=True) for k in _bands(o)]
            yield pd.DataFrame(out, columns=["id", "opening", "n_rows", "band"])

    def hashed(batches):
        for b in batches:
            s = [sorted({xxhash.xxh64_intdigest(x) - (1 << 63) for x in shingles(o)}) for o in b["opening"]]
            size = np.array([len(x) for x in s], dtype=np.int64)
            flat, start = np.array([x for y in s for x in y], dtype=np.int64).view(np.uint64), (np.cumsum(size) - size)[size > 0]
            x = np.zeros((SKETCH, len(s)), dtype=np.uint64)
            x[:, size > 0] = _parities(flat, start, SKETCH)
            yield pd.DataFrame({"ord": b["id"], "x0": x[0].view(np.int64), "x1": x[1].view(np.int64), "s": s})

    sets = stage(open_.select("id", "opening").mapInPandas(hashed, "ord long, x0 long, x1 long, s array<long>"), "sets")
    banded = stage(open_.select("id", "opening", "n_rows").mapInPandas(bands, "id long, opening string, n_rows long, band long"), "bands")
    hot = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("n_rows", "id")).alias("h")).filter("n > 1").select("band", "h")
    some = banded.join(hot, "band")
    heads = some.select(F.col("id").alias("ord_a"), F.col("h").alias("ord_b"))
    # Neighbours in the order of the text, within parts of the bucket of which none is large.
    near = Window.partitionBy("band", F.substring("opening", 1, 8)).orderBy("opening", "id")
    follow = some.select(F.col("id").alias("ord_a"), F.lag("id").over(near).alias("ord_b")).filter("ord_b is not null")
    links = stage(_similar(sets, heads.unionByName(follow).filter("ord_a <> ord_b").distinct()), "links")
    prefix = _prefixes(sets, SIMILARITY, ["x0", "x1"]).join(components(links), "ord", "left").withColumn("root", F.coalesce("root", "ord"))
    prefix = stage(prefix, "prefixes")
    apart = prefix.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("g")
    prefix = stage(prefix.join(apart, "g", "left_semi"), "apart")
    a, b = (prefix.select("g", F.col("ord").alias(f"ord_{x}"), F.col("root").alias(f"root_{x}"), F.col("size").alias(f"n{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("at", "x0", "x1")]) for x in "ab")
    # As in near_pairs(): the first shingle that two sets share has all others behind it; sketches differ in no more bits than the sets.
    both, least = F.col("na") + F.col("nb"), SIMILARITY / (1 + SIMILARITY)
    bits = F.bit_count(F.col("x0_a").bitwiseXOR(F.col("x0_b"))) + F.bit_count(F.col("x1_a").bitwiseXOR(F.col("x1_b")))
    may = (F.least(F.col("na") - F.col("at_a"), F.col("nb") - F.col("at_b")) >= least * both - 1e-9) & (bits <= (1 - 2 * least) * both + 1e-9)
    left = a.join(b, "g").filter("root_a < root_b").filter(may).filter(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9).select("ord_a", "ord_b").distinct()
    return links.unionByName(_similar(sets, left))


def _words(q):
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(q), F.lit(r"[\x{3400}-\x{9fff}]|[^\W\x{3400}-\x{9fff}]+"), F.lit(0)), lambda w: w != ""))


def _share(x, y):
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def _spread(asked: DataFrame, four: DataFrame) -> DataFrame:
    """root of the clusters two of whose prompts are unrelated; exact. asked: root, q; four: root, p (up to four of its prompts, more
    than one).

    The four settle almost every cluster that is spread. Of any other all prompts meet the four; then pairs are compared, but not
    those that cannot be unrelated: by the triangle inequality (one less the share of words is a metric) from each of the four,
    or as they have all words in common that the whole cluster has in common.
    """
    sets = four.select("root", F.transform("p", _words).alias("p"))
    told = stage(sets.withColumn("spread", F.exists("p", lambda x: F.exists("p", lambda y: _share(x, y) < UNRELATED))), "spread")
    rest = asked.join(told.filter("not spread").select("root", "p"), "root").select("root", "p", _words(F.col("q")).alias("w")).distinct()
    rest = stage(rest.select("root", "w", F.size("w").alias("n"), F.xxhash64("w").alias("id"), F.transform("p", lambda x: 1 - _share(x, F.col("w"))).alias("d")), "prompts")
    far = stage(rest.filter((F.col("n") == 0) | (F.array_max("d") > 1 - UNRELATED)).select("root").distinct(), "far")
    rest = rest.join(far, "root", "left_anti")
    sizes = rest.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.max("n").alias("longest"))
    every = rest.select("root", F.explode("w").alias("word")).groupBy("root", "word").agg(F.count(F.lit(1)).alias("sets")).join(sizes.select("root", "sets"), ["root", "sets"])
    core = sizes.join(every.groupBy("root").agg(F.count(F.lit(1)).alias("core")), "root", "left").select("root", "longest", F.coalesce("core", F.lit(0)).alias("core"))
    # At most n_a + n_b - core words are in either, at least core in both.
    apart = lambda n, c: F.col("core") < UNRELATED * (n - c)
    rest = stage(rest.join(core, "root").filter(apart(F.col("n") + F.col("longest"), F.col("core"))), "undecided")
    a, b = (rest.select("root", F.col("w").alias(f"w{x}"), F.col("n").alias(f"n{x}"), F.col("id").alias(f"id{x}"), F.col("d").alias(f"d{x}"), *(["core"] if x == "a" else [])) for x in "ab")
    reach = F.forall(F.zip_with("da", "db", lambda x, y: x + y), lambda d: d > 1 - UNRELATED - 1e-9)
    pairs = a.join(b, "root").filter((F.col("ida") < F.col("idb")) & apart(F.col("na") + F.col("nb"), F.col("core")) & reach & (_share(F.col("wa"), F.col("wb")) < UNRELATED))
    return told.filter("spread").select("root").unionByName(far).unionByName(pairs.select("root").distinct())


def templates(rows: DataFrame) -> DataFrame:
    """opening, n_rows, declines (the share of the cluster's answers that do): the openings whose cluster recurs across unrelated prompts.

    rows: q, opening, declines. Distinct openings are compared, never rows. Of the prompts of a cluster four, the first and last by
    two hashes, are looked at first; if any two prompts are unrelated, the cluster is spread.
    """
    ends = lambda c, h: [F.min_by(c, h), F.max_by(c, h)]
    h = [F.xxhash64("q"), F.xxhash64(F.lit(1), "q")]
    rows = rows.filter("opening is not null and opening <> ''")
    open_ = rows.groupBy("opening").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("declines"), 1)).alias("n_declines"), F.array_distinct(F.array(*ends("q", h[0]), *ends("q", h[1]))).alias("prompts")
    )
    open_ = stage(open_.withColumn("id", F.xxhash64("opening")), "openings")
    root = components(_links(open_)).select(F.col("ord").alias("id"), "root")
    placed = stage(open_.join(root, "id", "left").withColumn("root", F.coalesce("root", "id")), "clusters")
    q = placed.select("root", F.explode("prompts").alias("q")).distinct()
    four = q.groupBy("root").agg(F.array_distinct(F.array(*ends("q", h[0]), *ends("q", h[1]))).alias("p")).filter(F.size("p") > 1)
    spread = _spread(rows.select("q", "opening").join(placed.select("opening", "root"), "opening").select("root", "q"), four)
    sums = placed.join(spread, "root", "left_semi").groupBy("root").agg(F.sum("n_rows").alias("rows"), (F.sum("n_declines") / F.sum("n_rows")).alias("declines"))
    return placed.join(sums, "root").select("opening", F.col("rows").alias("n_rows"), "declines")


def refusals(rows: DataFrame) -> DataFrame:
    """ord of the answers that open with a declining template and otherwise say only what recurs among prompts that differ."""
    known = templates(rows.select("q", "opening", "declines")).filter("declines > 0.5").select("opening")
    some = stage(rows.filter("opening is not null").join(known, "opening", "left_semi").select("ord", "rest"), "declining")
    asked = some.select(F.explode("rest").alias("s")).distinct()
    said = rows.select("q", F.explode("rest").alias("s")).join(asked, "s", "left_semi")
    common = said.groupBy("s").agg(F.min("q").alias("x"), F.max("q").alias("y")).filter("x <> y").select("s")
    new = some.select("ord", F.explode("rest").alias("s")).join(common, "s", "left_anti").select("ord").distinct()
    return some.select("ord").join(new, "ord", "left_anti")


def endings(rows: DataFrame) -> DataFrame:
    """context, n, ends: over all sentences of all answers, how often a context occurs and how often it ends a sentence."""

    def part(batches):
        n: Counter = Counter()
        e: Counter = Counter()
        known = _Kinds()
        for b in batches:
            for a in b["a"]:
                t = _TOKEN.findall(a)
                seen, ended, before, last = [], [], "^", "^"
                # As contexts() has them, for every place but the end of the text.
                for i, (x, after) in enumerate(zip(t, t[1:], strict=False), 2):
                    counts, han, k, tail = known[x]
                    if counts:
                        c = (before + last + x, last + x) if han else (f"{last} {k}", k) if tail is None else (f"{last} {k}", k, tail)
                        seen += c
                        if after in ".。!?！？" and (i == len(t) or not t[i][0].isdigit()):
                            ended += c
                    before, last = last, k
                n.update(seen)
                e.update(ended)
        if n:
            yield pd.DataFrame({"context": list(n), "n": list(n.values()), "e": [e[k] for k in n]})

    return rows.mapInPandas(part, "context string, n long, e long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("e").alias("ends"))


def open_ends(rows: DataFrame) -> DataFrame:
    """ord, sure, level, context: answers that end without a full stop. sure: they break off whatever the contexts say."""

    def part(batches):
        for b in batches:
            out = []
            for o, a in zip(b["ord"], b["a"], strict=True):
                t = cleaned_end(a)
                if re.search(r"(\.\.\.|…)$", t):
                    out.append((o, True, 0, None))
                    continue
                if not t or _END.search(t):
                    continue
                tokens = _TOKEN.findall(t)
                if not tokens[-1][0].isalnum():
                    # A comma, a hyphen or an open bracket ends nothing; other marks may.
                    if tokens[-1] in ",，、;；-–—(（[【/&":
                        out.append((o, True, 0, None))
                    continue
                if len(tokens) < 3 or len(tokens) < 5 and re.search("[㐀-鿿]", t):
                    continue  # a short answer, such as a dose
                if _CONTACT_END.search(t[-160:]):
                    continue
                out += [(o, False, k, c) for k, c in enumerate(contexts(tokens, len(tokens)))]
            yield pd.DataFrame(out, columns=["ord", "sure", "level", "context"])

    return rows.mapInPandas(part, "ord long, sure boolean, level int, context string")


def truncated(rows: DataFrame) -> DataFrame:
    """ord of the answers (ord, a) that break off before their last sentence is finished."""
    ends = open_ends(rows)
    told = ends.filter("not sure").join(endings(rows), "context", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("ends", F.coalesce("ends", F.lit(0)))
    # The closest context that was seen often enough decides; where none was, the answer ends in the middle of a word.
    best = told.groupBy("ord").agg(F.min_by(F.struct("n", "ends"), F.when(F.col("n") >= SEEN, F.col("level")).otherwise(F.col("level") + 10)).alias("x"), F.max("n").alias("most"))
    broken = best.filter(F.when(F.col("most") < SEEN, F.col("x.ends") == 0).otherwise(F.col("x.ends") < ENDS * F.col("x.n"))).select("ord")
    return ends.filter("sure").select("ord").unionByName(broken)


def labelled(qa: DataFrame) -> DataFrame:
    """ord, defect (null where there is none): one row per row of ``qa``. A null answer is empty; a null question has no language and no copy."""
    rows = forms(qa)
    refusal = stage(refusals(rows).withColumn("refusal", F.lit("refusal")), "refusals")
    rest = rows.filter("label is null").join(refusal, "ord", "left_anti").select("ord", "a")
    cut = truncated(rest).distinct().withColumn("cut", F.lit("truncated"))
    return rows.select("ord", "label").join(refusal, "ord", "left").join(cut, "ord", "left").select("ord", F.coalesce(F.when(F.col("label").isin("empty", "copy"), F.col("label")), "refusal", "label", "cut").alias("defect"))


def found(qa: DataFrame) -> DataFrame:
    return labelled(qa).filter("defect is not null")
