"""Languages: evenly written codes of a column, and the language of a text by its script and function words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other ways to write a language.
NAMES = {
    "en": "en eng english", "zh": "zh zho chi cn chinese cmn 中文 汉语 英文版中文", "de": "de ger deu german deutsch", "es": "es spa spanish español espanol", "fr": "fr fra fre french",
}
_CODES = {n: code for code, names in NAMES.items() for n in names.split()}
# Function words by language.
FUNCTION_WORDS = {
    "en": "the a an of and or to in on at is are was be been may must should can could do does not with without for from this that which their they them when if after before while as by it who what how why because than there have has had will would i you we your our my please",
    "de": "der die das den dem des ein eine einen einem einer und oder nicht mit ohne für von zu zum zur im in ist sind war wird werden kann können muss müssen darf dürfen soll sollen bei nach vor wenn ob auf aus wie was wer warum ich sie wir es auch nur noch sich dass unter über während als ihre ihren ab trotz",
    "es": "el la los las un una unos unas de del y o no con sin para por en es son fue ser puede pueden debe deben que se su sus al como cuando si más pero antes después durante qué por cómo cuánto tienen tiene hasta lo le les este esta muy yo también solo nunca",
}
_WORDS = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿]")
_SPEAKS = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v.split()) for v in FUNCTION_WORDS.values() for w in v.split()}
_GERMAN, _SPANISH = re.compile("[äöüßÄÖÜ]"), re.compile("[ñáíóú¿¡Ñ]")
_BRACKETS = re.compile(r"[(（\[【][^()（）\[\]【】]*[)）\]】]")


def even(lang: Column) -> Column:
    """en, zh, de, es or fr however written; null where the column is null, blank, unknown or und."""
    key = F.regexp_extract(F.lower(F.trim(lang)), r"^([^\s_\-]+)", 1)
    table = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.element_at(table, key)


def scores(text: str) -> dict[str, float]:
    """Weight of each language in a text: Chinese characters, function words, and letters that only one language has."""
    han = len(_HAN.findall(text))
    out = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in filter(_SPEAKS.__contains__, _WORDS.findall(text.lower())):
        for k in _SPEAKS[w]:
            out[k] += 1
    if not text.isascii():
        out["de"] += 1.5 * len(_GERMAN.findall(text))
        out["es"] += 1.5 * len(_SPANISH.findall(text))
    out["zh"] = han * 0.7
    return out


def detect(text: str | None, default: str | None = None) -> str | None:
    """en, zh, de or es; ``default`` where nothing speaks for any. Words in brackets count only if there are no others."""
    if not text:
        return default
    s = scores(_BRACKETS.sub(" ", text))
    best = max(s, key=s.get)
    if s[best] <= 0:
        s = scores(text)
        best = max(s, key=s.get)
    return best if s[best] > 0 else default
