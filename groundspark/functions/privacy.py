"""De-identification by ordered substitutions, and the guards that keep personal data from leaving."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, all_of

# Patterns of personal data.
ID_CARD = r"(?<![0-9])(?:[0-9]{17}[0-9Xx]|[0-9]{15})(?![0-9])"
PHONE = r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
DATE = r"[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}日?"
FIELDS = "姓名|患者姓名|患者|病人|住址|地址|联系电话|联系方式|电话|name|patient|address|phone"
LABELED = rf"(?i)({FIELDS})({WS}*[:：]{WS}*)([^\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+)"


@dataclass(frozen=True)
class DeidConfig:
    id_card: bool = True
    phone: bool = True
    email: bool = True
    dates: bool = False
    labeled_fields: bool = True

    def values(self) -> list[tuple[str, str, str]]:
        every = [("id_card", ID_CARD, "[ID]", self.id_card), ("phone", PHONE, "[PHONE]", self.phone), ("email", EMAIL, "[EMAIL]", self.email), ("date", DATE, "[DATE]", self.dates)]
        return [(k, p, r) for k, p, r, on in every if on]


def deidentify(c: Column, config: DeidConfig | None = None) -> Column:
    """struct(text, found: array<struct<category, text>>): each stage works on what the one before it left."""
    k = config or DeidConfig()
    found = []

    def tagged(category: str, texts: Column) -> Column:
        return F.transform(texts, lambda x: F.struct(F.lit(category).alias("category"), x.alias("text")))

    for name, pattern, mask in k.values():
        found.append(tagged(name, all_of(c, pattern)))
        c = F.regexp_replace(c, pattern, mask)
    if k.labeled_fields:
        found.append(tagged("labeled", all_of(c, LABELED, 3)))
        c = F.regexp_replace(c, LABELED, "$1$2[REDACTED]")
    empty = F.array().cast("array<struct<category:string,text:string>>")
    return F.struct(c.alias("text"), (F.concat(*found) if found else empty).alias("found"))


def has_phi(c: Column, config: DeidConfig | None = None) -> Column:
    """Whether a value (not a labelled field) is left; false for null."""
    out = F.lit(False)
    for _, pattern, _ in (config or DeidConfig()).values():
        out = out | F.coalesce(c.rlike(pattern), F.lit(False))
    return out


class PHIError(ValueError):
    """Personal data where none may be."""


def guarded(c: Column, config: DeidConfig | None = None) -> Column:
    """The text, if no value is left in it; else the query fails before the text goes anywhere."""
    return F.when(has_phi(c, config), F.raise_error(F.lit("personal data would leave")).cast("string")).otherwise(c)


def violations(df: DataFrame, column: str, config: DeidConfig | None = None) -> DataFrame:
    return df.filter(has_phi(F.col(column), config))


def assert_no_phi(df: DataFrame, column: str, config: DeidConfig | None = None) -> None:
    if violations(df, column, config).limit(1).count():
        raise PHIError(f"personal data in {column}")


@dataclass(frozen=True)
class Deidentified:
    """A table of which ``columns`` were de-identified; what leaves the engine takes only these."""

    df: DataFrame
    columns: tuple[str, ...]

    @staticmethod
    def of(df: DataFrame, *columns: str, config: DeidConfig | None = None) -> Deidentified:
        return Deidentified(df.withColumns({c: deidentify(F.col(c), config)["text"] for c in columns}), columns)
