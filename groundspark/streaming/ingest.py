"""Optional extension: records cleaned and deduplicated as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import deidentify
from ..functions.text import NormalizeConfig, normalize_text, sha1_key


def cleaned(stream: DataFrame, text: str = "text", event_time: str = "ingested_at", lateness: str = "1 day", config: NormalizeConfig | None = None) -> DataFrame:
    """Normalized, de-identified texts, of equal ones within the watermark the first. Works on streams and on tables; null texts count as empty."""
    form = normalize_text(F.coalesce(F.col(text), F.lit("")), config)
    out = stream.withColumn(text, deidentify(form)["text"]).withColumn("text_key", sha1_key(F.col(text)))
    return out.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["text_key"]) if stream.isStreaming else out.dropDuplicates(["text_key"])


def counts(stream: DataFrame, event_time: str, key: str, window: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Rows per window and key; late rows within the watermark are counted."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
