"""Readers: JSON lines, records and nodes, held-out sets, node stores, evaluation records, images; and a probe of a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..session import stage

KNOWN = ("id", "text", "question", "answer", "lang")


# Line ends beside those at which a text source splits.
MORE_BREAKS = "[\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """ord, n, line: every physical line of the files, blank ones too; n counts within the file from 0, ord over all files by their path.

    Files are read in splits. Lines are numbered within their split, and the splits of all files by their counts, so a file may be
    as large as it likes and no task holds one.
    """
    parts = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m"))
    parts = stage(parts.withColumn("parts", F.split("value", MORE_BREAKS)).drop("value"), "lines")
    sizes = parts.groupBy("f", "at").agg(F.sum(F.size("parts")).alias("k"))  # a row a split
    before = lambda *by: Window.partitionBy(*by).orderBy("f", "at").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("f", "at", F.coalesce(F.sum("k").over(before("f")), F.lit(0)).alias("in_file"), F.coalesce(F.sum("k").over(before(F.lit(0))), F.lit(0)).alias("in_all"))
    own = Window.partitionBy("f", "at").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("own", F.coalesce(F.sum(F.size("parts")).over(own), F.lit(0))).join(start, ["f", "at"])
    each = placed.select("in_file", "in_all", "own", F.posexplode("parts").alias("i", "line"))
    return each.select((F.col("in_all") + F.col("own") + F.col("i")).alias("ord"), (F.col("in_file") + F.col("own") + F.col("i")).alias("n"), "line")


def load_jsonl(spark: SparkSession, path: str, id_field: str = "id", text_field: str = "text", question_field: str = "question", answer_field: str = "answer") -> DataFrame:
    """ord, record_id, text, question, answer, lang, metadata: blank lines are skipped, malformed ones raise.

    A missing id is the 0-based number of the physical line in its file, counting blank ones; ord counts on over the files of a
    directory. An empty text is ''. All other keys go to the metadata as text.
    """
    rows = _lines(spark, path).filter(F.trim("line") != "")
    obj = F.from_json("line", "map<string,string>", {"mode": "FAILFAST"})
    fields = {id_field, text_field, question_field, answer_field, "lang"}
    m = rows.select("ord", "n", obj.alias("m"))
    get = lambda k: F.col("m")[k]
    return m.select(
        "ord", F.coalesce(get(id_field), F.col("n").cast("string")).alias("record_id"), F.coalesce(get(text_field), F.lit("")).alias("text"),
        get(question_field).alias("question"), get(answer_field).alias("answer"), get("lang").alias("lang"), F.map_filter("m", lambda k, v: ~k.isin(*fields)).alias("metadata"),
    )


def drug_records_to_nodes(records: DataFrame, collection: str = "a_drug") -> DataFrame:
    return records.select("ord", F.col("record_id").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(collection).alias("collection"), "lang", F.array("record_id").alias("source_ids"), F.array().cast("array<string>").alias("entities"), F.lit(None).cast("double").alias("quality_score"), F.array().cast("array<string>").alias("flags"), "metadata")


def qa_records_to_items(records: DataFrame) -> DataFrame:
    return records.filter("question <> '' and answer <> ''").select("ord", "question", "answer", F.col("record_id").alias("source_id"))


def ct_records_to_samples(records: DataFrame) -> DataFrame:
    return records.select("ord", F.col("record_id").alias("case_id"), F.coalesce(F.col("metadata")["image_path"], F.lit("")).alias("image_path"), first_filled(F.col("answer"), F.col("text")).alias("report_text"), F.lit(None).cast("string").alias("area_band"), F.lit(False).alias("in_eval_set"), "metadata")


def load_heldout(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the file is held out."""
    return ct_records_to_samples(load_jsonl(spark, path)).withColumn("in_eval_set", F.lit(True))


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node_id and the record as JSON: from a folder as save_nodes() writes it (a record a line, read in splits), or from one JSON
    object of node id to record, which one task reads."""
    if not path.endswith(".json"):
        return spark.read.text(path).select(F.get_json_object("value", "$.node_id").alias("node_id"), F.col("value").alias("record"))
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("node_id", "record"))


def load_records(spark: SparkSession, runs_dir: str) -> DataFrame:
    """Evaluation records of a directory in the order of their run ids; none where it is missing."""
    from pathlib import Path

    from ..schemas import EVAL_RECORD

    if not runs_dir.startswith(("hdfs:", "s3")) and not any(Path(runs_dir).glob("*.json")):
        return spark.createDataFrame([], EVAL_RECORD)
    return spark.read.schema(EVAL_RECORD).json(runs_dir, multiLine=True, pathGlobFilter="*.json").orderBy("run_id")


def load_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), "content")


def probe(df: DataFrame, n: int = 50, pattern: str = r"\[?[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\s*,\s*[0-9]+\]?") -> dict:
    """Types of the fields, and which text fields of the first rows hold something like coordinates."""
    sample = df.limit(n)
    texts = [c for c, t in df.dtypes if t == "string"]
    hits = sample.agg(*[F.count(F.when(F.col(c).rlike(pattern), 1)).alias(c) for c in texts]).first() if texts else None
    return {"types": dict(df.dtypes), "coordinates": {c: hits[c] for c in texts} if hits else {}}


def strong_green(rgb) -> tuple[float, tuple[int, int, int, int] | None]:
    """Share of strongly green pixels of an image, and the box around them."""
    import numpy as np

    r, g, b = (rgb[..., i].astype(int) for i in range(3))
    m = (g > 100) & (g - r > 40) & (g - b > 40)
    if not m.any():
        return 0.0, None
    ys, xs = np.nonzero(m)
    return float(m.mean()), (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)
