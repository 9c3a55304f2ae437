import json

import pytest
from pyspark.sql import functions as F

from groundspark import schemas
from groundspark.config import AppConfig, RunRecord, load_config
from groundspark.sources import readers, store
from groundspark.streaming import ingest as stream


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"question": "q", "answer": "a", "drug": "x"}\n\n{"id": "r2", "text": "t", "n": 3}\n', encoding="utf-8")
    rows = readers.load_jsonl(spark, str(p)).orderBy("ord").collect()
    assert [(r.ord, r.record_id, r.text, r.metadata) for r in rows] == [(0, "0", "", {"drug": "x"}), (2, "r2", "t", {"n": "3"})]
    df = readers.load_jsonl(spark, str(p))
    assert readers.qa_records_to_items(df).count() == 1 and readers.drug_records_to_nodes(df).count() == 2
    held = readers.load_heldout(spark, str(p)).collect()
    assert all(r.in_eval_set for r in held) and held[0].report_text in ("a", "t")
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        readers.load_jsonl(spark, str(p)).collect()


def test_store(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path / "v"))
    assert s.count("a_drug") == 0
    s.add("a_drug", spark.createDataFrame([("x", [1.0]), ("y", [2.0])], "id string, embedding array<double>"))
    s.add("c_text", spark.createDataFrame([("z", [1.0])], "id string, embedding array<double>"))
    assert s.count("a_drug") == 2
    s.reset("a_drug")
    assert s.count("a_drug") == 0 and s.count("c_text") == 1
    with pytest.raises(ValueError):
        s.count("nope")


def test_index(spark, tmp_path):
    import numpy as np

    s = store.VectorStore(spark, str(tmp_path / "v"))
    items = spark.createDataFrame([(1, "q", "short answer")], "doc_id int, question string, answer string")
    store.index_qa(s, "b_medqa", items, lambda ts: np.array([[len(t), 1.0] for t in ts]))
    r = s.read("b_medqa").first()
    assert r.document == "short answer" and r.metadata["kind"] == "qa_short" and "parent_id" not in r.metadata
    roi = "array<struct<area_band:string>>"
    cases = spark.createDataFrame([("c1", "t", [("small",)], False), ("c2", None, None, None), ("c3", "t", [], True)], f"case_id string, report_text string, rois {roi}, in_eval_set boolean")
    assert sorted(x.id for x in store.ct_vectors(cases).collect()) == ["c1:roi0", "c1:text", "c1:whole", "c2:whole"]


def test_records(spark, tmp_path):
    assert readers.load_records(spark, str(tmp_path / "none")).count() == 0
    for i in ("b", "a"):
        store.save_record({"run_id": i, "metrics": {"x": 1.0}, "stratified": {"small": {"x": 2.0}}}, str(tmp_path))
    assert [r.run_id for r in readers.load_records(spark, str(tmp_path)).collect()] == ["a", "b"]
    RunRecord.create("r", AppConfig()).add("metrics", x=1).save(str(tmp_path))
    assert RunRecord.load(tmp_path / "r" / "run_record.json").metrics == {"x": 1}


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"seed": 1, "flags": {"dedup": True}}))
    c = load_config(str(p), {"GROUNDSPARK_SEED": "7"})
    assert c.seed == 7 and c.flags["dedup"] and c.flags["detect"] == "stub" and AppConfig().seed == 42


def test_invariants(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0.5), (2.0, 0.0, 1.0, 1.0, 1.5)], "x1 double, y1 double, x2 double, y2 double, area_fraction double")
    assert [r.violated for r in schemas.violations(df).collect()] == [["box", "fraction"]]
    with pytest.raises(schemas.ContractError):
        schemas.validate(df)
    assert schemas.validate(df.limit(1)) is not None


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a  b", "2024-01-01 00:00:00"), ("a b", "2024-01-01 00:01:00"), (None, "2024-01-01 00:02:00")], "text string, t string").select("text", F.col("t").cast("timestamp").alias("ingested_at")).write.parquet(str(src))
    s = spark.readStream.schema("text string, ingested_at timestamp").parquet(str(src))
    q = stream.cleaned(s).writeStream.format("memory").queryName("cleaned_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("cleaned_out").count() == 2


def test_jsonl_in_splits_and_folders(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        for name, k in (("b.jsonl", 40), ("a.jsonl", 25)):
            (tmp_path / name).write_text("".join(f'{{"text": "{name}{i}"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(k)), encoding="utf-8")
        rows = readers.load_jsonl(spark, str(tmp_path)).orderBy("ord").collect()
        assert [r.text for r in rows] == [f"a.jsonl{i}" for i in range(25)] + [f"b.jsonl{i}" for i in range(40)]
        assert rows[8].record_id == "10" and rows[25].record_id == "0" and len({r.ord for r in rows}) == 65
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_cases_with_images(spark, tmp_path):
    import numpy as np

    s = store.VectorStore(spark, str(tmp_path / "v"))
    px = np.zeros((8, 8, 3), np.uint8)
    px[2:4, 2:4] = 200
    roi = "array<struct<x1:double,y1:double,x2:double,y2:double,area_band:string>>"
    cases = spark.createDataFrame([("c1", "t", [(2.0, 2.0, 4.0, 4.0, "small"), (9.0, 9.0, 9.0, 9.0, "small")], False, px.tobytes(), 8, 8), ("c2", "u", [], True, px.tobytes(), 8, 8), ("c3", None, [], None, None, None, None)], f"case_id string, report_text string, rois {roi}, in_eval_set boolean, pixels binary, height int, width int")
    store.index_ct(s, cases, lambda ts: np.array([[1.0, len(t)] for t in ts]), lambda images: np.array([[i.mean(), i.shape[0]] for i in images]))
    assert [s.count(c) for c in ("c_text", "c_img_whole", "c_img_roi")] == [1, 1, 2]
    r = {x.id: x for x in s.read("c_img_roi").collect()}
    assert r["c1:roi0"].embedding[0] > 0.99 and r["c1:roi0"].metadata["area_band"] == "small" and r["c1:roi1"].embedding is None


def test_settings():
    from groundspark.config import seed_everything

    c = AppConfig({"seed": "3", "flags": {"dedup": True}}).with_overrides(flags={"fusion": "add"})
    assert c.seed == 3 and c["flags"]["dedup"] and c.flags["fusion"] == "add" and dict(AppConfig())["data_root"] == "data"
    with pytest.raises(AttributeError):
        c.seed = 4
    with pytest.raises(KeyError):
        AppConfig({"sed": 1})
    with pytest.raises(KeyError):
        RunRecord.create("r").add("nothing", x=1)
    assert seed_everything(7).integers(0, 1 << 30) == seed_everything(7).integers(0, 1 << 30)
