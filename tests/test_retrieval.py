import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.operators import chunking, report, retrieval
from groundspark.plans.queries import QUERIES


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id string, rank int")


def test_knn(spark):
    rows = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [-1.0, 0.0]), ("n", None)], "id string, vector array<double>")
    q = spark.createDataFrame([(1, [0.9, 0.1])], "query_id int, vector array<double>")
    assert [r.id for r in retrieval.knn(q, rows, 1).collect()] == ["x"]
    assert [r.id for r in retrieval.knn(q, rows, 1, F.col("id") != "x").collect()] == ["y"]
    assert retrieval.knn(q, rows.filter("false"), 1).count() == 0


def test_knn_in_blocks_and_ivf(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 40)
    v = np.random.default_rng(0).standard_normal((300, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    q = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r.query_id, r.id) for r in retrieval.knn(q, rows, 5).collect()}
    want = {(i, int(j)) for i in range(0, 300, 50) for j in np.argsort(-(u @ u[i]), kind="stable")[:5]}
    assert got == want
    cells, centres = retrieval.ivf(rows, 8)
    near = {(r.query_id, r.id) for r in retrieval.ann(q, cells, centres, 5, 6).collect()}
    assert cells.count() == 300 and len(near & want) >= 0.9 * len(want)


def test_rrf_and_automerge(spark):
    a, b = hits(spark, [(1, "a", 0), (1, "b", 1), (1, "c", 2)]), hits(spark, [(1, "b", 0), (1, "a", 1), (1, "d", 2)])
    out = [(r.id, r.score) for r in retrieval.rrf([a, b]).orderBy("rank").collect()]
    assert [i for i, _ in out] == ["a", "b", "c", "d"] and out[0][1] == pytest.approx(1 / 60 + 1 / 61)
    kids = spark.createDataFrame([("k1", "p"), ("k2", "p"), ("o", None)], "id string, parent_id string")
    fused = spark.createDataFrame([(1, "k1", 0.9, 0), (1, "k2", 0.8, 1)], "query_id int, id string, score double, rank int")
    assert [(r.id, r.score) for r in retrieval.automerge(fused, kids).collect()] == [("p", 0.9)]
    assert [r.id for r in retrieval.automerge(fused.limit(1), kids, 1.0).collect()] == ["k1"]


def test_bm25_keeps_zero_scores(spark):
    docs = spark.createDataFrame([(0, "aspirin dose"), (1, "liver"), (2, None), (3, "kidney stone")], "id int, text string")
    q = spark.createDataFrame([(7, "aspirin")], "query_id int, text string")
    assert [r.id for r in retrieval.bm25(q, docs, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.id for r in retrieval.bm25(q, docs, 3, drop_zero=True).collect()] == [0]


def test_rerank(spark):
    h = spark.createDataFrame([(1, "a", 1.0, 0), (1, "b", 2.0, 1), (1, "c", 3.0, 2)], "query_id int, id string, score double, rank int")
    out = retrieval.rerank(h, F.col("score")).orderBy("rank").collect()
    assert [r.id for r in out] == ["c", "b", "a"] and out[0].score == pytest.approx(1 / (1 + math.exp(-3))) and not out[0].abstain
    low = retrieval.rerank(h, F.lit(0.0), min_score=0.9).collect()
    assert len(low) == 3 and all(r.abstain for r in low)


def test_metrics(spark):
    h = hits(spark, [(1, f"d{i + 1}", i) for i in range(4)])
    m = retrieval.retrieval_metrics(h, spark.createDataFrame([(1, "d2"), (1, "d4")], "query_id int, id string"), (2, 4)).first()
    assert (m.recall_at_2, m.recall_at_4, m.mrr) == (0.5, 1.0, 0.5)
    assert m.ndcg_at_4 == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    none = retrieval.retrieval_metrics(h, spark.createDataFrame([(2, None)], "query_id int, id string"), (1,)).first()
    assert (none.recall_at_1, none.ndcg_at_1, none.mrr) == (1.0, 1.0, 0.0)


def test_cascade_and_evidence(spark):
    h = hits(spark, [(1, "A:roi0", 0), (1, "A:whole", 1), (1, "B:whole", 2)])
    out = retrieval.visual_cascade([h, h]).orderBy("rank").collect()
    assert [(r.id, r.score) for r in out][0] == ("A", 1.0) and len(out) == 2
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    ev = {r.query_id: r for r in retrieval.evidence(q, out and retrieval.visual_cascade([h]), spark.createDataFrame([("A", "t", "c")], "id string, text string, citation string")).collect()}
    assert ev[2].abstain and ev[2].abstain_reason == "no_evidence" and [e.citation for e in ev[1].evidence] == ["c", "B"]


def test_embed(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    out = retrieval.embed(df, "t", lambda ts: np.array([[len(t), 0.0] for t in ts])).collect()
    assert out[0].vector == [1.0, 0.0] and out[1].vector is None


def test_chunks(spark):
    conf = chunking.ChunkConfig(short_qa_tokens=5, child_tokens=8, min_chunk_tokens=1)
    items = spark.createDataFrame([(1, "q", "one two."), (2, "q", "a b c d e. f g h i j. k."), (3, None, None), (4, "q", "...... ")], "doc_id int, question string, answer string")
    out = chunking.chunk_qa(items, conf).collect()
    by = {d: [r for r in out if r.doc_id == d] for d in (1, 2, 3, 4)}
    assert [r.kind for r in by[1]] == ["qa_short"] and by[1][0].embed_text == "q\none two."
    kids = sorted((r.pos, r.text) for r in by[2] if r.is_leaf)
    assert kids == [(0, "a b c d e."), (1, "f g h i j. k.")] and {r.parent_id for r in by[2] if r.is_leaf} == {r.chunk_id for r in by[2] if not r.is_leaf}
    assert [r.text for r in by[3]] == [""] and len(by[4]) == 1
    merged = chunking.chunk_qa(items, chunking.ChunkConfig(short_qa_tokens=5, child_tokens=5, min_chunk_tokens=3)).filter("doc_id = 2 and is_leaf").collect()
    assert sorted(r.text for r in merged) == ["a b c d e.", "f g h i j. k."]


def test_report(spark):
    ev = [("s1",), ("s2",)]
    schema = "query_id int, lines array<string>, evidence array<struct<source_id:string>>, n_rois int, abstain boolean, abstain_reason string"
    rows = [(1, ["x [ROI1][S1]", "y [S2]", "z [S99]"], ev, 1, False, "none"), (2, [], [], 0, False, "none"), (3, ["x"], ev, 0, True, "low_confidence")]
    out = {r.query_id: r for r in report.assembled(spark.createDataFrame(rows, schema)).collect()}
    assert [(f.text, f.sources, f.roi, f.uncertain) for f in out[1].findings] == [("x", ["s1"], 1, False), ("y", ["s2"], None, False), ("z", [], None, True)]
    assert out[2].abstain_reason == "no_evidence" and out[3].abstain_reason == "low_confidence" and not out[1].abstain
    dropped = {r.query_id: r for r in report.assembled(spark.createDataFrame(rows, schema), drop_ungrounded=True).collect()}
    assert len(dropped[1].findings) == 2
    with pytest.raises(RuntimeError):
        report.generated(spark.createDataFrame([], "query_id int, prompt string, evidence array<struct<source_id:string>>, n_rois int, abstain boolean, abstain_reason string"), None)


def test_bm25_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.6, 30) if x < 40) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    q = docs.filter("id % 7 = 0").select(F.col("id").alias("query_id"), "text")
    whole = sorted(retrieval.bm25(q, docs, 8).collect())
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 9)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(retrieval.bm25(q, docs, 8).collect()) == whole and len(whole) == 9 * 8


def test_hybrid_query_sees_every_document_and_whole_texts(spark, tmp_path):
    start = " ".join(f"filler{i}" for i in range(12))
    texts = [f"{start} zebrafish"] + [f"only{i}" for i in range(11)] + ["zebrafish"]
    spark.createDataFrame([(3 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(4)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [r.id for r in QUERIES["hybrid_retrieve"](spark, str(tmp_path)).orderBy("rank").collect()]
    # The last document, alone under p3, has no vector and shares with the query only the word behind character 80.
    assert len(start) > 80 and got[:2] == ["p0", "p3"] and set(got) == {"p0", "p1", "p2", "p3"}


def test_probes_are_measured(spark):
    v = np.random.default_rng(5).standard_normal((400, 12))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    asked = rows.filter("id % 40 = 0").select(F.col("id").alias("query_id"), "vector")
    cells, centres = retrieval.ivf(rows, 16)
    n = retrieval.probes_for(asked, cells, centres, 5)
    assert retrieval.recall_of(retrieval.ann(asked, cells, centres, 5, n), retrieval.knn(asked, rows, 5)) >= 0.9
    assert retrieval.recall_of(asked.filter("false").withColumn("id", F.lit(1)), rows.filter("false").withColumn("query_id", F.lit(1))) == 1.0


def test_cited_answers(spark):
    from groundspark.plans import serve

    records = spark.createDataFrame([("a", "aspirin helps", "A"), ("b", None, "B"), ("c", "liver", None)], "id string, text string, citation string")
    asked = spark.createDataFrame([(1, "aspirin?"), (2, "weak"), (3, "nothing"), (4, None)], "query_id int, text string")
    found = hits(spark, [(1, "a", 0), (1, "b", 1), (2, "c", 0)]).withColumn("score", F.lit(1.0))
    qa = serve.CitedQA(lambda q: found, records, lambda q, p: F.when(p.contains("aspirin"), 3.0).when(p == "B", 1.0).otherwise(-2.0), lambda p: F.lit("yes [S2]\n\nno [S7]"))
    out = {r.query_id: r for r in qa.answer(asked).collect()}
    assert [(f.text, f.sources, f.uncertain) for f in out[1].findings] == [("yes", ["b"], False), ("no", [], True)] and not out[1].abstain
    assert (out[2].abstain_reason, out[3].abstain_reason, out[4].abstain_reason) == ("low_confidence", "no_evidence", "no_evidence") and out[2].findings == []
    assert serve.Pipeline(qa=qa).answer(asked).count() == 4


def test_pipeline(spark):
    from groundspark.config import AppConfig
    from groundspark.plans import serve

    p = serve.Pipeline()
    images = spark.createDataFrame([("i1",), ("i2",)], "image_id string")
    r = p.generate_report(images).orderBy("query_id").first()
    assert r.summary == "[stub] report with 2 grounded finding(s)" and r.findings[0].text == "[stub] suspected lesion at small band" and r.findings[0].roi == 1
    asked = spark.createDataFrame([(1, "what's it?"), (2, " "), (3, None)], "query_id int, text string")
    e = {r.query_id: r for r in p.retrieve(asked).collect()}
    assert len(e[1].evidence) == 3 and e[1].evidence[1].score == pytest.approx(0.9) and e[1].evidence[0].citation == '[stub] source 0 for query="what\'s it?"' and e[2].abstain and e[3].evidence == []
    a = {r.query_id: r for r in p.answer(asked, 1).collect()}
    assert len(a[1].findings) == 1 and a[2].abstain_reason == "no_evidence"
    with pytest.raises(NotImplementedError):
        serve.Pipeline(AppConfig({"flags": {"detect": "heat"}})).detect(images)
    own = serve.Pipeline(AppConfig({"flags": {"detect": "mine"}}), implementations={"detect": {"mine": lambda i: i.select("image_id", F.array().cast("array<struct<area_band:string>>").alias("rois"), F.lit(True).alias("abstained"))}})
    assert own.generate_report(images).first().abstain_reason == "no_evidence"
    assert {r.status for r in serve.tool_results(p, "retrieve_evidence", asked).collect()} == {"ok", "abstained"}
    with pytest.raises(ValueError):
        serve.tool_results(p, "other", asked)
