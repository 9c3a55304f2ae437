import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.operators import coreset, detection, heldout, report, stats, vision

BOX = "image_id int, ord long, x1 double, y1 double, x2 double, y2 double, {}"


@pytest.fixture(scope="module")
def curve(spark):
    gts = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.01), (2, 0, 0.0, 0.0, 10.0, 10.0, 0.2)], BOX.format("area_fraction double"))
    preds = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 50.0, 50.0, 60.0, 60.0, 0.7), (2, 0, 0.0, 0.0, 10.0, 10.0, 0.5)], BOX.format("confidence double"))
    return preds, gts


def test_froc_and_ap(curve):
    preds, gts = curve
    for flags in (detection.match(preds, gts), detection.match_single(preds, gts)):
        c = sorted(detection.froc(flags, gts, 2).collect(), key=lambda r: r.k)
        assert [r.fp_per_image for r in c] == [0, 0, 0.5, 0.5] and [r.sensitivity for r in c] == [0, 0.5, 0.5, 1]
        at = {r.fp_point: r for r in detection.sensitivity_at(detection.froc(flags, gts, 2), (0.0, 0.5, 2.0)).collect()}
        assert [at[p].sensitivity for p in (0.0, 0.5, 2.0)] == [0.5, 1, 1] and (at[0.0].sens_small, at[0.0].sens_large, at[0.0].sens_medium) == (1, 0, 0)
        assert detection.average_precision(flags, 2).first().ap == pytest.approx(5 / 6)


def test_second_match_is_wrong(spark):
    g = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.01)], BOX.format("area_fraction double"))
    p = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 0.0, 0.0, 10.0, 9.0, 0.8)], BOX.format("confidence double"))
    assert {r.ord: r.is_tp for r in detection.match(p, g).collect()} == {0: True, 1: False}
    assert detection.average_precision(detection.match(p, g.filter("false")), 0).first().ap == 0


def test_prf(spark):
    rows = lambda *x: spark.createDataFrame([(1, i) for i in x], "pair_id int, item string")
    r = report.multiset_prf(rows("liver", "lung"), rows("liver", "mass")).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    r = report.multiset_prf(rows("a", "a"), rows("a")).first()
    assert (r.precision, r.recall) == (0.5, 1.0)
    empty = report.multiset_prf(rows().filter("false") if False else rows("x").filter("false"), rows("x").filter("false")).first()
    assert (empty.tp, empty.precision) == (0, 0.0)


def test_traceability_and_abstention(spark):
    r = report.traceability(spark.createDataFrame([(True, False, 1), (False, True, 0)], "grounded boolean, uncertain boolean, n_evidence int")).first()
    assert (r.traceability, r.traceability_certain) == (0.5, 1.0)
    assert report.traceability(spark.createDataFrame([], "grounded boolean, uncertain boolean, n_evidence int")).first().traceability == 1.0
    r = report.abstention(spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "pred boolean, gold boolean")).first()
    assert (r.precision, r.recall, r.accuracy) == (0.5, 0.5, 0.5)


def test_statistics():
    x = np.random.default_rng(1).normal(0.3, 0.1, 37)
    rng = np.random.default_rng(0)
    one = np.array([x[rng.integers(0, 37, 37)].mean() for _ in range(50)])
    assert stats.bootstrap_ci(x, n=50)[1:] == pytest.approx(np.quantile(one, [0.025, 0.975]))
    assert stats.permutation_p(x, np.zeros(37), 200) == pytest.approx(1 / 201) and stats.permutation_p(x, x, 50) == 1.0
    assert stats.mcnemar(0, 0) == 1.0 and stats.mcnemar(2, 1) == 1.0
    assert stats.mcnemar(40, 10) == pytest.approx(math.erfc(math.sqrt(29**2 / 50 / 2))) and stats.mcnemar(40, 10, compat=True) == pytest.approx(math.exp(-(29**2) / 100))
    with pytest.raises(ValueError):
        stats.bootstrap_ci(np.array([]))
    with pytest.raises(ValueError):
        stats.permutation_p([1.0], [1.0, 2.0])


def test_ablation(spark):
    rows = [(v, i, "small" if i < 10 else "large", 0.5 + {"off": 0, "add": 0.3 + (0.1 if i < 10 else 0), "noop": 0}[v]) for v in ("off", "add", "noop") for i in range(20)]
    cells = stats.ablation(spark.createDataFrame(rows, "variant string, sample_id int, band string, score double"), "off", n=200)
    by = {(r.variant, r.band): r for r in cells.collect()}
    assert by["add", "overall"].delta == pytest.approx(0.35) and by["add", "small"].delta == pytest.approx(0.4) and by["add", "large"].delta == pytest.approx(0.3)
    assert by["noop", "overall"].p == 1.0 and not by["noop", "overall"].significant
    arms = {r.variant: r for r in stats.arm_report(cells).collect()}
    assert arms["add"].small_concentrated and not arms["noop"].small_concentrated
    assert stats.best_arms(stats.arm_report(cells)).first().best_overall == "add"
    passed = {(r.variant, r.band): r.passed for r in stats.gate(cells).collect()}
    assert passed["add", "overall"] and not passed["noop", "overall"]
    assert not stats.gate(cells, stats.GateConfig(min_delta=0.5)).filter("passed").count()
    assert stats.ablation_table(cells).count() == 2
    with pytest.raises(stats.QualityGateError):
        stats.assert_gate(cells)
    assert stats.variants({"a": 1}, {"a": [1, 2], "b": [3]}) == [("a=2", {"a": 2}), ("b=3", {"a": 1, "b": 3})]


def test_bands_and_leaks(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.01,), (0.015,), (0.03,), (None,)], "f double")
    assert {r.band: r.n for r in heldout.band_distribution(rows, F.col("f")).collect()} == {"small": 2, "medium": 1, "large": 0}
    a, b = (spark.createDataFrame([(x,) for x in s], "id string") for s in ("xy", "yz"))
    with pytest.raises(heldout.LeakError, match="y"):
        heldout.assert_never_touched(a, b)


def test_coreset(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    rows = spark.createDataFrame([(i, v.tolist(), (0.01, 0.03, 0.08)[i // 20]) for i, v in enumerate(x)], "id long, vector array<double>, area_fraction double")
    a = coreset.select(rows, coreset.CoresetConfig(budget=0.3)).collect()
    assert 12 <= len(a) <= 18 and {v.band for v in a} == {"small", "medium", "large"} and len({v.id for v in a}) == len(a)
    assert sorted(coreset.select(rows.repartition(3), coreset.CoresetConfig(budget=0.3)).collect()) == sorted(a)
    assert coreset.select(rows, coreset.CoresetConfig(budget=999)).count() == 60
    assert coreset.allocate_strata({"small": 10, "medium": 0, "large": 10}, 10) == {"small": 6, "medium": 0, "large": 4}
    assert coreset.sqrt_quota([1, 100], 20) == [1, 19]


def test_coreset_clusters_a_large_band_as_a_whole(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.1, (1300, 2)) for c in (0, 5, 10, 15)])
    rows = spark.createDataFrame([(i, v.tolist(), 0.01) for i, v in enumerate(x)], "id long, vector array<double>, area_fraction double")
    a = coreset.select(rows, coreset.CoresetConfig(budget=8, clusters=4)).collect()
    # Each of the four clouds is one cluster, of which one row is the nearest to its centre.
    assert len(a) == 8 and sorted((v.id // 1300, v.rank) for v in a) == [(c, k) for c in range(4) for k in range(2)]
    assert len({(v.id // 1300, v.cluster) for v in a}) == 4


def test_vision(spark):
    m = np.zeros((20, 20))
    m[8:12, 8:12] = 0.9
    assert [(b["x1"], b["y1"], b["x2"], b["y2"], b["confidence"]) for b in vision.heatmap_boxes(m)] == [(8, 8, 12, 12, 0.9)]
    assert vision.heatmap_boxes(np.zeros((5, 5))) == []
    rgb = np.zeros((200, 200, 3), np.uint8)
    rgb[50:100, 60:120] = (0, 255, 0)
    box = vision.green_boxes(rgb)
    assert [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in box] == [(60, 50, 120, 100)] and vision.green_boxes(np.zeros((9, 9, 3), np.uint8)) == []
    h = vision.heatmap([(90, 90, 110, 110)], 200, 200)
    assert np.unravel_index(h.argmax(), h.shape) == (100, 100) and vision.heatmap([], 4, 4).max() == 0
    rows = vision.heatmap_rows(spark.createDataFrame([(1, 90.0, 90.0, 110.0, 110.0)], "image_id int, x1 double, y1 double, x2 double, y2 double"), 200, 200)
    assert all(abs(r.value - h[r.y, r.x]) < 1e-9 for r in rows.collect())
    out = vision.with_green_boxes(spark.createDataFrame([(1, rgb.tobytes(), 200, 200), (2, None, 1, 1)], "image_id int, pixels binary, height int, width int")).orderBy("image_id").collect()
    assert len(out[0].rois) == 1 and out[1].rois == []


def test_curves_in_blocks_with_equal_confidences(spark, monkeypatch):
    from pyspark.sql import functions as F

    from groundspark import session

    monkeypatch.setattr(session, "BLOCK", 7)
    rows = [(i, 0, 0.5 if i % 3 else i / 100, bool(i % 2), None) for i in range(60)]
    flags = spark.createDataFrame(rows, "image_id int, ord long, confidence double, is_tp boolean, gt_band string")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    tp, want = 0, []
    for k, r in enumerate(order, 1):
        tp += r[3]
        want.append((k, tp))
    assert sorted((r.k, r.tp) for r in detection._running(flags).collect()) == want
    env = [max(t / k for k, t in want[i:]) for i in range(60)]
    assert detection.average_precision(flags, 30).first().ap == pytest.approx(sum(e for e, r in zip(env, order, strict=True) if r[3]) / 30)
    n = session.numbered(flags.select("image_id"), [F.desc("image_id")], "n").collect()
    assert sorted((r.image_id, r.n) for r in n) == [(i, 60 - i) for i in range(60)]


def test_envelope_of_a_large_block_takes_no_square_of_it(spark):
    from time import monotonic

    n = 60_000
    flags = spark.range(n).select(F.col("id").alias("image_id"), F.lit(0).cast("long").alias("ord"), (-F.col("id") / n).alias("confidence"), (F.col("id") % 3 == 0).alias("is_tp"), F.lit(None).cast("string").alias("gt_band"))
    detection.average_precision(flags.limit(10), 1).first()
    began = monotonic()
    ap = detection.average_precision(flags, n // 3).first().ap
    assert monotonic() - began < 15
    i = np.arange(n)
    env = np.maximum.accumulate((np.cumsum(i % 3 == 0) / (i + 1))[::-1])[::-1]
    assert ap == pytest.approx(env[i % 3 == 0].sum() / (n // 3))


def test_detection_metrics(curve):
    preds, gts = curve
    r = detection.detection_metrics(preds, gts, 2).first()
    assert r.metrics["mAP"] == pytest.approx(5 / 6) and r.metrics["sens@0.5fp"] == 1.0 and r.stratified["small"]["sens@1.0fp"] == 1.0 and (r.n_images, r.total_gt) == (2, 2)


def test_detection_metrics_put_predictions_in_order_once(curve, monkeypatch):
    calls, real = [], detection.in_blocks
    monkeypatch.setattr(detection, "in_blocks", lambda *a: calls.append(a) or real(*a))
    assert detection.detection_metrics(*curve, 2).first().metrics["mAP"] == pytest.approx(5 / 6) and len(calls) == 1


def test_runs_and_gates(spark):
    from groundspark.config import AppConfig

    spec = stats.EvalSpec("r1", lambda c: c.seed, lambda seed: {"metrics": {"x": seed}, "stratified": {"small": {"x": 1}}})
    row = stats.run_eval(spark, AppConfig({"seed": 5}), spec, "base").first()
    assert (row.run_id, row.metrics, row.stratified, row.baseline_id, row.flags["detect"]) == ("r1", {"x": 5.0}, {"small": {"x": 1.0}}, "base", "stub")
    with pytest.raises(ValueError):
        stats.run_eval(spark, AppConfig(), stats.EvalSpec("r", lambda c: 0, lambda x: {}))
    pairs = spark.createDataFrame([(i, 0.5, 0.5 + 0.1 * (i % 2)) for i in range(40)], "sample_id int, baseline double, variant double")
    good, same = stats.check_scores(pairs, n=300).first(), stats.check_scores(pairs.withColumn("variant", pairs.baseline), n=300).first()
    assert good.passed and good.delta == pytest.approx(0.05) and not same.passed and same.p == 1.0
    # Resamples by Poisson draws agree with resampling as a whole.
    _, low, high = stats.bootstrap_ci(np.array([0.1 * (i % 2) for i in range(40)]), n=4000)
    assert good.ci_low == pytest.approx(low, abs=0.006) and good.ci_high == pytest.approx(high, abs=0.006)
    again = stats.check_scores(pairs.repartition(5), n=300).first()
    assert (again.ci_low, again.p) == (pytest.approx(good.ci_low), good.p)
    rows = [(v, i, "small" if i < 10 else "large", 0.5 + (0.3 if v == "add" else 0)) for v in ("off", "add") for i in range(20)]
    arms = stats.arm_ablation(spark.createDataFrame(rows, "variant string, sample_id int, band string, score double"), n=100)
    assert arms.first().gate_passed and len(stats.summary_lines(arms)) == 3 and stats.blocked(stats.gate(stats.ablation(spark.createDataFrame(rows, "variant string, sample_id int, band string, score double"), "off", n=100))).count() == 0


def test_windows_of_heat_maps(spark):
    # Centre at a half: rounded to even; three deviations rounded up; boxes outside leave nothing.
    h = vision.heatmap([(0, 0, 25, 25)], 100, 100, least=1.0, scale=0.1)
    assert h[12 - 8, 12] > 0 and h[12 + 8, 12] > 0 and h[12 + 9, 12] == 0 and vision.heatmap([(300, 300, 310, 310)], 50, 50).max() == 0
    boxes = [(0.0, 0.0, 25.0, 25.0), (40.0, 10.0, 47.0, 90.0), (-50.0, 0.0, -44.0, 5.0), (98.0, 98.0, 99.0, 99.0)]
    df = spark.createDataFrame([(1, *b) for b in boxes] + [(2, None, None, None, None)], "image_id int, x1 double, y1 double, x2 double, y2 double")
    for kw in ({}, {"anneal": 0.5}, {"out_size": (40, 60)}, {"elliptical": False}):
        want = vision.heatmap(boxes, 100, 100, **kw)
        got = {(r.y, r.x): r.value for r in vision.heatmap_rows(df, 100, 100, **kw).collect()}
        assert all(v == pytest.approx(want[k]) for k, v in got.items()) and set(zip(*map(list, np.nonzero(want)), strict=True)) <= set(got)


def test_inpainting():
    rgb = np.full((80, 80, 3), 90, np.uint8)
    rgb[20:40, 20:22] = rgb[20:40, 38:40] = rgb[20:22, 20:40] = rgb[38:40, 20:40] = (0, 255, 0)
    boxes = vision.green_boxes(rgb)
    mask = vision.inpaint_mask(rgb, boxes, np.random.default_rng(0))
    plain = vision.inpaint_mask(rgb, boxes, np.random.default_rng(0), vision.InpaintConfig(decoys=0))
    assert mask.sum() > plain.sum() >= 144 and (mask | ~plain).all()
    out = vision.inpainted(rgb, np.random.default_rng(0))
    assert (out == 90).all() and (vision.inpainted(out, np.random.default_rng(0)) == out).all()


def test_extractors(spark):
    from pyspark.sql import functions as F

    from groundspark.operators import entities

    backend = entities.by_language(entities.dictionary_backend("[A-Z][a-z]+"), entities.dictionary_backend("[一-鿿]癌", "disease"))
    pairs = spark.createDataFrame([(1, "Liver Mass", "Liver"), (2, "肝癌肝癌与肺癌", "肝癌"), (3, None, None)], "pair_id int, pred string, ref string")
    r = report.extracted_prf(pairs, entities.extractor(backend)).first()
    assert (r.tp, r.fp, r.fn) == (2, 3, 0)
    m = {x.metric: x.value for x in report.report_metrics(pairs, entities.extractor(backend, False), lambda c: F.array(F.struct(F.length(c).alias("s")))).collect()}
    assert m["entity_recall"] == 1.0 and m["relation_precision"] == pytest.approx(1 / 3)
    reports = spark.createDataFrame([(1, [("x", ["s"], None, False)], False), (2, [], True)], "query_id int, findings array<struct<text:string,sources:array<string>,roi:int,uncertain:boolean>>, abstain boolean")
    e = {x.metric: x.value for x in report.e2e_metrics(reports, spark.createDataFrame([(1, False), (2, True)], "query_id int, abstain boolean")).collect()}
    assert e["traceability"] == 1.0 and e["abstain_accuracy"] == 1.0 and "abstain_f1" not in {x.metric for x in report.e2e_metrics(reports).collect()}
