import hashlib

import pytest
from pyspark.sql import functions as F

from groundspark.functions import math as fm
from groundspark.functions import text as ft
from groundspark.functions.privacy import Deidentified, PHIError, assert_no_phi, deidentify, has_phi
from groundspark.plans.queries import QUERIES


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("５ｍｇ", "5mg"), ("（注）", "(注)"), ("a    b\tc", "a b c"), ("好的。。。", "好的。"), ("a\n \n \n \nb", "a\n\nb"), ("a\n\nb", "a\n\nb"), ("wow!!!", "wow!"), ("Disclaimer: x\nkept\nPage 3", "kept"), ("", ""), (None, None), ("5mg 50mg 5mL", "5mg 50mg 5mL")],
)
def test_normalize(spark, given, wanted):
    assert one(spark, given, ft.normalize_text) == wanted
    if wanted is not None:
        assert one(spark, wanted, ft.normalize_text) == wanted  # idempotent


def test_superscripts_can_be_kept(spark):
    assert one(spark, "10²", ft.normalize_text) == "102"
    assert one(spark, "10²", lambda c: ft.normalize_text(c, ft.NormalizeConfig(protect_superscripts=True))) == "10²"


def test_scalars(spark):
    assert [one(spark, t, ft.estimate_tokens) for t in ("liver mass", "肝占位", "肝 mass")] == [2, 3, 2]
    assert one(spark, "Aspirin 阿司匹林", ft.tokenize) == ["aspirin", "阿", "司", "匹", "林"]
    assert one(spark, "a. b! c", ft.split_sentences) == ["a.", "b!", "c"]
    assert one(spark, "a b c d", ft.shingles) == ["a b c", "b c d"]
    assert one(spark, "a b", ft.shingles) == ["a b"]
    assert one(spark, "ab", lambda c: ft.shingles(c, char=True)) == ["a b"]
    assert one(spark, "", ft.shingles) == []
    assert one(spark, "x [S1][S12] y [ROI3]", lambda c: ft.tags(c, "S")) == [1, 12]
    assert one(spark, "x [S1] y [ROI3]", ft.strip_tags) == "x  y"
    assert one(spark, "c1:roi0", ft.case_id) == "c1"
    assert [one(spark, t, lambda c: ft.map_label(c, F.lit("en"))) for t in ("CHEMICAL", "???", None)] == ["drug", "other", "other"]
    assert one(spark, "bod", lambda c: ft.map_label(c, F.lit("zh"))) == "anatomy"
    assert [one(spark, t, ft.detect_language) for t in ("肝占位", "liver", "")] == ["zh", "en", "en"]


def test_deidentify(spark):
    t = "tel 13812345678 mail a.b@c.org id 11010519491231002X, 5mg daily"
    r = one(spark, t, deidentify)
    assert r.text == "tel [PHONE] mail [EMAIL] id [ID], 5mg daily"
    assert [x.category for x in r.found] == ["id_card", "phone", "email"]
    assert one(spark, "姓名：张三 ok", deidentify).text == "姓名：[REDACTED] ok"
    assert not one(spark, r.text, has_phi) and one(spark, t, has_phi) and one(spark, None, has_phi) is False
    df = spark.createDataFrame([(t,), (None,)], "t string")
    with pytest.raises(PHIError):
        assert_no_phi(df, "t")
    assert_no_phi(Deidentified.of(df, "t").df, "t")


def test_math(spark):
    row = spark.range(1).select(
        fm.box_iou(tuple(map(F.lit, (0.0, 0.0, 2.0, 2.0))), tuple(map(F.lit, (1.0, 0.0, 3.0, 2.0)))).alias("iou"), fm.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("v"),
        fm.l2_normalize(F.array(F.lit(0.0))).alias("z"), fm.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j"), fm.sigmoid(F.lit(-800.0)).alias("s"),
        fm.anneal_factor(F.lit(0), F.lit(10)).alias("a0"), fm.anneal_factor(F.lit(10), F.lit(10)).alias("a1"), fm.band(F.lit(0.05)).alias("b"),
    ).first()
    assert row.iou == pytest.approx(1 / 3) and row.v == pytest.approx([0.6, 0.8]) and row.z == [0.0] and row.j == 1.0 and row.s == 0.0
    assert row.a0 == pytest.approx(1.0) and row.a1 == pytest.approx(0.25) and row.b == "medium"
    assert fm.resolve_k(0) == 1 and fm.resolve_k(16) == 4


def test_whole_documents_are_deidentified(spark, tmp_path):
    long = "filler words " * 400 + "mail q.r@ward.org or 13912345678, "
    df = spark.createDataFrame([(7, long, "s", "c", "en"), (8, None, "s", "c", "en")], "doc_id long, text string, source string, collection string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["deid_texts"](spark, str(tmp_path)).collect()}
    tail = "\ntel [PHONE], id [ID], mail [EMAIL]; Name: [REDACTED] ok"
    want = {7: "filler words " * 400 + "mail [EMAIL] or [PHONE], " + tail, 8: tail}
    assert {k: r.h for k, r in got.items()} == {k: hashlib.sha1(v.encode()).hexdigest() for k, v in want.items()}
    assert got[7].kinds == "id_card,phone,phone,email,email,labeled" and got[8].kinds == "id_card,phone,email,labeled" and not any(r.left for r in got.values())
