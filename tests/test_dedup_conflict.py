import itertools
import random

import pytest
from pyspark.sql import functions as F

from groundspark.operators import conflict, dedup, entities
from groundspark.plans.ingest import IngestConfig, ingest_documents

NODE = "ord long, node_id string, text string, collection string, lang string, source_ids array<string>, entities array<string>, quality_score double, flags array<string>, metadata map<string,string>"


def nodes(spark, texts, meta=None):
    return spark.createDataFrame([(i, f"n{i}", t, "a_drug", None, [f"s{i}"], [], None, [], (meta or {}).get(i, {})) for i, t in enumerate(texts)], NODE)


def test_exact(spark):
    out = {r.node_id: r for r in dedup.exact_dedup(nodes(spark, ["x  y", "x y", "z", None, ""])).collect()}
    assert sorted(out) == ["n0", "n2", "n3"]
    assert out["n0"].source_ids == ["s0", "s1", "n1"] and out["n0"].flags == ["dedup"] and out["n2"].flags == []
    assert dedup.exact_dedup(nodes(spark, [])).count() == 0


def test_structured(spark):
    df = nodes(spark, ["a", "b", "c", "d"], {0: {"drug": "x", "section": "1"}, 1: {"drug": "x", "section": "1"}, 2: {"drug": "x"}})
    assert sorted(r.node_id for r in dedup.structured_dedup(df, ["drug", "section"]).collect()) == ["n0", "n2", "n3"]


def test_near(spark):
    kept = dedup.near_dedup(nodes(spark, ["a b c d e f g h", "a b c d e f g x", "p q r s t u v w", "", ""]), 0.7)
    assert sorted(r.node_id for r in kept.collect()) == ["n0", "n2", "n3"]


def test_near_pairs_are_those_of_brute_force(spark):
    random.seed(1)
    texts = []
    for _ in range(12):
        base = [random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(2, 40))]
        for _ in range(5):
            t = list(base)
            for _ in range(random.randint(0, 4)):
                t[random.randrange(len(t))] = random.choice("xyz")
            texts.append(" ".join(t))
    texts += ["", " ", texts[0]]
    sets = [{" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in (t.split() for t in texts)]
    for threshold in (0.5, 0.85):
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
        docs = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").filter("trim(text) <> ''")
        got = {(r.ord_a, r.ord_b) for r in dedup.all_pairs(docs, dedup.near_pairs(docs, threshold)).collect()}
        assert got == want


def test_near_pairs_keep_every_pair_and_move_few_sets(spark, monkeypatch):
    # Records of a form: of 300 words 120 are common to all, so prefixes meet often, and pairs are near in blocks of three.
    random.seed(2)
    form = [f"f{i}" for i in range(120)]
    texts = []
    for k in range(40):
        own = [f"w{random.randrange(400)}" for _ in range(180)]
        for m in range(3):
            t = form + own
            for _ in range(m * 4):
                t[random.randrange(len(t))] = f"x{random.randrange(50)}"
            texts.append("\u3000".join(t) + "\x1f" * (k % 2))
    texts += [texts[0], "", "\xa0", "a b", "a  b", "a b c", "ab", "c"]
    sets = [{" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in (t.split() for t in texts)]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j]}
    want = {k: v for k, v in want.items() if v >= 0.85}
    docs = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    staged, real = {}, dedup.stage
    monkeypatch.setattr(dedup, "stage", lambda df, name: staged.setdefault(name, []).append(x := real(df, name)) or x)
    links = dedup.near_pairs(docs, blanks=False)
    got = {(r.ord_a, r.ord_b): r.jaccard for r in dedup.all_pairs(docs, links).collect()}
    assert got == pytest.approx(want) and len(want) > 50
    assert links.filter("ord_a in (121, 122)").count() == 0 and dedup.near_pairs(docs).filter("ord_a = 121 and ord_b = 122").count() == 1
    assert staged["candidates"][-1].count() <= 2 * len(want)  # the sets of these alone are fetched
    char = {(r.ord_a, r.ord_b) for r in dedup.near_pairs(spark.createDataFrame([(0, "abcdefgh"), (1, "abcdefgh"), (2, "abcdefgx"), (3, "")], "ord long, text string"), 0.7, char=True).collect()}
    assert char == {(0, 1), (0, 2)}
    assert dedup.near_pairs(docs.filter("false")).count() == 0


def test_near_dedup_writes_no_set_twice(spark, monkeypatch):
    staged, real = [], dedup.stage
    monkeypatch.setattr(dedup, "stage", lambda df, name: staged.append((name, df.columns)) or real(df, name))
    kept = dedup.near_dedup(nodes(spark, ["a b c d e f g h", "a b c d e f g x", "p q r s t u v w", "p q r s t u v w", "", ""]), 0.7)
    assert sorted(r.node_id for r in kept.collect()) == ["n0", "n2", "n4"]
    assert [name for name, columns in staged if "s" in columns] == ["shingles"]


def test_clusters_move_no_more_than_they_need(spark, monkeypatch):
    staged, real = [], dedup.stage
    monkeypatch.setattr(dedup, "stage", lambda df, name: staged.append(name) or real(df, name))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c d e f g h", "a b c d e f g x", "p q r s", "p  q r s", "", ""])], "ord long, text string")
    got = {r.ord: r.root for r in dedup.components(dedup.near_pairs(docs, 0.7)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4} and "sets" not in staged and "candidates" in staged


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 205), (205, 99)]
    got = {r.ord: r.root for r in dedup.components(spark.createDataFrame(edges, "ord_a long, ord_b long")).collect()}
    assert got == {i: 0 for i in range(41)} | dict.fromkeys((99, 100, 101, 205), 99)


QA = "ord long, question string, answer string, source_id string"


@pytest.mark.parametrize(("verdict", "n", "flag"), [("equivalent", 1, "equivalent"), ("complementary", 1, "llm_merged"), ("conflicting", 2, "conflict"), ("unrelated", 2, None)])
def test_verdicts(spark, verdict, n, flag):
    items = spark.createDataFrame([(0, "q?", "a", "s1"), (1, "q?", "b", "s2"), (2, "other", "x", "s3"), (3, "other", "x", "s4")], QA)
    out = conflict.resolved(items, lambda q, a: F.lit(verdict), lambda q, a: F.array_join(a, "+")).orderBy("ord").collect()
    group = [r for r in out if r.question == "q?"]
    assert len(group) == n and all(r.flags == ([flag] if flag else []) for r in group)
    single = [r for r in out if r.question == "other"]
    assert len(single) == 1 and single[0].source_ids == ["s3", "s4"]


def test_judge_sees_no_phone(spark):
    items = spark.createDataFrame([(0, "q 13812345678?", "call 13812345678", "s1"), (1, "q 13812345678?", "b", "s2")], QA)
    seen = conflict.resolved(items, lambda q, a: F.when(q.contains("138") | F.array_join(a, " ").contains("138"), "conflicting").otherwise("equivalent")).collect()
    assert [r.flags for r in seen] == [["equivalent"]]
    assert conflict.for_judge(items).filter("answer like '%138%'").count() == 0
    with pytest.raises(RuntimeError):
        conflict.resolved(items)
    assert conflict.resolved(items, enabled=False).count() == 2


def test_signals(spark):
    ent = [("X", "drug", 0, 1, "en", "C1", 1.0), ("Y", "drug", 2, 3, "en", None, 1.0)]
    rows = spark.createDataFrame([(0, "a b c d", ent)], f"ord long, text string, ents array<{entities.ENTITY}>")
    df = spark.createDataFrame([("x", 1)], "entity string, df long")
    r = entities.with_signals(rows, df, 10).first()
    assert (r.density, r.linkable_rate) == (0.5, 0.5)
    # y never occurs in the frequencies, so it counts as rare too
    assert r.rare_rate == 0.5 or r.rare_rate == 1.0


def test_ingest_chain(spark):
    raw = nodes(spark, ["aspirin 13812345678 for Hepatitis.", "aspirin  13812345678 for Hepatitis.", "nothing here"])
    r = ingest_documents(raw, IngestConfig(), entities.dictionary_backend("[A-Z][a-z]{6,}"))
    assert [(x.node_id, x.source_ids) for x in r.nodes.collect()] == [("n0", ["s0", "s1", "n1"])]
    assert [x.node_id for x in r.dropped.collect()] == ["n2"] and r.coverage_lost.count() == 0
    s = r.stats.first()
    assert (s.n_in, s.n_after_dedup, s.n_out, s.phi_found) == (3, 2, 1, 2)
    with pytest.raises(entities.CoverageError):
        entities.assert_coverage(spark.createDataFrame([("rareonly",)], "entity string"), spark.createDataFrame([], "entity string"))


def test_ingest_writes_texts_once_and_merges_as_step_by_step(spark, monkeypatch):
    from groundspark.plans import ingest

    word = lambda i: chr(97 + i % 26) * (1 + i // 26)
    base = " ".join(f"{word(i)} Hepatitis" for i in range(60))
    texts = [base + " end", base + "  end", base + " other end", "unlike Aspirin text", base + " last words", "", None, "unlike Aspirin text"]
    raw = nodes(spark, texts, {2: {"k": "1"}, 3: {"k": "1"}, 4: {"k": "2"}})
    want = dedup.near_dedup(dedup.exact_dedup(dedup.structured_dedup(raw.filter("ord in (2, 3, 4, 5)"), ["k"])))
    staged, real = [], ingest.stage
    monkeypatch.setattr(ingest, "stage", lambda df, name: staged.append((name, df)) or real(df, name))
    got = ingest_documents(raw.filter("ord in (2, 3, 4, 5)"), IngestConfig(near_dedup=True, structured_key_fields=("k",), deidentify=False, ner_filter=False)).nodes
    columns = ("node_id", "text", "source_ids", "flags")
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert [name for name, df in staged if "text" in df.columns] == ["cleaned"]
    r = ingest_documents(raw, IngestConfig(near_dedup=True), entities.dictionary_backend("[A-Z][a-z]{6,}"))
    s = r.stats.first()
    assert (s.n_in, s.n_after_dedup, s.n_dropped_quality, s.n_out) == (8, 3, 1, 2)
    merged = {x.node_id: x.source_ids for x in r.nodes.collect()}
    assert merged == {"n0": ["s0", "s1", "n1", "s2", "n2", "s4", "n4"], "n3": ["s3", "s7", "n7"]}


def test_questions_that_masking_makes_equal_stay_apart(spark):
    from pyspark.sql import functions as F

    from groundspark.operators import conflict

    rows = [(1, "Call 13800138000?", "yes"), (2, "Call 13800138000?", "no"), (3, "Call 13900139000?", "yes"), (4, "Call 13900139000?", "no 13900139000"), (5, None, None)]
    items = spark.createDataFrame([(*r, f"s{r[0]}") for r in rows], "ord long, question string, answer string, source_id string")
    seen = conflict.resolved(items, lambda q, a: F.when(q.contains("[PHONE]") & ~F.array_join(a, "").contains("139"), "conflicting").otherwise("equivalent"))
    got = sorted((r.ord, r.answer, tuple(r.flags)) for r in seen.collect())
    assert got == [(1, "yes", ("conflict",)), (2, "no", ("conflict",)), (3, "yes", ("conflict",)), (4, "no 13900139000", ("conflict",)), (5, None, ())]
    from groundspark.functions.privacy import guarded

    with pytest.raises(Exception, match="personal data"):
        items.select(guarded(F.col("answer"))).collect()
