import pytest

pytest.importorskip("groundspark.llm")
from groundspark.llm import lookalikes, near_dups  # noqa: E402
from groundspark.llm.canon import Canonical, bigrams, fit  # noqa: E402

MODEL = Canonical(dict(bigrams(["people who have patients take the tablets at home cop ease"] * 5)))


@pytest.mark.parametrize(
    ("a", "b"),
    [("Реοрlе wһο һаvе", "People who have"), ("５ ｍｇ", "5 mg"), ("naıve" if False else "naïve", "naïve"), ("pa​tients­", "patients"), ("a b c", "a b c"), ("⼈⼯", "人工"), (" x  y ", "x y"), ("ﬁt", "fit"), ("сор", "cop"), ("ё", "ë")],
)
def test_equal_looking_texts_have_one_form(a, b):
    assert MODEL(a) == MODEL(b)
    assert MODEL(MODEL(a)) == MODEL(a)


def test_equal_looking_words_of_two_scripts_have_one_form(spark):
    model = Canonical(dict(bigrams(["patients take the tablets at home"] * 50 + ["сера и вода при лечении"] * 20)))
    for a, b in (("cepa", "сера"), ("cop", "сор"), ("ρace", "pace")):
        assert model(a) == model(b) == model(model(a))
    assert model("вода") == "вода" and model("вoдa") == "вода"
    greek = Canonical(dict(bigrams(["το νερό και το φως"] * 50)))
    assert greek("oo") == greek("οο")
    df = rows(spark, ["patients take cepa"] * 3 + ["patients take сера"] * 2 + ["patients take the tablets вода"] * 9)
    assert {(r.ord_a, r.ord_b) for r in lookalikes.found(df).collect()} == {(i, j) for i in range(3) for j in (3, 4)}


@pytest.mark.parametrize(("a", "b"), [("10⁹", "109"), ("H₂", "H2"), ("naïve", "naive"), ("Word", "word"), ("½", "1/2")])
def test_visible_differences_stay(a, b):
    assert MODEL(a) != MODEL(b)


def test_null_and_blank():
    assert MODEL(None) is None and MODEL(" ​\n　") == "" and Canonical({})("аbс") == "abc"


def rows(spark, texts, tbl="t"):
    return spark.createDataFrame([(tbl, i, t) for i, t in enumerate(texts)], "tbl string, ord long, text string")


def test_pairs(spark):
    df = rows(spark, ["Take one tablet", "Tаke оne tablet", "Take one tablet", "take one tablet", None, "", " ", "Take one tablet"])
    got = {(r.ord_a, r.ord_b) for r in lookalikes.found(df.withColumn("form", df.text)).collect()}
    assert got == {(0, 1), (1, 2), (0, 7), (1, 7), (2, 7)}
    assert lookalikes.found(df.filter("false")).count() == 0
    assert [r.form for r in lookalikes.canonical(df).orderBy("ord").collect()][4:7] == [None, "", ""]
    assert fit(df.filter("false"), "text") == {}


def test_near_pairs_are_those_of_brute_force(spark, monkeypatch):
    import random
    from collections import Counter

    # Small leaves and blocks, so that trees, triangle bounds and blocks are all used.
    for name, value in (("LEAF", 8), ("BLOCK", 6)):
        monkeypatch.setattr(near_dups, name, value)
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts: list = []
    for _ in range(25):
        base = random.choices(vocabulary, k=random.randint(45, 140))
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(random.randint(0, len(t) // 4)):
                t[random.randrange(len(t))] = random.choice(vocabulary)
            random.shuffle(t)
            texts.append(" ".join(t[: random.randint(int(0.85 * len(t)), len(t))]))
    texts += ["word " * 60, "word " * 70, "肝" * 89, "肝" * 90, "肝" * 100, None, "", texts[0], texts[0].upper()]
    bags = [Counter(t.lower().split()) if t and "肝" not in t else Counter(t or "") for t in texts]

    def near(i, j):
        n = [sum(b.values()) for b in (bags[i], bags[j])]
        least = 90 if "肝" in (texts[i] or "") else 50
        return min(n) >= least and sum((bags[i] & bags[j]).values()) >= 0.8 * max(n) - 1e-9

    want = {(i, j) for j in range(len(texts)) for i in range(j) if near(i, j)}
    df = rows(spark, texts)
    members, links = near_dups.near_classes(df)
    got = [(r.ord_a, r.ord_b) for r in near_dups.expanded(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    assert near_dups.expanded(*near_dups.near_classes(df.filter("false"))).count() == 0


def test_near_texts_of_mixed_scripts_and_groups(spark):
    latin, han = [f"w{i}" for i in range(60)], [chr(0x4E00 + i) for i in range(60)]
    a = " ".join(latin + han[:56])
    b = " ".join(latin[:54] + han)  # a little more than half Chinese
    c = " ".join(latin[:50] + han + ["new", "words"])
    other = " ".join(f"z{i}" for i in range(80))
    df = rows(spark, [a, b, c, other, other], "raw_records")
    members, links = near_dups.near_classes(df)
    assert {(r.ord_a, r.ord_b) for r in near_dups.expanded(members, links).collect()} == {(0, 1), (0, 2), (1, 2), (3, 4)}
    raw, nodes = df.drop("tbl"), df.drop("tbl").filter("ord > 2")
    got = {(r.tbl, r.ord): (r.class_ord, r.n_copies, r.n_links, r.group_ord) for r in near_dups.groups(raw, nodes).collect()}
    assert got == {("raw_records", 0): (0, 1, 2, 0), ("raw_records", 1): (1, 1, 2, 0), ("raw_records", 2): (2, 1, 2, 0), ("raw_records", 3): (3, 2, 0, 3), ("raw_records", 4): (3, 2, 0, 3), ("knowledge_nodes", 3): (3, 2, 0, 3), ("knowledge_nodes", 4): (3, 2, 0, 3)}


def _phrased(count: int, seed: int):
    """Bags of texts made of phrases, each with a near one; the frequent and the rare words are those of all texts."""
    import numpy as np

    from groundspark.llm.near import Bags

    r = np.random.default_rng(seed)
    phrases = r.integers(1, 1 << 47, (120, 6)).astype(np.uint64) << np.uint64(1)
    flat, sizes = [], []
    for _ in range(count):
        w = phrases[r.choice(120, int(r.integers(22, 28)), replace=False)].ravel()
        other = w.copy()
        cut = int(r.integers(1, int(0.2 * len(w))))
        other[r.choice(len(w), cut, replace=False)] = r.integers(1, 1 << 47, cut).astype(np.uint64) << np.uint64(1)
        flat += [w, other]
        sizes += [len(w), len(w)]
    n = np.array(sizes)
    return Bags.elements(np.concatenate(flat), n), n


def test_axes_leave_few_pairs_and_lose_none(monkeypatch):
    import numpy as np

    from groundspark.llm.near import fingerprints, own_bits, shared

    e, n = _phrased(1200, 5)
    bags = np.split(e, np.cumsum(n)[:-1])
    fps = fingerprints(e, n, own_bits([bags[:1000], []])).view(np.uint64)
    for a, b in np.random.default_rng(1).integers(0, len(n), (300, 2)):
        assert near_dups.distances(fps[a], fps[b]) <= n[a] + n[b] - 2 * shared(bags[a], bags[b])
    apart = lambda x: np.median([near_dups.distances(x[::2], y) for y in x[:200:2]])
    assert apart(fps) > 1.1 * apart(fingerprints(e, n).view(np.uint64))

    tested = []
    count = np.bitwise_count
    homes = near_dups.Homes([(int(k), i, f.tobytes()) for i, (k, f) in enumerate(zip(n, fps, strict=True))])
    assert homes.axes is not None
    monkeypatch.setattr(np, "bitwise_count", lambda x: tested.append(len(x)) or count(x))
    got = {(int(i), int(homes.id[k])) for x, y in homes.close(n, fps) for i, k in zip(x, y, strict=True)}
    monkeypatch.undo()
    d = np.array([near_dups.distances(fps, x) for x in fps])
    longer = (n[None] >= n[:, None]) & (n[None] <= (n / 0.8 + 1e-9).astype(int)[:, None])
    want = longer & (d <= n[:, None] - np.floor(0.6 * n - 1e-9)[None])
    assert got == {(int(i), int(k)) for i, k in zip(*np.nonzero(want), strict=True)} and all((2 * i, 2 * i + 1) in got for i in range(1200))
    assert sum(tested) < 0.1 * longer.sum()


def test_pairs_of_a_large_band_are_those_without_axes(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(8)
    phrases = [" ".join(f"p{i}w{k}" for k in range(6)) for i in range(200)]
    texts = [" ".join(phrases[k] for k in r.choice(200, 12, replace=False)) for _ in range(1250)]
    texts += [f"{t} own{i}" for i, t in enumerate(texts)]
    df = rows(spark, texts)
    sides = [F.col("cid_a"), F.col("cid_b")]
    got = {tuple(x) for x in near_dups.near_classes(df)[1].select(*sides).collect()}
    monkeypatch.setattr(near_dups, "MANY", 1 << 40)
    assert got == {tuple(x) for x in near_dups.near_classes(df)[1].select(*sides).collect()} and {(i, 1250 + i) for i in range(1250)} <= got
