import random

import numpy as np
import pytest

pytest.importorskip("groundspark.llm")
from groundspark.llm import pii, qa_defects, reading, sampling, split_overlap  # noqa: E402
from groundspark.llm.tagger import KINDS, Tagger  # noqa: E402

LONG = "Patients with poorly controlled diabetes should undergo assessment of fluid balance over {} hours before surgery, and dosing should be reviewed by the prescriber in all cases."


def test_defects(spark):
    good = [(f"How is drug{i} stored at {i} degrees?", LONG.format(i) + " Keep it dry.") for i in range(40)]
    bad = [
        ("How much drug1?", None, "empty"), ("How much drug2?", "N/A", "empty"), ("How much drug3?", "<p></p>", "empty"), ("Who should take drug4 at night?", "Q: who should take drug4 at night", "copy"),
        ("How much drug5?", "I'm sorry, but I cannot comment on individual cases. Please ask.", "refusal"), ("Can I take drug6?", "I'm sorry, but I cannot comment on individual cases.", "refusal"),
        ("Can I take drug7 with the evening meal?", "肌酐清除率下降的老年患者外科干预之前需谨慎调整血清肌酐与血钾浓度。", "other_language"), ("Is drug8 safe with the tablets?", LONG.format(3) + " Patients with poorly controlled", "truncated"),
        ("Is drug9 safe for the patients?", "Patients with poorly controlled diabetes should undergo assess...", "truncated"), ("Is it?", "No.", None), ("Is it two?", "5 mg", None), (None, "Yes, with food.", None),
        ("May I take it in the evening?", LONG.format(9).rstrip(".") + " (诺佐佐亚 / Kubamalume)", None),
    ]
    items = [(q, a, None) for q, a in good] + bad
    df = spark.createDataFrame([(i, q, a, "x") for i, (q, a, _) in enumerate(items)], "ord long, question string, answer string, label string")
    got = {r.ord: r.defect for r in qa_defects.labelled(df).collect()}
    assert got == {i: k for i, (_, _, k) in enumerate(items)}
    assert qa_defects.found(df.filter("false")).count() == 0


def test_refusals_of_any_length_are_told_by_their_cluster(spark):
    long_ = "I am sorry, but as a matter of principle the people who run this service have asked me never to comment on the treatment of individual patients, and so I cannot say anything about this question, however much I would like to help you with it today."
    asked = ["How is Zubex stored in winter?", "Can my son swim with asthma?", "When does the clinic open again?", "Is grapefruit harmful beside Kalomil?", "What about a rash on the left arm?"]
    rows = [(q, long_, True) for q in asked]
    rows += [(q, long_.replace("today", t), True) for q, t in zip(asked, ("now", "here"), strict=False)]
    # The same opening, but the answer goes on with something of its own; one prompt only; a short answer that recurs.
    rows += [(q, f"{long_} Still, keep number {i}{i} dry and cool.", False) for i, q in enumerate(asked)]
    rows += [("Is one prompt enough?", "We cannot tell you that here, please.", False)] * 3
    rows += [(q, "Yes, with food.", False) for q in asked]
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(rows)], "ord long, question string, answer string")
    got = {r.ord for r in qa_defects.refusals(qa_defects.forms(df)).collect()}
    assert got == {i for i, (*_, k) in enumerate(rows) if k}


def test_clusters_keep_nearly_all_similar_openings(spark):
    r = random.Random(4)
    base = [[f"{chr(97 + k)}{i}" for i in range(24)] for k in range(8)]
    rows = []
    for k in range(8):
        for i in range(30):
            w = list(base[k])
            if i % 3:
                w[r.choice([0, 23])] = f"x{r.randrange(4)}"
            rows.append((f"how about {k} {i} {r.randrange(999)}", " ".join(w)))
    openings = sorted({o for _, o in rows})
    sets = {o: set(qa_defects.shingles(o)) for o in openings}
    alike = [(x, y) for i, x in enumerate(openings) for y in openings[:i] if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    df = spark.createDataFrame([(o, 1, i) for i, o in enumerate(openings)], "opening string, n_rows long, id long")
    root = {openings[x.ord]: x.root for x in qa_defects.components(qa_defects._links(df)).collect()}
    assert len(alike) > 100 and sum(root.get(x) is not None and root.get(x) == root.get(y) for x, y in alike) >= 0.95 * len(alike)


def test_no_similar_openings_stay_apart(spark):
    # Openings that are alike only by way of others: neither the most frequent one of a bucket nor the neighbour in order is alike.
    r = random.Random(6)
    openings = set()
    for k in range(12):
        base = [f"b{k}w{i}" for i in range(34)]
        for _ in range(40):
            w = list(base)
            for _ in range(r.choice([1, 2])):
                w[r.choice([0, 1, 2, 31, 32, 33])] = f"x{r.randrange(9)}"
            openings.add(" ".join(w[r.randrange(3) :]))
    openings = sorted(openings)
    sets = {o: set(qa_defects.shingles(o)) for o in openings}
    alike = [(x, y) for i, x in enumerate(openings) for y in openings[:i] if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    df = spark.createDataFrame([(o, 1, i) for i, o in enumerate(openings)], "opening string, n_rows long, id long")
    root = {openings[x.ord]: x.root for x in qa_defects.components(qa_defects._links(df)).collect()}
    assert len(alike) > 1000 and all(root.get(x) is not None and root[x] == root[y] for x, y in alike)


def test_any_two_unrelated_prompts_spread_a_cluster(spark):
    from pyspark.sql import functions as F

    def middle(prompts, others):
        """The first of the prompts that neither hash puts first or last among the others."""
        h = {q: (x, y) for q, x, y in spark.createDataFrame([(q,) for q in [*prompts, *others]], "q string").select("q", F.xxhash64("q"), F.xxhash64(F.lit(1), "q")).collect()}
        return next(q for q in prompts if all(min(h[o][i] for o in others) < h[q][i] < max(h[o][i] for o in others) for i in (0, 1)))

    related = [f"how is the red Zubex tablet stored safely {i}" for i in range(40)]
    alone = middle([f"can my son number {i} swim with asthma" for i in range(40)], related)
    # Both share six words of eight with the others, but four with each other.
    x = middle([f"how is the red Zubex tablet cooled x{i}" for i in range(40)], related)
    x2 = middle([f"y{i} z{i} the red Zubex tablet stored safely" for i in range(40)], related)
    asked = {"one odd prompt": [*related, alone], "none": related, "two ends": [*related, x, x2]}
    rows = [(q, f"{k} opens an answer in just this way every time", False) for k, qs in asked.items() for q in qs]
    got = {r.opening.split(" opens")[0]: r.n_rows for r in qa_defects.templates(spark.createDataFrame(rows, "q string, opening string, declines boolean")).collect()}
    assert got == {"one odd prompt": 41, "two ends": 42}


def test_only_whole_contact_details_end_an_answer(spark):
    cut = ["Family members caring for the patient are asked to", "Patients below 139 kilograms should", "Ring the phone of the ward and", "Keep the next of kin informed of", "Staff contact the patient, who slowly reduces headaches and", "慢性阻塞性气道疾病患者每隔212日常伴有电解质紊乱与"]
    whole = ["Tel: 07700 900471", "Reach us at x.y@mail.example.org", "petra (at) inbox (dot) example (dot) com", "Regards, Petra Thornshaw", "Next of kin: Petra Thornshaw", "Address: 46 Millrace Lane, Hexley 58098", "SSN Z34422954", "患者姓名：尉迟思齐", "住址：青石巷3号4单元316室", "Their reach is [PHONE]"]
    other = [f"{x} take one tablet." for x in ("asked to", "weight should", "day and", "because of", "电解质紊乱与脱水有关") for _ in range(15)]
    rows = [*cut, *whole, *other]
    got = {r.ord for r in qa_defects.truncated(spark.createDataFrame(list(enumerate(rows)), "ord long, a string")).collect()}
    assert got == set(range(len(cut)))


def test_split_overlap(spark):
    r = random.Random(2)
    text = " ".join(r.choices([f"w{i}" for i in range(400)], k=120))
    words = text.split()
    moved = " ".join(words[60:] + words[:55] + ["new"] * 5)
    rows = [(1, "CT-2020-00012345", text, "train"), (2, "ct 2020 12345", None, "test"), (3, "CTA-2020-1", moved, "val"), (4, None, "short", "test"), (5, "x", " ".join(r.choices("abcdefgh", k=100)), "val"), (6, "AB-2019-7:roi0", text, "train"), (7, " ab_2019_0007 ", None, "train"), (8, "AB20190007", text, "test")]
    df = spark.createDataFrame([(*x, "s", "extra") for x in rows], "ord long, case_id string, report_text string, split string, source string, cid string")
    got = {(x.ord_a, x.ord_b) for x in split_overlap.found(df).collect()}
    assert got == {(1, 2), (1, 3), (3, 6), (1, 8), (6, 8), (7, 8)}
    rep = {(x.split, x.source): x for x in split_overlap.report(df).collect()}
    assert rep["test", "s"].n_overlapping == 2 and rep["test", "s"].n_rows == 3 and rep["val", "s"].n_pairs == 2
    assert 0 < split_overlap.fractions(df).filter("ord = 3").first().overlap_fraction <= 1
    assert split_overlap.found(df.filter("false")).count() == 0


def test_near_records_in_another_order_are_found(spark):
    r, rows, want = random.Random(9), [], set()
    for i in range(40):
        w = r.sample([f"w{k}" for k in range(2500)], 100)
        cut = 10 if i % 2 else 19
        other = w[cut:] + [f"n{i}x{k}" for k in range(cut)]
        r.shuffle(other)
        rows += [(2 * i, None, " ".join(w), "train"), (2 * i + 1, None, " ".join(other), "test")]
        want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame([(*x, "s") for x in rows], "ord long, case_id string, report_text string, split string, source string")
    got = {(x.ord_a, x.ord_b) for x in split_overlap.found(df).collect()}
    assert got <= want and {p for p in want if p[0] // 2 % 2} <= got and len(got) >= 38  # of those at the limit, 19 words in 100, nearly all


def test_hot_chunks_are_refined(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "HOT", 4)
    phrase = " ".join(f"p{i}" for i in range(40))
    r = random.Random(4)
    own = [" ".join(f"u{r.randrange(500)}" for _ in range(60)) for _ in range(12)]
    rows = [(i, None, f"{phrase} {own[i // 2]}" + (" end" if i % 2 else ""), "train" if i % 2 else "test") for i in range(24)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "ord long, case_id string, report_text string, split string, source string")
    assert {(x.ord_a, x.ord_b) for x in split_overlap.found(df).collect()} == {(i, i + 1) for i in range(0, 24, 2)}


def test_pairs_that_share_only_hot_chunks_are_found(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "HOT", 0)
    r = random.Random(6)
    rows = []
    for i in range(12):
        w = [f"v{r.randrange(3000)}" for _ in range(110)]
        # Every eleventh word is new, so hardly two or three chunks in a row are left.
        rows += [(2 * i, None, " ".join(w), "train"), (2 * i + 1, None, " ".join(f"n{i}x{k}" if k % 11 == 3 else x for k, x in enumerate(w)), "test")]
    df = spark.createDataFrame([(*x, "s") for x in rows], "ord long, case_id string, report_text string, split string, source string")
    assert {(x.ord_a, x.ord_b) for x in split_overlap.found(df).collect()} == {(i, i + 1) for i in range(0, 24, 2)}


def test_allocation():
    assert sampling.allocate([0.5, 0.3, 0.2], [0, 0, 0], [100, 100, 100], 10) == [5, 3, 2]
    assert sum(sampling.allocate([1 / 3] * 3, [0] * 3, [100] * 3, 10)) == 10
    assert sampling.allocate([0.9, 0.1], [0, 3], [100, 100], 10) == [7, 3]
    assert sampling.allocate([0.9, 0.1], [0, 0], [4, 100], 10) == [4, 6]
    assert sampling.allocate([0.5, 0.5], [0, 0], [2, 1], 10) == [2, 1]
    assert sampling.allocate([None, 1.0], [None, 0], [5, 5], 0) == [0, 0]


def test_sampling(spark):
    ct = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ord long, source string")
    rois = [(i, 1 if i % 3 else 2, i // 2 if i < 10 else i, 0.01 if i % 2 else None, " Small" if i % 4 else "unknown") for i in range(120)] + [(900, 1, 50, 7.0, "LARGE"), (901, 3, 1, 0.01, None), (902, 77, 1, 0.01, None)]
    r = spark.createDataFrame(rois, "ord long, sample_ord long, roi_index int, area_fraction double, area_band string")
    t = spark.createDataFrame([("p", "a", "small", 0.9, 0, 0.29), ("p", "a", "large", 0.1, 9, 0.29), ("q", "zz", "small", 1.0, 1, 0.5)], "plan_id string, source string, area_band string, target_share double, min_rows int, sample_rate double")
    regs = sampling.regions(r, ct).toPandas()
    assert not regs.duplicated(["sample_ord", "roi_index"]).any() and set(regs.source) == {"a", "b"}
    assert sorted((x.plan_id, x.area_band) for x in sampling.unmet(t, r, ct).collect()) == [("p", "large"), ("q", "small")]
    a = sampling.sampled(t, r, ct).toPandas()
    quota = {(x.plan_id, x.area_band): x.quota for x in sampling.allocated(t, sampling.regions(r, ct)).collect()}
    assert a.groupby(["plan_id", "area_band"]).size().to_dict() == {k: v for k, v in quota.items() if v}
    assert not a.duplicated(["plan_id", "sample_ord", "roi_index"]).any()
    again = sampling.sampled(t, r.repartition(7), ct).toPandas()
    assert set(a.itertuples(index=False, name=None)) == set(again.itertuples(index=False, name=None))
    assert sampling.unmet(t.filter("false"), r, ct).count() == 0 and sampling.sampled(t, r.filter("false"), ct).count() == 0


def test_gradients_and_learning():
    t = Tagger(Tagger.letters(["ab c1"]))
    r = np.random.default_rng(0)
    for k in t.p:
        t.p[k] = (t.p[k] + r.standard_normal(t.p[k].shape) * 0.1).astype(np.float32)
    x, y = r.integers(1, 7, (3, 7)), r.integers(0, 6, (3, 7))
    x[1, 5:] = 0
    _, g = t._gradients(x, y)
    for k in t.p:
        i = (int(x[0, 0]), 3) if k == "emb" else tuple(int(r.integers(0, s)) for s in t.p[k].shape)
        was = t.p[k][i]
        t.p[k][i] = was + 1e-2
        up = t._gradients(x, y)[0]
        t.p[k][i] = was - 1e-2
        down = t._gradients(x, y)[0]
        t.p[k][i] = was
        assert (up - down) / 2e-2 == pytest.approx(float(g[k][i]), abs=2e-3)
    q = random.Random(1)
    texts = [f"{'call' if i % 2 else 'lot'} {q.randrange(10**6, 10**7)} now" for i in range(200)]
    tags = [[2 if c.isdigit() and s.startswith("call") else 0 for c in s] for s in texts]
    m = Tagger(Tagger.letters(texts))
    m.train(texts[:150], tags[:150], steps=120)
    out = m.tag([*texts[150:], "", "call 1234567 now " * 9])
    right = sum((o == np.array(w)).mean() for o, w in zip(out[:50], tags[150:], strict=True)) / 50
    assert right > 0.97 and len(out[50]) == 0 and len(out[51]) == 153


PEOPLE = ["Corwin Ashmoor", "Thea Fairby", "Nell Tolmere", "Orrin Wendvane", "Brisa Larkby"]


def _letter(i: int) -> tuple[str, set]:
    q = random.Random(i)
    who, n = PEOPLE[q.randrange(5)], q.randrange(10**5, 10**6)
    kinds = [
        (f"Ask {who}, phone 07700 {n}, about this case.", {"name", "phone"}), (f"Please write to x{n}@mail.example.org for the results.", {"email"}), (f"Her identity card reads 9{n % 90 + 10} 00 {n % 9000 + 1000}.", {"id_number"}),
        (f"The patient lives at {n % 300} Greenfinch Lane, Hexley.", {"address"}), (f"Lot 20{n}{n} is on shelf {n % 40}.", set()), ("Patients should keep the tablets dry.", set()), (f"Reply to Mr {who.split()[1]}, please.", {"name"}),
    ]
    s, k = kinds[q.randrange(7)]
    return f"Patients should take the tablets with food. {s} Patients should rest.", k


def test_personal_details(spark):
    letters = [_letter(i) for i in range(700)]
    raw = spark.createDataFrame([(i, t, None, {"drug": "Zubuhavex"}) for i, (t, _) in enumerate(letters)] + [(9001, None, "", None)], "ord long, text string, question string, metadata map<string,string>")
    qa = spark.createDataFrame([], "ord long, answer string")
    df = pii.fields(raw, qa)
    finder = pii.trained(df, raw)
    assert finder.examples > 100
    held = [_letter(i) for i in range(5000, 5200)]
    spans = finder.spans([t for t, _ in held])
    hit = sum({k for *_, k in s} == k for s, (_, k) in zip(spans, held, strict=True))
    assert hit >= 0.85 * len(held)
    for (t, _), s in zip(held, spans, strict=True):
        out = pii.redacted(t, s)
        kept = t
        for a, b, k in sorted(s, reverse=True):
            kept = kept[:a] + pii.PLACEHOLDER[k] + kept[b:]
        assert out == kept and out.startswith("Patients should take")
    assert finder.spans([None, "", "x" * 5000]) == [[], [], []]
    got = pii._detected(df, finder, False)
    assert set(got.columns) == {"tbl", "ord", "field_name", "kind"} and {r.kind for r in got.collect()} <= set(KINDS)
    assert pii.found(raw.filter("false"), qa).count() == 0


def test_usual_words_behind_a_title_can_be_names():
    usual = pii.Usual.of(["Hasklake", "Tolvane", "Patients"])
    for t, w in (("La señora Hasklake preguntó", "Hasklake"), ("Reply to Mr Tolvane via", "Tolvane")):
        a = t.index(w)
        assert pii.possible("name", w, t[:a], t[a + len(w) :], usual)
    assert not pii.possible("name", "Hasklake", "the ", " scale", usual) and not pii.possible("name", "Tolvane", "the ", " syndrome", usual)
    assert not pii.possible("name", "Patients", "Rest. ", " should", usual)


def test_the_filter_of_usual_words_is_that_of_the_cluster(spark):
    words = ["liver", "Leber", "肝", "naïve", "Zubuhavex"]
    text = " ".join(f"{w} {w} {w} x" for w in words)
    df = spark.createDataFrame([(text,), (None,), ("Only Once",)], "text string")
    grams, usual = pii.survey(df, "text", spark.createDataFrame([("zubuhavex ",)], "word string"))
    assert "liver" in usual and "naïve" in usual and "zubuhavex" in usual and "Zubuhavex" in usual and "Only" not in usual and "Leber" not in usual
    assert grams["^l"] == 3 and pii.survey(df.filter("false"), "text")[0] == {}


def test_emissions_are_those_of_training():
    r = np.random.default_rng(2)
    t = Tagger({chr(97 + i): i + 3 for i in range(20)}, 1)
    for k in ("b", "bias"):
        t.p[k] += r.standard_normal(t.p[k].shape).astype(np.float32)
    x = r.integers(1, 23, (30, 40))
    x[20:, :15] = 0
    h, _ = t._run(x)
    want = h[0] @ t.p["out"][0] + h[1] @ t.p["out"][1] + t.p["bias"]
    assert np.abs(t.emissions(x) - want.transpose(2, 0, 1)).max() < 1e-5


def test_emissions_of_odd_and_even_windows():
    """The two directions meet at one place, between two, or at once."""
    from groundspark.llm.tagger import PAD

    t, r = Tagger({chr(97 + i): i + 3 for i in range(20)}, 1), np.random.default_rng(4)
    t.p["bias"] += r.standard_normal(t.p["bias"].shape).astype(np.float32)
    for steps in (1, 2, 3, 8, 9):
        x = r.integers(1, 23, (steps, 5))
        x[steps // 2 + 1 :, 3] = PAD
        h, _ = t._run(x)
        want = h[0] @ t.p["out"][0] + h[1] @ t.p["out"][1] + t.p["bias"]
        got = t.emissions(x)
        assert got.shape == (len(KINDS) + 1, steps, 5)
        assert np.abs(got - want.transpose(2, 0, 1)).max() < 1e-5


def test_windows_and_bounds_lose_no_path():
    r, q = np.random.default_rng(3), random.Random(3)
    t = Tagger(Tagger.letters(["abcdefgh 123"]), hidden=8, fold={0x200B: ""})
    for k in t.p:
        t.p[k] = (t.p[k] + r.standard_normal(t.p[k].shape) * 0.3).astype(np.float32)
    t.p["bias"][0] += 1.6
    texts = ["".join(q.choices("abcdefgh 123", k=q.randrange(1, 400))) for _ in range(60)] + ["", "ab​c"]
    some = 0
    for text, y in zip(texts, t.paths(texts, 96, 16, 7), strict=True):
        if not text:
            assert y is None
            continue
        kept = text.replace("​", "")
        step = -(-(len(kept) - 16) // (n := max(1, -(-(len(kept) - 16) // 80)))) if len(kept) > 16 else len(kept)
        starts = [0] if len(kept) <= 96 else range(0, len(kept) - 16, step)
        parts = [(s, t.emissions(t.ids(kept[s : s + (step + 16 if len(kept) > 96 else len(kept))])[:, None])[:, :, 0]) for s in starts]
        want = t.viterbi(t._joined(parts, len(kept))[:, :, None])[0]
        got = np.zeros(len(text), np.int8) if y is None else y
        assert (got[[i for i, c in enumerate(text) if c != "​"]] == want).all()
        some += bool(want.any())
    assert 5 < some < len(texts)


def test_homoglyphs_keep_places():
    form, where = pii.aligned("Соntасt​ dеtаіlѕ", pii.Canonical({}))
    assert form == "Contact details" and where[7] == 8


def test_isotonic():
    ends, values = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert list(values) == [1.0, 2.5, 4.0] and list(ends) == [1.0, 3.0, 4.0]


def test_reading(spark):
    styles = {1: "you can take this pill and rest at home with the soup ", 2: "patients who drink alcohol should not stop the evening tablet without asking ", 3: "elderly residents with reduced clearance require regular monitoring of the serum creatinine ", 4: "autonomic decompensation was independently associated with progressive interstitial fibrosis of the cohort "}
    q = random.Random(0)
    doc = lambda k: ". ".join(" ".join(q.sample(styles[k].split(), 9)) for _ in range(8))
    texts = [(i, doc(i % 4 + 1)) for i in range(160)] + [(900, "Title"), (901, None), (902, "Na\t318\tg/L\n013420;64;7194\n" * 9), (903, "Ältere Menschen dürfen auf keinen Fall während der ersten Tage das Pflaster nicht mit der Hand beobachten und so weiter.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a", i % 4 + 1) for i in range(80)] + [(1, "b", None), (2, "b", 9)], "doc_id long, annotator string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading.graded(docs, labels).collect()}
    assert set(got) == set(range(160)) and sum(got[i] == i % 4 + 1 for i in range(80, 160)) >= 72
    assert reading.graded(docs, labels.filter("false")).count() == 0 and reading.graded(docs.filter("false"), labels).count() == 0


def test_every_graded_document_is_learned_from(spark):
    from pyspark.sql import functions as F

    styles = {1: "you can take this pill and rest at home with the soup", 2: "patients who drink alcohol should not stop the evening tablet", 4: "autonomic decompensation was independently associated with the progressive fibrosis of cohort"}
    q = random.Random(1)
    doc = lambda k: ". ".join(" ".join(q.sample(styles[k].split(), 8)) for _ in range(3))
    # The highest level is given to those documents only that a sample of 3,000 in the order of a hash would leave out.
    order = [r.id for r in spark.range(3200).orderBy(F.xxhash64("id"), "id").collect()]
    level = {i: 4 if k >= 3000 else 1 + k % 2 for k, i in enumerate(order)}
    docs = spark.createDataFrame([(i, doc(level[i])) for i in range(3200)] + [(9000 + k, doc(4)) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a", level[i]) for i in range(3200)], "doc_id long, annotator string, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading.graded(docs, labels).filter("doc_id >= 9000").collect()}
    assert len(got) == 20 and all(v == 4 for v in got.values())
    one, other = reading.trained(docs.repartition(7), labels), reading.trained(docs.coalesce(1), labels)
    assert np.array_equal(one.weights["en"], other.weights["en"]) and all(np.array_equal(a, b) for a, b in zip(one.curve["en"], other.curve["en"], strict=True))
