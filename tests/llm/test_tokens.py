import os
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("groundspark.llm")
from groundspark.llm import encode, packing, token_budget  # noqa: E402
from groundspark.llm.tokenizers import FOLDER, SPLIT, ByteEncoder, counter, pieces, ranks  # noqa: E402
from groundspark.llm.trie import TrieCounter  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no vocabularies here")


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    odd = ["".join(random.choices("aA1 \n中文é's?！﻿😀ſ½٣ \t_-αЖＡ３́µ²×", k=50)) for _ in range(300)]
    return [*odd, "", " ", "   x", "hello world's 12345", "肝功能损害者" * 50, "<|endoftext|> a", "x" * 3000, "It's  a\n\n test "]


def test_ids_and_counts_are_exact(texts):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks("byte_bpe_50k"), special_tokens={})
    want = [ref.encode_ordinary(t) for t in texts]
    e = ByteEncoder()
    assert [e.ids(t) for t in texts] == want and [e.text(w) for w in want] == texts
    assert [e.count(t) for t in texts] == [len(w) for w in want] == TrieCounter().counts(texts)
    assert e.ids(None) == [] and all("".join(pieces(t)) == t for t in texts)


def test_other_tokenizers_are_exact(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    hf = Tokenizer.from_file(f"{FOLDER}/word_bpe_49k.json")
    hf.encode_special_tokens = True
    p, w = counter("piece_bpe_32k"), counter("word_bpe_49k")
    for _ in range(2):  # the second time from memory
        assert [p.count(t) for t in texts] == [len(sp.encode(t)) for t in texts]
        assert [w.count(t) for t in texts] == [len(hf.encode(t, add_special_tokens=False).ids) for t in texts]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_encoding_table(spark, texts):
    df = docs(spark, [*texts, None])
    out = encode.encoded(df)
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = {r.doc_id: r.text for r in encode.decoded(out).collect()}
    assert [got[i] for i in range(len(texts))] == texts and got[len(texts)] == ""
    assert encode.encoded(df.filter("false")).count() == 0


def test_plan_is_best_fit_decreasing():
    for seed in range(60):
        random.seed(seed)
        cap = random.choice([5, 37, 512])
        items = [random.randint(1, cap) for _ in range(random.randint(0, 150))] + [random.randint(1, max(1, cap // 5))] * (seed % 3 * 25)
        load, done = Counter(), Counter()
        for size, rank, n, first, per in packing.plan(Counter(items).items(), cap):
            assert n > 0 and rank == done[size]
            done[size] += n
            for k in range(n):
                load[first + k // per] += size
        gaps: list[int] = []
        for s in sorted(items, reverse=True):
            fit = [(g, i) for i, g in enumerate(gaps) if g >= s]
            if fit:
                gaps[min(fit)[1]] -= s
            else:
                gaps.append(cap - s)
        assert done == Counter(items) and max(load.values(), default=0) <= cap and sorted(load) == list(range(len(gaps)))


def test_packed_table(spark):
    texts = ["a " * random.Random(i).randint(0, 900) for i in range(60)] + ["", None, "b " * 5000]
    caps = spark.createDataFrame([(1, 512, "byte_bpe_50k"), (2, 300, "word_bpe_49k"), (3, None, "byte_bpe_50k")], "capacity_id int, capacity_tokens int, tokenizer string")
    rows = packing.packed(docs(spark, texts), caps).toPandas()
    for cid, cap, name in ((1, 512, "byte_bpe_50k"), (2, 300, "word_bpe_49k")):
        x, c = rows[rows.capacity_id == cid], counter(name)
        assert x.groupby("doc_id").tokens.sum().to_dict() == {i: c.count(t) for i, t in enumerate(texts)}
        load = x.groupby("container_id").tokens.sum()
        assert load.max() <= cap and sorted(load.index) == list(range(len(load)))
        big = x.groupby("doc_id").filter(lambda g: g.tokens.sum() <= cap).groupby("doc_id").size()
        assert (big == 1).all()  # nothing is split that fits
        assert np.ceil(x.tokens.sum() / cap) >= 0.9 * len(load)
    assert set(rows.capacity_id) == {1, 2}
    assert packing.packed(docs(spark, texts).filter("false"), caps).count() == 0


def test_budget(spark):
    raw = spark.createDataFrame(
        [(1, "r1", "liver mass", "en_GB", "s1", None), (2, "r1", "liver mass again", "EN", "s2", None), (3, "r2", "肝占位" * 9, None, None, None), (4, None, None, "und", "s1", None)],
        "ord long, record_id string, text string, lang string, source string, ingested_at timestamp",
    )
    nodes = spark.createDataFrame([(1, "a", "liver", "Chinese", " C-Text", ["r1", "zz"]), (2, "b", "x", "de-AT", None, None)], "ord long, node_id string, text string, lang string, collection string, source_ids array<string>")
    src = spark.createDataFrame([("s1", "d1"), ("s2", "d2")], "source string, domain string")
    t = {(r.tbl, r.source, r.domain, r.lang, r.collection): (r.n_docs, r.n_tokens) for r in token_budget.totals(raw, nodes, src).collect()}
    e = ByteEncoder()
    assert t["raw_records", "s1", "d1", "en", "(none)"] == (1, e.count("liver mass")) and t["raw_records", "s1", "d1", "und", "(none)"] == (1, 0)
    assert t["raw_records", "(none)", "(none)", "zh", "(none)"] == (1, e.count("肝占位" * 9))
    assert t["knowledge_nodes", "s2", "d2", "zh", "c_text"] == (1, e.count("liver")) and t["knowledge_nodes", "(none)", "(none)", "de", "(none)"] == (1, 1)
    assert token_budget.totals(raw.filter("false"), nodes.filter("false"), src).count() == 0
