import random
import zlib

import numpy as np

from loomgraph.llm import langid


def small(languages=("a", "b", "c"), hidden=4):
    net = langid.Network.fresh(list(languages), hidden)
    net.x, net.u, net.b, net.v, net.c = (w.astype(np.float64) for w in net.weights())
    return net


def test_gradients_are_those_of_the_loss():
    net, r = small(), np.random.default_rng(0)
    windows, labels, mask = r.integers(0, 256, (5, 7)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.ones((5, 7), bool)
    mask[0, 5:] = False
    _, gradients = langid.backward(net, windows, labels, mask)
    for w, g in zip(net.weights(), gradients):
        for _ in range(5):
            at = tuple(int(r.integers(0, s)) for s in w.shape)
            old, losses = w[at], []
            for step in (0.01, -0.01):
                w[at] = old + step
                losses.append(langid.backward(net, windows, labels, mask)[0])
            w[at] = old
            assert abs((losses[0] - losses[1]) / 0.02 - g[at]) < 1e-4


def test_pooling_counts_every_byte_once():
    net = langid.Network.fresh(["a", "b"])
    texts = [b"x", b"word " * 10, bytes(range(32, 127)) * 3, b"y" * langid.WINDOW]
    got = langid.pooled(net, texts)
    for text, row in zip(texts, got):
        filled, total, done = text.ljust(langid.WINDOW, b" "), np.zeros(2), 0
        starts = list(range(0, len(filled) - langid.WINDOW + 1, langid.WINDOW))
        if starts[-1] + langid.WINDOW < len(filled):
            starts.append(len(filled) - langid.WINDOW)
        for s in starts:
            p = langid.forward(net, np.frombuffer(filled[s : s + langid.WINDOW], np.uint8)[None])
            for t in range(langid.WINDOW):
                if s + t == done and done < len(text):
                    total += p[t, :, 0]
                    done += 1
        assert done == len(text) and np.allclose(row, total / len(text), atol=1e-5)


WORDS = {"en": "the and of with from that which house street water".split(), "de": "und der nicht über schön straße wasser häuser ich".split(), "fr": "le et dans être où maison rue français élève que".split()}


def corpus(n):
    r = random.Random(4)
    return [(i, " ".join(r.choice(WORDS[g]) for _ in range(r.randrange(3, 120))), g) for i, g in enumerate(r.choice(list(WORDS)) for _ in range(n))]


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(400) + [(1000, None, "en"), (1001, "", "en"), (1002, "123 456 !", "de"), (1003, "the house", None), (None, "und nicht", "de"), (1005, "the water and " * 20_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as p")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1003].lang_pred == "en" and got[1005].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    tested = [(got[i].lang_pred, g) for i, _, g in corpus(400) if got[i].held_out]
    assert len(tested) > 50 and sum(a == b for a, b in tested) >= 0.95 * len(tested)


def test_no_labels_and_no_rows(spark):
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    df = spark.createDataFrame([(1, "the house", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]


def test_sample_is_bounded_by_documents(spark):
    one = spark.range(20_000).selectExpr("1L as doc_id", "concat('the house ', id) as text", "'en' as lang")
    more = spark.range(1000, 3000).selectExpr("id as doc_id", "concat('und nicht ', id, repeat(' wasser', 40)) as text", "concat('l', id % 7) as lang")
    passages, languages = langid.labelled_passages(one.union(more), most=20)
    assert languages.count("en") <= langid.SPOTS and {g for g in languages} == {"en", *(f"l{k}" for k in range(7))}
    assert all(20 <= languages.count(f"l{k}") <= 20 * langid.SPOTS for k in range(7)) and all(len(p) <= langid.WINDOW for p in passages)


def test_more_than_256_languages(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "concat(char(97 + id % 20), char(97 + (id div 20) % 16), ' word') as text", "concat('l', id % 320) as lang")
    assert len(set(langid.labelled_passages(df)[1])) == 320
