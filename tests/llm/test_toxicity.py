import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import toxicity as t


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


TERMS = [t.Term("idiot", False, 3, 2), t.Term("worthless", False, 3, 2), t.Term("scum", False, 3, 2), t.Term("moron", False, 3, 0), t.Term("achlich", True, 3, 2), t.Term("boco", True, 3, 0), t.Term("idea", False, 1, 1)]


def brute(word):
    best = set()
    for k, term in enumerate(TERMS):
        ends = range(len(word) + 1) if term.stem else [len(word)]
        edits = min(distance(term.text, word[:e]) for e in ends)
        if edits <= term.edits:
            best.add((edits, 2 * k + (edits > 0)))
    return {c for e, c in best if e == min(x for x, _ in best)} or {-1}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "idioot", "idit", "worthlss", "wortless", "scum", "sum", "achlichen", "aclich", "boco", "bocooo", "idea", "x"]) | st.text("abcdehilostwz", min_size=1, max_size=12), min_size=1, max_size=8))
def test_automaton_is_edit_distance(words):
    points = t.folded(" ".join(words))
    starts, ends = t.words_of(points)
    for automaton in (t.Automaton(TERMS), t.Automaton(TERMS, cells=1)):  # the second one's table is full all the time
        assert all(g in brute(w) for g, w in zip(automaton.walk(automaton.classes(points), starts, ends), words))
        assert len(automaton.sets) <= 64 or automaton.most_states > 64


def test_quotation_counts_less_than_abuse():
    texts = ["you idiot, you are an IDI0T", 'he said "you are an idiot" and left', "you are an early bird and you are left"] * 40
    model = t.fit(texts, [1, 0, 0] * 40)
    automaton = t.Automaton(model.terms)
    found, n = t.hits(texts[:3], automaton)
    assert [c for _, c in found[0]] == [False, False] and [c for _, c in found[1]] == [True] and not found[2]
    assert n.tolist() == [6, 8, 9]
    said, quoted, calm = model.score(t.features(texts[:3], model.terms, automaton))
    assert said >= t.PREDICT > quoted and calm < t.PREDICT


def test_pieces_of_a_long_text_lose_no_hit():
    text = ("calm words here " * 40_000) + "idiot " + "x" * 600_000 + " idiot"
    found, n = t.hits([text], t.Automaton(TERMS))
    assert len(found[0]) == 2


def corpus(n):
    r = random.Random(1)
    calm = [f"{a}{b}" for a in ("ra", "lo", "mi", "te", "su") for b in ("ner", "kal", "vos", "din")]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [r.choice(calm) for _ in range(r.randrange(20, 200))], i % 6 == 0
        if toxic:
            for _ in range(r.randrange(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(["blorf", "blorfen", "snarkvile", "SNARKVILE!", "idiot"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents(spark):
    rows, labels = corpus(900)
    rows += [(5000, None), (5001, ""), (5002, "... 12"), (None, "ranner"), (5, "repeated row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as score", "8 as __y")
    marks = spark.createDataFrame([*labels, (None, 1), (6000, None)], "doc_id long, toxic int")
    got = t.toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    assert by[5000].score == by[5001].score and by[5000].predicted == 0
    tested = [(by[i].predicted, y) for i, y in labels if i != 5 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in labels if i != 5)
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)
    kept = t.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


@pytest.mark.parametrize("labels", [[], [(1, 0)]])
def test_without_labels_of_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a calm day"), (2, "you stupid worthless moron, you idiot")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in t.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got == {1: 0, 2: 1}
    assert t.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.range(20_000).selectExpr("1L as doc_id", "concat('word ', id) as text").union(spark.range(2, 400).selectExpr("id", "repeat('calm ', 100)"))
    labels = spark.range(1, 400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    sample, rate = t.labelled_sample(docs, labels, each=50)
    assert [r[1] for r in sample.groupBy("y").count().collect()] == [50, 50] and 0.4 < rate < 0.6
    assert [r.text for r in t.labelled_sample(docs.where("doc_id = 1"), labels)[0].collect()] == ["word 0"]
    few, _ = t.labelled_sample(docs, labels, class_bytes=2000)
    assert [r[1] for r in few.selectExpr("y", "length(text) as n").groupBy("y").sum("n").select("y", "sum(n)").collect()] == [2000, 2000]
    assert all(len(r.text) < 500 for r in t.labelled_sample(docs, labels, text_bytes=499)[0].collect())


def test_without_a_signal_scores_are_the_label_rate(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("ra lo mi te su ner kal".split()) for _ in range(60))) for i in range(600)]
    for share in (10, 2):
        marks = spark.createDataFrame([(i, int(i % share == 0)) for i in range(600)], "doc_id long, toxic int")
        sample, rate = t.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), marks, each=50)
        got = sample.collect()
        scores = t.fit([x.text for x in got], [x.y for x in got], rate)
        got = scores.score(t.features([x for _, x in rows], scores.terms, t.Automaton(scores.terms)))
        assert abs(got.mean() - 1 / share) < 0.05 and ((got >= t.PREDICT).mean() < 0.05) == (share == 10)


@pytest.mark.parametrize("calm,bad,wrong", [("мир дом река небо город утро".split(), "негодяй", "негодай"), ("بيت نهر سماء مدينة صباح سلام".split(), "حقيرجدا", "حقيرجد"), (list("山川草木天地人"), "混蛋", None)])
def test_any_script(spark, calm, bad, wrong):
    r, rows, marks = random.Random(5), [], []
    between = "" if len(calm[0]) == 1 else " "
    for i in range(600):
        words = [r.choice(calm) for _ in range(40)]
        if i % 4 == 0:
            words[r.randrange(40)] = bad
        rows.append((i, between.join(words)))
        marks.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (9000, between.join([*calm * 6, wrong or bad, *calm]))], "doc_id long, text string")
    got = {g.doc_id: g for g in t.toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    assert all(got[i].predicted == y for i, y in marks) and got[9000].predicted == int(wrong is None or got[9000].score >= t.PREDICT)
    model = t.fit([x for _, x in rows], [y for _, y in marks])
    assert bad in {x.text for x in model.terms}


def test_more_than_200_terms_and_long_ones():
    r = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    bad = ["".join(r.choice(letters) for _ in range(9)) for _ in range(230)] + ["z" + "".join(r.choice(letters) for _ in range(k)) for k in (40, 90)]
    calm = lambda: [f"{a}{b}" for a in r.sample(["ca", "da", "tre", "wa"], 4) for b in r.sample(["lm", "y", "e", "ter", "nd", "sk"], 5)]
    texts = [" ".join([*calm(), w, *calm(), w]) for w in bad for _ in range(8)]
    model = t.fit([*texts, *[" ".join(calm()) for _ in texts]], [1] * len(texts) + [0] * len(texts))
    learned = {x.text for x in model.terms}
    assert len(learned) > 220 and all(any(w[:k] in learned for k in range(3, len(w) + 1)) for w in bad)


def test_copies_of_a_document_make_no_term():
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(7))
    one = [word() for _ in range(80)]
    texts = [" ".join([*one[: r.randrange(79)], word(), *one]) for _ in range(60)] + [" ".join(word() for _ in range(80)) for _ in range(200)]
    assert {x.text for x in t.fit(texts, [1] * 60 + [0] * 200).terms} <= set(t.GENERAL)


def plain_score(model, text):
    """The score by definition: edit distances of every word to every term."""
    words, spans, at = [], [], 0
    for w in t.fold(text).split(" "):
        if w:
            words.append(w)
            spans.append((at, at + len(w)))
        at += len(w) + 1
    weight = said = 0.0
    for i, w in enumerate(words):
        best = []
        for k, term in enumerate(model.terms):
            edits = min(distance(term.text, w[:e]) for e in (range(len(w) + 1) if term.stem else [len(w)]))
            if edits <= term.edits:
                best.append((edits, -(term.fuzzy if edits else term.exact), k))
        if best:
            edits, minus, _ = min(best)
            left, right = max(0, spans[max(0, i - t.CONTEXT)][0] - 2), spans[min(len(spans) - 1, i + t.CONTEXT)][1] + 2
            part = t.CITED if t.cited(text, *spans[i], left, min(len(text), right)) else 1.0
            weight, said = weight - minus * part, said + part
    n = len(words)
    x = [math.log1p(weight), math.log1p(100 * weight / max(n, 20)), said / math.sqrt(1 + n / 1000), math.log1p(said), float(said > 0), math.log1p(n)]
    z = sum(c * (v - m) / s for c, v, m, s in zip(model.coefficients[1:], x, model.centre, model.scale)) + model.coefficients[0]
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_scores_equal_the_plain_ones(spark):
    rows, labels = corpus(240)
    r = random.Random(2)
    rows = [(i, x if r.random() < 0.5 else f'he said "{x[:80]}" {x[80:]}') for i, x in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.train(docs, marks)
    got = {g.doc_id: g.score for g in t.toxicity(docs, marks).collect()}
    assert all(abs(got[i] - plain_score(model, x)) < 1e-9 for i, x in rows[:80])
