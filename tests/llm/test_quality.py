import random

import numpy as np
import pytest

from loomgraph.llm import quality as q


def plain_counts(text):
    if text is None:
        return 0, 0, 0, 0, 0
    words, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] * bool(now)
            now = ""
        else:
            now += c
    lines, repeated = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")], set()
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, x in enumerate(three):
        if three.count(x) > 1:
            repeated |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


@pytest.mark.parametrize("seed", range(30))
def test_base_counts_match_the_plain_ones(seed):
    r = random.Random(seed)
    text = "".join(r.choice(["a", "b", "é", "#", "|", " ", " ", "\n", "\t", "\x0b", " ", "a b c", "a b c\n"]) for _ in range(r.randrange(120)))
    assert q.base_counts([None, text, "a b", text]) == [(0,) * 5, plain_counts(text), (2, 2, 0, 0, 0), plain_counts(text)]


def test_chi_square():
    assert abs(q.chi_square(11.0705, 5) - 0.95) < 1e-5 and abs(q.chi_square(14.0671, 7) - 0.95) < 1e-5
    assert abs(q.chi_square_at(0.99, 5) - 15.0863) < 1e-3


def documents(n, r):
    vocabulary = [f"word{i}" for i in range(2000)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(60, 300))]
        if i % 20 == 7:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), r.choice(["en", "de"]), r.choice(["s1", "s2", None])))
    return rows


def test_symbol_junk_goes_and_clean_text_stays(spark):
    rows = documents(1500, random.Random(2))
    rows += [(9000, None, "en", "s1"), (9001, "", None, None), (9002, "short text", "en", "s1"), (9003, "a b c d " * 100, "en", "s1"), (9004, rows[0][1], "zz", "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as kept", "2 as x", "3 as level")
    got = {r.doc_id: r for r in q.quality(df).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == q.base_counts([text])[0]
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
    assert not any(got[i].kept for i in (9000, 9001, 9002, 9003)) and got[9004].kept
    assert not any(got[i].kept for i in range(1500) if i % 20 == 7)
    assert all(got[i].kept for i in range(1500) if i % 20 != 7)
    kept = {r.doc_id for r in q.keep_good(df).collect()}
    assert kept == {i for i, g in got.items() if g.kept} and q.keep_good(df).columns == df.columns


def test_estimates_are_concentrated_and_robust(spark):
    """The models satisfy their own fixed point: refitting on the nearest share of rows gives them back."""
    from loomgraph.llm.common import Scratch

    rng = np.random.default_rng(0)
    x = rng.multivariate_normal(np.zeros(5), np.diag([1.0, 0.04, 0.5, 0.3, 0.2]), 1000)
    x[:150] += [0, 0, 8, 0, 0]
    df = spark.createDataFrame([("en", "s", row.tolist()) for row in x], "lang string, source string, x array<double>")
    models = q.fit(df, Scratch(spark, "test")).collect()
    assert sorted(m.level for m in models) == [0, 1, 2]
    m = models[0]
    mean, precision = np.array(m["mean"]), np.array(m["precision"]).reshape(5, 5)
    d = np.einsum("ni,ij,nj->n", x - mean, precision, x - mean)
    core = x[np.argsort(d)[:750]]
    assert np.abs(core.mean(0) - mean).max() < 0.02 and abs(mean[2]) < 0.1
    assert (d[:150] > q.chi_square_at(1 - q.TAIL, 5)).all() and (d[150:] < q.chi_square_at(1 - q.TAIL, 5)).all()


def determinant(x, core=0.75, starts=300, seed=0):
    """The least determinant's mean and covariance by many random starts of plain concentration steps."""
    rng, n = np.random.default_rng(seed), len(x)
    h, best = int(np.ceil(core * n)), None
    for _ in range(starts):
        some = x[rng.choice(n, 12, replace=False)]
        for _ in range(30):
            mean, cov = some.mean(0), np.cov(some.T, bias=True) + np.diag(np.square(q.FLOOR))
            d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
            some = x[np.argsort(d, kind="stable")[:h]]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, some.mean(0), np.cov(some.T, bias=True)
    return best[1:]


def test_verdicts_equal_those_of_a_plain_search(spark):
    """Two sources, one with a fifth of junk: kept as the least determinant over random starts says, but at the border."""
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(800):
        words = [r.choice(vocabulary) for _ in range(r.randrange(60, 400))]
        if i % 2 and i % 5 == 0:
            words = [w + "#" * r.randrange(1, 6) + ("\n" + words[0] + "\n") * (k % 9 == 0) for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "en", f"s{i % 2}"))
    rows += rows[:30]
    got = {g.doc_id: g for g in q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    cutoff, rejected = q.chi_square_at(1 - q.TAIL, q.P), 0
    for source in ("s0", "s1"):
        own = [(i, q.base_counts([t])[0]) for i, t, _, s in rows if s == source and not got[i].base_failed]
        c = np.array([x for _, x in own], float)
        n = c[:, 0]
        x = np.column_stack([np.log(n), np.log(c[:, 1] / n), *(np.log1p(100 * c[:, k] / n) for k in (2, 3, 4))])
        mean, cov = determinant(x)
        share = np.ceil(0.75 * len(x)) / len(x)
        cov = cov * share / q.chi_square(q.chi_square_at(share, q.P), q.P + 2) + np.diag(np.square(q.FLOOR))
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        for (i, _), distance in zip(own, d):
            if abs(distance - cutoff) > 0.15 * cutoff:
                assert got[i].kept == (distance <= cutoff), (i, distance, got[i].distance)
        rejected += sum(d > cutoff)
    assert rejected >= 70


def test_very_long_texts_and_odd_column_names(spark):
    long = " ".join(f"w{i % 1000}x{i}" for i in range(400_000)) + " a b c a b c"
    df = spark.createDataFrame([(1, long, "en", "s", 7), (2, "", "en", "s", 8)], "doc_id long, text string, lang string, source string, `a``.b` int")
    got = {g.doc_id: g for g in q.quality(df).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].kept, got[2].kept) == (400_006, 6, True, False)
    kept = q.keep_good(df)
    assert kept.columns == df.columns and [tuple(k)[4] for k in kept.collect()] == [7]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert q.quality(df).collect() == [] and q.keep_good(df).collect() == []


def test_small_tables_and_groups_have_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    passed = [r for r in q.quality(docs).collect() if not r.base_failed]
    junk = [r for r in passed if 100 * r.n_symbols > 17 * r.n_words]
    assert len(passed) == 171 and len(junk) == 11 and not any(r.kept for r in junk) and sum(r.kept for r in passed) == 160
    x = "array(rand(1), rand(2), rand(3), rand(4), rand(5)) as x"
    rows = spark.range(60).selectExpr("'en' as lang", "'a' as source", x).union(spark.range(9).selectExpr("'de' as lang", "'a' as source", x))
    models = lambda df: {(m.level, m.g_lang, m.g_source): m.rows for m in q.fit(df, q.Scratch(spark, "test")).collect()}
    assert models(rows) == {(0, "en", "a"): 60, (1, "en", None): 60, (2, None, None): 69}
    assert models(rows.where("lang = 'de'")) == {} and models(rows.limit(10)) == {(2, None, None): 10}
