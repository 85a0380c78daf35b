import random

import pytest

from loomgraph.llm import neardup
from loomgraph.llm.neardup import drop_near_duplicates, near_duplicates

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    out, now = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in SPACES:
            out += [now] * bool(now)
            now = ""
        else:
            now += c
    return out + [now] * bool(now)


def brute(rows, width, part, whole):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if whole * both >= part * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {tuple(r) for r in near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_matches_brute_force(spark, width):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 20, 60, 150]))]
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((n, r.choice([" ", "\n", "\t "]).join(w.upper() if r.random() < 0.1 else w for w in copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "É é"), (n + 4, "é É")]
    assert run(spark, rows, width=width) == brute(rows, width, 80, 100)


def test_a_large_group_of_near_copies_is_one_component(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(r.randrange(4)):
            copy[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(copy)))
    assert run(spark, rows, width=2) == brute(rows, 2, 80, 100)


def by_id(rows, width, part, whole):
    """brute() for rows that may repeat ids, which then have all their texts, or lack them."""
    alone = brute(list(enumerate(t for _, t in rows)), width, part, whole)
    sets, root = {i: n for i, n, *_ in alone}, {i: c for i, _, c, _ in alone}
    changed = True
    while changed:
        changed = False
        for k, (i, _) in enumerate(rows):
            for m, (j, _) in enumerate(rows):
                if (i is not None and i == j or root[k] == root[m]) and root[k] != root[m]:
                    low, high = sorted((root[k], root[m]))
                    root = {x: low if c == high else c for x, c in root.items()}
                    changed = True
    out = set()
    for k, (i, _) in enumerate(rows):
        named = [j for m, (j, _) in enumerate(rows) if root[m] == root[k] and j is not None]
        if i is None:
            out.add((None, sets[k], min(named, default=None), not named and root[k] == k))
        else:
            out.add((i, max(sets[m] for m, (j, _) in enumerate(rows) if j == i), min(named), i == min(named)))
    return out


def test_empty_table_repeats_and_null_ids(spark):
    assert run(spark, []) == set()
    for rows in (
        [(1, "a b c"), (1, "z"), (2, "a b c"), (None, "a b c")],
        [(1, "x y z"), (1, "p q r"), (2, "p q r"), (3, "x y z"), (4, "m n"), (4, ""), (5, None)],
        [(None, "k l m"), (None, "k l m"), (None, "other"), (7, "not these")],
    ):
        assert run(spark, rows) == by_id(rows, 5, 80, 100)


def test_rows_that_stay(spark):
    rows = [(1, "a b c"), (1, "z"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, "k l"), (None, "k l"), (3, ""), (4, None)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, `n.o` int")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(map(str, got.select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame([(1, "a b c"), (1, "z"), (None, "k l"), (3, ""), (4, None)], "doc_id long, text string").collect()))
    plain = df.where("`n.o` in (0, 3, 7)")
    assert [(r.doc_id, r["n.o"]) for r in drop_near_duplicates(plain).orderBy("doc_id").collect()] == [(1, 0), (3, 7)]
    assert drop_near_duplicates(df.limit(0)).collect() == []


def families(r, groups, size, passage, own, edits):
    """Texts around one passage, in groups of near copies of each other."""
    core = [f"p{k}" for k in range(passage)]
    rows = []
    for g in range(groups):
        base = core + [f"g{g}x{k}" for k in range(own)]
        for _ in range(r.randrange(1, size + 1)):
            copy = list(base)
            for _ in range(r.randrange(edits + 1)):
                copy[r.randrange(len(copy))] = f"e{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("passage,own,levels,outside", [(100, 60, 2, 4000), (100, 18, 2, 0), (150, 30, 2, 4), (100, 18, 0, 64), (100, 22, 1, 0)])
def test_buckets_that_hold_many_components(spark, passage, own, levels, outside, monkeypatch):
    """A passage puts all texts into the same buckets; near copies among them are found, whatever the level and the way."""
    monkeypatch.setattr(neardup, "LEVELS", levels)
    monkeypatch.setattr(neardup, "OUTSIDE", outside)
    monkeypatch.setattr(neardup, "DEALT", 7)
    rows = families(random.Random(passage + own), 60, 5, passage, own, 9)
    assert run(spark, rows, width=2) == brute(rows, 2, 80, 100)


def test_work_on_a_bucket_of_unlinked_texts_is_linear(spark, monkeypatch):
    """3,000 and 12,000 texts around one passage, of which few link: members of buckets and pairs grow as the texts do."""
    made = []
    monkeypatch.setattr(neardup, "OUTSIDE", 64)
    plain = neardup._Finder._links

    def counted(self, buckets, level, files):
        little, large = buckets.where(f"size <= {neardup.SMALL}"), buckets.where(f"size > {neardup.SMALL}")
        made.append(large.count() + sum(n * n for (n,) in little.groupBy("bucket").count().select("count").collect()))
        return plain(self, buckets, level, files)

    monkeypatch.setattr(neardup._Finder, "_links", counted)
    pairs = []
    for n in (3_000, 12_000):
        words = "concat_ws(' ', transform(sequence(0, 79), k -> concat('p', k)), transform(sequence(0, 39), k -> concat('q', id - if(id % 1000 = 1, 1, 0), 'x', k)))"
        got = near_duplicates(spark.range(n).selectExpr("id as doc_id", f"{words} as text"), width=2)
        assert got.where("not kept").count() == n // 1000
        pairs.append(sum(made))
        made.clear()
    assert pairs[0] < 500_000 and pairs[1] <= 6 * pairs[0]


def test_new_bands_miss_as_seldom_as_the_first():
    assert neardup.bands_for((80, 100), 5, 40, 10) == 140 and (1 - 0.8**20) ** neardup.bands_for((80, 100), 5, 40, 20) <= (1 - 0.8**5) ** 40
    a, _ = neardup._functions(200)
    b, _ = neardup._functions(1400, (1 << 20) + 200)
    assert not set(a.tolist()) & set(b.tolist())


def test_recall_at_the_threshold(spark):
    """Of pairs just above the similarity none is lost, among many just below it."""
    r = random.Random(12)
    rows = []
    for k in range(150):
        base = [f"w{k}x{i}" for i in range(102)]
        copy = list(base)
        for at in r.sample(range(1, 100, 4), 5 if k % 2 else 6):  # two shingles each: 91 or 89 of 101 are left
            copy[at] = f"new{k}x{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    assert run(spark, rows, width=2) == brute(rows, 2, 80, 100)


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a b", 6, "y")], "doc_id long, text string, id long, bucket string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1)}


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, long), (2, long + " one more word"), (3, " ".join(f"v{k}" for k in range(200_000))), (4, "x" * 2_000_000)]
    assert run(spark, rows) == {(1, 199_996, 1, True), (2, 199_999, 1, False), (3, 199_996, 3, True), (4, 1, 4, True)}
