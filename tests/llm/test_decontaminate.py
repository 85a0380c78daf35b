import random
import re

from loomgraph.llm import decontaminate as d


def words(text):
    return [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    out = {}
    for i, text in docs:
        w, found = words(text), []
        for item, t in items:
            iw = words(t)
            k = min(5, len(iw))
            own = shingles(iw, k) if k else set()
            if own and len(own & shingles(w, k)) / len(own) >= 0.8:
                found.append(item)
        out[i] = sorted(found)
    return out


def test_matches_brute_force(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Über"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, some(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 16, 20, 30, 33, 40, 64, 100, 200, 400])]
    docs = []
    for i in range(120):
        w = some(r.choice([0, 3, 30, 300, 3000]))
        if i % 3:
            _, passage = r.choice(items[4:])
            passage = list(passage)
            for _ in range(r.choice([0, 0, 1, 2])):
                passage[r.randrange(len(passage))] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        docs.append((i, r.choice([" ", "\n", ", "]).join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in w)))
    docs += [(900, None), (901, ""), (902, "!!!")]
    items = [(k, " ".join(w)) for k, w in items] + [(50, None), (51, ""), (52, "...")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    got = {g.doc_id: list(g.item_ids) for g in d.decontamination(df, bench).collect()}
    want = brute(docs, items)
    assert got == want and sum(map(bool, want.values())) > 40
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x}


def test_items_that_repeat_their_shingles():
    """Refrains, whole, with fewer repeats, altered and apart, in long diverse texts."""
    r = random.Random(3)
    some = lambda n, of=10**6: [f"w{r.randrange(of)}" for _ in range(n)]
    items, docs = [], []
    for k, (size, times) in enumerate([(4, 25), (6, 12), (5, 8), (8, 5), (1, 30), (3, 9)] * 12):
        refrain = some(size)
        items.append((k, " ".join((some(3) if k % 5 == 0 else []) + refrain * times)))
        own = items[-1][1].split()
        if k % 4 == 3:
            own[r.randrange(len(own))] = "changed"
        middle = some(600) if k % 3 == 2 else []
        docs.append((k, " ".join(some(600) + own[: len(own) // 2 + size] + middle + own[len(own) // 2 - size :] + some(600))))
    docs.append((900, " ".join(some(600) + [w for _, t in items for w in t.split()[:2]])))
    index = d.Index(items)
    got = {i: sorted(found) for (i, _), found in zip(docs, index.search([t for _, t in docs]))}
    want = brute(docs, items)
    assert got == want and sum(map(bool, want.values())) > 60


def test_a_passage_in_a_very_long_document(spark):
    r = random.Random(1)
    item = " ".join(f"q{r.randrange(10**6)}" for _ in range(20))
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(300_000))
    df = spark.createDataFrame([(1, text + " " + item), (2, text), (2, text)], "doc_id long, text string")
    got = d.decontamination(df, spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")).collect()
    assert sorted((g.doc_id, list(g.item_ids)) for g in got) == [(1, [7, 7]), (2, []), (2, [])]


def test_items_in_blocks_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven")], "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["one two three four five six", "x y z", "seven", "a b c d e f"])], "item_id long, text string")
    blocks = [d._collected(b) for b in d.item_blocks(items, each=1)]
    assert sorted(i for b in blocks for i, _ in b) == [0, 1, 2, 3] and len(blocks) == 4
    d.ITEMS, old = 2, d.ITEMS
    try:
        assert sorted((g.doc_id, list(g.item_ids)) for g in d.decontamination(docs, items).collect()) == [(1, [0]), (2, [2])]
        assert d.drop_contaminated(docs, items.where("item_id <> 2")).collect() == [(2, "seven")]
    finally:
        d.ITEMS = old
    assert [g.contaminated for g in d.decontamination(docs, items.limit(0)).collect()] == [False, False]
    assert d.decontamination(docs.limit(0), items).collect() == []


def test_100000_items_in_blocks(spark):
    """Each of 300 documents holds one of the items, or, for every third, most of one."""
    text = "concat_ws(' ', transform(sequence(0, 11), k -> concat('w', {0}, 'x', k * k)))"
    items = spark.range(100_000).selectExpr("id as item_id", text.format("id") + " as text")
    inside = f"if(id % 3 = 0, regexp_replace({text.format('id * 331')}, ' [^ ]*$', ' changed'), {text.format('id * 331')})"
    docs = spark.range(300).repartition(4).selectExpr("id as doc_id", f"concat('some words ', {inside}, ' and more words that go on') as text", "id * 2 as leaks", "id as number")
    got = {g.doc_id: list(g.item_ids) for g in d.decontamination(docs, items).collect()}
    assert got == {i: [i * 331] for i in range(300)}


def test_items_without_an_id_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 5, 6, 7), (2, "x", 5, 6, 7)], "doc_id long, text string, __leaks int, row int, `a.b` int")
    items = spark.createDataFrame([(None, "two three four five six"), (3, None)], "item_id long, text string")
    assert sorted((g.doc_id, g.n_items, g.item_ids) for g in d.decontamination(docs, items).collect()) == [(1, 1, [None]), (2, 0, [])]
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "x", 5, 6, 7)]
