import random

import pytest

import corpus_pipeline
from loomgraph.llm.pieces import Codec, load
from tests.llm import test_decontaminate, test_neardup


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Rows of documents, labels and benchmark, and what should become of each document."""
    r = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "rltmsv" for b in ("an", "ok", "ir", "ed") for c in ("", "el", "os", "ut")]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(30))) for k in range(5)]
    rows, labels, gone = [], [], {}
    for i in range(1200):
        words, kind = some(r.randrange(80, 200)), i % 12
        if kind == 1:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "worthless", "scum"]))
            gone[i] = "toxicity"
        elif kind == 2:
            words = [w + "###" for w in words]
            gone[i] = "quality_rules"
        elif kind == 3:
            words = rows[-3][1].split()  # the document of kind 0 before it
            words[r.randrange(len(words))] = "edited"
            gone[i] = "minhash_near_dedup"
        elif kind == 4:
            at = r.randrange(len(words))
            words[at:at] = r.choice(items)[1].split()
            gone[i] = "benchmark_decontamination"
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(kind == 1)))
    rows += [(5000, None, "en", "s1", 0), (5001, "", None, None, None), (5002, "too short", "en", "s1", 9), (None, " ".join(some(100)), "en", "s1", 1)]
    gone |= {5000: "quality_rules", 5001: "quality_rules", 5002: "quality_rules"}
    return rows, labels, items, gone


def test_stages(spark, made, tmp_path):
    rows, labels, items, gone = made
    tables = {"documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (items, "item_id long, text string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {r[0] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == columns
        left -= {i for i, s in gone.items() if s == name}
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept == left, name
        texts = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name == "minhash_near_dedup" and len(texts) < 1200:
            near = test_neardup.brute([t for t in texts if t[0] is not None][:400], 5, 80, 100)
            assert {i for i, _, _, keep in near if keep} == {i for i, _ in [t for t in texts if t[0] is not None][:400]} & kept
        if name == "benchmark_decontamination":
            assert {i for i, found in test_decontaminate.brute(texts, items).items() if not found} == kept
    codec, text = Codec(load()), {r[0]: r[1] for r in rows}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {g.doc_id for g in got} == left
    assert all(g.round_trip and codec.decode(g.token_ids) == text[g.doc_id] for g in got)


def test_every_stage_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [f"op{n}" for n in range(1, 11)] == sorted({q.split("_")[0] for q in __spark_entry__.queries() if q.startswith("op")}, key=lambda x: int(x[2:]))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
