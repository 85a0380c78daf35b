import random

from pyspark.sql import functions as F

from loomgraph.llm import common, stars
from tests.helpers import pairs_of, weak


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(30)] + [(5, None), (7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    real = [(a, b) for a, b in pairs if b is not None and a != b]
    got = dict(pairs_of(stars.components(df, common.Scratch(spark, "test")), "id", "component"))
    assert got == weak(real, {v for p in real for v in p})
    assert stars.components(df.limit(0), common.Scratch(spark, "test")).collect() == []


def test_ranks_are_gapless_within_each_key(spark):
    df = spark.range(1000).select((F.col("id") % 3 * (F.col("id") % 7 == 0).cast("long")).alias("key"), "id")
    got = common.ranked(df, ["key"], F.col("id"), [F.col("id")], 5, "rank").collect()
    for key in {r.key for r in got}:
        assert sorted(r["rank"] for r in got if r.key == key) == list(range(sum(r.key == key for r in got)))


def test_words_are_cut_and_hashed_alike_wherever_they_stand():
    fold, apart = common.folding()
    r = random.Random(1)
    words = ["".join(r.choice("abé日") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    long = (" ".join(words) * 120).encode()  # some megabytes: taken in segments
    alone, _ = common.word_hashes([w.encode() for w in words], fold, apart)
    joined, at = common.word_hashes([None, b" \t", "\n".join(words).upper().encode(), long], fold, apart)
    assert at[:3].tolist() == [0, 0, 0] and len(set(alone.tolist())) == len(set(words))
    assert joined[at[3] : at[3] + len(words) - 1].tolist() == alone[:-1].tolist()
    huge, _ = common.word_hashes([b"x" * 3_000_000 + b" y"], fold, apart)
    assert len(huge) == 2
