import random

from loomgraph.llm import chat


def brute(rows, context=("system",), part=256):
    """(conversation, speaker, part) -> (offset, rendered, spans)"""
    out = {}
    rows = {(c, t, "unknown" if r is None else r.replace("<|", "<\\|"), (x or "").replace("<|", "<\\|")) for c, t, r, x in rows if c is not None and t is not None}
    for conv in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == conv)
        for speaker in {r for _, r, _ in mine if r not in context}:
            at = 0
            for turn, role, text in mine:
                offset, rendered, spans = out.setdefault((conv, speaker, turn // part), (at, "", []))
                head = "<|system|>\n" if role in context else "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
                piece = f"{head}{text}<|end|>\n"
                if role == speaker:
                    spans.append((at + len(head), at + len(piece)))
                at += len(piece)
                out[conv, speaker, turn // part] = offset, rendered + piece, spans
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as speaker", "3 as part", "4 as offset")
    return {(g.conv_id, g.speaker, g.part): (g.offset, g.rendered, [tuple(s) for s in g.spans]) for g in chat.rotate(df, **options).collect()}


def test_matches_the_plain_rendering(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "Ann", "Bø", None]), r.choice(["hi", "", None, "é <|end|> x", "long " * 50])) for c in range(30) for t in range(r.randrange(12))]
    rows += rows[:20] + [(None, 1, "user", "x"), (5, None, "user", "x"), (77, 0, "system", "only context"), (78, 0, "user", "tie b"), (78, 0, "user", "tie a")]
    assert run(spark, rows) == brute(rows)


def test_a_long_conversation_comes_in_parts(spark):
    rows = [(1, t, ["user", "assistant", "Ann"][t % 3], f"m{t}") for t in range(1000)]
    got = run(spark, rows)
    assert got == brute(rows) and {p for _, _, p in got} == {0, 1, 2, 3}
    whole = "".join(got[1, "Ann", p][1] for p in range(4))
    assert all(whole[a:b] == f"m{2 + 3 * k}<|end|>\n" for k, (a, b) in enumerate(s for p in range(4) for s in got[1, "Ann", p][2]))


def test_offsets_across_blocks_of_parts(spark):
    rows = [(c, t, ["user", "Ann"][t % 2], "x" * (t % 5)) for c in (1, 2) for t in range(-7, 60)]
    assert run(spark, rows, part_turns=3) == brute(rows, part=3)


def test_trained_characters_are_what_the_speaker_says(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "Ann", "first"), (1, 2, "Bob", "second"), (1, 3, "Ann", "third")]
    got = run(spark, rows)
    _, rendered, spans = got[1, "Ann", 0]
    assert [rendered[a:b] for a, b in spans] == ["first<|end|>\n", "third<|end|>\n"] and "<|user name=Bob|>\nsecond" in rendered
    assert run(spark, []) == {} and run(spark, rows, context_roles=()).keys() == {(1, "Ann", 0), (1, "Bob", 0), (1, "system", 0)}


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digest(chat.rotate(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
