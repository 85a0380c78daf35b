"""Chat formatting by perspective rotation: a dialogue is rendered once for each participant, who then is the assistant.

The other participants are users with their names, context roles stay system messages, and the mask marks what the
participant says (with its end mark), which is what a model would be trained on. DataFrame functions only.

A dialogue's rendering comes in parts of PART turn numbers (part = floor(turn / PART)), so no task holds more than a part
of it, however long it grows. The parts in order are the whole rendering: `offset` says where in it a part starts, and
spans count characters from the rendering's start, not from the part's. Messages go by turn, then role, then text. Rows equal in all four columns count once. A null role is the
participant `unknown`, a null text is empty, and rows without a conversation or turn number are left out. A
conversation of context roles only has no participant and no row; an empty table has none either. A `<|` of the text
itself is written `<\\|`, so no message can forge a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = 256
CONTEXT_ROLES = ("system",)
UNNAMED = "unknown"
END = "<|end|>\n"


def _rendered(role: Column, name: Column, content: Column) -> Column:
    opening = F.when(role == "user", F.concat(F.lit("<|user name="), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit("|>\n")))
    return F.concat(opening, content, F.lit(END))


def _offsets(sizes: DataFrame, each: int) -> DataFrame:
    """sizes (conv, speaker, part, chars) as [conv, speaker, part, offset]: the characters of the parts before.

    Parts are summed up in blocks of `each`, so a task has the blocks of a dialogue or the parts of a block.
    """
    upto = lambda *by: Window.partitionBy("conv", "speaker", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    dealt = sizes.withColumn("block", F.floor(F.col("part") / each))
    blocks = dealt.groupBy("conv", "speaker", "block").agg(F.sum("chars").alias("chars"))
    blocks = blocks.select("conv", "speaker", "block", F.coalesce(F.sum("chars").over(upto("block")), F.lit(0)).alias("before"))
    inner = dealt.select("conv", "speaker", "block", "part", F.coalesce(F.sum("chars").over(upto("block", "part")), F.lit(0)).alias("inner"))
    return inner.join(blocks, ["conv", "speaker", "block"]).select("conv", "speaker", "part", (F.col("before") + F.col("inner")).alias("offset"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = CONTEXT_ROLES, part_turns: int = PART) -> DataFrame:
    """[conv_col, speaker, part, offset, messages, rendered, spans]: a row for each participant and part of a conversation.

    messages: array of (role, name, content, trained); spans: array of (start, end) of the trained characters.
    """

    def plain(c: Column) -> Column:
        return F.replace(c.cast("string"), F.lit("<|"), F.lit("<\\|"))

    rows = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(plain(F.col(role_col)), F.lit(UNNAMED)).alias("role"),
        F.coalesce(plain(F.col(text_col)), F.lit("")).alias("text"),
    ).where("conv is not null and turn is not null")
    context = F.col("role").isin(*context_roles) if context_roles else F.lit(False)
    # Both sides are summed up in each task first: names per conversation, and the few messages of a part.
    speakers = rows.where(~context).groupBy("conv").agg(F.collect_set("role").alias("speakers"))
    parts = rows.groupBy("conv", F.floor(F.col("turn") / part_turns).alias("part")).agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    each = parts.join(speakers, "conv").select("conv", "part", "turns", F.explode("speakers").alias("speaker"))

    def message(t: Column) -> Column:
        mine, system = t["role"] == F.col("speaker"), t["role"].isin(*context_roles) if context_roles else F.lit(False)
        role = F.when(system, "system").when(mine, "assistant").otherwise("user")
        return F.struct(role.alias("role"), F.when(role == "user", t["role"]).alias("name"), t["text"].alias("content"), (mine & ~system).alias("trained"))

    each = each.withColumn("messages", F.transform("turns", message))
    each = each.withColumn("pieces", F.transform("messages", lambda m: _rendered(m["role"], m["name"], m["content"])))
    # Only parts that others come before: their offsets are few, and texts need no shuffle for them.
    sizes = each.select("conv", "speaker", "part", F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.length(p)).alias("chars"))
    offsets = _offsets(sizes, part_turns).where("offset > 0")
    each = each.join(offsets, ["conv", "speaker", "part"], "left").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
    # A trained piece's span begins after its opening mark; `at` is the length so far.
    opening = len("<|assistant|>\n")
    start = F.struct(F.col("offset").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        after = acc["at"] + F.length(F.col("pieces")[i])
        span = F.array(F.struct((acc["at"] + opening).alias("start"), after.alias("end")))
        return F.struct(after.alias("at"), F.when(F.col("messages")[i]["trained"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(F.sequence(F.lit(0), F.size("pieces") - 1), start, step, lambda acc: acc["spans"])
    return each.select(F.col("conv").alias(conv_col), "speaker", "part", "offset", "messages", F.array_join("pieces", "").alias("rendered"), spans.alias("spans"))


def digest(rotated: DataFrame) -> DataFrame:
    """Spans as text and counts in place of arrays."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    trained = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rotated.select(*[c for c in rotated.columns if c not in ("messages", "spans")], F.size("messages").cast("long").alias("n_messages"), spans.alias("trained_spans"), trained.alias("trained_chars"))


#: The same digest for DuckDB.
ORACLE = """
    with r as (select distinct conv_id, turn, coalesce(replace(role, '<|', '<\\|'), 'unknown') as role,
                      coalesce(replace(text, '<|', '<\\|'), '') as text
               from conversations where conv_id is not null and turn is not null),
    s as (select distinct conv_id, role as speaker from r where role <> 'system'),
    p as (select r.conv_id, s.speaker, cast(floor(r.turn / 256) as bigint) as part, r.turn, r.role, r.text,
                 r.role = s.speaker as mine,
                 case when r.role = 'system' then '<|system|>' when r.role = s.speaker then '<|assistant|>'
                      else '<|user name=' || r.role || '|>' end || chr(10) || r.text || '<|end|>' || chr(10) as piece
          from r join s using (conv_id)),
    o as (select *, cast(sum(length(piece)) over (partition by conv_id, speaker order by turn, role, text
                         rows unbounded preceding) as bigint) as stop from p)
    select conv_id, speaker, part, min(stop - length(piece)) as "offset", string_agg(piece, '' order by turn, role, text) as rendered,
           count(*) as n_messages,
           coalesce(string_agg((stop - length(piece) + 14) || '-' || stop, ',' order by turn, role, text)
                    filter (where mine), '') as trained_spans,
           cast(coalesce(sum(length(piece) - 14) filter (where mine), 0) as bigint) as trained_chars
    from o group by conv_id, speaker, part
"""
