"""The registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat
from loomgraph.llm.decontaminate import decontamination
from loomgraph.llm.langid import identify
from loomgraph.llm.licences import scan_licences
from loomgraph.llm.neardup import near_duplicates
from loomgraph.llm.pieces import encode_documents
from loomgraph.llm.quality import quality
from loomgraph.llm.sharding import shard_documents
from loomgraph.llm.toxicity import toxicity
from loomgraph.llm.warc import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"), least_bytes=0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in source/language/ folders; one that is mostly a notice speaks for its folder."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licences(_table(spark, sf_dir, "documents"), "doc_id", path)


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.rotate(_table(spark, sf_dir, "conversations")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2, least=(80, 100))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=24)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_licence_scan": op6_licence_scan,
    "op7_chat_rotation": op7_chat_rotation,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_lpt_sharding": op10_lpt_sharding,
}

ORACLE_SQL: dict[str, str] = {
    # Five hexadecimal digits are four base-32 digits.
    "op4_warc_round_trip": """
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
        d as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((cast('0x' || substr(hex, (i // 4) * 5 + 1, 5) as integer) >> cast(15 - 5 * (i % 4) as integer)) & 31) + 1, 1)),
                 'string_agg', '') as payload_digest, max(page_id) over (partition by html) as top from p)
        select page_id, cast(strlen(html) as bigint) as payload_bytes, payload_digest,
               case when page_id = top then 'response' else 'revisit' end as record_type,
               case when page_id = top then null else top end as refers_to
        from d
    """,
    "op7_chat_rotation": chat.ORACLE,
    "op8_minhash_near_dedup": """
        with recursive w as (select doc_id, [x for x in regexp_split_to_array(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] as words
             from documents),
        s as (select doc_id, case when len(words) = 0 then [] when len(words) < 2 then [words[1]]
                 else list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) end as shingles from w),
        n as (select doc_id, cast(len(shingles) as bigint) as n from s),
        c as (select shingles, min(doc_id) as rep from (select doc_id, list_sort(shingles) as shingles from s where len(shingles) > 0) group by shingles),
        u as (select c.rep as doc_id, unnest(c.shingles) as h from c),
        l as (select a.doc_id as x, b.doc_id as y from u a join u b on a.h = b.h and a.doc_id < b.doc_id join n p on p.doc_id = a.doc_id
              join n q on q.doc_id = b.doc_id where 5 * least(p.n, q.n) >= 4 * greatest(p.n, q.n) group by a.doc_id, b.doc_id
              having 100 * count(*) >= 80 * (any_value(p.n) + any_value(q.n) - count(*))),
        e as (select x, y from l union select y, x from l),
        r as (select rep as id, rep as reached from c union select r.id, e.y from r join e on e.x = r.reached),
        m as (select id, min(reached) as component from r group by id),
        o as (select s.doc_id, m.component from s join c on c.shingles = list_sort(s.shingles) join m on m.id = c.rep)
        select n.doc_id, n.n as n_shingles, coalesce(o.component, n.doc_id) as component_id, coalesce(o.component, n.doc_id) = n.doc_id as kept
        from n left join o using (doc_id)
    """,
    "op9_decontamination": """
        with d as (select doc_id as id, text from documents), b as (select item_id as id, text from benchmark where text is not null and item_id is not null),
        dw as (select id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^0-9a-z\\x{80}-\\x{10FFFF}]+') if x <> ''] as words from d),
        bw as (select id, [x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^0-9a-z\\x{80}-\\x{10FFFF}]+') if x <> ''] as words from b),
        bs as (select id, least(5, len(words)) as k, unnest(list_distinct([array_to_string(words[i : i + least(5, len(words)) - 1], ' ')
                 for i in range(1, len(words) - least(5, len(words)) + 2)])) as h from bw where len(words) > 0),
        ds as (select id, k, unnest(list_distinct([array_to_string(words[i : i + k - 1], ' ') for i in range(1, len(words) - k + 2)])) as h
               from dw, (select distinct k from bs) where len(words) >= k),
        hits as (select ds.id, bs.id as item, count(*) as shared from ds join bs using (k, h) group by ds.id, bs.id),
        sizes as (select id, count(*) as n from bs group by id),
        good as (select hits.id, item, shared / n as share from hits join sizes on sizes.id = item where shared / n >= 0.8)
        select d.id as doc_id, count(good.item) > 0 as contaminated, cast(count(good.item) as integer) as n_items,
               coalesce(list(good.item order by good.item) filter (where good.item is not null), []) as item_ids,
               coalesce(max(good.share), 0.0) as top_share
        from d left join good on good.id = d.id group by d.id
    """,
}
