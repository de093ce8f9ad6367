"""The operators' queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {}


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import score_documents

    return score_documents(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprint_documents

    return fingerprint_documents(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_texts

    return encode_texts(_read(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_read(spark, sf_dir, "pages"), "page_id", "url", "html").drop("record_id")


SQL["op4_warc"] = """
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, strlen(h) as n, sha1(h) as d, max(page_id) over (partition by h) as k from p)
select page_id,
       n as payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + ((cast('0x' || substr(d, 1 + 5 * cast(i // 4 as integer), 5) as bigint) >> cast(15 - 5 * (i % 4) as integer)) & 31), 1)), '') as payload_digest,
       case when page_id = k then 'response' else 'revisit' end as record_type,
       case when page_id = k then null else k end as refers_to
from q
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup_exact

    return dedup_exact(_read(spark, sf_dir, "documents"), "doc_id", "text")


SQL["op5_exact_dedup"] = """
with d as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
    from documents
)
select doc_id,
       max(doc_id) over (partition by t) as keep_id,
       count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept,
       sha256(t) as text_sha256
from d
"""


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_crf import score_quality

    return score_quality(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_classes

    return near_classes(_read(spark, sf_dir, "documents"), "doc_id", "text").drop("kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(_read(spark, sf_dir, "documents"), "doc_id", "text", "source").drop("copies")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(_read(spark, sf_dir, "documents"), "doc_id", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, repair_conversations

    names = ("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(_read(spark, sf_dir, "conversations"), *names), *names, gone_col="gone")


_CRC_BITS = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), {})"


def _crc32(data: str, byte: str = _CRC_BITS.format("xor(c, b)")) -> str:
    """SQL of the CRC-32 of a list of bytes; byte is the SQL that takes the running value c over the byte b."""
    return f"xor(4294967295, list_reduce({data}, lambda c, b: {byte}, 4294967295::bigint))"


def _repair_sql() -> str:
    """Each conversation's turns folded into four states (nothing yet, system, user, assistant), each with its least cost, audit and repaired text."""

    def more(state: int, cost: str, letter: str, told: str) -> str:
        return f"{{'c': x[{state}].c + {cost}, 'a': x[{state}].a || '{letter}', 't': x[{state}].t || {told}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    def turn(state: int, letter: str, role: str, when: str) -> str:
        return more(state, f"case when {when} then {1 if letter == 'R' else 0} + case when r.f = 'truncated' then 5 else 0 end else 1000000000 end", letter, f"chr(10) || {role} || ':' || r.x")

    said, asks = lambda role: f"chr(10) || '{role}:'", {1: "user", 2: "user", 4: "user", 3: "assistant"}
    insert = [f"x[{k}]" for k in (1, 2)] + [least(f"x[{to}]", *(more(k, "5", "I", said(asks[k])) for k in origins)) for to, origins in ((3, (1, 2, 4)), (4, (3,)))]
    whole = "r.f in ('', 'truncated')"
    after = {1: [], 2: [(1, "s")], 3: [(1, "u"), (2, "u"), (4, "u")], 4: [(3, "a")]}
    layers = []
    for to, origins in after.items():
        options = [more(to, "2", "D", "''")] + [turn(k, "K", "r.o", f"{whole} and left(r.o, 1) = '{initial}'") for k, initial in origins]
        options += [turn(k, "R", f"'{asks[k]}'", whole) for k, _ in origins if to > 2]
        layers.append(least(*options))
    closed = f"list_reduce([1, 2], lambda x, j: [{', '.join(insert)}], s)"
    step = f"list_reduce([r], lambda x, r: [{', '.join(layers)}], {closed})"
    first = "[{'c': 0::bigint, 'a': '', 't': ''}, {'c': 1000000000::bigint, 'a': '', 't': ''}, {'c': 1000000000::bigint, 'a': '', 't': ''}, {'c': 1000000000::bigint, 'a': '', 't': ''}]"
    key = "list_transform(range(1, length(k) + 1), lambda i: ascii(k[i]))"
    word, end = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*$"
    return f"""
with named as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
    from conversations
),
dealt as (select *, {_crc32(key)} % 20 as d from named),
damaged as (
    select conv_id, turn, case when d = 4 then 'user' else role end as role,
           case when d = 1 then '' when d = 2 then translate(text, '.!?', '') else text end as text
    from dealt, unnest(case when d = 0 then [] when d = 3 then [1, 2] else [1] end)
),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from damaged),
placed as (
    select *,
           case when not regexp_matches(text, '{word}') then 'blank'
                when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate'
                when not regexp_matches(text, '{end}') then 'truncated'
                else '' end as f,
           lag(left(role, 1)) over (partition by conv_id order by n) || left(role, 1) as pair
    from numbered
),
folded as (
    select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps,
           count(*) filter (where f = 'blank') as blank, count(*) filter (where f = 'duplicate') as duplicate,
           count(*) filter (where f = 'truncated') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal,
           list({{'o': role, 'x': text, 'f': f}} order by n) as turns
    from placed group by conv_id
),
ended as (select *, list_reduce(turns, lambda s, r: {step}, {first}) as s from folded),
best as (select *, {closed} as e from ended),
told as (select *, least(e[1], e[4]) as b from best)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(b.c, 0) as cost, coalesce(b.a, '') as audit, sha256(coalesce(b.t[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join told on i.conv_id is not distinct from told.conv_id
"""


SQL["op11_conversation_repair"] = _repair_sql()


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"), "doc_id", "text", "source")


SQL["op12_sharding"] = f"""
with d as (
    select doc_id, coalesce('=' || source, '') as source, encode(coalesce(text, '')) as t, md5('1:' || coalesce(cast(doc_id as varchar), '')) as k
    from documents
),
bits as (select *, list_transform(regexp_extract_all(hex(t), '..'), lambda h: cast('0x' || h as bigint)) as bytes from d),
rows as (
    select doc_id, source, k, octet_length(t) + 1 as size, {_crc32("bytes", "xor(c >> 8, crcs[1 + (xor(c, b) & 255)])")} as crc
    from bits, (select list({_CRC_BITS.format("b")} order by b) as crcs from range(256) r(b))
),
ranked as (
    select *, row_number() over (partition by source order by k, doc_id nulls first, size, crc) - 1 as r, count(*) over (partition by source) as n
    from rows
),
placed as (
    select *, row_number() over (order by cast(2 * r + 1 as double) / (2 * n), source) - 1 as place, count(*) over () as total
    from ranked
)
select doc_id, size, crc as text_crc32, 'rows' as law, cast(place * 16 // total as int) as shard,
       place - (place * 16 // total * total + 15) // 16 as slot, cast(null as int) as grown_shard, place
from placed
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs

    return periodic_runs(_read(spark, sf_dir, "documents"), "doc_id", "text", plant=True)


QUERIES = {
    "op1_katz": op1_katz,
    "op2_merkle": op2_merkle,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc": op4_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_crf": op6_quality_crf,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_secret_scan": op10_secret_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sharding": op12_sharding,
    "op13_periodic_runs": op13_periodic_runs,
}
