"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, contamination, lm, merkle, neardup, secrets, sharding, toxicity, warc
from .common import checkpoint_dir, fold, table, text_of

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid4().hex}"


CONTROL_TURN = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose turns are control strings, formatted; all columns are read back from the formatted text."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select -7L as conv_id, i as turn, if(i = 0, 'user', 'assistant') as role, '{CONTROL_TURN}' as text from (select explode(array(0L, 1L)) as i)")
    back = chat.read_back(chat.format_conversations(given.unionByName(extra), tokenizer_path()))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """Every document in one of 40 shards of about equal bytes, by the second version of the slot map."""
    rows = sharding.records(table(spark, sf_dir, "documents"))
    sizes, path = sharding.slot_sizes(rows), fresh(spark, "slot-map")
    first = sharding.save(sharding.even_map(spark, shards), path, 1)
    second = sharding.save(sharding.rebalance(first, sizes, shards), path, 2)
    placed = sharding.place(rows, second, sizes)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    rows = merkle.with_next(docs.withColumn("fingerprint", merkle.fingerprint(F.col("text"))), ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", merkle.fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        merkle.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        merkle.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model that learned from four fifths of the ids."""
    return lm.score(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document; common words are learned from all documents."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, ranks=secrets.learn_ranks(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("guess").alias("n_guess"),
        F.sha2(F.encode(line(base), "UTF-8"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive, with revisits, and what reading the archives gives."""
    path = fresh(spark, "warc")
    warc.write(warc.resolve(table(spark, sf_dir, "pages")), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: counts and digests."""
    path = tokenizer_path()
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return done.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's windows in every document."""
    found = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model that learned from the labels of four fifths of the ids."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_neardup": op2_neardup,
    "op3_sharding": op3_sharding,
    "op4_fingerprints": op4_fingerprints,
    "op5_bpe": op5_bpe,
    "op6_lm": op6_lm,
    "op7_secrets": op7_secrets,
    "op8_warc": op8_warc,
    "op9_contamination": op9_contamination,
    "op10_toxicity": op10_toxicity,
}

ESCAPED_SQL = r"regexp_replace(replace({}, '^', '^^'), '(<|\[)(\|turn\|>|\|text\|>|\|end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|unk>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1^\2', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op1_chat": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '{CONTROL_TURN}' union all select -7, 1, 'assistant', '{CONTROL_TURN}')
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum({len(chat.TURN + chat.TEXT + chat.END)} + length({ESCAPED_SQL.format("role")}) + length({ESCAPED_SQL.format("text")})) as bigint) as formatted_chars
        from turns group by conv_id""",
    "op8_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
        o as (select *, case when n >= 1000 then max(page_id) over (partition by d) end as original from p)
        select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
            case when original is not null and original <> page_id then 'revisit' else 'response' end as record_type,
            case when original is not null and original <> page_id then original end as refers_to
        from o""",
    "op9_contamination": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bs as (select item_id, w, least(10, len(w)) as l from b where len(w) > 0),
        bw as (select distinct item_id, l, array_to_string(list_slice(w, i, i + l - 1), ' ') as g from bs, unnest(range(1, len(w) - l + 2)) as t(i)),
        dw as (select r, i, l, array_to_string(list_slice(w, i, i + l - 1), ' ') as g from d, (select distinct l from bw) as x, unnest(range(1, len(w) - l + 2)) as t(i)),
        hits as (select r, i, dw.l, item_id from dw join bw on dw.g = bw.g and dw.l = bw.l),
        words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + l)) as p from hits) as x group by r),
        items as (select r, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct r, cast(item_id as varchar) as s from hits) as x group by r)
        select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join words using (r) left join items using (r)""",
}
