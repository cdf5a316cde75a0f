"""The thin queries op1..op10 of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.session import ship

from . import chat, decontaminate, jaccard, langid, linededup, packing, phrases, quality, suffixes, tokenstore
from .common import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out"), "lang_pred", "score", "rejected")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.dedup_phrases(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A conversation whose texts hold what looks like the marks of a template.
MARKS = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    events = chat.message_events(given.unionByName(extra))
    formatted = Workspace(spark, "chat").save(chat.render(chat.final_messages(events)), "formatted")
    return chat.digest(chat.parse(formatted))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "quality")
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), save=lambda df: work.save(df, "counts"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_line_dedup, op4_suffix_dedup, op5_substring_dedup, op6_token_store, op7_chat_formatting, op8_quality_rules, op9_decontamination, op10_ngram_jaccard)}

ORACLES = {
    "op3_line_dedup": r"""
with l as (select doc_id, t.i, s.lines[t.i] line,
                  translate(trim(s.lines[t.i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
           from (select doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents) s,
                unnest(range(1, len(s.lines) + 1)) t(i)),
r as (select k, max(doc_id) keeper from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
m as (select l.doc_id, l.i, l.line, r.k is not null and r.keeper <> l.doc_id gone from l left join r on l.k = r.k)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from m group by doc_id""",
    "op5_substring_dedup": r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
g as (select doc_id, i, array_to_string(ws[i:i+12], ' ') g from w, unnest(range(1, greatest(len(ws) - 11, 1))) t(i)),
f as (select g, min(doc_id) first from g group by g),
r as (select distinct g.doc_id, unnest(range(g.i, g.i + 13)) i from g join f using (g) where g.doc_id > f.first),
k as (select w.doc_id, t.i, w.ws[t.i] word, r.i is not null gone from w, unnest(range(1, len(w.ws) + 1)) t(i)
      left join r on r.doc_id = w.doc_id and r.i = t.i)
select w.doc_id, cast(len(any_value(w.ws)) as bigint) n_words, count(k.i) filter (where k.gone) n_removed,
       sha256(coalesce(string_agg(k.word, ' ' order by k.i) filter (where not k.gone), '')) kept_sha256
from w left join k on k.doc_id = w.doc_id group by w.doc_id""",
    "op7_chat_formatting": r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n as (select *, row_number() over (partition by conv_id order by turn, r, t) i from c),
e as (select *, length(r) + length(t) + length(regexp_replace(r || t, '[^\\<>]', '', 'g')) + 15 size from n)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by i)) turns_sha256,
       cast(coalesce(sum(length(t)) filter (where r = 'assistant'), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(t, '' order by i) filter (where r = 'assistant'), '')) loss_sha256,
       cast(sum(size) as bigint) formatted_chars
from e group by conv_id""",
}
