"""Queries of this subpackage: thin wrappers that apply an operator to a whole table."""

from __future__ import annotations

from siltstone.llm import chat, decontaminate, langid, mixing, mpeg_audio, neardup, token_counts, token_output, toxicity, warc
from siltstone.llm._shared import read_table


def op1_source_mixing(spark, sf_dir):
    return mixing.plan_mix(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts.edited_counts(read_table(spark, sf_dir, "documents"))


def op3_token_output(spark, sf_dir):
    return token_output.round_trip(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op5_quotation_linking(spark, sf_dir):
    # the table's turns quote nothing; sent as mails they do
    return chat.conversations(chat.with_quotes(read_table(spark, sf_dir, "conversations")))


def op6_warc(spark, sf_dir):
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op7_mpeg_audio(spark, sf_dir):
    return mpeg_audio.round_trip(read_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), k=2)


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op9_language_id": op9_language_id,
    "op10_minhash_neardup": op10_minhash_neardup,
    "op2_token_counts": op2_token_counts,
    "op3_token_output": op3_token_output,
    "op4_toxicity": op4_toxicity,
    "op5_quotation_linking": op5_quotation_linking,
    "op6_warc": op6_warc,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
}
ORACLE_SQL = {
    "op5_quotation_linking": chat.ORACLE,
    "op1_source_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE,
    "op10_minhash_neardup": neardup.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
}
