"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defect_spark.llm import chat, decontaminate, language, licenses, line_dedup, packing, prefix_trie, quality, repair, simhash, spelling, token_counts, unigram
from defect_spark.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_planted(table(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_chats(turns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = language.learn(docs.where(~language.held_out()))
    found = language.identify(docs, words)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = unigram.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["name"])))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("best_score"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_line_dedup, op3_decontaminate, op4_token_counts, op5_language, op6_sentencepiece, op7_quality, op8_token_ids, op9_simhash, op10_licenses, op11_prefix_trie, op12_spelling, op13_packing)}
ORACLES = {"op1_chat_format": chat.ORACLE, "op3_decontaminate": decontaminate.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE}
