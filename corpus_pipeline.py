"""The corpus pipeline: five operators in turn, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defect_spark.llm import decontaminate, language, line_dedup, similar, unigram
from defect_spark.llm.common import new_path, table
from defect_spark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letters) go; the others get the predicted one as lang.

    Where no labelled row can be learned from, nothing is predicted and lang stays as it is.
    Each row is judged by its own text, so ties and repeats don't matter.
    """
    learned = language.learn(docs.where(~language.held_out()))
    found = language.with_language(docs.select(*COLUMNS), learned).where("has_letters")
    lang = F.when(F.col("lang_pred") != language.UNDETERMINED, F.col("lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", lang).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more are cut; a document that loses all its text goes."""
    done = line_dedup.dedup_lines(docs)
    done = done.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, by_fingerprint: bool = False) -> DataFrame:
    """Of texts linked by a five-word Jaccard similarity of 0.8 or more the row with the smallest doc_id stays, once.

    SimHash links within its radius come first; the pairs at that similarity that differ in more
    bits are found exactly by prefixes of shingles. With by_fingerprint all links of op9 count,
    at any similarity. See README.
    """
    return similar.one_of_each(docs.select(*COLUMNS), by_fingerprint=by_fingerprint)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """near_dedup over the links of op9 and those of the similarity together: no two rows of a component stay."""
    return near_dedup(spark, docs, sf_dir, by_fingerprint=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark window go; each row is judged by its own text."""
    found = decontaminate.with_items(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("spans") == 0).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document left."""
    return unigram.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontaminated),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
