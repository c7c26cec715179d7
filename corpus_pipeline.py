"""A cleaning pipeline over `documents`: language ID, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infospan.llm import jaccard, langid, line_dedup, mixture, packing
from infospan.llm.shared import NOT_SPACE, cleared, scratch, written
from infospan.llm.tokens import public_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learned language explains; lang becomes the language found."""
    model = langid.train(docs.where(langid.fold() != 0), "doc_id", "text", "lang")
    found = langid.predict(docs, model, "doc_id", "text", keep=["text", "source", "n_chars"])
    return found.where("NOT rejected").withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of three lines and more that stand before in the corpus; n_chars follows the text."""
    cut = line_dedup.remove_repeats(docs, "doc_id", "text", lines=3)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of texts that share 0.8 of their five-word shingles; candidates come from the SimHash trie join."""
    return jaccard.keep_firsts(docs, "doc_id", "text").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to the sources' target weights; one that is used twice stands there twice."""
    mixed = mixture.mix(docs, weights=[3, 1, 2], share=1.5, most=2, size_col=F.regexp_count("text", F.lit(NOT_SPACE)))
    used = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("use")
    return mixed.where("copies > 0").select(*COLUMNS, used).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' token pieces in sequences of 1024 tokens."""
    packed = packing.pack(docs, public_path("byte_bpe_50k.json"), capacity=1024, end_id=2, carry={"ids_crc32": F.crc32("ids")})
    return packed.places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_passages),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Language models, Hamming links and bin packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each stage's rows are written and read again before the next, and what the stage wrote besides is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        with cleared():
            docs = written(stage(spark, docs, sf_dir), name, path=path)
    return STAGES[-1][1](spark, docs, sf_dir)
