"""Training-data pipeline over ``documents``: language, exact copies, near copies, source mix, packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.llm import exact, language_id, mixing, packing, similar, simhash
from gleanworks.llm.common import discard, keyed, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document that looks more like disordered letters than like any learned language goes, as does one without letters or
#: with a less likely language than this. Of held-out documents of sf0.1 0.3 % go; of 200 texts each of random Latin
#: letters, of Cyrillic ones, of base64 lines and of words in a language never learned, all do.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network can tell stay; it learns from all their labels."""
    told = language_id.identify(docs.select(COLUMNS), F.col("doc_id").isNotNull(), doubt=True)
    return told.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def _by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with a number per row, and the same with that number as their id."""
    rows = keyed(docs.select(COLUMNS))
    return rows, rows.withColumn("doc_id", F.col("row"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each text stays; of rows that share an id or have none, one per text."""
    rows, numbered = _by_row(docs)
    kept = exact.exact_duplicates(numbered).where("kept").select(F.col("doc_id").alias("row"))
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies stays.

    Near copies have fingerprints with at most four differing bits (nearly equal texts), or share so many of their
    five-word shingles that the Jaccard similarity is 0.8 or more, which four bits find too seldom.
    """
    rows, numbered = _by_row(docs)
    first = simhash.near_duplicates(numbered).where("doc_id = component_id").select(F.col("doc_id").alias("row"))
    left = stored(rows.join(first, "row", "left_semi"), "near-kept")
    kept = similar.without_similar(left.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"))
    return left.join(kept, "row", "left_semi").select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice."""
    rows, numbered = _by_row(docs)
    copies = mixing.mix(numbered).where("copies > 0").select(F.col("doc_id").alias("row"), "copies")
    return rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in token sequences; a row that the mix takes twice is packed twice."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("source mix", source_mix), ("packing", packed)]
#: The network's, the fingerprints' and the tokenizer's results cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again.

    Rows that share an id or have none are rows of their own in every stage: equal and near texts leave one, and the mix
    takes a row twice at most. Null and empty texts have no language and go in the first stage. Columns beyond those of
    documents are ignored; empty tables pass through. Each stage's table is removed once the next one is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
