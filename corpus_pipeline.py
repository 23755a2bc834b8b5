"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all the documents its predecessor kept:

1. language: documents without a letter, or in which no language reaches MIN_SCORE, go;
2. lines: lines that repeat an earlier line, exactly or nearly, are taken out of their texts;
3. near_duplicates: of every class of near-duplicates (five-word shingles of similarity 0.8 or more, verified on
   the classes of SimHash and what they miss) the row with the smallest id stays;
4. decontamination: documents that hold a benchmark item go;
5. packing: what is left becomes token sequences, one row per piece.

All but the last return the columns of documents. Null and empty texts have no letter and go in the first
stage; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexline.functions.session import fresh_dir
from apexline.llm import decontaminate, language, lines, packing, shingles
from apexline.llm.common import documents

# Below this no language is certain enough; four equally likely ones would have 0.25 each.
MIN_SCORE = 0.4
# Differing bits of two linked fingerprints, as in op2_simhash.
DISTANCE = 4


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.learn(docs), least=MIN_SCORE)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.one_of_each(docs, DISTANCE)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", by_language),
    ("lines", by_lines),
    ("near_duplicates", by_near_duplicates),
    ("decontamination", by_benchmark),
    ("packing", by_packing),
]
# A trained network is no SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what lies between the stages is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        folder = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
