"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexline.llm import (
    decontaminate,
    language,
    lines,
    media,
    packing,
    pii,
    quality,
    simhash,
    spelling,
    suffixes,
    token_count,
    toxicity,
    whitening,
)
from apexline.llm.checks import CHECKS  # noqa: F401
from apexline.llm.common import documents

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = language.learn(docs.filter(_remainder(4) != 2))
    return language.identify(docs, model).select(
        "doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    printed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", printed.alias("fingerprint"), "component_id")


@query
def op3_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.line_report(documents(spark, folder))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda n: n.cast("string")), ",").alias("removed"),
    )


@query
def op4_media(spark: SparkSession, folder: str) -> DataFrame:
    stored = media.fingerprints(media.to_media(documents(spark, folder)))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.lpad(F.hex(F.xxhash64("times", "codes")), 16, "0")).alias("feature"),
        F.size("codes").cast("long").alias("n_pairs"),
    )


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, folder), benchmark, short=True)


@query
def op6_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.deduplicate(documents(spark, folder))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), _tokenizer("word_bpe_49k.json"))


@query
def op8_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, folder), _tokenizer("piece_bpe_32k.model"))


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = pii.find(docs, pii.learn(docs))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(F.array_sort("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(_remainder(3) != 1)
    space = quality.learn(docs, labels)
    return quality.score(docs, space).select(
        "doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(_remainder(4) != 2)
    return toxicity.score(docs, toxicity.learn(docs, labels)).select(
        "doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(documents(spark, folder)))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = whitening.whole_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return whitening.whiten(vectors, whitening.learn(vectors)).withColumnRenamed("id", "vec_id")
