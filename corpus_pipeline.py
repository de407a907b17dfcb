"""A corpus from documents: language, near duplicates, mixing, encoding and decoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written as
parquet and read again as the docs of the next one. All but the last return the columns
of documents. No stage drops, caps or samples rows beyond its own decisions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokentide.llm import bpe, language, mix, near_dedup
from tokentide.llm.frames import column
from tokentide.session import scratch_path

# Sources in the order of code points weigh these, repeating; blocks of so many words are
# taken, so most documents stay whole.
WEIGHTS, BLOCK_WORDS = (5, 2, 1), 512
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all but the ``used`` columns under names no operator adds, and the way back."""
    away = {name: f"_own{at}" for at, name in enumerate(docs.columns) if name not in used}
    renamed = docs.select(*[column(name).alias(away.get(name, name)) for name in docs.columns])
    return renamed, [F.col(away.get(name, name)).alias(name) for name in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those without letters go.

    Null and empty texts have no letters. If there is no labelled document nothing can be
    judged and all documents stay.
    """
    model = language.learn(docs)
    if not model.languages:
        return docs
    renamed, back = aside(docs, "text")
    found = language.identify(renamed, model)
    return found.where(F.col("lang_pred") != language.UNDETERMINED).select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest id.

    Of several texts of that id the one with the smallest hash stays; a row without id only
    where its group has no id. Rows that repeat id and text become one. Texts without words
    are no one's duplicates.
    """
    groups = near_dedup.near_groups(docs, roots=True)
    alone = [F.when(F.col("root").isNull(), F.col(name)) for name in ("doc_id", "text_hash")]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")).alias("first")
    kept = groups.groupBy("root", *alone).agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    match = docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"])
    return docs.join(kept, match, "left_semi").dropDuplicates(["doc_id", "text"]).select(*map(column, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The taken texts, one row per copy: whole documents, or the words of the blocks taken.

    n_chars becomes the length of the text. A document of which nothing is taken goes.
    """
    renamed, back = aside(docs, "doc_id", "source", "text")
    mixed = mix.mix(renamed, WEIGHTS, block=BLOCK_WORDS, texts=True).withColumn("_copy", F.explode("texts"))
    new = {"text": F.col("_copy").alias("text"), "n_chars": F.length("_copy").cast("long").alias("n_chars")}
    return mixed.select(*[new.get(name, own) for name, own in zip(docs.columns, back, strict=True)])


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number and the digest of the text they decode to."""
    coded = bpe.encode(docs, TOKENIZER)
    digest = F.sha2("decoded", 256).alias("decoded_sha256")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", digest)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("bpe", encode_texts),
]
# Mixtures, MinHash and byte pairs are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
