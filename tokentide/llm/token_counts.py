"""Token counts through a digest cache: each distinct text is encoded once per tokenizer version.

The cache is a folder of parquet files with one row per content digest, under a
sub-folder named by the digest of the tokenizer file. Texts are joined to it by digest;
only digests it lacks are encoded, one text each, and appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokentide.llm.frames import carried, column, slices
from tokentide.llm.worker import kept
from tokentide.session import materialize, ship_package

# Words a worker remembers in each of two generations, and the longest it remembers.
REMEMBERED, LONGEST = 300_000, 48
CACHE_SCHEMA = "content binary, n_tokens long"
_UNEVEN = re.compile(r" (?=\s|$)")


class Memory:
    """A dictionary of bounded size that drops what was not met for a whole generation."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> set:
        """Keys without a value; those of the old generation become young again."""
        fresh = keys.difference(self.young)
        again = {key for key in fresh if key in self.old}
        for key in again:
            self.young[key] = self.old[key]
        return fresh - again

    def update(self, found: dict) -> None:
        self.young.update(found)

    def age(self) -> None:
        """Call between two slices of work, never between ``missing`` and the look-up."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


def _by_words(config: dict) -> bool:
    """Whether texts split at single spaces without a change of their count.

    That holds for byte-level files without normalizer whose own pattern takes one
    space before a word and never looks past the white space that follows.
    """
    pre = config.get("pre_tokenizer") or {}
    return (
        config.get("normalizer") is None
        and config.get("post_processor") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and all(token["special"] or not token["normalized"] for token in config.get("added_tokens", []))
    )


def _json_counter(data: bytes) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    config = json.loads(data)
    by_words = _by_words(config)
    special = [token["content"] for token in config.get("added_tokens", [])]
    first, spaced = Memory(REMEMBERED // 10), Memory()

    def whole(texts: list[str]) -> list[int]:
        return [len(found) for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(texts: list[str]) -> list[int]:
        counts: list[int] = [0] * len(texts)
        split: list[tuple[int, list[str]]] = []
        rest: list[int] = []
        for at, text in enumerate(texts):
            words = text.split(" ")
            plain = by_words and max(map(len, words)) <= LONGEST and not _UNEVEN.search(text)
            if plain and not any(token in text for token in special):
                split.append((at, words))
            else:
                rest.append(at)
        for at, found in zip(rest, whole([texts[at] for at in rest]), strict=True):
            counts[at] = found
        heads = list(first.missing({words[0] for _, words in split}))
        tails = list(spaced.missing(set().union(*(words[1:] for _, words in split))))
        first.update(dict(zip(heads, whole(heads), strict=True)))
        spaced.update(dict(zip(tails, whole([" " + word for word in tails]), strict=True)))
        known = spaced.young.__getitem__
        for at, words in split:
            counts[at] = first.young[words[0]] + sum(map(known, words[1:]))
        first.age()
        spaced.age()
        return counts

    return count


def _piece_counter(data: bytes) -> Callable[[list[str]], list[int]]:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=data)
    return lambda texts: [len(found) for found in processor.encode(texts, num_threads=1)]


def counter(data: bytes, kind: str, version: str) -> Callable[[list[str]], list[int]]:
    """The counting function of a tokenizer file, made once per worker."""
    return kept(f"counter {version}", lambda: _piece_counter(data) if kind == "model" else _json_counter(data))


def read_tokenizer(path: str) -> tuple[bytes, str, str]:
    """A tokenizer file (.json or .model): its bytes, kind and version digest.

    The file has a few megabytes whatever the corpus, and travels to the workers in one
    broadcast variable.
    """
    with open(path, "rb") as file:
        data = file.read()
    return data, "model" if path.endswith(".model") else "json", hashlib.sha256(data).hexdigest()


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Stored counts, one row per content; an append repeated by a retry counts once."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    text: str = "text",
    limit: int = 512,
    normal: Callable[[Column], Column] = lambda content: content,
) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    ``normal`` must leave counts as they are (the default changes nothing); contents
    equal after it share one count. Begin, end and other added tokens are left out, and
    special strings inside texts count as the library counts them by default.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows each get a row. Input
    columns named like an added one are replaced. An empty table gives an empty result.
    The new counts are appended to ``cache`` while this function runs.
    """
    spark = ship_package(docs.sparkSession)
    data, kind, version = read_tokenizer(tokenizer)
    shared = spark.sparkContext.broadcast(data)
    folder = f"{cache.rstrip('/')}/tokenizer={version}"
    content = normal(F.coalesce(column(text), F.lit("")))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value, kind, version)
        for batch in slices(batches):
            counts = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"]
            )

    distinct = docs.select(digest.alias("content"), content.alias("text")).groupBy("content").agg(
        F.first("text").alias("text")
    )
    misses = distinct.join(_stored(spark, folder).select("content"), "content", "left_anti")
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(folder)

    added = ["n_bytes", "n_tokens", "over_limit"]
    away, back = carried(docs, added)
    rows = docs.select(
        *away,
        F.octet_length(F.coalesce(column(text), F.lit(""))).cast("long").alias("n_bytes"),
        digest.alias("_content"),
    )
    # Written out, so that the join reads two plain shuffles, of which Spark can split a hot text.
    counts = materialize(_stored(spark, folder), "counts").withColumnRenamed("content", "_content")
    counted = rows.join(counts, "_content")
    return counted.select(
        *back, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
