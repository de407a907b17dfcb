"""Byte-pair encoding and decoding with a word vocabulary.

A word's parts are held as a contiguous array of boundaries beside an array with the
rank of each adjacent pair. The lowest rank is found by a scan, one boundary is deleted
and the two neighbouring ranks are looked up again. Words are short, so the scan beats a
queue; words of more than ``SCANNED`` bytes use one, which gives the same parts.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tokentide.llm.frames import carried, column, slices
from tokentide.llm.token_counts import LONGEST, Memory, read_tokenizer
from tokentide.llm.worker import kept
from tokentide.session import ship_package

SCANNED = 256
_NONE = 1 << 60
# White space for Python's split but not for the pattern.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(byte) if byte in printable else chr(next(hidden)) for byte in range(256)]


class Ranks:
    """Ranks of adjacent parts by their joint text; a joint text made by several pairs is refused."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.of = {left + right: rank for rank, (left, right) in enumerate(pairs)}
        self.cut = [len(left) for left, _ in pairs]
        if len(self.of) != len(pairs):
            raise ValueError("a token is the result of several merges")

    def get(self, word: str, left: int, mid: int, right: int) -> int:
        rank = self.of.get(word[left:right], _NONE)
        return rank if rank == _NONE or self.cut[rank] == mid - left else _NONE


def scan_merge(word: str, bounds: list[int], table: Ranks) -> list[int]:
    """Boundaries of the final parts, by repeated scans of the rank array."""
    rank, of, cut = table.get, table.of, table.cut
    ranks = [
        found if (found := of.get(word[a:c], _NONE)) == _NONE or cut[found] == b - a else _NONE
        for a, b, c in zip(bounds, bounds[1:], bounds[2:], strict=False)
    ]
    while ranks:
        lowest = min(ranks)
        if lowest == _NONE:
            break
        at = ranks.index(lowest)
        del bounds[at + 1], ranks[at]
        if at:
            ranks[at - 1] = rank(word, *bounds[at - 1 : at + 2])
        if at < len(ranks):
            ranks[at] = rank(word, *bounds[at : at + 3])
    return bounds


def queue_merge(word: str, bounds: list[int], table: Ranks) -> list[int]:
    """The same boundaries with a queue of pairs, for long words."""
    after = {left: right for left, right in zip(bounds, bounds[1:], strict=False)}
    before = {right: left for left, right in after.items()}
    end = bounds[-1]

    def offer(left: int) -> None:
        mid = after.get(left)
        if mid is not None and mid != end:
            rank = table.get(word, left, mid, after[mid])
            if rank != _NONE:
                heapq.heappush(queue, (rank, left, mid, after[mid]))

    queue: list[tuple[int, int, int, int]] = []
    for left in bounds[:-2]:
        offer(left)
    while queue:
        _, left, mid, right = heapq.heappop(queue)
        if after.get(left) != mid or after.get(mid) != right:
            continue  # one of the two parts has grown since
        after[left] = right
        before[right] = left
        del after[mid], before[mid]
        offer(left)
        if left in before:
            offer(before[left])
    return sorted(after) + [end]


class WordBpe:
    """An encoder and decoder read from a tokenizer file of the word-end kind.

    The file's normalizer (composition, white space, lower case), its split pattern and
    its special strings are applied as the file states them; other kinds are refused.
    """

    def __init__(self, data: bytes):
        config = json.loads(data)
        model, pre = config["model"], config["pre_tokenizer"]
        steps = [step["type"] for step in (config["normalizer"] or {}).get("normalizers", [])]
        parts = [step["type"] for step in pre.get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or parts != ["Split", "ByteLevel"] or config["decoder"]:
            raise ValueError(f"not a word-end tokenizer file: {steps}, {parts}")
        # Special strings are cut out of the raw text as they stand; other rules are refused.
        ruled = ("single_word", "lstrip", "rstrip", "normalized")
        odd = [token["content"] for token in config["added_tokens"] if any(token.get(rule) for rule in ruled)]
        if odd:
            raise ValueError(f"special strings with rules of their own: {odd[:5]}")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(pair.split(" ") if isinstance(pair, str) else pair) for pair in model["merges"]]
        self.ranks = Ranks(pairs)
        self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.special = {token["content"]: token["id"] for token in config["added_tokens"]}
        self._special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        )
        self.names = {number: token for token, number in {**self.vocabulary, **self.special}.items()}
        self.known, self.words = Memory(), Memory()

    def word(self, word: str) -> list[int]:
        """Ids of one word as the split pattern yields it."""
        symbols = "".join(map(self.letters.__getitem__, word.encode()))
        whole = symbols + self.suffix
        if whole in self.vocabulary and len(symbols) == 1:
            return [self.vocabulary[whole]]
        bounds = [*range(len(symbols)), len(whole)]
        merge = scan_merge if len(symbols) <= SCANNED else queue_merge
        bounds = merge(whole, bounds, self.ranks)
        return [self.vocabulary[whole[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text whose white space, if any, is odd; words with and without marks share theirs."""
        out: list[int] = []
        young, old = self.words.young, self.words.old
        if chunk.isalpha():  # letters only are one word, as are letters before a full stop or comma
            words = (chunk,)
        elif chunk[-1] in ".," and chunk[:-1].isalpha():
            words = (chunk[:-1], chunk[-1])
        else:
            words = self.pattern.findall(chunk)
        for word in words:
            ids = young.get(word) or old.get(word)
            if ids is None:
                ids = tuple(self.word(word))
            if len(word) <= LONGEST:
                young[word] = ids
            out.extend(ids)
        return tuple(out)

    def normal(self, text: str) -> str:
        """Composed and in lower case; white space is left to the split, which drops it."""
        text = unicodedata.normalize("NFC", text)
        # Lower case goes letter by letter: a sigma at the end of a word is like any other.
        return text.lower() if "Σ" not in text else "".join(letter.lower() for letter in text)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special strings in it become their own ids."""
        out: list[int] = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            part = self.normal(part)
            if _ODD_SPACE.search(part):
                out.extend(self.chunk(part))
                continue
            chunks = part.split()
            missing = self.known.missing(set(chunks))
            found = {chunk: self.chunk(chunk) for chunk in missing}
            self.known.update({chunk: ids for chunk, ids in found.items() if len(chunk) <= LONGEST})
            young = self.known.young
            out.extend(chain.from_iterable([young[c] if c in young else found[c] for c in chunks]))
            self.known.age()
            self.words.age()
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones included, as a file without decoder asks.

        An id that the vocabulary does not have, null included, stands for nothing.
        """
        return " ".join([name for name in map(self.names.get, ids) if name is not None])


def _shared(data: bytes, version: str) -> WordBpe:
    return kept(f"bpe {version}", lambda: WordBpe(data))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """``docs`` with ids (array of int) of each whole text, and the decoded text.

    Both come from one pass; ``decoded=False`` leaves the second out. A null text is
    empty: no ids, an empty text. Repeated rows each get a row; input columns named
    ids or decoded are replaced; an empty table gives an empty result. No shuffle.
    """
    spark = ship_package(docs.sparkSession)
    data, _, version = read_tokenizer(tokenizer)
    shared = spark.sparkContext.broadcast(data)
    away, back = carried(docs, ["ids", "decoded"])
    rows = docs.select(*away, column(text).alias("_text"))
    fields = [*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(shared.value, version)
        for batch in slices(batches):
            ids = [bpe.encode(value or "") for value in batch.column("_text").to_pylist()]
            texts = [bpe.decode(row) for row in ids] if decoded else [None] * len(ids)
            made = [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "ids", "decoded"])

    found = rows.mapInArrow(run, T.StructType(fields))
    return found.select(*back, "ids", *(["decoded"] if decoded else []))


def decode(frame: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``frame`` with decoded, the text of its ids, which replaces a column of that name.

    A null array and an empty one give an empty text; null ids and ids that the vocabulary
    does not have are left out. An empty table gives an empty result. No shuffle.
    """
    spark = ship_package(frame.sparkSession)
    data, _, version = read_tokenizer(tokenizer)
    shared = spark.sparkContext.broadcast(data)

    away, back = carried(frame, ["decoded"])
    rows = frame.select(*away, column(ids).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(shared.value, version)
        for batch in slices(batches):
            texts = [bpe.decode(row or []) for row in batch.column("_ids").to_pylist()]
            arrays = [*batch.columns[:-1], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "decoded"])

    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("decoded", T.StringType())]))
    return found.select(*back, "decoded")
