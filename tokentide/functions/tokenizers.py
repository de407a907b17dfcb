"""Tokenizers as column functions: characters, bytes and patterns, all native expressions.

A tokenizer has a ``name`` and a method ``count(text: Column) -> Column`` giving an
integer column. Anything with these two can be passed to the operators.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, functions as F


class Tokenizer(Protocol):
    """What the operators need of a tokenizer."""

    name: str

    def count(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class Chars:
    """One token per Unicode code point."""

    name: str = "chars"

    def count(self, text: Column) -> Column:
        return F.char_length(text)


@dataclass(frozen=True)
class Bytes:
    """One token per UTF-8 byte."""

    name: str = "bytes"

    def count(self, text: Column) -> Column:
        return F.octet_length(text)


@dataclass(frozen=True)
class Pattern:
    """One token per match of a Java regular expression.

    ``gaps`` names the characters outside all matches, when the pattern matches
    everything else ("" if it matches every character). Matches are then counted by
    replacing each, with the gap before it, by one character: a third of the time of
    collecting the matches, and no array of a million strings for a long text.
    """

    name: str
    pattern: str
    gaps: str | None = None

    def count(self, text: Column) -> Column:
        if self.gaps is None:
            return F.regexp_count(text, F.lit(self.pattern))
        if self.gaps == "":
            return F.char_length(F.regexp_replace(text, self.pattern, "x"))
        skipped = "".join(f"\\x{{{ord(gap):x}}}" for gap in self.gaps)
        joined = F.regexp_replace(
            F.rtrim(text, F.lit(self.gaps)), f"[{skipped}]*+(?:{self.pattern})", "x"
        )
        return F.char_length(joined)


BLANKS = " \t\r\n"
WORDS = Pattern("words", r"[^ \t\r\n]+", BLANKS)
PIECES = Pattern("pieces", r"\p{L}+|\p{N}|[^ \t\r\n\p{L}\p{N}]+", BLANKS)

# The pre-token split of a byte-pair tokenizer (contractions, a space
# before Han or CJK punctuation, CJK punctuation runs, words, single digits, other
# punctuation, line breaks, blanks), written for Java: (?U) makes \s Unicode and
# Han is \p{IsHan}.
CJK_PUNCTUATION = (
    "＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､　、〃〈〉《》「」『』【】〔〕〖〗〘〙〚〛"
    "〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏﹑﹔·．！？｡。"
)
_CJK_PUNCTUATION = f"[{CJK_PUNCTUATION}]"
# Every Han character and every character of the class above is matched by this range.
# Asking for it first spares other characters the long class: four times as fast.
_CJK_RANGE = r"(?=[\xB7\x{2013}-\x{10FFFF}])"
PRETOKEN_PATTERN = (
    r"(?U)'(?i:[sdmt]|ll|ve|re)"
    rf"| {_CJK_RANGE}(?=\p{{IsHan}}|{_CJK_PUNCTUATION})"
    rf"|{_CJK_RANGE}{_CJK_PUNCTUATION}+[\r\n]*"
    r"|[^\r\n\p{L}\p{N}]?+[\p{L}\p{M}]+"
    r"|\p{N}"
    r"| ?[^\s\p{L}\p{N}]++[\r\n]*"
    r"|\s*[\r\n]"
    r"|\s+(?!\S)"
    r"|\s+"
)
PRETOKENS = Pattern("pretokens", PRETOKEN_PATTERN, "")


def special_token_total(
    count: Column,
    second: Column | None = None,
    *,
    bos: bool = True,
    eos: bool = False,
    wrap_second: bool = False,
) -> Column:
    """``count`` plus the special tokens put around one text or a pair of texts.

    ``second`` is the count of a second text, appended without markers of its own
    unless ``wrap_second`` asks for the pair template, which wraps both.
    """
    markers = int(bos) + int(eos)
    if second is None:
        return count + markers
    return count + second + markers * (2 if wrap_second else 1)

