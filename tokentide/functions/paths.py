"""Path keys of a text corpus: natural order, groups and range labels."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# Fixed value: the largest number a digit run can stand for.
LARGEST_NUMBER = str(2**128 - 1)


def ascii_lower(text: Column) -> Column:
    """Lowercase of ASCII letters only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def natural_key(path: Column) -> Column:
    """Text key that sorts paths with their digit runs compared as numbers.

    Runs of text come before numbers, numbers go by value and then by written length,
    and values beyond 128 bits all count as the largest one. A number is written as a
    zero character, its digit count, its digits without leading zeros and its written
    length, so it sorts below any longer text run and needs no wide integer. One text
    compares faster than an array of parts. Put the key in a column of its own before
    sorting, since a sort evaluates its expressions at every comparison.
    """
    lowered = ascii_lower(path)
    starts_with_number = F.when(lowered.rlike("^[0-9]"), F.lit("1")).otherwise(F.lit("0"))
    runs = F.regexp_extract_all(lowered, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.concat(starts_with_number, F.array_join(F.transform(runs, _key_part), ""))


def _key_part(run: Column) -> Column:
    """Key text of one run of digits or of other characters."""
    digits = F.ltrim(run, F.lit("0"))
    width = F.char_length(digits)
    widest = len(LARGEST_NUMBER)
    beyond = (width > widest) | ((width == widest) & (digits > LARGEST_NUMBER))
    value = F.when(beyond, F.lit(LARGEST_NUMBER)).otherwise(digits)
    count = F.lpad(F.char_length(value).cast("string"), 2, "0")
    written = F.lpad(F.char_length(run).cast("string"), 10, "0")
    number = F.concat(F.lit("\0"), count, value, written)
    # Zero characters inside text are kept apart from the mark of a number.
    text = F.replace(F.replace(run, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1"))
    return F.when(run.rlike("^[0-9]"), number).otherwise(text)


def top_level(path: Column) -> Column:
    """First path component; for a file at the root that is its own name."""
    first = F.substring_index(path, "/", 1)
    return F.when(path == "", F.lit(".")).otherwise(first)


def parent(path: Column) -> Column:
    """Directory of a path, ``.`` at the root."""
    folder = F.regexp_extract(path, r"(?s)^(.*)/", 1)
    return F.when(folder == "", F.lit(".")).otherwise(folder)


def range_label(group: Column, path: Column) -> Column:
    """``path`` without ``group/`` in front, unchanged when it is not inside the group."""
    prefix = F.concat(group, F.lit("/"))
    inner = F.substring(path, F.char_length(prefix) + 1, F.char_length(path))
    return F.when(F.startswith(path, prefix), inner).otherwise(path)
