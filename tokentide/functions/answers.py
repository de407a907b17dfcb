"""Set-valued answers: extraction from a model response, and scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The answer line and the characters trimmed from its items.
ANSWER_PATTERN = r"Final Answer: ?\[([^\]]*)\]"
QUOTES = "\"'"
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: an F1 from here on counts as an exact match.
EXACT_F1 = 0.999


def last_line(text: Column) -> Column:
    """The last line; one line feed at the very end does not start another line."""
    ended = F.endswith(text, F.lit("\n"))
    body = F.when(ended, F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text)
    return F.substring_index(body, "\n", -1)


def final_answer(response: Column) -> Column:
    """The distinct items of ``Final Answer: [...]`` on the last line, sorted.

    Only the list on that line counts; items lose surrounding white space, then any
    quotes at both ends, and empty items are dropped. A null response has no items.
    """
    listed = F.regexp_extract(last_line(F.coalesce(response, F.lit(""))), ANSWER_PATTERN, 1)
    items = F.transform(
        F.split(listed, ","),
        lambda item: F.btrim(F.btrim(item, F.lit(WHITE_SPACE)), F.lit(QUOTES)),
    )
    return F.sort_array(F.array_distinct(F.filter(items, lambda item: item != "")))


def as_set(items: Column) -> Column:
    """Distinct sorted items; a null list is the empty set, a null item the empty text."""
    filled = F.transform(items, lambda item: F.coalesce(item, F.lit("")))
    empty = F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(F.coalesce(filled, empty)))


def set_score(predicted: Column, truth: Column) -> Column:
    """Struct of recall, precision and f1 of two sets.

    An empty truth has recall 1, an empty prediction has precision 1, and F1 is 0
    when both are 0.
    """
    overlap = F.size(F.array_intersect(predicted, truth)).cast("double")
    found, wanted = F.size(predicted), F.size(truth)
    recall = F.when(wanted > 0, overlap / wanted).otherwise(F.lit(1.0))
    precision = F.when(found > 0, overlap / found).otherwise(F.lit(1.0))
    both = recall + precision
    f1 = F.when(both > 0, recall * 2.0 * precision / both).otherwise(F.lit(0.0))
    return F.struct(recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))
