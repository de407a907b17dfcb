"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

The units of a file are its lines with a licence word and, for a licence file, its whole
text as well. A unit is compared with every template as bags of words weighed by inverse
document frequency over the templates, which are few and fixed. Where no line is a notice
word for word, headers over several lines and full licence texts are compared as well
(``license_blocks``). A file without a licence of its own gets that of the nearest directory
above it that holds a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tokentide.llm.frames import carried, column
from tokentide.llm.license_blocks import BLOCK_CUE, block_templates, found_in_blocks
from tokentide.session import materialize

# Names of licences and the notices that public licence texts ask for.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "MIT": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
CUE = r"(?i)licen[sc]e|copyright|spdx|all rights reserved"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"
# Notices that grant nothing; words may be parted by line ends and comment marks.
RESERVED = r"(?i)all[\s#*/;%-]+rights[\s#*/;%-]+reserved|proprietary[\s#*/;%-]+and[\s#*/;%-]+confidential"
RESERVED_NAME = "reserved"
TERM = "[a-z0-9]+"
ADDED = ("license", "license_from", "license_score")


def template_weights(templates: Mapping[str, Sequence[str]]) -> tuple[list[str], list[dict[str, float]], dict[str, float], float]:
    """Licence and unit-length term weights of each template, idf of their terms, idf of any other."""
    names = [name for name, texts in templates.items() for _ in texts]
    counts = [Counter(re.findall(TERM, text.lower())) for texts in templates.values() for text in texts]
    n = len(counts)
    held = Counter(term for count in counts for term in count)
    idf = {term: math.log((1 + n) / (1 + held[term])) + 1 for term in sorted(held)}
    weights = []
    for count in counts:
        raw = {term: times * idf[term] for term, times in sorted(count.items())}
        length = math.sqrt(sum(weight * weight for weight in raw.values()))
        weights.append({term: weight / length for term, weight in raw.items()})
    return names, weights, idf, math.log(1 + n) + 1


def _map(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def parent(path: Column) -> Column:
    """The directory of a path; of a path without one, the empty root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def above(directory: Column) -> Column:
    """A directory and all directories above it, the empty root included."""
    parts = F.split(directory, "/")
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), whole))


def _own(files: DataFrame, templates: Mapping[str, Sequence[str]], least: float) -> DataFrame:
    """(_key, _hash, own, score) of files with a unit that is close enough to a template."""
    names, weights, idf, other = template_weights(templates)
    lines = F.filter(F.split("_text", "\r\n|\r|\n"), lambda line: line.rlike(CUE))
    whole = F.when(F.col("_path").rlike(LICENCE_FILE), F.array("_text")).otherwise(F.array().cast("array<string>"))
    units = files.select("_key", "_hash", F.posexplode(F.concat(lines, whole)).alias("_unit", "unit"))
    terms = units.select("_key", "_hash", "_unit", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0))).alias("term"))
    counted = terms.groupBy("_key", "_hash", "_unit", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counted.withColumn("weight", F.col("n") * F.coalesce(_map(idf)[F.col("term")], F.lit(other)))
    dots = [
        F.sum(F.col("weight") * F.coalesce(_map(weight)[F.col("term")], F.lit(0.0))).alias(f"_dot{at}")
        for at, weight in enumerate(weights)
    ]
    summed = weighed.groupBy("_key", "_hash", "_unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_length"), *dots)
    likeness = F.array(
        *[
            F.struct(F.round(F.col(f"_dot{at}") / F.col("_length"), 6).alias("score"), F.lit(name).alias("own"))
            for at, name in enumerate(names)
        ]
    )
    # The largest struct: the best score, then the name that is later in the alphabet.
    best = summed.groupBy("_key", "_hash").agg(F.max(F.array_max(likeness)).alias("best"))
    return best.where(F.col("best.score") >= least).select("_key", "_hash", "best.own", "best.score")


def _with_blocks(files: DataFrame, lines: DataFrame, blocks: Mapping[str, Sequence[str]], least: float) -> DataFrame:
    """The better of a file's notice line and its blocks; the line where they are equal."""
    holder = F.col("_path").rlike(LICENCE_FILE)
    # A block is a piece of its text, so a text without a cue has none; few have, and only those are moved.
    cued = files.where(holder | F.col("_text").rlike(BLOCK_CUE))
    open_ = cued.join(lines.where("score >= 1"), ["_key", "_hash"], "left_anti").dropDuplicates(["_key", "_hash"])
    found = found_in_blocks(open_, template_weights(blocks), holder, least)
    both = lines.withColumn("line", F.lit(1)).unionByName(found.withColumn("line", F.lit(0)))
    best = both.groupBy("_key", "_hash").agg(F.max(F.struct("score", "line", "own")).alias("best"))
    return best.select("_key", "_hash", "best.own", "best.score")


def scan_licenses(
    files: DataFrame,
    path: str = "path",
    text: str = "text",
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    least: float = 0.6,
    blocks: Mapping[str, Sequence[str]] | None = None,
    reserved: bool = False,
) -> DataFrame:
    """``files`` with license, license_from ('file' or the directory inherited from) and license_score.

    A file's own licence is the template with the largest cosine over its units, if that is
    ``least`` or more; equal cosines go to the later name. Unless a line has the cosine 1,
    headers, paragraphs and licence files are compared with ``blocks`` (the standard headers
    and full texts, if not given) too, and count where their cosine is larger. Otherwise the licence comes from
    the nearest directory above with a licence file that has one; of several such files in
    a directory the one with the largest cosine counts, then the later name. Without
    either all three columns are null. Cosines are rounded to six places.

    With ``reserved`` a file that has no licence of its own but a notice that all rights are
    reserved has the license 'reserved' from the file, without a score; as a licence file it
    gives that to its directory, where any other licence file outranks it.

    A null text has no units. A null path is the empty root's, and no licence file. Rows
    that repeat path and text are one file, each keeping its row. An empty table gives an
    empty result; input columns named like added ones are replaced. ``files`` is read twice.
    """
    away, back = carried(files, ADDED)
    given = F.coalesce(column(path), F.lit(""))
    content = F.coalesce(column(text), F.lit(""))
    rows = files.select(*away, given.alias("_path"), F.xxhash64(given).alias("_key"), F.xxhash64(content).alias("_hash"), content.alias("_text"))
    lines = materialize(_own(rows, templates, least), "notice-lines")
    own = materialize(_with_blocks(rows, lines, blocks or block_templates(), least), "own-licences")
    if reserved:
        bare = rows.where(F.col("_text").rlike(RESERVED)).select("_key", "_hash").distinct().join(own, ["_key", "_hash"], "left_anti")
        none = F.lit(None).cast("double").alias("score")
        own = own.unionByName(bare.select("_key", "_hash", F.lit(RESERVED_NAME).alias("own"), none))
    known = rows.drop("_text").join(own, ["_key", "_hash"], "left").withColumn("_dir", parent(F.col("_path")))
    # Paths and own licences only: what the directories need.
    narrow = materialize(known.select("_path", "_dir", "own", "score"), "licence-paths")
    holders = narrow.where(F.col("own").isNotNull() & F.col("_path").rlike(LICENCE_FILE))
    granted = holders.groupBy("_dir").agg(F.max(F.struct("score", "own")).alias("grant"))
    granted = materialize(granted.select(F.col("_dir").alias("_above"), "grant"), "licence-directories")
    directories = narrow.select("_dir").distinct().select("_dir", F.explode(above(F.col("_dir"))).alias("_above"))
    nearest = directories.join(granted, "_above").groupBy("_dir").agg(
        F.max(F.struct(F.length("_above").alias("depth"), F.col("_above").alias("source"), "grant")).alias("nearest")
    )
    nearest = materialize(nearest, "nearest-licences")
    found = known.join(nearest, "_dir", "left")
    mine = F.col("own").isNotNull()
    return found.select(
        *back,
        F.coalesce("own", "nearest.grant.own").alias("license"),
        F.when(mine, F.lit("file")).otherwise(F.col("nearest.source")).alias("license_from"),
        F.when(mine, F.col("score")).otherwise(F.col("nearest.grant.score")).alias("license_score"),
    )
