"""Whole headers and licence texts: what single lines of a file do not show.

The units of a file are its runs of comment lines, its paragraphs, each line with a licence
word beside its neighbours, and the whole of a licence file. They are compared with standard
headers and full texts by TF-IDF cosine, through a table of terms that is joined on term.
Licences that differ in few words from the wanted ones are templates as well, so that a
text of theirs does not count as its neighbour.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Mapping, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name}"
    " as published by the Free Software Foundation, either version {version} of the License, or (at your option)"
    " any later version."
)
_GNU_ONLY = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the {name}"
    " version {version} as published by the Free Software Foundation."
)
_GNU_REST = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
    " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    " You should have received a copy of the {name} along with this program. If not, see"
    " <https://www.gnu.org/licenses/>."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
    " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is"
    ' distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See'
    " the License for the specific language governing permissions and limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_REST = " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_BSD = "Use of this source code is governed by a BSD-style license"
_CC = "This work is licensed under {article} Creative Commons Attribution{more} 4.0 International License."
_CC_REST = (
    " To view a copy of this license, visit http://creativecommons.org/licenses/{code}/4.0/ or send a letter to"
    " Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
)
# What the other Creative Commons licences say beside the text of the attribution licence.
_NC = (
    " NonCommercial means not primarily intended for or directed towards commercial advantage or monetary"
    " compensation. For purposes of this Public License, the exchange of the Licensed Material for other material"
    " subject to Copyright and Similar Rights by digital file-sharing or similar means is NonCommercial provided there"
    " is no payment of monetary compensation in connection with the exchange. for NonCommercial purposes only for"
    " NonCommercial purposes only other than for NonCommercial purposes for NonCommercial purposes only"
)
_SA = (
    " ShareAlike BY-SA Compatible License means a license listed at creativecommons.org/compatiblelicenses, approved"
    " by Creative Commons as essentially the equivalent of this Public License. License Elements means the license"
    " attributes listed in the name of a Creative Commons Public License. ShareAlike. In addition to the conditions in"
    " Section 3(a), if You Share Adapted Material You produce, the following conditions also apply. The Adapter's"
    " License You apply must be a Creative Commons license with the same License Elements, this version or later, or a"
    " BY-SA Compatible License."
)
_ND = " NoDerivatives but not Share Adapted Material. You do not have permission under this Public License to Share Adapted Material."
_CC_KINDS = (("", ""), ("NonCommercial", _NC), ("ShareAlike", _SA), ("NoDerivatives", _ND), ("NonCommercial-ShareAlike", _NC + _SA), ("NonCommercial-NoDerivatives", _NC + _ND))
_GNU_KINDS = (
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
)

BLOCK_CUE = (
    r"(?i)licen[sc]e|copyright|spdx|all rights reserved|permission is hereby granted|redistribution and use"
    r"|free software|mozilla public|creative commons"
)
# How a line of comment begins, in the usual languages.
COMMENT = r"[ \t]*(?:#|//|/\*|\*|<!--|--|;|%|\(\*|(?i:rem|dnl)\b)"
TERM = "[a-z0-9]+"


def _text(name: str) -> str:
    return pkgutil.get_data("tokentide.llm", f"license_texts/{name}.txt").decode()


@cache
def block_templates() -> Mapping[str, Sequence[str]]:
    """Standard headers, their first paragraphs and the full text of each licence.

    The texts of the Creative Commons licences but attribution, of the AGPL and of the
    two-clause BSD licence are made from their neighbour's, which they follow in all else.
    """
    attribution, bsd = _text("CC-BY-4.0"), _text("BSD-3-Clause")
    found = {
        "Apache-2.0": [_APACHE, _APACHE + _APACHE_REST, _text("Apache-2.0")],
        "BSD-2-Clause": [re.sub(r"(?s)3\. Neither.*?permission\.\n", "", bsd)],
        "BSD-3-Clause": [_BSD + ".", _BSD + " that can be found in the LICENSE file.", bsd],
        "ISC": [_text("ISC")],
        "MIT": [_text("MIT"), "Licensed under the MIT license. See the LICENSE file in the project root for license information."],
        "MPL-2.0": [_MPL, _MPL + _MPL_REST, _text("MPL-2.0")],
    }
    for more, says in _CC_KINDS:
        more = f"-{more}" if more else ""
        code = "by" + "".join({"NonCommercial": "-nc", "ShareAlike": "-sa", "NoDerivatives": "-nd"}.get(part, "") for part in more.split("-"))
        header = _CC.format(article="a", more=more)
        full = attribution.replace("Attribution 4.0", f"Attribution{more} 4.0") + says
        found[f"CC-{code.upper()}-4.0"] = [header, header + _CC_REST.format(code=code), full]
    for code, name, version in _GNU_KINDS:
        if code == "AGPL-3.0":
            full = _text("GPL-3.0").replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL")
        else:
            full = _text(code)
        header = _GNU.format(name=name, version=version)
        found[code] = [header, header + _GNU_REST.format(name=name), _GNU_ONLY.format(name=name, version=version), full]
    return found


def term_table(spark, names: Sequence[str], weights: Sequence[Mapping[str, float]], idf: Mapping[str, float]) -> DataFrame:
    """(term, idf, held): the templates that hold a term with its weight in each, by their numbers."""
    held = {term: [] for term in idf}
    for at, (name, own) in enumerate(zip(names, weights, strict=True)):
        for term, weight in own.items():
            held[term].append({"template": at, "name": name, "part": weight})
    entry = pa.struct([("template", pa.int32()), ("name", pa.string()), ("part", pa.float64())])
    schema = pa.schema([("term", pa.string()), ("idf", pa.float64()), ("held", pa.list_(entry))])
    return spark.createDataFrame(pa.table([list(held), [idf[term] for term in held], list(held.values())], schema=schema))


def _paragraphs(text: Column) -> Column:
    """Parts between lines without a letter or digit."""
    return F.split(text, r"\n[^\p{L}\p{N}\n]*(?=\n)")


def block_units(text: Column, whole: Column) -> Column:
    """The distinct units of a text in which a licence word stands; ``whole`` asks for all of it too."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    # Possessive, so that a run of any length needs no stack.
    runs = F.regexp_extract_all(text, F.lit(rf"(?m)(?:^{COMMENT}[^\n]*(?:\n|\z))++"), F.lit(0))

    def windows(lines: Column) -> Column:
        cues = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda at: F.get(lines, at - 1).rlike(BLOCK_CUE))

        def beside(at: Column) -> Column:
            ends = ((F.greatest(at - 1, F.lit(1)), 2), (at, 2), (F.greatest(at - 1, F.lit(1)), 3))
            return F.array(*[F.array_join(F.slice(lines, first, F.lit(n)), "\n") for first, n in ends])

        return F.flatten(F.transform(cues, beside))

    # As an element of an array the lines are split once, not once per line.
    near = F.flatten(F.transform(F.array(F.split(text, "\n")), windows))
    blocks = F.concat(runs, F.flatten(F.transform(runs, _paragraphs)), _paragraphs(text), near)
    cued = F.filter(blocks, lambda block: block.rlike(BLOCK_CUE))
    return F.array_distinct(F.concat(cued, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def found_in_blocks(files: DataFrame, weighed: tuple, whole: Column, least: float) -> DataFrame:
    """(_key, _hash, own, score) of files (_key, _hash, _path, _text) with a unit close enough to a template.

    ``weighed`` is names, weights, idf of the templates and idf of any other term.
    """
    names, weights, idf, other = weighed
    units = files.select("_key", "_hash", F.posexplode(block_units(F.col("_text"), whole)).alias("_unit", "unit"))
    terms = units.select("_key", "_hash", "_unit", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0))).alias("term"))
    counted = terms.groupBy("_key", "_hash", "_unit", "term").agg(F.count(F.lit(1)).alias("n"))
    table = F.broadcast(term_table(files.sparkSession, names, weights, idf))
    joined = counted.join(table, "term", "left").withColumn("weight", F.col("n") * F.coalesce("idf", F.lit(other)))
    # Number -1 sums the squares, which make the length of the unit.
    square = F.struct(F.lit(-1).alias("template"), F.lit("").alias("name"), F.col("weight").alias("part"))
    parts = F.concat(F.array(square), F.coalesce("held", F.array().cast("array<struct<template:int,name:string,part:double>>")))
    summed = (
        joined.select("_key", "_hash", "_unit", "weight", F.explode(parts).alias("held"))
        .groupBy("_key", "_hash", "_unit", "held.template", "held.name")
        .agg(F.sum(F.col("weight") * F.col("held.part")).alias("dot"))
    )
    square = F.max(F.when(F.col("template") < 0, F.col("dot")))
    dots = F.collect_list(F.when(F.col("template") >= 0, F.struct("dot", "name")))
    told = summed.groupBy("_key", "_hash", "_unit").agg(F.sqrt(square).alias("length"), dots.alias("dots"))
    alike = F.transform("dots", lambda at: F.struct(F.round(at["dot"] / F.col("length"), 6).alias("score"), at["name"].alias("own")))
    best = told.groupBy("_key", "_hash").agg(F.max(F.array_max(alike)).alias("best"))
    return best.where(F.col("best.score") >= least).select("_key", "_hash", "best.own", "best.score")
