"""License scans: own licences, inheritance, edge cases."""

from __future__ import annotations

import math
import re
from collections import Counter

from tests.plans import plan_text
from tokentide.llm import license_blocks, licenses
from tokentide.llm.license_blocks import block_templates
from tokentide.llm.licenses import scan_licenses


def scan(rows, data, schema="path string, text string"):
    return {r.path: (r.license, r.license_from) for r in scan_licenses(rows(data, schema)).collect()}


def test_own_and_inherited(rows):
    found = scan(
        rows,
        [
            ("a/LICENSE", "Some project.\nReleased under the MIT License.\n"),
            ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
            ("a/x.py", "code"),
            ("a/b/y.py", "code about licences"),
            ("a/b/c/d/z.py", None),
            ("a/b/own.py", "# SPDX-License-Identifier: Apache-2.0\r\ncode"),
            ("ab/w.py", "nothing"),
            ("top.py", ""),
            ("e/LICENSE", "no words of any known kind"),
            ("e/f.py", "x"),
        ],
    )
    assert found == {
        "a/LICENSE": ("MIT", "file"),
        "a/b/COPYING.txt": ("GPL-3.0", "file"),
        "a/x.py": ("MIT", "a"),
        "a/b/y.py": ("GPL-3.0", "a/b"),
        "a/b/c/d/z.py": ("GPL-3.0", "a/b"),
        "a/b/own.py": ("Apache-2.0", "file"),
        "ab/w.py": (None, None),
        "top.py": (None, None),
        "e/LICENSE": (None, None),
        "e/f.py": (None, None),
    }


def test_root_ties_repeats_and_clashes(rows):
    data = [
        ("LICENSE", "Released under the MIT License."),
        ("LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        ("q/x", "x"),
        ("q/x", "x"),
        (None, "Released under the MIT License."),
    ]
    frame = rows([(*d, "old", 1) for d in data], "path string, text string, License string, best int")
    found = scan_licenses(frame)
    assert found.columns == ["path", "text", "best", "license", "license_from", "license_score"]
    told = sorted((str(r.path), r.license, r.license_from) for r in found.collect())
    # Equal cosines in one directory: the later name.
    assert told == [("LICENSE", "MIT", "file"), ("LICENSE.txt", "Apache-2.0", "file"), ("None", "MIT", "file"), ("q/x", "MIT", ""), ("q/x", "MIT", "")]
    assert scan_licenses(frame.where("false")).count() == 0
    plan = plan_text(found)
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop"))


def test_long_licence_file(rows):
    long = ("filler words " * 30_000) + "\nLicensed under CC BY-NC 4.0.\n"
    assert scan(rows, [("p/NOTICE", long), ("p/q", "x")]) == {"p/NOTICE": ("CC-BY-NC-4.0", "file"), "p/q": ("CC-BY-NC-4.0", "p")}


GPL_HEADER = """# This file is part of Frobnicate.
#
# Frobnicate is free software: you can redistribute it and/or modify
# it under the terms of the GNU {kind}General Public License as published by
# the Free Software Foundation, either version {version} of the License, or
# (at your option) any later version.
#
# Frobnicate is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU {kind}General Public License for more details.
import os
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
   License, v. 2.0. If a copy of the MPL was not distributed with this
   file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int x;
"""
APACHE_HEADER = """\"\"\"A module.

Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");\r
you may not use this file except in compliance with the License.
\"\"\"
"""


def test_wrapped_headers(rows):
    found = scan(
        rows,
        [
            ("h/gpl3.py", GPL_HEADER.format(kind="", version=3)),
            ("h/gpl2.py", GPL_HEADER.format(kind="", version=2)),
            ("h/lgpl.py", GPL_HEADER.format(kind="Lesser ", version="2.1")),
            ("h/agpl.py", GPL_HEADER.format(kind="Affero ", version=3)),
            ("h/mpl.c", MPL_HEADER),
            ("h/mpl.js", MPL_HEADER.replace("\n   ", "\n * ")),
            ("h/bsd.go", "// Copyright 2009 Some Authors.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage x\n"),
            ("h/apache.py", APACHE_HEADER),
            ("h/prose.txt", "Words before.\nThis work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International\nLicense.\nwords after\n"),
            ("h/none.py", "# The licence server asks for a copyright notice\n# of any kind, see below.\n" * 3000),
        ],
    )
    assert {path: license for path, (license, _) in found.items()} == {
        "h/gpl3.py": "GPL-3.0",
        "h/gpl2.py": "GPL-2.0",
        "h/lgpl.py": "LGPL-2.1",
        "h/agpl.py": "AGPL-3.0",
        "h/mpl.c": "MPL-2.0",
        "h/mpl.js": "MPL-2.0",
        "h/bsd.go": "BSD-3-Clause",
        "h/apache.py": "Apache-2.0",
        "h/prose.txt": "CC-BY-NC-4.0",
        "h/none.py": None,
    }


def test_whole_licence_files(rows):
    texts = {name: full[-1] for name, full in block_templates().items()} | {"MIT": block_templates()["MIT"][0]}
    data = [(f"{name}/LICENSE", f"Some Project\n\nCopyright (c) 2001 Jane Doe\n\n{text}") for name, text in texts.items()]
    found = scan(rows, [*data, *((f"{name}/src/x", "code") for name in texts)])
    assert len(data) >= 16
    for name in texts:
        assert found[f"{name}/LICENSE"] == (name, "file")
        assert found[f"{name}/src/x"] == (name, name)


def test_reserved_rights_block_inheritance(rows):
    data = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/x.py", "# Copyright 2020 Someone. All rights reserved.\ncode"),
        ("a/y.py", "# Copyright 2020 Someone. All rights\n# reserved.\n# SPDX-License-Identifier: Apache-2.0"),
        ("a/w.py", "# all rights\n# reserved"),
        ("a/z.py", "code"),
        ("a/b/LICENSE", "All Rights Reserved."),
        ("a/b/z.py", "code"),
    ]
    found = scan_licenses(rows(data, "path string, text string"), reserved=True).collect()
    assert {r.path: (r.license, r.license_from, r.license_score is None) for r in found} == {
        "a/LICENSE": ("MIT", "file", False),
        "a/x.py": ("reserved", "file", True),
        "a/y.py": ("Apache-2.0", "file", False),
        "a/w.py": ("reserved", "file", True),
        "a/z.py": ("MIT", "a", False),
        "a/b/LICENSE": ("reserved", "file", True),
        "a/b/z.py": ("reserved", "a/b", True),
    }


def plain_units(text, holder):
    """Blocks of a text by the rules that ``block_units`` states, line by line."""
    text = re.sub("\r\n?", "\n", text)
    lines = text.split("\n")
    comment, cue = re.compile(license_blocks.COMMENT), re.compile(license_blocks.BLOCK_CUE)

    def paragraphs(lines):
        # Lines without a letter or digit part paragraphs; a text begins and ends with one of its own.
        parts, own = [], []
        for at, line in enumerate(lines):
            if 0 < at < len(lines) - 1 and not any(c.isalnum() for c in line):
                parts.append(own)
                own = []
            else:
                own.append(line)
        return ["\n".join(part) for part in [*parts, own]]

    runs, run = [], []
    for line in [*lines, None]:
        if line is not None and comment.match(line):
            run.append(line)
        elif run:
            runs.append("\n".join(run))
            run = []
    blocks = [*runs, *paragraphs(lines)]
    for run in runs:
        blocks += paragraphs(run.split("\n"))
    for at, line in enumerate(lines):
        if cue.search(line):
            before = max(at - 1, 0)
            blocks += ["\n".join(lines[first : first + n]) for first, n in ((before, 2), (at, 2), (before, 3))]
    return [block for block in blocks if cue.search(block)] + ([text] if holder else [])


def plain_license(path, text, least=0.6):
    """The licence of a file of its own: the best cosine of its lines, then of its blocks, then reserved rights."""

    def best(units, templates):
        names, weights, idf, other = licenses.template_weights(templates)
        found = [(0.0, "")]
        for unit in units:
            counts = Counter(re.findall("[a-z0-9]+", unit.lower()))
            own = {term: n * idf.get(term, other) for term, n in counts.items()}
            length = math.sqrt(sum(w * w for w in own.values()))
            for name, weight in zip(names, weights):
                dot = sum(w * weight.get(term, 0.0) for term, w in own.items())
                found.append((round(dot / length, 6) if length else 0.0, name))
        return max(found)

    holder = re.search(licenses.LICENCE_FILE, path) is not None
    lines = [line for line in re.split("\r\n|\r|\n", text) if re.search(licenses.CUE, line)]
    told = best([*lines, *([text] if holder else [])], licenses.TEMPLATES)
    if told[0] < 1:
        blocks = best(plain_units(text, holder), license_blocks.block_templates())
        told = blocks if blocks[0] > told[0] else told
    if told[0] >= least:
        return told[1], told[0]
    return ("reserved", None) if re.search(licenses.RESERVED, text) else (None, None)


def test_every_document_equals_a_plain_scan(spark):
    """All documents of a table, headers and whole licence files written into some of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    headers = [t for own in license_blocks.block_templates().values() for t in own if len(t) < 3000]
    wrapped = ["\n".join(f"# {line}" for line in re.findall(r"(?s).{1,60}(?:\s|$)", header.replace("\n", " "))) for header in headers]
    rows = []
    for i, r in enumerate(docs.select("doc_id", "source", "text").collect()):
        text = r.text or ""
        if i % 10 == 3:
            text = f"{wrapped[i % len(wrapped)]}\n\n{text}"
        elif i % 10 == 6:
            text = f"{text}\n{headers[i % len(headers)]}"
        rows.append((r.doc_id, f"d{r.doc_id}/" + ("LICENSE" if i % 25 == 0 else "x.txt"), text))
    frame = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = {r.doc_id: r for r in scan_licenses(frame, reserved=True).collect()}
    own = 0
    for key, path, text in rows:
        name, score = plain_license(path, text)
        told = found[key]
        # Every file has a directory of its own, so nothing is inherited.
        assert told.license == name and (score is None or abs(told.license_score - score) < 2e-6), (key, path)
        own += name is not None
    assert own > 200 and sum(r.license == "reserved" for r in found.values()) > 0
