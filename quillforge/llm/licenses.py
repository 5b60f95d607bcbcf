"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines that speak of a licence (a header) and whole short texts (a licence file) become sparse vectors of words and word
pairs, weighted by inverse document frequency over the templates; the template of the highest cosine names the licence if
the cosine passes a threshold. Words that no template has weigh as much as the rarest that one has, so ordinary prose
drowns a match. A text whose whole vector passes is a licence file of its directory, whatever its length; it is compared
with notices and with whole licences (``license_texts``), header lines with notices and SPDX identifiers. Each of the three
sets of templates has its own weights. The Creative Commons licences but CC0 have no whole text here, only notices.

Files without a licence of their own take that of the licence file in the nearest ancestor directory: distinct directories
are joined to the licence directories by each of their ancestor paths, the deepest match wins, and files join their
directory's result. Ties within a directory go to the highest cosine, then to the name that sorts first.

Null and empty texts match nothing by themselves but inherit. A null path inherits nothing. Repeated rows keep their rows.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, texts

# fixed values: notices and opening clauses by which public licences are known
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
SUFFIXES = {"GPL-3.0": ("", "-only", "-or-later"), "GPL-2.0": ("", "-only", "-or-later"), "LGPL-3.0": ("", "-only", "-or-later")}
SPDX = {name: [f"SPDX-License-Identifier: {name}{x}" for x in SUFFIXES.get(name, ("",))] for name in TEMPLATES}
SPEAKS = re.compile(r"licen[sc]e|spdx|public domain|permission is hereby granted|redistribution and use", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)?")


def terms(line: str) -> Counter:
    ws = WORD.findall(line.lower())
    return Counter(ws) + Counter(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))


class Templates:
    """Unit vectors of all templates as postings, so a text only meets templates it shares terms with."""

    def __init__(self, templates: dict[str, list[str]] | None = None):
        rows = [(name, terms(t)) for name, ts in (templates or TEMPLATES).items() for t in ts]
        df = Counter(t for _, c in rows for t in c)
        self.idf = {t: math.log(1 + len(rows) / n) for t, n in df.items()}
        self.rare = math.log(1 + len(rows))
        self.names = [name for name, _ in rows]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, counts) in enumerate(rows):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in counts.items()))
            for t, n in counts.items():
                self.postings.setdefault(t, []).append((k, n * self.idf[t] / norm))

    def best(self, line: str) -> tuple[str | None, float]:
        counts = terms(line)
        norm = math.sqrt(sum((n * self.idf.get(t, self.rare)) ** 2 for t, n in counts.items()))
        dots: dict[int, float] = {}
        for t, n in counts.items():
            for k, w in self.postings.get(t, ()):
                dots[k] = dots.get(k, 0.0) + n * self.idf[t] * w
        if not dots:
            return None, 0.0
        top = min(dots, key=lambda k: (-round(dots[k], 12), self.names[k]))
        return self.names[top], dots[top] / norm


def whole_texts() -> dict[str, list[str]]:
    """Licences in full, by name."""
    folder = resources.files(__package__) / "license_texts"
    return {f.name.removesuffix(".txt"): [f.read_text("utf-8")] for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def best_of(line: str, sets: tuple[Templates, ...]) -> tuple[str | None, float]:
    """The best match over several sets of templates, the first of equal ones."""
    return max((t.best(line) for t in sets), key=lambda found: found[1])


def header(text: str, *sets: Templates) -> tuple[str | None, float]:
    """The best match of any line, or pair of lines, that speaks of a licence."""
    best: tuple[str | None, float] = (None, 0.0)
    if not SPEAKS.search(text):
        return best
    lines = text.split("\n")
    for k, line in enumerate(lines):
        if SPEAKS.search(line):
            for part in (line, *re.split(r"(?<=[.!?])\s+", line), " ".join(lines[max(0, k - 1) : k + 2])):
                found = best_of(part, sets)
                if found[1] > best[1]:
                    best = found
    return best


def scan(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    id_col: str = "doc_id",
    threshold: float = 0.6,
    file_threshold: float = 0.5,
) -> DataFrame:
    """doc_id, path, license, similarity, evidence (file, header, inherited or none), license_dir it comes from."""
    small_batches(files.sparkSession)
    frame = files.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    notices, wholes, spdx = Templates(), Templates(whole_texts()), Templates(SPDX)

    def run(it):
        for batch in batches(it):
            rows = []
            for text in texts(batch):
                name, cosine, evidence = None, 0.0, "none"
                if SPEAKS.search(text):
                    name, cosine = best_of(text, (notices, wholes))
                    evidence = "file" if cosine >= file_threshold else "none"
                    if evidence == "none":
                        name, cosine = header(text, notices, spdx)
                        evidence = "header" if cosine >= threshold else "none"
                rows.append((name, cosine, evidence) if evidence != "none" else (None, cosine, "none"))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("path"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string())],
                names=["doc_id", "path", "license", "similarity", "evidence"],
            )

    kind = frame.schema["doc_id"].dataType.simpleString()
    own = frame.mapInArrow(run, f"doc_id {kind}, path string, license string, similarity double, evidence string")
    return inherit(own)


def inherit(own: DataFrame) -> DataFrame:
    """Give files without a licence that of the nearest ancestor directory with a licence file."""
    from .common import stored

    own = stored(own.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), "licenses")
    top = F.struct(F.col("similarity"), F.transform(F.split("license", ""), lambda c: -F.ascii(c)), F.col("license"))
    granted = own.where("evidence = 'file' and dir is not null").groupBy("dir").agg(F.max(top).alias("top"))
    granted = granted.select(F.col("dir").alias("at"), F.col("top.license").alias("given"), F.col("top.similarity").alias("cosine"))
    wanting = own.where("evidence = 'none' and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    climb = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    near = wanting.select("dir", F.explode(F.array_distinct(climb)).alias("at")).join(granted, "at")
    near = near.groupBy("dir").agg(F.max_by(F.struct("at", "given", "cosine"), F.length("at")).alias("near"))
    near = near.select(F.col("dir").alias("for"), "near.*")
    out = own.join(near, (own["dir"] == near["for"]) & (own["evidence"] == "none"), "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "given").alias("license"),
        F.when(F.col("given").isNotNull(), F.col("cosine")).otherwise(F.col("similarity")).alias("similarity"),
        F.when(F.col("given").isNotNull(), F.lit("inherited")).otherwise(F.col("evidence")).alias("evidence"),
        F.coalesce(F.col("at"), F.when(F.col("evidence") == "file", F.col("dir"))).alias("license_dir"),
    )
