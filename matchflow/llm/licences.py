"""Licence scans: minhash bands over overlapping windows retrieve templates, shingle containment verifies them.

DataFrame functions only. Texts become digests of five-word shingles, in chunks of bounded size; a template of fewer
words has its whole sequence as its only shingle, and texts get shingles of that width for it. A template of t
shingles is looked for in windows of three blocks, a block being the smallest power of two of which two hold t: any
stretch of t shingles lies in one window, and fills more than a third of it. A window with the wanted containment
then collides with its template in one of the bands with a probability of 0.999 at least.
"""

from __future__ import annotations

import random
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Words of a shingle; fewer for a template that has fewer.
WORDS = 5
#: Bands of one row each: at the lowest similarity of a wanted window, 0.25, all 24 fail in 0.1 percent of the cases.
BANDS = 24
#: Shingles in a chunk, and the templates' shingles in all, which go into the plan and must stay few.
CHUNK, TEMPLATE_SHINGLES = 4096, 100_000

#: Words of a paragraph of a licence text; a shorter one, such as a heading, goes with the next.
PARAGRAPH = 10
TEXTS = Path(__file__).parent / "licence_texts"


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, without line breaks, and with typographic apostrophes, which words end at just the same."""
    parts, waiting = [], ""
    for part in re.split(r"\n\s*\n", text.replace("'", "\u2019")):
        waiting = " ".join(f"{waiting} {part}".split())
        if len(re.findall("[a-z0-9]+", waiting.lower())) >= PARAGRAPH:
            parts.append(waiting)
            waiting = ""
    if waiting:
        parts.append(f"{parts.pop()} {waiting}" if parts else waiting)
    return parts


# Public licence notices, and below every paragraph of the licence texts.
NOTICES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                       "General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
               "Public License v1.0 which accompanies this distribution",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
               "which is available at",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                   "Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
NOTICES |= {f"{path.stem}-text-{i:03d}": part for path in sorted(TEXTS.glob("*.txt"))
            for i, part in enumerate(paragraphs(path.read_text(encoding="utf-8")), 1)}
#: Notices of fewer words than a shingle.
SHORT_NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "cc-by-4.0-short": "CC BY 4.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-unlicense": "SPDX-License-Identifier: Unlicense",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "license_id STRING, text STRING")


def short_notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SHORT_NOTICES.items()), "license_id STRING, text STRING")


def words_of(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles_of(words, width: int = WORDS):
    """Digests of the shingles of a word array, in order; none where it has fewer words than a shingle."""
    def of(w):
        at = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    # As a lambda's variable the array is computed once, not for every shingle.
    return F.get(F.transform(F.array(words), of), F.lit(0))


def seeds() -> list[int]:
    rng = random.Random(1997)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(BANDS)]


def once(array):
    """An array as a generator's only row, so that later filters and expressions don't compute it again."""
    return F.explode(F.array(array))


def lowest(window):
    """One smallest value per band: the digests under as many exclusive-ors."""
    return F.transform(F.array(*[F.lit(s) for s in seeds()]), lambda s: F.array_min(F.transform(window, lambda x: x.bitwiseXOR(s))))


def template_rows(templates: DataFrame) -> DataFrame:
    """(license_id, width, wanted, t, block): distinct shingles of every template that has any."""
    words = templates.where("license_id IS NOT NULL AND text IS NOT NULL").select("license_id", words_of(F.col("text")).alias("words"))
    rows = words.where("size(words) > 0").withColumn("width", F.least(F.size("words"), F.lit(WORDS)))
    per_width = F.coalesce(*[F.when(F.col("width") == n, shingles_of(F.col("words"), n)) for n in range(1, WORDS + 1)])
    rows = rows.select("license_id", "width", F.array_distinct(per_width).alias("wanted")).withColumn("t", F.size("wanted"))
    return rows.withColumn("block", F.expr("CAST(greatest(1, power(2, ceil(log2(t / 2.0)))) AS INT)"))


def needed(wanted: DataFrame, share: float) -> DataFrame:
    """(shingle): of every template so many that a window with the wanted containment has one of them at least."""
    least = F.greatest(F.lit(1), F.col("t") - F.ceil(F.col("t") * share - 1e-9) + 1).cast("int")
    return wanted.select(F.explode(F.slice(F.sort_array("wanted"), F.lit(1), least)).alias("shingle")).distinct()


def matches(docs: DataFrame, templates: DataFrame, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license_id, containment, position): the largest share of a template's shingles in one window of a document.

    ``position`` is the first shingle (word) of the first window with that share.

    * null or empty text, or fewer words than the shortest template's shingle: no row; null id: rows under a null id
    * repeated ids: one row per id and template, of the best window of all their texts
    * a template of fewer than five words matches where all its words stand in order; templates that are null or have no
      words match nothing; equal templates match each under its id
    * empty tables: no rows; other columns are not looked at; very long texts are scanned whole, chunk by chunk
    """
    wanted = stored(template_rows(templates), "templates")
    total = wanted.select(F.explode("wanted")).distinct().count()
    if total > TEMPLATE_SHINGLES:
        raise ValueError(f"templates of more than {TEMPLATE_SHINGLES} shingles; scan with fewer at a time")
    known = [r[0] for r in needed(wanted, share).collect()]
    widths = sorted(r[0] for r in wanted.select("width").distinct().collect()) or [WORDS]
    blocks = sorted(r[0] for r in wanted.select("block").distinct().collect())  # powers of two: a few
    longest = 3 * max(blocks, default=1)
    if longest > CHUNK:
        chunk = 1 << (longest - 1).bit_length()
    else:
        chunk = CHUNK

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), once(words_of(F.col(f"`{text_col}`"))).alias("words"))
    # Chunk starts are multiples of every block, so windows lie where they would in the whole text.
    starts = F.expr(f"CASE WHEN size(words) >= {widths[0]} THEN sequence(0, size(words) - {widths[0]}, {chunk}) END")
    chunks = rows.select("id", "words", F.explode(starts).alias("start")).select(
        "id", "start", F.slice("words", F.col("start") + 1, chunk + longest + WORDS - 1).alias("words"))
    hashed = chunks.select("id", "start", F.inline(F.array(*[
        F.struct(F.lit(n).alias("width"), shingles_of(F.col("words"), n).alias("sh")) for n in widths])))
    # A window without any of these shingles cannot have the wanted containment.
    among = f"x IN ({', '.join(f'{k}L' if k > -(1 << 63) else 'CAST(-9223372036854775808 AS BIGINT)' for k in known)})"
    known_in = lambda array: F.expr(f"exists({array}, x -> {among})") if known else F.lit(False)
    near = hashed.where(known_in("sh")).select("id", "start", "width", "sh", F.explode(F.array(*[F.lit(b) for b in blocks or [1]])).alias("block"))
    # The last chunk may be too short for the wider shingles.
    at = F.expr(f"CASE WHEN size(sh) > 0 THEN sequence(0, least(size(sh), {chunk}) - 1, block) ELSE CAST(array() AS ARRAY<INT>) END")
    cut = F.transform(at, lambda at: F.struct(
        (F.col("start") + at).alias("position"), F.slice("sh", at + 1, F.col("block") * 3).alias("window")))
    windows = near.select("id", "width", "block", F.inline(cut)).where(known_in("window"))
    windows = windows.select("id", "width", "block", "position", once(F.array_distinct("window")).alias("window"))
    banded = windows.select("*", F.posexplode(lowest(F.col("window"))).alias("band", "value"))
    keys = wanted.select("license_id", "wanted", "t", "width", "block", F.posexplode(lowest(F.col("wanted"))).alias("band", "value"))
    found = banded.join(F.broadcast(keys), ["width", "block", "band", "value"])
    # A window that collides in several bands is verified alike each time; only the best of a document counts.
    contained = F.size(F.array_intersect("window", "wanted")) / F.col("t")
    return (found.select("id", "license_id", "position", contained.alias("containment")).where(F.col("containment") >= share)
            .groupBy("id", "license_id").agg(F.max("containment").alias("containment"),
                                             F.min_by("position", F.struct(-F.col("containment"), "position")).cast("long").alias("position"))
            .withColumnRenamed("id", id_col))
