"""License scans: MinHash bands retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Customary statements of well-known licenses, and two whole license texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
WORD = "[a-z0-9]+"


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def anchors(templates: dict[str, str], width: int, least: float) -> list[str]:
    """Words without which no template can be contained to the share ``least``.

    For each template its longest words are taken until fewer than that share of its shingles
    has none of them, so a text without any anchor can be left out without loss.
    """
    found: set[str] = set()
    for text in templates.values():
        words = _words(text)
        k = min(width, len(words))
        shingles = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        for word in sorted(set(words), key=lambda w: (w not in found, -len(w), w)):
            if sum(not found & set(s) for s in shingles) < least * len(shingles):
                break
            found.add(word)
    return sorted(found)


def _shingles(hashes: Column, k: int) -> Column:
    """Hashes of the runs of k words, from the hashes of the words; none if there are fewer."""
    n = F.size(hashes) - k + 1
    run = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), run)).otherwise(F.array().cast("array<bigint>"))


def _hashed(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bands(shingles: Column, bands: int, rows: int) -> Column:
    """A hash of each band's rows, every row the least of one hash function over the shingles."""
    low = lambda j: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(j))))
    return F.array(*[F.xxhash64(F.lit(b), *[low(b * rows + r) for r in range(rows)]) for b in range(bands)])


def templates_table(spark: SparkSession, templates: dict[str, str], width: int) -> DataFrame:
    """license, words, k, shingles."""
    rows = spark.createDataFrame([(n, _words(t)) for n, t in sorted(templates.items())], "license string, words array<string>")
    rows = rows.withColumn("k", F.least(F.lit(width), F.size("words"))).withColumn("hashes", _hashed("words"))
    found = F.coalesce(*[F.when(F.col("k") == k, _shingles(F.col("hashes"), k)) for k in range(1, width + 1)])
    return rows.withColumn("shingles", F.array_distinct(found)).drop("hashes")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, width: int = 5, least: float = 0.8, bands: int = 12, rows: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, license, start_word, containment, windows: each license found in a whole text.

    Overlapping windows as long as a template are laid at every word. Where a window and a
    template agree in a band, the words from one length before the window to
    one behind it are searched for the template by exact containment of its shingles of ``width``
    words (of all words, if it has fewer), so words put into a license don't push its end out of
    sight. A window that holds the share ``least`` of a template's shingles, shifted or edited,
    has Jaccard similarity 0.66 or more with it, so the 12 bands of one row meet with probability
    1 - 0.34**12 or more for one window; one that holds half of them still meets with 0.99, and
    neighbouring windows try again. start_word is the first best window's first word (from 0).

    A window can agree with a template in a band only if it holds the shingle in which the template's
    first row of that band is least. Each text is hashed once; only where one of these few shingles stands are windows laid
    and their bands computed, on a slice of the hashes around it. So work grows with the length of
    a text and with the licenses in it, not with words that licenses use too.

    Words are runs of a-z and 0-9 in the lower-cased text. Null and empty texts have no row, nor
    do texts without a license. Rows that repeat id and text are reported once; rows that share only
    the id are told apart by text_hash. Templates and anchors are broadcast or literal; their
    number is a parameter of the job, not of the data.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    marks = anchors(templates, width, least)
    low = F.lower(F.col(text_col))
    may = F.exists(F.array(low), lambda t: reduce(Column.__or__, [t.contains(word) for word in marks], F.lit(False)))  # in an array, so that the text is lower-cased once
    known = templates_table(spark, templates, width)
    mine = known.select("license", "k", F.size("words").alias("n"), "shingles", F.posexplode(_bands(F.col("shingles"), bands, rows)).alias("band", "value"))
    least_of = lambda j: F.min_by("s", F.xxhash64("s", j))
    marked = mine.select("license", "band", F.explode("shingles").alias("s")).groupBy("license", "band").agg(least_of(F.col("band").cast("int") * rows).alias("hash"))
    mine = mine.join(marked, ["license", "band"]).collect()  # one row per template and band
    table = spark.createDataFrame(mine, "license string, band int, k int, n int, shingles array<long>, value long, hash long")
    texts = docs.where(may).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.regexp_extract_all(low, F.lit(WORD), 0).alias("words"))
    texts = texts.select("doc_id", "text_hash", F.size("words").alias("size"), _hashed("words").alias("words"))

    def hits_of(k: int) -> Column:
        """Places of shingles of k words in which a template is least, each with the shingles around it."""
        wanted, reach = sorted({r["hash"] for r in mine if r["k"] == k}), 2 * max(r["n"] for r in mine if r["k"] == k)

        def around(i: Column) -> Column:
            base = F.greatest(i - reach, F.lit(0))
            return F.struct(F.lit(k).alias("k"), i.alias("i"), F.get(f"s{k}", i).alias("hash"), base.alias("base"), F.slice(f"s{k}", base + 1, F.lit(2 * reach + 1)).alias("part"))

        at = F.filter(F.transform(f"s{k}", lambda h, i: F.when(h.isin(wanted), i)), lambda i: i.isNotNull())
        return F.transform(at, around)

    lengths = sorted({r["k"] for r in mine})
    hashed = texts.select("doc_id", "text_hash", "size", *[_shingles(F.col("words"), k).alias(f"s{k}") for k in lengths])
    hits = hashed.select("doc_id", "text_hash", "size", F.explode_outer(F.concat(*map(hits_of, lengths))).alias("h")).where("h is not null").select("doc_id", "text_hash", "size", "h.*")
    met = hits.join(F.broadcast(table), ["k", "hash"])
    first, last = F.greatest(F.col("i") - F.col("n") + F.col("k"), F.lit(0)), F.least(F.col("i"), F.greatest(F.col("size") - F.col("n"), F.lit(0)))
    met = met.where(first <= last).withColumn("start", F.explode(F.sequence(first, last)))
    held = F.slice("part", F.col("start") - F.col("base") + 1, F.col("n") - F.col("k") + 1)
    low_of = lambda r: F.array_min(F.transform(held, lambda h: F.xxhash64(h, F.col("band") * rows + r)))
    met = met.where(F.xxhash64("band", *[low_of(r) for r in range(rows)]) == F.col("value"))
    before = F.greatest(F.col("start") - F.col("n"), F.lit(0))
    searched = F.slice("part", before - F.col("base") + 1, F.col("start") - before + 2 * F.col("n") - F.col("k") + 1)
    share = F.size(F.array_intersect(searched, "shingles")) / F.size("shingles")
    found = met.select("doc_id", "text_hash", "license", "start", share.alias("containment")).where(F.col("containment") >= least)
    best = found.groupBy("doc_id", "text_hash", "license", "start").agg(F.max("containment").alias("containment"))
    return best.groupBy("doc_id", "text_hash", "license").agg(
        F.min_by("start", F.struct(-F.col("containment"), F.col("start"))).alias("start_word"), F.max("containment").alias("containment"), F.count(F.lit(1)).alias("windows")
    )
