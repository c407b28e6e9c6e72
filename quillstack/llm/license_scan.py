"""License scans: templates are found in texts by MinHash bands over overlapping windows and verified exactly.

Texts are lower-cased and cut into words of a-z and 0-9. Templates are sorted into classes by their number of words; a
class slides windows of its own length and stride over a text, so that every passage as long as a template of the class
lies whole in some window. Windows and templates are compared as sets of five-word shingles: ``BANDS`` bands of
``ROWS`` MinHash values retrieve candidate pairs, and a pair is kept if the window holds at least ``CONTAINMENT`` of the
template's shingles. A window is longer than its template, so it may hold all that is asked for at a Jaccard similarity of
0.4 to 0.5; :func:`missed` gives the probability that all bands miss such a pair, below 1e-5 for each template here.

Before that, texts and windows without any anchor word are put aside, at no loss: anchors are words of the templates
chosen so that the shingles without one are too few for the containment asked for.

Of matches that overlap in a text, as those of licenses with like wording do, the one that holds most of its template stays
(then that of most shingles, then the first by name). The list is that of common notices and of how common licenses begin;
it is a parameter, and whole license texts can be given with it.

Only DataFrame functions are used. The templates are a fixed list, so the broadcast of their bands is bounded.

Defined cases: a null or empty text has no match; a text shorter than a window is one shorter window; repeated rows (of
one doc_id) are one; of equally good windows the first counts; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, BANDS, ROWS = 5, 0.75, 64, 2

#: Notices by which texts state their license.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice-2": "Released under the Apache License 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
}
#: Words too common to be anchors.
COMMON = {"the", "under", "this", "with", "from", "that", "are", "for", "and", "you", "may", "not", "work", "without", "copy", "free", "use", "following", "persons", "person", "charge", "above", "appear", "purpose", "files", "file"}


def words_of(text: str) -> list[str]:
    """The words of a template, as :func:`words` takes them."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def shingle_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    """Distinct shingles of each template; a template of fewer words is one shingle."""
    out = {}
    for name, text in templates.items():
        w = words_of(text)
        out[name] = sorted({" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))})
    return out


def anchors(templates: dict[str, str], containment: float = CONTAINMENT) -> list[str]:
    """Words without which no window can hold ``containment`` of a template's shingles."""
    sets = {n: [s.split() for s in x] for n, x in shingle_sets(templates).items()}
    uses: dict[str, int] = {}
    for x in sets.values():
        for word in {w for s in x for w in s}:
            uses[word] = uses.get(word, 0) + 1
    chosen: list[str] = []
    for x in sets.values():
        need = lambda: sum(any(w in chosen for w in s) for s in x) <= (1 - containment) * len(x)  # noqa: B023, E731
        ranked = sorted({w for s in x for w in s}, key=lambda w: (w in COMMON or len(w) < 4, -uses[w], w))
        for word in ranked:
            if not need():
                break
            chosen.append(word)
    return sorted(set(chosen))


def length_class(n: int) -> tuple[int, int]:
    """Window and stride, in words, of the class of templates of n words: any n words lie whole in a window."""
    most = SHINGLE
    while most < n:
        most += max(1, most // 4)
    stride = max(1, most // 4)
    return most + stride - 1, stride


def missed(n: int, containment: float = CONTAINMENT, bands: int = BANDS, rows: int = ROWS) -> float:
    """The greatest probability that all bands miss a window that holds ``containment`` of a template of n words."""
    shingles_of = lambda words: max(1, words - SHINGLE + 1)
    window, own = shingles_of(length_class(n)[0]), shingles_of(n)
    shared = -(-own * containment // 1)
    return (1 - (shared / (window + own - shared)) ** rows) ** bands


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Distinct shingles of an array of words; of fewer than five words (but not none) the whole."""
    one = F.filter(F.array(F.array_join(w, " ")), lambda s: s != "")
    many = F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
    return F.array_distinct(F.when(F.size(w) < SHINGLE, one).otherwise(many))


def bands(s: Column, n: int = BANDS, rows: int = ROWS) -> Column:
    """Hashes of the bands of MinHash values of an array of shingles."""
    least = lambda j: F.array_min(F.transform(s, lambda x: F.xxhash64(j, x)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(b, *[least(b * rows + r) for r in range(rows)]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """Matches in ``docs`` (doc_id, text): doc_id, license, n_shared, n_shingles, containment, begin_word, n_words.

    ``n_words`` is the length of the window, which begins at ``begin_word``, a count of words before it.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    marks = anchors(templates, containment)
    classes: dict[tuple[int, int], list[str]] = {}
    for name, text in templates.items():
        classes.setdefault(length_class(len(words_of(text))), []).append(name)
    sets = shingle_sets(templates)
    rows = [F.struct(F.lit(n).alias("license"), F.lit(w).alias("window"), F.array(*[F.lit(s) for s in sets[n]]).alias("template")) for (w, _), names in classes.items() for n in names]
    known = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    known = known.select("license", "window", "template", F.explode(F.array_distinct(bands(F.col("template")))).alias("band"))

    found = docs.select("doc_id", "text").where(F.lower("text").rlike("|".join(marks))).select("doc_id", words(F.col("text")).alias("w"))
    anchored = F.array(*[F.lit(m) for m in marks])

    def windows(window: int, stride: int) -> Column:
        # past the first, windows that begin so late that the one before has the last word too add nothing
        last = F.greatest(F.lit(0), F.size("w") - window + stride - 1)
        cut = F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.struct(i.alias("begin"), F.slice("w", i + 1, window).alias("part"), F.lit(window).alias("window")))
        return F.filter(cut, lambda x: F.arrays_overlap(x["part"], anchored))

    cut = found.select("doc_id", F.explode(F.concat(*[windows(w, s) for w, s in classes])).alias("x")).select("doc_id", "x.begin", "x.window", "x.part")
    cut = cut.select("doc_id", "begin", "window", F.size("part").alias("n_words"), shingles(F.col("part")).alias("s"))
    banded = cut.select("*", F.explode(F.array_distinct(bands(F.col("s")))).alias("band"))
    pairs = banded.join(F.broadcast(known), ["window", "band"])
    shared = F.size(F.array_intersect("template", "s"))
    good = pairs.withColumn("n_shared", shared).where(F.col("n_shared") >= F.lit(containment) * F.size("template"))
    best = good.groupBy("doc_id", "license").agg(F.max(F.struct("n_shared", (-F.col("begin")).alias("from"), "n_words", F.size("template").alias("n_shingles"))).alias("m"))
    # a document has a match of each template at most
    own = F.struct((F.col("m.n_shared") / F.col("m.n_shingles")).alias("share"), F.col("m.n_shared").alias("shared"), "license", "m")
    beats = lambda a, b: (a["share"] > b["share"]) | ((a["share"] == b["share"]) & ((a["shared"] > b["shared"]) | ((a["shared"] == b["shared"]) & (a["license"] < b["license"]))))
    overlap = lambda a, b: (-a["m"]["from"] < -b["m"]["from"] + b["m"]["n_words"]) & (-b["m"]["from"] < -a["m"]["from"] + a["m"]["n_words"])
    gathered = best.groupBy("doc_id").agg(F.collect_list(own).alias("all"))
    best = gathered.select("doc_id", F.explode(F.filter("all", lambda b: ~F.exists("all", lambda a: beats(a, b) & overlap(a, b)))).alias("x")).select("doc_id", "x.license", "x.m")
    return best.select("doc_id", "license", "m.n_shared", "m.n_shingles", (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"), (-F.col("m.from")).alias("begin_word"), "m.n_words")
