"""License scans by diagonal voting.

All rolling k-word hashes of a document are joined with the places of the same words in
license templates.  A hit at word p of the document and place t of a template votes for
the diagonal p - t; a copied template gathers its votes on one diagonal, and each word
put in or left out moves the rest to a diagonal close by.  Diagonals not further apart
than ``GAP`` are merged into spans.  Hits are exact: the words behind equal hashes are
compared before they vote.

A span is verified twice.  It must cover ``COVER`` of its template's places and all places
of the template's deciding words, which tell it from its neighbours ("version 2 of the
license").  Then each word that several verified spans claim goes to the one that covers
most places, and a span stands only if it still passes with the words left to it.  So a
license that quotes most of another's wording gives its own label only.  Licenses are held
as several templates (grant, conditions, warranty), each of which is enough.

The base phrases are templates too, which must be covered in full on a single diagonal.

Cases: a null text is empty; documents without hits have null places, empty labels and
score 0; equal claims on a word go to the template listed first; repeated rows each get
their row; columns of the names added here are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logdistill.llm.common import count_words, grams, stage, text_key, words_of

K = 3
GAP = 8
COVER = 0.6

# Phrases that name a license wherever their words stand.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wording of public licenses, by label: (deciding words, text).
TEMPLATES = {
    "mit": [
        (["to deal in the Software without restriction"],
         """Permission is hereby granted, free of charge, to any person obtaining a copy of this
         software and associated documentation files (the "Software"), to deal in the Software
         without restriction, including without limitation the rights to use, copy, modify, merge,
         publish, distribute, sublicense, and/or sell copies of the Software"""),
        (["the above copyright notice and this permission notice shall be included in all copies"],
         """and to permit persons to whom the Software is furnished to do so, subject to the following
         conditions: The above copyright notice and this permission notice shall be included in all
         copies or substantial portions of the Software."""),
        (["without warranty of any kind express or implied", "authors or copyright holders be liable"],
         """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
         INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
         PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
         FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
         OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
         DEALINGS IN THE SOFTWARE."""),
    ],
    "apache-2": [
        (["Apache License Version 2 0"],
         """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
         file except in compliance with the License. You may obtain a copy of the License at"""),
        (["Unless required by applicable law or agreed to in writing software"],
         """Unless required by applicable law or agreed to in writing, software distributed under
         the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
         KIND, either express or implied. See the License for the specific language governing
         permissions and limitations under the License."""),
    ],
    "gpl-2": [
        (["General Public License version 2"],
         """licensed under the GNU General Public License, version 2"""),
        (["the GNU General Public License", "version 2 of the License"],
         """you can redistribute it and/or modify it under the terms of the GNU General Public
         License as published by the Free Software Foundation; either version 2 of the License,
         or (at your option) any later version."""),
    ],
    "gpl-3": [
        (["General Public License version 3"],
         """licensed under the GNU General Public License, version 3"""),
        (["the GNU General Public License", "version 3 of the License"],
         """you can redistribute it and/or modify it under the terms of the GNU General Public
         License as published by the Free Software Foundation, either version 3 of the License,
         or (at your option) any later version."""),
    ],
    "gpl": [
        (["the GNU General Public License"],
         """you can redistribute it and/or modify it under the terms of the GNU General Public
         License as published by the Free Software Foundation"""),
    ],
    "lgpl": [
        (["GNU Lesser General Public License"],
         """you can redistribute it and/or modify it under the terms of the GNU Lesser General
         Public License as published by the Free Software Foundation"""),
        (["GNU Lesser General Public License"],
         """licensed under the GNU Lesser General Public License"""),
    ],
    "agpl": [
        (["GNU Affero General Public License"],
         """you can redistribute it and/or modify it under the terms of the GNU Affero General
         Public License as published by the Free Software Foundation"""),
        (["GNU Affero General Public License"],
         """licensed under the GNU Affero General Public License"""),
    ],
    "bsd": [
        (["Redistribution and use in source and binary forms"],
         """Redistribution and use in source and binary forms, with or without modification, are
         permitted provided that the following conditions are met"""),
        (["provided by the copyright holders and contributors"],
         """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
         EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
         MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ],
    "isc": [
        (["software for any purpose with or without fee"],
         """Permission to use, copy, modify, and/or distribute this software for any purpose with
         or without fee is hereby granted, provided that the above copyright notice and this
         permission notice appear in all copies"""),
        (["disclaims all warranties with regard to this software"],
         """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
         THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ],
    "mpl-2": [
        (["Mozilla Public License v 2 0"],
         """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"""),
    ],
    "cc-by": [
        (["Attribution 4 0"],
         """licensed under a Creative Commons Attribution 4.0 International License"""),
    ],
    "cc-by-sa": [
        (["Attribution ShareAlike 4 0"],
         """licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"""),
    ],
    "cc-by-nd": [
        (["Attribution NoDerivatives 4 0"],
         """licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"""),
    ],
    "cc-by-nc": [
        (["Attribution NonCommercial 4 0"],
         """licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"""),
    ],
    "cc-by-nc-sa": [
        (["Attribution NonCommercial ShareAlike 4 0"],
         """licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International
         License"""),
    ],
    "cc-by-nc-nd": [
        (["Attribution NonCommercial NoDerivatives 4 0"],
         """licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0
         International License"""),
    ],
    "unlicense": [
        (["released into the public domain"],
         """This is free and unencumbered software released into the public domain"""),
    ],
}


def template_places(spark: SparkSession) -> DataFrame:
    """(template, label, base, size, place, tw, gram, deciding, n_deciding): k-grams of all templates.

    ``deciding`` marks the grams of deciding words, ``n_deciding`` is their number.
    """
    rows = [(i, label, True, text, []) for i, (text, label) in enumerate(PHRASES.items())]
    for label, parts in TEMPLATES.items():
        rows += [(len(rows) + i, label, False, text, words) for i, (words, text) in enumerate(parts)]
    worded = spark.createDataFrame(
        rows, "template int, label string, base boolean, text string, deciding array<string>"
    ).select(
        "template", "label", "base", words_of(F.col("text")).alias("ws"),
        F.flatten(F.transform("deciding", lambda d: grams(words_of(d), K))).alias("marks"),
    )
    # The grams of deciding words must stand in the text, or the template could never match.
    return worded.select(
        "template", "label", "base", (F.size("ws") - (K - 1)).alias("size"), "ws", "marks",
        F.posexplode_outer(grams(F.col("ws"), K)).alias("place", "gram"),
    ).select(
        "template", "label", "base", "size", "place", "gram",
        F.slice("ws", F.col("place") + 1, K).alias("tw"),
        F.array_contains("marks", F.col("gram")).alias("deciding"),
        F.size(F.array_distinct("marks")).alias("n_deciding"),
    )


def votes(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct verified hits (__doc, __text, template, label, base, size, n_deciding, deciding, place, at)."""
    worded = docs.select("__doc", "__text", words_of(F.col("text")).alias("ws"))
    hits = (
        worded.withColumn("__g", grams(F.col("ws"), K))
        # An outer explode, so that the optimizer adds no second evaluation of the array.
        .select("__doc", "__text", "ws", F.posexplode_outer("__g").alias("at", "gram"))
        # The templates are the fixed texts above: some 300 rows.
        .join(F.broadcast(places), "gram")
        .where(F.slice("ws", F.col("at") + 1, K) == F.col("tw"))
    )
    return hits.select(
        "__doc", "__text", "template", "label", "base", "size", "n_deciding", "deciding", "gram", "place", "at"
    ).distinct()


def spans(hits: DataFrame) -> DataFrame:
    """Verified spans: (__doc, __text, template, label, base, start, end, cover)."""
    keys = ["__doc", "__text", "template", "label", "base"]
    diagonal = F.col("at") - F.col("place")
    # Templates are short, so the places and grams of one are a small set.
    covered = F.size(F.collect_set("place"))
    decided = F.size(F.collect_set(F.when(F.col("deciding"), F.col("gram"))))
    base = (
        hits.where("base").groupBy(*keys, "size", diagonal.alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
        .where(F.col("votes") == F.col("size"))
        .select(
            *keys, F.col("first").cast("long").alias("start"),
            (F.col("last") + K).cast("long").alias("end"), F.lit(1.0).alias("cover"),
        )
    )
    # Diagonals at most GAP apart belong together.  Words that occur twice in a template
    # also vote for far diagonals, which stay on their own and are not covered.
    row = Window.partitionBy("__doc", "__text", "template").orderBy("diagonal", "at")
    far = F.when(F.col("diagonal") - F.lag("diagonal").over(row) <= GAP, 0).otherwise(1)
    grouped = (
        hits.where("not base").withColumn("diagonal", diagonal)
        .withColumn("far", far).withColumn("group", F.sum("far").over(row))
    )
    enough = (F.col("covered") >= F.col("size") * COVER) & (F.col("decided") == F.col("n_deciding"))
    whole = [*keys, "group", "size", "n_deciding"]
    passed = (
        grouped.groupBy(*whole).agg(covered.alias("covered"), decided.alias("decided")).where(enough)
        .select("__doc", "__text", "template", "group", "covered")
    )
    claim = F.struct("covered", (-F.col("template")).alias("t"), (-F.col("group")).alias("g"))
    word = Window.partitionBy("__doc", "__text", "at")
    own = (
        grouped.join(passed, ["__doc", "__text", "template", "group"])
        .withColumn("claim", claim).withColumn("best", F.max("claim").over(word))
        .where(F.col("claim") == F.col("best"))
    )
    merged = (
        own.groupBy(*whole)
        .agg(
            covered.alias("covered"), decided.alias("decided"),
            F.min("at").cast("long").alias("start"), (F.max("at") + K).cast("long").alias("end"),
        )
        .where(enough)
        .select(*keys, "start", "end", (F.col("covered") / F.col("size")).alias("cover"))
    )
    return base.unionByName(merged)


def find_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keyed = docs.drop(*own).withColumn(
        "__doc", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    ).withColumn("__text", text_key(F.col("text")))
    hits = stage(votes(keyed, template_places(docs.sparkSession)), "license-hits")
    names = lambda only: F.array_join(F.array_sort(F.collect_set(only)), ",")
    facts = (
        spans(hits)
        .groupBy("__doc", "__text")
        .agg(
            F.count(F.when(F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
            names(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            names(F.col("label")).alias("labels"),
            F.max("cover").alias("score"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        keyed.withColumn("n_words", count_words(F.col("text")))
        .join(facts, ["__doc", "__text"], "left")
        .withColumn("n_base", F.coalesce("n_base", zero))
        .withColumn("base_labels", F.coalesce("base_labels", F.lit("")))
        .withColumn("labels", F.coalesce("labels", F.lit("")))
        .withColumn("score", F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)))
        .drop("__doc", "__text")
    )


def licensed_documents(docs: DataFrame) -> DataFrame:
    return find_licenses(docs.select("doc_id", "text")).drop("text")
