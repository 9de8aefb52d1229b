"""Licence templates in blocks of text, by an exact set-similarity join with prefix, length and positional filters.

All expressions are Spark's own. Texts are read once; what goes on are the places of the
templates' words. Line ends mean nothing, so a wrapped notice is like any other. A template
has a reach: the least power of two (8 or more) that is at least twice its number of words.
Blocks are runs of twice the reach, one beginning at each multiple of it, so every run of
words as long as the reach lies in a block whole. A block meets a template if it holds the
share ``threshold`` of the template's words; templates leave out the words of ``COMMON``,
so a notice may lack or change those.

Words are put in one global order, from rare to frequent in the corpus. A block that holds
o of a template's t words must hold one of the template's t - o + 1 rarest (prefix filter),
have o words (length filter), and, from the word where it first meets the template, both
must have o words left in the order (positional filter). What passes is counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words that templates leave out.
COMMON = "a an and are as at be in is it of on or that the this to under was with you"
#: What names a licence in a line, by label. All these words are needed.
NAMES = {
    "apache-notice": "apache license 2 0",
    "mit-notice": "mit license",
    "bsd-notice": "bsd license",
    "gpl-notice": "gnu general public license",
    "lgpl-notice": "gnu lesser general public license",
    "mpl-notice": "mozilla public license",
    "cc-by-notice": "cc by 4 0",
    "cc-by-nc-notice": "cc by nc 4 0",
    "cc-by-sa-notice": "creative commons attribution sharealike",
    "cc0-notice": "cc0 public domain",
    "reserved-notice": "copyright all rights reserved",
}
#: Wordings of public licences and their notices, by label. A word counts once, and a tenth of them may be missing.
PARAGRAPHS = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    " subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain"
    " the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice"
    " appear in all copies",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by"
    " applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    " see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"
    " of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"
    " or fitness for a particular purpose see the gnu general public license for more details",
    "mpl-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by-deed": "you are free to share copy and redistribute the material in any medium or format adapt remix transform and build upon the material for any purpose even commercially under the following terms"
    " attribution you must give appropriate credit provide a link to the license and indicate if changes were made",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or"
    " as a compiled binary for any purpose commercial or non commercial and by any means",
}
TEMPLATES = NAMES | {label: " ".join(w for w in text.split() if w not in COMMON.split()) for label, text in PARAGRAPHS.items()}
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def reach_of(words: int) -> int:
    """How many running words a template of so many may be spread over, at least."""
    return max(8, 1 << (2 * words - 1).bit_length())


def _places(hits: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively, from the places (i, w) of words that all phrases' words are among."""
    ws = phrase.split()

    def here(x: Column, j: Column) -> Column:
        ok = x["w"] == ws[0]
        for k, w in enumerate(ws[1:], 1):
            after = F.get(hits, (j + k).cast("int"))
            ok = ok & F.coalesce((after["w"] == w) & (after["i"] == x["i"] + k), F.lit(False))
        return F.when(ok, x["i"].cast("long"))

    return F.filter(F.transform(hits, here), lambda i: i.isNotNull())


def license_scan(docs: DataFrame, threshold: float = 0.9, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Licence labels of each row of docs (doc_id, text; other columns are ignored).

    A-Z are lower-cased; words are runs of letters, digits and characters beyond ASCII.
    Returns doc_id, n_words, n_base, first_word and last_word (places of the phrases),
    base_labels and labels (with those of the templates; comma-joined), and score: 1 with a
    phrase, else the largest share of a template that any block holds, or 0 if none reaches
    ``threshold``.

    A null text counts as empty and has no labels. Rows are judged by their own text (equal
    64-bit hashes count as equal texts), so repeated and missing ids do no harm. An empty
    table gives an empty result. A text's words are one array of its row, so a text must
    stay well below the 2 GB that a row may have.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sets = {k: sorted(set(v.split())) for k, v in templates.items()}
    vocabulary = sorted({w for ws in sets.values() for w in ws} | {w for p in PHRASES for w in p.split()})
    # 1. The one pass over texts: number of words, and the places of those that matter.
    words = F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN), "")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), words.alias("_words"))
    known = F.array(*map(F.lit, vocabulary))
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    none = F.array().cast("array<struct<i: int, w: string>>")
    hits = F.when(F.arrays_overlap("_words", known), hits).otherwise(none)
    facts = scratch.table(read.select("doc_id", "t", F.size("_words").cast("long").alias("n_words"), hits.alias("hits")))
    # 2. How many documents hold each word, hence the order and each template's prefix.
    held = facts.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in held.collect()}  # at most a row for each of the templates' words
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    need = {k: math.ceil(threshold * len(ws) - 1e-9) for k, ws in sets.items()}
    ordered = {k: sorted(ws, key=rank.__getitem__) for k, ws in sets.items()}
    prefix = [(w, k, i, len(ws), need[k], reach_of(len(ws))) for k, ws in ordered.items() for i, w in enumerate(ws[: len(ws) - need[k] + 1])]
    postings = docs.sparkSession.createDataFrame(prefix, "w string, label string, at int, size int, need int, reach int")  # at most the templates' words
    # 3. Blocks around the words of a prefix, with their other words in the global order.
    first = sorted({p[0] for p in prefix})
    some = facts.filter(F.exists("hits", lambda x: x["w"].isin(first)))
    reaches = sorted({p[-1] for p in prefix})
    spots = some.select("doc_id", "t", F.explode("hits").alias("x")).select("doc_id", "t", "x.i", "x.w", F.explode(F.array(*map(F.lit, reaches))).alias("reach"))
    block = F.explode(F.array_compact(F.array(F.floor(F.col("i") / F.col("reach")), F.when(F.col("i") >= F.col("reach"), F.floor(F.col("i") / F.col("reach")) - 1))))
    spots = spots.select("doc_id", "t", "w", "reach", block.alias("block"))
    key = F.create_map(*(x for w in vocabulary for x in (F.lit(w), F.lit(rank[w]))))
    own = F.array_sort(F.transform(F.collect_set("w"), lambda w: F.struct(key[w].alias("r"), w.alias("w"))))
    blocks = spots.groupBy("doc_id", "t", "reach", "block").agg(own.alias("own")).filter(F.exists("own", lambda x: x["w"].isin(first)))
    met = blocks.select("doc_id", "t", "reach", F.col("own.w").alias("own"), F.posexplode("own.w").alias("j", "w")).join(F.broadcast(postings), ["w", "reach"])
    left = F.least(F.col("size") - F.col("at"), F.size("own") - F.col("j"))
    met = met.filter((F.size("own") >= F.col("need")) & (left >= F.col("need")))
    words_of = F.create_map(*(x for k, ws in ordered.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))))
    share = F.size(F.array_intersect("own", words_of[F.col("label")]))
    found = met.withColumn("n", share).filter("n >= need").groupBy("doc_id", "t").agg(F.collect_set("label").alias("found"), F.max(F.col("n") / F.col("size")).alias("best"))
    found = scratch.table(found.withColumnsRenamed({"doc_id": "_d", "t": "_t"}))
    # 4. The phrases, and all of it together.
    out = facts.withColumns({f"_p{i}": _places(F.col("hits"), p) for i, p in enumerate(PHRASES)})
    all_places = F.concat(*(F.col(f"_p{i}") for i in range(len(PHRASES))))
    names = F.array_compact(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(v)) for i, v in enumerate(PHRASES.values()))))
    out = out.select("doc_id", "t", "n_words", F.size(all_places).cast("long").alias("n_base"), F.array_min(all_places).alias("first_word"), F.array_max(all_places).alias("last_word"), names.alias("_base"))
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    joined = F.array_sort(F.array_union("_base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(joined, ",").alias("labels"), score.alias("score"))
