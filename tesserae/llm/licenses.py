"""License notices in texts, by diagonal voting against templates.

1. Every text is cut into words; the rolling hashes of GRAM words at each position join the positions of the same hashes in
   the templates (equality join).
2. A match at word i of the text and word j of the template votes for the diagonal i - j. Votes are counted per document,
   template and diagonal; diagonals that lie within the template's number of allowed edits of each other are taken together,
   and those with enough votes are candidates: an edit destroys at most GRAM votes and moves what follows by one diagonal at
   most, so that no notice within the allowed edits is lost.
3. The words around each candidate are compared with the template's own words: the least number of word edits between the
   template and any stretch of them decides.

Templates of the base are exact: no edits, and every place counts. Notices allow an edit per five words. Where the best
places of two notices overlap, only the better one's label counts.

Cases: null and empty texts have no words and no labels; several notices in a text all count; rows with the same or a null
doc_id are told apart by a hash of their text, and equal rows get equal results; very long texts are cut into words a text
at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import NO_ID, Prefix, chunks, mix, stage

GRAM = 3
#: Most positions of all templates, so that they can be sent to every task.
POSITIONS = 100_000
#: Phrases of the base and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: The notices that the licenses themselves ask for, and common short forms.
NOTICES = [
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
]
#: The bytes of words: digits, letters and all that is not ASCII; A-Z count as lower case.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20 for c in range(256)).lower()
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_GRAMS = "doc_id long, tkey long, words array<string>, grams array<long>"
_PLACES = "doc_id long, tkey long, template int, first int, last int, edits int"


def split(text: str | bytes) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(_WORDS).split()


def edits_allowed(m: int) -> int:
    """An edit per five words, and few enough that a notice with so many still has a vote."""
    return max(0, min(m // 5, (m - GRAM) // GRAM))


def word_grams(words: list[bytes]) -> np.ndarray:
    """Hashes of the runs of GRAM words."""
    if len(words) < GRAM:
        return np.zeros(0, np.int64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    return mix(Prefix(data).span(start[: len(words) - GRAM + 1], end[GRAM - 1 :])).view(np.int64)


def templates(base: list | None = None, notices: list | None = None) -> list[tuple[str, list[bytes], int]]:
    """(label, words, allowed edits) of all templates, those of the base first; -1 stands for exact."""
    out = [(label, split(text), -1) for label, text in (BASE if base is None else base)]
    out += [(label, split(text), edits_allowed(len(split(text)))) for label, text in (NOTICES if notices is None else notices)]
    if any(len(w) < GRAM for _, w, _ in out):
        raise ValueError(f"templates need {GRAM} words or more")
    if sum(len(w) for _, w, _ in out) > POSITIONS:
        raise ValueError(f"the templates have more than {POSITIONS} words")
    return out


def document_grams(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, its words and the hashes of their runs; texts of fewer words are left out."""

    def run(batches):
        for batch in batches:
            for keys, texts in chunks(list(zip(batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist(), strict=True)), batch.column("text").to_pylist(), 1 << 20):
                words = [split(t) for t in texts]
                grams = [word_grams(w) for w in words]
                keep = [k for k in range(len(words)) if len(grams[k])]
                ids, tkeys = ([keys[k][i] for k in keep] for i in (0, 1))
                offsets = np.cumsum([0, *(len(grams[k]) for k in keep)]).astype(np.int32)
                flat = pa.array(np.concatenate([grams[k] for k in keep]) if keep else np.zeros(0, np.int64))
                listed = pa.ListArray.from_arrays(np.cumsum([0, *(len(words[k]) for k in keep)]).astype(np.int32), pa.array([w for k in keep for w in words[k]], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tkeys, pa.int64()), listed, pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "tkey", "words", "grams"])

    return docs.select("doc_id", "tkey", "text").mapInArrow(run, _GRAMS)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.crc32(text)).alias("tkey"), text.alias("text"))


def candidates(docs: DataFrame, known: list) -> DataFrame:
    """doc_id, tkey, template, diagonal and the words around it (which begin at word `at`) where votes are enough."""
    rows = [(k, j, int(g)) for k, (_, words, _) in enumerate(known) for j, g in enumerate(word_grams(words).tolist())]
    spark = docs.sparkSession
    positions = F.broadcast(spark.createDataFrame(rows, "template int, j int, gram long"))  # at most POSITIONS rows
    sizes = [(k, len(words), max(0, e), len(words) - GRAM + 1 - GRAM * max(0, e)) for k, (_, words, e) in enumerate(known)]
    size = F.broadcast(spark.createDataFrame(sizes, "template int, m int, e int, least int"))
    long = document_grams(docs).select("doc_id", "tkey", "words", F.posexplode("grams").alias("i", "gram"))
    votes = long.join(positions, "gram").join(size, "template").withColumn("diagonal", F.col("i") - F.col("j"))
    at = F.greatest(F.col("diagonal") - F.col("e"), F.lit(0))
    around = F.slice("words", at + 1, F.col("m") + 2 * F.col("e") + F.least(F.col("diagonal") - F.col("e"), F.lit(0)))
    votes = votes.select("doc_id", "tkey", "template", "diagonal", "e", "least", "j", at.alias("at"), around.alias("around"))
    keys = ["doc_id", "tkey", "template"]
    counted = votes.groupBy(*keys, "diagonal", "e", "least").agg(F.count_distinct("j").alias("n"), F.first("at").alias("at"), F.first("around").alias("around"))
    # exact templates look at their own diagonal alone
    widest = max(e for _, _, e, _ in sizes)
    band = Window.partitionBy(*keys).orderBy("diagonal").rangeBetween(-widest, widest)
    near = F.aggregate(F.filter(F.collect_list(F.struct("diagonal", "n")).over(band), lambda v: F.abs(v["diagonal"] - F.col("diagonal")) <= F.col("e")), F.lit(0).cast("long"), lambda a, v: a + v["n"])
    return counted.withColumn("near", near).where(F.col("near") >= F.col("least")).select(*keys, "diagonal", "at", "around")


def closest(template: list[bytes], words: list[bytes]) -> tuple[int, int, int]:
    """(edits, first, last + 1) of the stretch of words that is closest to the template: of equal ones the one that ends
    first, and of these the shortest."""
    edits, first = [0] * (len(words) + 1), list(range(len(words) + 1))
    for k, t in enumerate(template, 1):
        left, left_first = edits[0], first[0]
        edits[0] = k
        for j, w in enumerate(words, 1):
            up, up_first = edits[j], first[j]
            best = min((left + (t != w), -left_first), (up + 1, -up_first), (edits[j - 1] + 1, -first[j - 1]))
            left, left_first = up, up_first
            edits[j], first[j] = best[0], -best[1]
    end = min(range(len(edits)), key=lambda j: (edits[j], j))
    return edits[end], first[end], end


def verified(candidates: DataFrame, known: list) -> DataFrame:
    """doc_id, tkey, template, first, last, edits: the places where words are the template's, within its edits."""

    def run(batches):
        for pdf in batches:
            out = []
            for d, h, t, at, around in zip(pdf["doc_id"], pdf["tkey"], pdf["template"], pdf["at"], pdf["around"], strict=True):
                _, words, most = known[t]
                edits, a, b = closest(words, [w.encode() for w in around])
                if edits <= max(0, most):
                    out.append((d, h, t, at + a, at + b - 1, edits))
            got = pd.DataFrame(out, columns=["doc_id", "tkey", "template", "first", "last", "edits"])
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    return candidates.drop("diagonal").mapInPandas(run, _PLACES).distinct()


def places(docs: DataFrame, known: list) -> DataFrame:
    return verified(candidates(keyed(docs), known), known)


def scan(docs: DataFrame, base: list | None = None, notices: list | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    score: 1 where a base phrase stands, else 1 less the share of edited words of the closest notice; 0 without any.
    """
    known = templates(base, notices)
    about = F.broadcast(docs.sparkSession.createDataFrame([(k, label, len(words), most < 0) for k, (label, words, most) in enumerate(known)], "template int, label string, m int, of_base boolean"))
    found = places(docs, known).join(about, "template").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = stage(found.withColumn("share", 1 - F.col("edits") / F.col("m")), "licenses-places")
    keys = ["doc_id", "tkey"]
    at_base = found.where("of_base").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_base"), F.min("first").cast("long").alias("first_word"), F.max("first").cast("long").alias("last_word"), F.collect_set("label").alias("base"))
    # each notice's best place; one that a better notice overlaps does not count
    best = found.where("NOT of_base").groupBy(*keys, "template", "label").agg(F.min(F.struct("edits", "last", (-F.col("first")).alias("back"), "first", "share")).alias("p"))
    listed = best.groupBy(*keys).agg(F.collect_list(F.struct("label", F.col("p.first").alias("first"), F.col("p.last").alias("last"), F.col("p.share").alias("share"))).alias("ps"))
    better = lambda p: F.exists("ps", lambda q: (q["share"] > p["share"]) & (q["first"] <= p["last"]) & (q["last"] >= p["first"]))
    notice = listed.select(*keys, F.transform(F.filter("ps", lambda p: ~better(p)), lambda p: p["label"]).alias("more"), F.array_max(F.transform("ps", lambda p: p["share"])).alias("share"))
    every = keyed(docs).withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long")).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "doc_id", "tkey", "n_words").toDF("doc_id", "given", "tkey", "n_words")
    out = every.join(at_base, keys, "left").join(notice, keys, "left")
    none = F.array().cast("array<string>")
    text = lambda a: F.array_join(F.array_sort(a), ",")
    base_set = F.coalesce("base", none)
    return out.select(
        F.col("given").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", text(base_set).alias("base_labels"),
        text(F.array_union(base_set, F.coalesce("more", none))).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
