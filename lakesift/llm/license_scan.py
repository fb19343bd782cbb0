"""License scans by diagonal voting.

Word k-grams of every text, as rolling hashes, are joined in Spark with the
positions of the templates' k-grams.  A hit votes for the diagonal (offset of
document position and template position); votes are counted for each
(document, template, diagonal).  Words that are inserted or dropped shift the
offset, so diagonals of a template that follow one another in the text, with a
gap of a share of the template's words at most, form one run, however far their
offsets differ.  Runs that have enough of a template are verified word by word
over their whole span.

Base labels are exact phrases.  The texts are passed once: what is written are
the figures and the grams whose low hash bits occur in a template.  The
templates' table is a constant of bounded size, so it is broadcast; only hits
are shuffled, partially aggregated.

Edge cases: null, blank and short texts have no words or hits; repeated rows
are scanned alike (votes count distinct template positions, so they don't add
up); null ids are kept; very long texts are handled in bounded chunks; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import byte_map, gram_hashes, on_workers, runs, small_side, staged, word_hashes

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Texts by which licences are granted (notices and headers), and their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the "
            "GNU General Public License as published by the Free Software Foundation, either version"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the "
             "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted "
                    "in any form or by any means"),
)

#: Words of a gram, share of a template that counts, and the gap within a run: a
#: share of the template's words.
GRAM = 3
MIN_SHARE = 0.8
GAP_SHARE = 0.35
#: Low bits of a hash that grams are held against before they leave a worker.
SIEVE = 0xFFFF

#: Words: letters a-z (A-Z folded), digits and everything outside ASCII.
WORDS = byte_map([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
CHUNK_BYTES = 1 << 20


def _words(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


def _gap(template: list[bytes]) -> int:
    """Words between two parts of a run of a template, at most."""
    return max(GRAM, int(GAP_SHARE * len(template)))


def base_places(words: list[bytes], phrases=PHRASES) -> tuple[int, int | None, int | None, list[str]]:
    """Count, first and last start, and labels of the exact phrases."""
    joined = b" " + b" ".join(words) + b" "
    starts, labels = [], set()
    for phrase, label in phrases:
        needle, at = b" " + phrase.encode() + b" ", -1
        while (at := joined.find(needle, at + 1)) >= 0:
            starts.append(joined.count(b" ", 0, at))
            labels.add(label)
    return len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def template_grams(templates=TEMPLATES) -> list[tuple[int, int, int]]:
    """(t, p, h): template number, position and hash of each gram."""
    rows = []
    for t, (_, text) in enumerate(templates):
        words, offsets = word_hashes([text.encode().translate(WORDS)])
        grams, _ = gram_hashes(words, offsets, GRAM)
        rows += [(t, p, int(h)) for p, h in enumerate(grams[: max(0, len(words) - GRAM + 1)].view(np.int64))]
    return rows


def _row_key(id_col: str, text_col: str):
    """Rows with equal keys are equal rows and have equal results."""
    return F.sha2(F.to_json(F.struct(F.col(id_col).alias("i"), F.col(text_col).alias("t"))), 256)


def rolling(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(key, id, base figures, grams) of docs (key, id, text); ``grams`` are the
    (pos, h) that pass the sieve."""
    kind = docs.schema["id"].dataType.simpleString()
    sieve = np.zeros(SIEVE + 1, bool)
    sieve[[h & SIEVE for _, _, h in template_grams(templates)]] = True

    def run(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode().translate(WORDS) for t in batch.column(2)]
            for a, b in runs(texts, CHUNK_BYTES):
                base = [base_places(t.split(), phrases) for t in texts[a:b]]
                words, offsets = word_hashes(texts[a:b])
                grams, spans = gram_hashes(words, offsets, GRAM)
                grams = grams.view(np.int64)
                hit = np.flatnonzero(sieve[grams & SIEVE])
                doc = np.searchsorted(spans[:, 0], hit, "right") - 1
                # of texts that start at one place, only the last has words there
                inside = hit < spans[doc, 1]
                hit, doc = hit[inside], doc[inside]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(hit - spans[doc, 0]), pa.array(grams[hit])], ["pos", "h"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                    pa.array(np.diff(offsets), pa.int64()), pa.array([x[0] for x in base], pa.int64()),
                    pa.array([x[1] for x in base], pa.int64()), pa.array([x[2] for x in base], pa.int64()),
                    pa.array([x[3] for x in base], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(ends), found),
                ], ["key", "id", "n_words", "n_base", "first_word", "last_word", "base", "grams"])

    return docs.mapInArrow(run, f"key string, id {kind}, n_words bigint, n_base bigint, first_word bigint, "
                                "last_word bigint, base array<string>, grams array<struct<pos:bigint,h:bigint>>")


def candidate_spans(rows: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Runs of diagonals with enough votes: (key, t, start, stop) in words."""
    spark = rows.sparkSession
    sizes = F.broadcast(spark.createDataFrame([
        (t, len(_words(text)), _gap(_words(text))) for t, (_, text) in enumerate(templates)], "t int, words int, gap int"))
    grams = rows.select("key", F.inline("grams"))
    hits = grams.join(F.broadcast(spark.createDataFrame(template_grams(templates), "t int, p int, h bigint")), "h")
    votes = hits.select("key", "t", "p", "pos", (F.col("pos") - F.col("p")).alias("diagonal")).distinct()
    diagonals = votes.groupBy("key", "t", "diagonal").agg(
        F.collect_set("p").alias("ps"), F.min("pos").alias("low"), F.max("pos").alias("high")).join(sizes, "t")
    # diagonals that follow one another in the text form one run
    by = Window.partitionBy("key", "t").orderBy("low", "diagonal")
    so_far = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("low") - so_far - GRAM > F.col("gap")).cast("int")
    merged = diagonals.withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(by)).groupBy("key", "t", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("votes"), F.first("words").alias("words"),
        F.min("low").alias("start"), (F.max("high") + GRAM).alias("stop"))
    # a changed word takes at most GRAM votes, so half the share is asked for here
    enough = F.col("votes") >= F.greatest(F.lit(1), (F.col("words") - GRAM + 1) * MIN_SHARE / 2)
    return merged.where(enough).select("key", "t", "start", "stop")


def _best(spans: list[dict]) -> list[dict]:
    """Of overlapping spans the best, then the longest, then the first label."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: (-x["score"], x["start"] - x["stop"], x["label"], x["start"])):
        if all(s["stop"] <= o["start"] or o["stop"] <= s["start"] for o in out):
            out.append(s)
    return out


def _windows(start: int, stop: int, size: int) -> list[tuple[int, int]]:
    """A span as it is, or, if repeats of a template run together in it,
    overlapping windows of two template lengths."""
    if 2 * (stop - start) <= 3 * size:
        return [(start, stop)]
    return [(a, min(a + 2 * size, stop)) for a in range(start, stop, size)]


def verified(docs: DataFrame, spans: DataFrame, n_spans: int, templates=TEMPLATES) -> DataFrame:
    """(key, spans): for docs with candidates, those that hold on the words, as
    (label, start, stop, score)."""

    def run(batches):
        wanted = [_words(text) for _, text in templates]
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                words, kept = _words(text.as_py() or ""), []
                for c in found:
                    template = wanted[c["t"]]
                    for start, stop in _windows(c["start"], c["stop"], len(template)):
                        # words near the ends that no whole gram holds
                        start, stop = max(0, start - _gap(template)), stop + _gap(template)
                        match = SequenceMatcher(None, template, words[start:stop], autojunk=False).get_matching_blocks()
                        match = [m for m in match if m.size]
                        score = sum(m.size for m in match) / len(template)
                        if score >= MIN_SHARE:
                            span = {"label": templates[c["t"]][0], "start": start + match[0].b,
                                    "stop": start + match[-1].b + match[-1].size, "score": round(score, 6)}
                            if span not in kept:
                                kept.append(span)
                out.append(sorted(_best(kept), key=lambda x: (x["start"], x["stop"], x["label"], x["score"])))
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["key", "spans"])

    of_doc = spans.groupBy("key").agg(F.collect_list(F.struct("t", "start", "stop")).alias("found"))
    joined = docs.join(small_side(of_doc, n_spans, 200), "key").select("key", "text", "found").dropDuplicates(["key"])
    return joined.mapInArrow(run, "key string, spans array<struct<label:string,start:bigint,stop:bigint,score:double>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` and the verified ``spans``."""
    spark = docs.sparkSession
    on_workers(spark)
    keyed = docs.select(_row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = staged(rolling(keyed), "license-rows")
    spans = staged(candidate_spans(rows), "license-spans")
    n_spans = spans.count()
    good = staged(verified(keyed, spans, n_spans), "license-verified")
    side = small_side(good, good.count(), 400)
    out = rows.drop("grams").join(side, "key", "left")
    own = F.coalesce(F.transform("spans", lambda s: s["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        join(F.col("base")).alias("base_labels"), join(F.concat("base", own)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<label:string,start:bigint,stop:bigint,score:double>>")).alias("spans"))
