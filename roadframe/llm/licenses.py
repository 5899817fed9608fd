"""License scans by diagonal voting.

Every rolling k-gram of words of every text is joined with the places of that k-gram in the templates. A hit at word i of
a text and word t of a template is a vote for the diagonal i - t, on which a copy of the template stands. Votes are
counted per diagonal, neighbouring diagonals (words added or left out) are merged into spans, and a span is
verified by the share of the template's words that it holds and by its length. The join compares the words of a k-gram
beside its hash, so votes are exact, and spans need no second look at the texts.

Defined results: null and empty texts have no words and no labels; a text of fewer than K words has no k-gram; repeated
rows give one row each; overlapping places all count; rows without a doc_id are treated like others; further columns
are ignored; an empty table gives no rows. A text must fit a task, and its votes need not.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays as A
from .session import cut, text_rows

#: Words of a k-gram: those of the shortest phrase.
K = 3
#: The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Opening or granting sentences of common licenses, in words of the scanned class, with the labels they stand for.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2",
    "licensed under the apache license 2 0": "apache-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "mozilla public license version 2": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
}
#: Templates of fewer words must stand whole; of longer ones this share suffices, in a span this many times as long.
WHOLE_BELOW, LEAST_SHARE, LONGEST_SPAN = 20, 0.8, 1.25
#: Diagonals so many words apart are merged, and at most a quarter of the template.
BAND = 8
#: Template places up to this number are sent to all tasks; more are joined like any table.
SENT_PLACES = 100_000
#: The template that every text matches once, so that texts without votes stay.
EVERY = -1

_GRAMS = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("n_words", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("gram", pa.string())])
GRAMS_DDL = "doc_id long, own long, n_words long, at long, h long, gram string"


def word_array(texts: A.Texts, words: A.Words) -> pa.Array:
    """The words of a chunk as strings."""
    ends = np.append(0, np.cumsum(words.end - words.start))
    data = texts.buf[A.covered_runs(words.start, words.end - words.start)]
    return pa.Array.from_buffers(pa.large_string(), words.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def rolling(column: pa.Array) -> tuple[A.Words, np.ndarray, np.ndarray, pa.Array]:
    """(words, first word, hash and words of every k-gram) of a column of texts, lower-cased."""
    raw = A.Texts.of(column)
    texts = A.Texts(A.LOWER[raw.buf], raw.off)
    words = A.Words(texts, A.ALNUM)
    at, h = A.windows(A.prints(texts, words.start, words.end), words.doc, K)
    each = word_array(texts, words)
    parts = [each.slice(j, max(0, words.n - K + 1)) for j in range(K)]
    grams = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).take(pa.array(at)) if len(at) else pa.array([], pa.large_string())
    return words, at, h, grams


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each k-gram, and one for the text itself with an empty k-gram."""
    for b in A.chunks(batches):
        words, at, h, grams = rolling(b.column("text"))
        doc = words.doc[at]
        key = pa.array(np.concatenate([np.arange(b.num_rows), doc]))
        yield A.batch(
            _GRAMS,
            b.column("doc_id").take(key),
            b.column("own").take(key),
            pa.array(np.concatenate([words.counts, np.zeros(len(at), dtype=np.int64)])),
            np.concatenate([np.zeros(b.num_rows, dtype=np.int64), at - words.first[doc]]),
            np.concatenate([np.zeros(b.num_rows, dtype=np.uint64), h]).view(np.int64),
            pa.concat_arrays([pa.repeat("", b.num_rows), grams.cast(pa.string())]),
        )


def template_places(spark: SparkSession, phrases: Mapping[str, str], templates: Mapping[str, str]) -> tuple[DataFrame, int]:
    """(template, label, base, words, t, h, gram: each k-gram of each template, their number). A template of fewer than K words is refused."""
    texts, labels = [*phrases, *templates], [*phrases.values(), *templates.values()]
    words, at, h, grams = rolling(pa.array(texts, pa.string()))
    if min(words.counts, default=K) < K:
        raise ValueError(f"a template has at least {K} words")
    rows = [(EVERY, None, False, 0, 0, 0, "")]
    for place, code, gram in zip(at.tolist(), h.view(np.int64).tolist(), grams.to_pylist(), strict=True):
        i = int(words.doc[place])
        rows.append((i, labels[i], i < len(phrases), int(words.counts[i]), place - int(words.first[i]), code, gram))
    return spark.createDataFrame(rows, "template int, label string, base boolean, words int, t int, h long, gram string"), len(rows)


def votes(docs: DataFrame, phrases: Mapping[str, str], templates: Mapping[str, str]) -> DataFrame:
    """doc_id, own (hash of the text), template, label, base, words, diagonal, n_words, copies, ts: the places of the template that a diagonal has votes for.

    Rows that agree in doc_id and text vote together; copies counts them, in the row of template EVERY.
    """
    rows = text_rows(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    grams = rows.withColumn("own", F.xxhash64("text")).select("doc_id", "own", "text").mapInArrow(_gram_rows, GRAMS_DDL)
    places, n = template_places(docs.sparkSession, phrases, templates)
    hits = grams.join(F.broadcast(places) if n <= SENT_PLACES else places, ["h", "gram"])
    return hits.groupBy("doc_id", "own", "template", "label", "base", "words", (F.col("at") - F.col("t")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.count("*").alias("copies"), F.array_sort(F.collect_set("t")).alias("ts")
    )


def _covered(ts):
    """How many template words the k-grams at the ascending places ts hold."""
    gaps = F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts)), lambda a, b: F.least(b - a, F.lit(K)))
    return F.aggregate(gaps, F.lit(K), lambda x, y: x + y)


def spans(voted: DataFrame) -> DataFrame:
    """doc_id, own, template, label, base, words, start, end, share: merged spans of templates with votes; end is exclusive, share what they hold of the template."""
    each = voted.filter(F.col("template") != EVERY).select(
        "doc_id", "own", "template", "label", "base", "words", "diagonal", "ts", (F.col("diagonal") + F.array_min("ts")).alias("from"), (F.col("diagonal") + F.array_max("ts") + K).alias("to"), (_covered(F.col("ts")) / F.col("words")).alias("alone")
    )
    keys = ["doc_id", "own", "template", "label", "base", "words"]
    line = Window.partitionBy(*keys).orderBy("diagonal")
    # a phrase stands on one diagonal, whole
    band = F.when(F.col("base"), F.lit(0)).otherwise(F.least(F.lit(BAND), F.floor(F.col("words") / 4)))
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > band
    numbered = each.withColumn("chain", F.sum(F.when(apart, 1).otherwise(0)).over(line))
    merged = numbered.groupBy(*keys, "chain").agg(F.min("from").alias("start"), F.max("to").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ts")))).alias("ts"), F.max("alone").alias("alone"))
    short = F.col("end") - F.col("start") <= LONGEST_SPAN * F.col("words")
    share = F.greatest("alone", F.when(short, _covered(F.col("ts")) / F.col("words")).otherwise(F.lit(0.0)))
    return merged.select(*keys, "start", "end", share.alias("share"))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (label, start, end, share of every verified span, by start) and score, the best share of any span, for every row."""
    # a row per text and diagonal: the k-grams are made once
    voted = cut(votes(docs, phrases, templates))
    found = spans(voted)
    needed = F.when(F.col("base") | (F.col("words") < WHOLE_BELOW), F.lit(1.0)).otherwise(F.lit(LEAST_SHARE))
    place = F.when(F.col("share") >= needed, F.struct("start", "label", "end", "base", "share"))
    # null fields of an every-row keep it apart from spans
    every = voted.filter(F.col("template") == EVERY).select("doc_id", "own", "n_words", "copies", F.lit(None).cast("struct<start:long,label:string,end:long,base:boolean,share:double>").alias("place"), F.lit(0.0).alias("share"))
    each = found.select("doc_id", "own", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("copies"), place.alias("place"), "share")
    joined = every.unionByName(each).groupBy("doc_id", "own").agg(F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.array_sort(F.collect_list("place")).alias("places"), F.max("share").alias("score"))
    return joined.select("doc_id", "n_words", "places", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score")
