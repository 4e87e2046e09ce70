"""License scan by diagonal voting.

Every rolling word k-gram of every text is joined to the k-gram positions of the templates. A hit at
word i of the text and word j of a template votes for the diagonal i - j. Votes are summed by
(document, template, diagonal) before they move; a diagonal has each position of the template once at most. Neighbouring
diagonals are merged, so that a few inserted or lost words don't split a place. What is merged is verified: each
diagonal must go on in the text behind the one before, with template positions that all come later, so that a place is
of distinct positions in their order; where one isn't, a new place begins. A place counts if the positions that it
covers reach the template's share. The short base phrases are templates that must be covered wholly
on one diagonal; longer license notices give the method's own labels.

The templates are a fixed table of some hundred k-grams, so the join is a broadcast one. A place is a row of its own, so
a text of any length with any number of places is sorted, not collected.
Defined cases: a null or wordless text has no words and no places; texts of fewer than k words have no
k-grams; rows are told apart by a row number, so repeated rows and null ids each give their own row; an
empty table gives an empty one; other columns of docs, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents
from .kernels import LETTERS, LOWER_VALUES, chunks, grams, valid, words

K_PHRASE, K_NOTICE = 2, 3
#: Label and phrase. These must stand whole.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Label and the opening of a license notice. These count from NOTICE_SHARE of their k-grams on.
NOTICES = (
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
NOTICE_SHARE = 0.6
#: Diagonals that are one place if they are so near each other.
NEIGHBOUR = 3


def _hashes(text: str, k: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    w = words(np.array([0, len(data)]), data, LETTERS, LOWER_VALUES)
    return grams(w.hashes(), k)


def template_table(spark: SparkSession, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """gram, template, label, kind, j (position), need (k-grams that must be there), size (k-grams of the template)."""
    rows = []
    for kind, k, items in (("base", K_PHRASE, phrases), ("notice", K_NOTICE, notices)):
        for i, (label, text) in enumerate(items):
            h = _hashes(text, k).astype(np.int64)
            need = len(h) if kind == "base" else max(1, int(np.ceil(NOTICE_SHARE * len(h))))
            rows += [(int(x), f"{kind}{i}", label, kind, j, need, len(h)) for j, x in enumerate(h)]
    return spark.createDataFrame(rows, "gram long, template string, label string, kind string, j int, need int, size int")


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text: its number of words, and the hashes of its 2-grams, then its 3-grams."""
    for batch in batches:
        for lo, hi, offs, data in chunks(batch.column(2)):
            w = words(offs, data, LETTERS, LOWER_VALUES)
            h = w.hashes()
            parts, sizes = [], []
            for k in (K_PHRASE, K_NOTICE):
                g, ok = grams(h, k), valid(w.doc, k)
                parts.append(g[ok])
                sizes.append(np.maximum(0, w.count - k + 1))
            total = sizes[0] + sizes[1]
            ends = np.concatenate(([0], np.cumsum(total)))
            both = np.empty(ends[-1], np.uint64)
            for i, (g, n) in enumerate(zip(parts, sizes, strict=True)):
                start = ends[:-1] + (sizes[0] if i else 0)
                both[np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(g))] = g
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(both.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(w.count), lists], names=["row", "doc_id", "n_words", "grams"])


PLACE = ("row", "doc_id", "n_words", "template", "label", "kind", "need", "size")


def scan(docs: DataFrame, phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """A row for each place: row, doc_id, n_words, template, label, kind, start and end (words), covered, size. Rows of docs without
    any have one with label null."""
    spark = docs.sparkSession
    table = F.broadcast(template_table(spark, phrases, notices))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = rows.mapInArrow(_word_grams, "row long, doc_id long, n_words long, grams array<long>")
    each = hashed.select("row", "doc_id", "n_words", F.posexplode_outer("grams").alias("at", "gram"))
    first_notice = F.greatest(F.lit(0), F.col("n_words") - (K_PHRASE - 1))
    # A text's first k-gram stays without a hit, so that each row of docs comes out.
    hits = each.join(table, "gram", "left").where("template is not null or at is null or at = 0")
    place = F.when(F.col("kind") == "base", F.col("at")).otherwise(F.col("at") - first_notice)
    hits = hits.withColumn("diagonal", (place - F.col("j")).cast("long"))
    # 2-grams and 3-grams are hashed with their length, so a gram never meets a template of the other length.
    votes = hits.groupBy(*PLACE, "diagonal").agg(F.count("template").alias("votes"), F.min("j").alias("low"), F.max("j").alias("high"))
    begin = F.col("diagonal") + F.col("low")
    before = Window.partitionBy("row", "template").orderBy(begin, "diagonal")
    goes_on = (F.col("kind") == "notice") & (F.col("low") > F.lag("high").over(before)) & (F.abs(F.col("diagonal") - F.lag("diagonal").over(before)) <= NEIGHBOUR)
    merged = votes.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("place", F.sum("new").over(before))
    k = F.when(F.col("kind") == "base", K_PHRASE).otherwise(K_NOTICE)
    spans = merged.groupBy(*PLACE, "place").agg(F.min(begin).alias("start"), F.max(F.col("diagonal") + F.col("high") + k).alias("end"), F.sum("votes").alias("covered"))
    real = F.col("covered") >= F.col("need")
    return spans.select("row", "doc_id", "n_words", "template", F.when(real, F.col("label")).alias("label"), F.when(real, F.col("kind")).alias("kind"), "start", "end", "covered", "size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    base = F.col("kind") == "base"
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.lit(True)).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("covered") / F.col("size"))), F.lit(0.0)).alias("score"),
    ).drop("row")
