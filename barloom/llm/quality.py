"""Quality rules: per-text counts, and lines that too many documents of a host share.

One pass over the texts turns every document into counts and the hashes of its
normalised lines (lower case, digits as 0, one space between words). Distinct documents
per (host, line) are counted with partial sums before the shuffle, so a line that stands
everywhere is no hot group; copies of one text within a host count once, so a text isn't
boilerplate for being copied. A line is removed if more than `line_documents` documents
and more than the share `line_share` of the host's documents have it. A document is
depleted if the removed lines hold more than the share `depleted` of its words.

A host has at most (lines per document / line_share) lines above the limit, so they are
one short array per host, joined to the documents on the host.

Defined results: a null or blank text has no words and fails the base rules; a null host
is a host of its own; repeated rows are judged alike; an empty table stays empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored

_WORD = re.compile("[^\x20\x09-\x0d]+")
_DIGITS = re.compile(r"\d+")
_SYMBOLS = "#*$%&|<>"

FEATURES = ("_key binary, host string, doc_id long, n_words long, word_chars long, n_symbols long, "
            "n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<int>")

#: Hosts whose lines may be sent to every executor.
BROADCAST_HOSTS = 5_000


def repeated_words(words: list[str], window: int = 3) -> int:
    """Words that lie in a window of words found twice or more, the first one included."""
    n = len(words)
    if n <= window:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    g = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k:n - window + 1 + k]
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    twice = np.zeros(len(g), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(window):
        inside[k:k + len(g)] |= twice
    return int(inside.sum())


def _features(text: str):
    words = _WORD.findall(text)
    hashes, sizes, seen, again = [], [], set(), 0
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if own:
            again += line in seen
            seen.add(line)
            hashes.append(xxhash.xxh3_64_intdigest(_DIGITS.sub("0", " ".join(own).lower())) - 2**63)
        else:
            hashes.append(None)
        sizes.append(len(own))
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in _SYMBOLS), again,
            repeated_words(words), hashes, sizes)


def row_key(host: Column, text: Column) -> Column:
    """One binary key of a host and a text, nulls included."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit("")),
                                  F.lit("\n"), F.coalesce(text, F.lit("")))))


def text_features(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = list(zip(*[_features(t or "") for t in part.column("_text").to_pylist()]))
                types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), part.column("host"), part.column("doc_id"),
                     *[pa.array(c, t) for c, t in zip(cols, types)]],
                    names=[f.split()[0] for f in FEATURES.split(", ")])

    return docs.select(row_key(F.col(host), F.col(text)).alias("_key"), F.col(host).cast("string").alias("host"),
                       "doc_id", F.col(text).alias("_text")).mapInArrow(measure, FEATURES)


def frequent_lines(features: DataFrame, line_documents: int = 20, line_share: float = 0.02) -> DataFrame:
    """(host, frequent): per host the hashes of the lines above both limits."""
    distinct = features.dropDuplicates(["_key"])
    lines = (distinct.select("host", F.explode(F.array_distinct(F.filter(
        "line_hashes", lambda h: h.isNotNull()))).alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_documents))
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    return (lines.alias("l").join(hosts.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host")))
            .where(F.col("n") > line_share * F.col("docs"))
            .groupBy("l.host").agg(F.collect_list("line").alias("frequent"))
            .select(F.col("l.host").alias("host"), "frequent"))


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", min_words: int = 50,
                  repeat_percent: int = 50, line_documents: int = 20, line_share: float = 0.02,
                  depleted: float = 0.5) -> DataFrame:
    """One row per document: its counts, the lines to remove and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, removed_lines (numbers from 0), removed_words and the key that `row_key` gives.
    """
    features = stored(text_features(docs, host, text))
    frequent = stored(frequent_lines(features, line_documents, line_share))
    marked = features.alias("f").join(
        small_side(frequent, BROADCAST_HOSTS).alias("q"), F.col("f.host").eqNullSafe(F.col("q.host")), "left")
    # Numbers from 0 of the lines whose hash is in the host's list.
    removed = F.filter(F.transform(F.col("line_hashes"), lambda h, i: F.when(
        F.array_contains(F.col("frequent"), h), i)), lambda i: i.isNotNull())
    marked = marked.select("f.*", F.when(F.col("frequent").isNotNull(), removed)
                           .otherwise(F.array().cast("array<int>")).alias("removed_lines"))
    gone = F.aggregate("removed_lines", F.lit(0).cast("long"),
                       lambda a, i: a + F.element_at("line_words", i + 1))
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")))
    return (marked.withColumn("removed_words", gone).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("removed_words") <= depleted * F.col("n_words")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "removed_lines", "removed_words", "_key"))


def without_lines(text: Column, removed_lines: Column) -> Column:
    """The text without the lines of these numbers."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(removed_lines, i)), "\n")


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that the rules keep, as they are."""
    host, text = rules.get("host", "source"), rules.get("text", "text")
    rejected = stored(quality_rules(docs, **rules).where(~F.col("kept")).select(F.col("_key").alias("_barloom_key")).distinct())
    return (docs.withColumn("_barloom_key", row_key(F.col(host), F.col(text)))
            .join(small_side(rejected), "_barloom_key", "left_anti").select(*docs.columns))
