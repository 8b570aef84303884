"""N-gram Jaccard join with Bayesian candidate pruning, over whole texts.

Words are what stands between white space, in lower case; a shingle is five of them. Equal
texts are one node, whatever their number. The steps are those of `shingle_links`; classes
are the components of the links.

Defined results: a text without words (null, blank) is alike to none and a class of its own
per row; a text of fewer than five words is one shingle; rows without an id are joined like
others and named by a null; repeated rows are copies; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored, word_hashes
from barloom.llm.components import connected_components
from barloom.llm.shingle_links import ShingleLinks, text_node

_NO_ID = -2**63


def _lower(text: str):
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def class_table(docs: DataFrame, text: str = "text", steps: ShingleLinks | None = None) -> DataFrame:
    """Per text with words: node, root, links, copies, least (doc_id), class_id; stored."""
    steps = steps or ShingleLinks()
    place = F.coalesce(F.col("doc_id"), F.lit(_NO_ID)).alias("place")
    read = docs.select("doc_id", place, text_node(_lower(text)).alias("node"),
                       word_hashes(_lower(text)).alias("words"))
    sketched = stored(steps.sketches(read))
    where = sketched.groupBy("node").agg(F.min("place").alias("place"))

    def fetch(nodes):
        chosen = stored(where.join(small_side(nodes), "node"))
        return read.select("place", "node", "words").join(small_side(chosen), ["place", "node"]).select("node", "words")

    links, edges = steps.run(sketched, fetch)
    roots = connected_components(edges)
    nodes = stored(sketched.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
                   .join(roots, "node", "left").join(links, "node", "left")
                   .select("node", F.coalesce("root", "node").alias("root"), "least", "copies",
                           F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    classes = nodes.groupBy("root").agg(F.min("least").alias("class_id"))
    return stored(nodes.join(classes, "root"))


def ngram_jaccard_join(docs: DataFrame, text: str = "text", steps: ShingleLinks | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies.

    `class_id` is the smallest doc_id of the class; `n_links` the different texts that reach
    the threshold with this one; `n_copies` the rows with this very text.
    """
    told = class_table(docs, text, steps).select("node", "class_id", "links", "copies")
    out = docs.select("doc_id", text_node(_lower(text)).alias("node")).join(told, "node", "left")
    alone = F.col("copies").isNull()  # a text without words
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each_class(docs: DataFrame, text: str = "text", steps: ShingleLinks | None = None) -> DataFrame:
    """The rows of `docs` with one row of each class: that with the smallest doc_id.

    Texts without words all stay.
    """
    told = class_table(docs, text, steps)
    placed = docs.withColumn("_barloom_node", text_node(_lower(text))).withColumn(
        "_barloom_place", F.coalesce(F.col("doc_id"), F.lit(_NO_ID)))
    first = told.groupBy("root").agg(F.min(F.struct(
        F.coalesce("least", F.lit(_NO_ID)).alias("_barloom_place"), F.col("node").alias("_barloom_node"))).alias("k")).select("k.*")
    rows = placed.groupBy("_barloom_node", "_barloom_place").agg(F.count(F.lit(1)).alias("_same")).join(
        told.select(F.col("node").alias("_barloom_node")), "_barloom_node")
    marked = stored(rows.join(first.withColumn("_first", F.lit(True)), ["_barloom_node", "_barloom_place"], "left"))
    # Most rows are either the only one at a kept place or not kept; the others are repeated rows.
    gone = stored(marked.where("_first is null or _same > 1").select("_barloom_node", "_barloom_place"))
    again = stored(marked.where("_first and _same > 1").select("_barloom_node", "_barloom_place"))
    single = placed.join(small_side(gone), ["_barloom_node", "_barloom_place"], "left_anti")
    repeated = placed.join(small_side(again), ["_barloom_node", "_barloom_place"]).dropDuplicates(["_barloom_node"])
    return single.select(docs.columns).union(repeated.select(docs.columns))
