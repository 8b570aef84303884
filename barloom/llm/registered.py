"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.llm.oracles import ORACLES

#: Key of the surrogates in the registered query; a job brings its own.
SURROGATE_KEY = "registered-query"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, n_copies."""
    from barloom.llm.near_copies import ngram_jaccard_join
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    from barloom.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and how many lines the method removes."""
    from barloom.llm.quality import quality_rules
    q = quality_rules(table(spark, sf_dir, "documents"))
    return q.withColumn("n_removed_lines", F.size("removed_lines")).drop("_key", "removed_lines")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, evidence."""
    from barloom.llm.toxicity import score_toxicity
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    from barloom.llm.topk import top_k_search
    return top_k_search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    from barloom.llm.licences import scan_licences
    return scan_licences(table(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with private data replaced, and how many places that were."""
    from barloom.llm.surrogates import replace_private_data
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_private_data(docs, SURROGATE_KEY)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    from barloom.llm.html_text import extract_main_text
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    from barloom.llm.mixing import mix_sources
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, position, start, n_words, class_id, n_occurrences, removed."""
    from barloom.llm.passages import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    from barloom.llm.common import words
    from barloom.llm.periodic_runs import periodic_runs
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    # Texts with h % 10 = 0 repeat what stands from word a on, every p words.
    chosen = docs.withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text")))).select(
        "doc_id", "text", "w", F.when(n > 0, g % n).cast("int").alias("a"), (3 + g % 8).cast("int").alias("c"))
    chosen = chosen.withColumn("p", F.expr("1 + (size(w) - a) div c").cast("int"))
    again = F.array_join(F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get(F.col("w"), F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    texts = chosen.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))
    out = periodic_runs(texts)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    return (out.withColumn("b", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.before")).alias("start"),
        F.col("b.length").alias("length"), (-F.col("b.less")).alias("period"),
        F.expr("1000 * b.length div -b.less").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256."""
    from barloom.llm.exact_copies import exact_copies
    return exact_copies(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    from barloom.llm.spelling import spelling_variants
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit("([A-Za-zÀ-ÿ]+)"))
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return spelling_variants(runs.select(F.when(h % 97 == 0, shorter).otherwise(F.col("run")).alias("word")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages of corpus_pipeline.py make of `documents`."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [pipeline, op1_ngram_jaccard_join, op2_pack_documents, op3_quality_rules, op4_toxicity, op5_top_k, op6_licence_scan, op7_surrogates, op8_main_text, op9_mix_sources, op10_repeated_passages,
           op11_periodic_runs, op12_exact_copies, op13_spelling_variants]
    return {f.__name__: f for f in own}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
