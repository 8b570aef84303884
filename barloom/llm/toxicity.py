"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary labelled texts, are interpolated
Kneser-Ney: discounted bigram counts over discounted continuation counts of the class
(in how many different contexts a word stands) over one backoff that both share, the
pooled continuation counts. Rare expressions, which neither class has seen enough of,
thus get the same probability from both. A text's evidence is the difference of the two
log-likelihoods per word; a logistic curve through evidence and length, fitted on labelled
texts that the models have not seen, makes it a score from 0 to 1.

Counting: tasks sum bigrams before the shuffle, so a frequent pair is no hot group; copies
of a text count once. Entries that say nothing about the class are pruned (likelihood-ratio
statistic below `evidence`) and the backoff weights of what stays are renormalised, as in
entropy pruning; what is pruned contributes the same to both classes. What stays is sent to
the tasks if its counted rows are few, and joined by word otherwise; results are the same.

Defined results: null and blank texts have no words and score what the curve gives for no
evidence; rows without a label teach nothing; several labels of a document count as toxic
if one is; repeated rows score alike; an empty table stays empty; without labels of both
kinds every score is the share of toxic texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import small_side, stored

WORD_PATTERN = r"[\p{L}\p{N}]+"
#: Added to twice the logarithm of the number of entries tested: of so many entries without
#: any meaning, about one in a hundred models would keep one.
EVIDENCE = 6.0
#: Rows of the pruned model that may be sent to every task (16 bytes each).
BROADCAST_ENTRIES = 1_000_000
#: Labelled texts, at most, that the curve is fitted on.
CALIBRATION_TEXTS = 20_000
CALIBRATION_SHARE = 5  # one labelled text in so many is kept from the models
_TOKENS_HELD = 4_000_000
_START = np.uint64(1)


def _tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def _pairs(column):
    """(bigram keys, words, document numbers, words per document); words are 32-bit hashes."""
    words = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(0xFFFFFFFF)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = _START
    return (before << np.uint64(32) | words).view(np.int64), words.view(np.int64), sizes


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled_texts(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(h, doc_id, toxic): one row per distinct text that may teach, null labels left out."""
    marks = (labels.where(F.col("toxic").isNotNull()).groupBy("doc_id")
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    rows = (docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
            .select("doc_id", F.md5(F.coalesce(F.col(text), F.lit(""))).alias("h")))
    return (rows.join(marks, "doc_id").groupBy("h")
            .agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))


def bigram_counts(texts: DataFrame) -> DataFrame:
    """(k, t, o): toxic and ordinary counts of each bigram of rows (toxic, tokens)."""
    def count(batches):
        held, n = ([], []), 0

        def sums():
            keys = np.concatenate(held[0] + held[1] + [np.empty(0, np.int64)])
            toxic = np.zeros(len(keys), np.int64)
            toxic[:sum(map(len, held[0]))] = 1
            k, at = np.unique(keys, return_inverse=True)
            t = np.bincount(at, toxic, len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k), pa.array(t), pa.array(np.bincount(at, minlength=len(k)) - t)], names=["k", "t", "o"])

        for batch in batches:
            keys, _, sizes = _pairs(batch.column("tokens"))
            toxic = np.repeat(batch.column("toxic").to_numpy() > 0, sizes)
            held[0].append(keys[toxic])
            held[1].append(keys[~toxic])
            n += len(keys)
            if n > _TOKENS_HELD:
                yield from sums()
                held, n = ([], []), 0
        yield from sums()

    return (texts.select("toxic", "tokens").mapInArrow(count, "k long, t long, o long")
            .groupBy("k").agg(F.sum("t").cast("int").alias("t"), F.sum("o").cast("int").alias("o")))


def _discount(n1, n2) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _xlog(x: Column, expected: Column) -> Column:
    return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)


def _statistic(t: Column, o: Column, share: Column) -> Column:
    """Likelihood ratio of counts (t, o) against a toxic share of `share`."""
    n = t + o
    return 2 * (_xlog(t, n * share) + _xlog(o, n * (1 - share)))


def model_entries(bigrams: DataFrame, evidence: float = EVIDENCE) -> DataFrame:
    """The pruned models as (level, key, ratio).

    Levels: 1 a word, 2 a bigram, 3 the backoff weight of a context; `ratio` is the toxic
    log-probability less the ordinary one, less the same of a word that is in neither model.
    """
    word = F.expr("k & 4294967295")
    words = stored(bigrams.groupBy(word.alias("w")).agg(
        F.count_if(F.col("t") > 0).alias("t"), F.count_if(F.col("o") > 0).alias("o"),
        F.count(F.lit(1)).alias("n")))

    def tallies(df, *columns):
        asked = [f(F.col(c)).alias(f"{c}_{name}") for c in columns for name, f in (
            ("sum", F.sum), ("seen", lambda x: F.count_if(x > 0)),
            ("once", lambda x: F.count_if(x == 1)), ("twice", lambda x: F.count_if(x == 2)))]
        return {k: float(v or 0) for k, v in df.agg(*asked).first().asDict().items()}

    u, b = tallies(words, "t", "o", "n"), tallies(bigrams, "t", "o")
    if not (u["t_sum"] and u["o_sum"]):
        return words.select(F.lit(1).alias("level"), F.col("w").alias("key"), F.lit(0.0).alias("ratio")).limit(0)
    d1 = {c: _discount(u[f"{c}_once"], u[f"{c}_twice"]) for c in "ton"}
    d2 = {c: _discount(b[f"{c}_once"], b[f"{c}_twice"]) for c in "to"}
    shared = ((F.col("n") - d1["n"]) / u["n_sum"]
              + d1["n"] * u["n_seen"] / u["n_sum"] / (u["n_seen"] + 1))

    def p_word(c):
        return (F.greatest(F.col(c) - d1[c], F.lit(0.0)) / u[f"{c}_sum"]
                + d1[c] * u[f"{c}_seen"] / u[f"{c}_sum"] * shared)

    share = u["t_sum"] / (u["t_sum"] + u["o_sum"])
    words = words.select("w", p_word("t").alias("pt"), p_word("o").alias("po"), shared.alias("ps"),
                         _statistic(F.col("t"), F.col("o"), F.lit(share)).alias("g"))
    enough = evidence + 2 * math.log(u["n_seen"])
    kept = stored(words.where(F.col("g") >= enough))
    mass = kept.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("pt", "po", "ps")]).first()
    rest = math.log((1 - mass["pt"]) / (1 - mass["po"]))  # the kept words' shared mass cancels

    # Bigrams against what the word alone says, with the context's own backoff weight.
    alone = words.select("w", F.when(F.col("g") >= enough, F.col("pt")).otherwise(F.col("ps") * math.exp(rest))
                         .alias("pt"), F.when(F.col("g") >= enough, F.col("po")).otherwise(F.col("ps")).alias("po"))
    scale = b["t_sum"] / b["o_sum"]
    often = stored(bigrams.where(F.col("t") + F.col("o") >= 3).withColumn("w", word)).join(alone, "w")
    expected = scale * F.col("pt") / (scale * F.col("pt") + F.col("po"))
    telling = stored(often.where(_statistic(F.col("t"), F.col("o"), expected)
                                 >= evidence + 2 * math.log(b["t_seen"] + b["o_seen"]))
                     .withColumn("u", F.expr("shiftrightunsigned(k, 32)")))
    contexts = telling.select("u").distinct()
    of_context = (bigrams.withColumn("u", F.expr("shiftrightunsigned(k, 32)"))
                  .join(small_side(stored(contexts)), "u", "left_semi").groupBy("u").agg(
                      *[F.sum(c).alias(f"c{c}") for c in "to"],
                      *[F.count_if(F.col(c) > 0).alias(f"s{c}") for c in "to"]))

    def p_pair(c):
        p = F.col(f"p{c}")
        return F.when(F.col(f"c{c}") > 0, F.greatest(F.col(c) - d2[c], F.lit(0.0)) / F.col(f"c{c}")
                      + d2[c] * F.col(f"s{c}") / F.col(f"c{c}") * p).otherwise(p)

    pairs = stored(telling.join(of_context, "u").select(
        "k", "u", "pt", "po", p_pair("t").alias("qt"), p_pair("o").alias("qo")))
    left = pairs.groupBy("u").agg(*[F.sum(c).alias(c) for c in ("pt", "po", "qt", "qo")])
    # Rounding, or one context with a single follower, could use up all the mass.
    weight = {c: F.greatest(1 - F.col(f"q{c}"), F.lit(1e-9)) / F.greatest(1 - F.col(f"p{c}"), F.lit(1e-9))
              for c in "to"}
    entries = (kept.select(F.lit(1).alias("level"), F.col("w").alias("key"), (F.log(F.col("pt") / F.col("po")) - rest).alias("ratio"))
               .unionByName(pairs.select(F.lit(2).alias("level"), F.col("k").alias("key"),
                                         (F.log(F.col("qt") / F.col("qo")) - rest).alias("ratio")))
               .unionByName(left.select(F.lit(3).alias("level"), F.col("u").alias("key"),
                                        F.log(weight["t"] / weight["o"]).alias("ratio"))))
    return stored(entries)


def evidence_by_task(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (.., tokens) with `n` words and `evidence`, the model being sent to every task."""
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    found = entries.toArrow().sort_by("key")
    level, key, ratio = (found.column(c).to_numpy() for c in ("level", "key", "ratio"))
    for x in (1, 2, 3):
        levels[x] = (key[level == x], ratio[level == x])

    def look(x, keys):
        known, value = levels[x]
        if not len(known):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return np.where(hit, value[at], 0.0), hit

    names = [c for c in rows.columns if c != "tokens"]

    def score(batches):
        for batch in batches:
            keys, words, sizes = _pairs(batch.column("tokens"))
            own, _ = look(1, words)
            weight, _ = look(3, (keys.view(np.uint64) >> np.uint64(32)).view(np.int64))
            pair, hit = look(2, keys)
            sums = np.concatenate([[0.0], np.cumsum(np.where(hit, pair, own + weight))])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])],
                names=[*names, "n", "evidence"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "tokens")
    return rows.mapInArrow(score, f"{fields}{', ' if fields else ''}n long, evidence double")


def evidence_by_join(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by shuffles, for a model of any size. Rows are told apart by `row`."""
    parts = {x: entries.where(F.col("level") == x).select(F.col("key").alias(f"k{x}"), F.col("ratio").alias(f"r{x}"))
             for x in (1, 2, 3)}
    low = F.transform("tokens", lambda h: h.bitwiseAND(4294967295))
    told = rows.withColumn("row", F.monotonically_increasing_id())
    told = stored(told)
    pairs = F.transform(low, lambda w, i: F.struct(
        w.alias("k1"), F.when(i > 0, F.element_at(low, i)).otherwise(int(_START)).alias("k3")))
    flat = (told.select("row", F.explode(pairs).alias("p")).select("row", "p.k1", "p.k3")
            .groupBy("row", "k1", "k3").agg(F.count(F.lit(1)).alias("c"))
            .withColumn("k2", F.shiftleft("k3", 32).bitwiseOR(F.col("k1"))))
    for x in (1, 2, 3):
        flat = flat.join(parts[x], f"k{x}", "left")
    one = F.coalesce("r2", F.coalesce("r1", F.lit(0.0)) + F.coalesce("r3", F.lit(0.0)))
    sums = flat.groupBy("row").agg(F.sum("c").alias("n"), F.sum(one * F.col("c")).alias("evidence"))
    return (told.join(sums, "row", "left").drop("row", "tokens")
            .withColumns({"n": F.coalesce("n", F.lit(0)).cast("long"), "evidence": F.coalesce("evidence", F.lit(0.0))}))


def _inputs(n: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), 10 * evidence / n, evidence / np.sqrt(n)], axis=1)


def fit_curve(n, evidence, toxic, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's steps for the logistic curve through (1, evidence per word, evidence per root of words)."""
    x, y = _inputs(np.asarray(n, float), np.asarray(evidence, float)), np.asarray(toxic, float)
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[0] = math.log(share / (1 - share))
    if y.min(initial=1) == y.max(initial=0):
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.7,
                   evidence: float = EVIDENCE, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, evidence for every document."""
    teach = stored(labelled_texts(docs, labels, text))
    aside = F.pmod(F.xxhash64("h"), F.lit(CALIBRATION_SHARE)) == 0
    tokens = _tokens(F.col(text)).alias("tokens")

    def with_texts(marks):  # a copy with the same id would count twice
        chosen = docs.select("doc_id", F.md5(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text))
        return chosen.join(small_side(stored(marks)), ["doc_id", "h"]).select("toxic", tokens)

    counts = stored(bigram_counts(with_texts(teach.where(~aside))))
    entries = model_entries(counts, evidence)
    by = evidence_by_task if entries.count() <= broadcast_entries else evidence_by_join
    seen = by(with_texts(teach.where(aside).orderBy("h").limit(CALIBRATION_TEXTS)), entries)
    known = seen.select("n", "evidence", "toxic").toPandas()
    w = [float(x) for x in fit_curve(known["n"], known["evidence"], known["toxic"])]
    rows = by(docs.select("doc_id", tokens), entries)
    n = F.greatest(F.col("n"), F.lit(1))
    z = F.lit(w[0]) + w[1] * 10 * F.col("evidence") / n + w[2] * F.col("evidence") / F.sqrt(n)
    return (rows.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))
            .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"),
                    F.col("n").alias("n_words"), "evidence"))
