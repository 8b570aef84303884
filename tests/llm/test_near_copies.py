import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import shingle_links as S
from barloom.llm.components import connected_components
from barloom.llm.near_copies import ngram_jaccard_join, one_of_each_class
from barloom.llm import passages as passages_module
from barloom.llm.passages import (_words, grams_near, hashed_lines, repeated_passages, sentence_runs, whole_groups,
                                  without_repeats)
from barloom.llm.shingle_links import ShingleLinks
from tests.llm import brute

LETTERS = [f"w{i}" for i in range(400)]


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        words[r.randrange(len(words))] = r.choice(LETTERS)
    return words


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = []
    for _ in range(25):
        base = [r.choice(LETTERS) for _ in range(r.randint(30, 120))]
        for _ in range(r.choice([1, 1, 2, 6])):
            out.append(" ".join(edited(r, base, r.randint(0, 5))))
    base = [r.choice(LETTERS) for _ in range(90)]  # a large, loose group
    out += [" ".join(edited(r, base, r.randint(0, 4))) for _ in range(700)]
    out += [out[0]] * 40 + ["a b", "A b", "", " \n ", None, "one", "word " * 3000]
    return list(enumerate(out))


def test_join_equals_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_jaccard_join(df).collect()}
    assert got == brute.near_copies(rows)


def test_one_of_each_class(spark, rows):
    again = [*rows, rows[0], rows[-1]]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in again], "doc_id long, text string, _node int, node string")
    out = one_of_each_class(df)
    want = brute.near_copies(rows)
    blank = {d for d, t in rows if not (t or "").strip()}
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for c, _ in want.values()} | blank)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(empty).count() == 0
    assert repeated_passages(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f")],
                                "doc_id long, text string")
    got = ngram_jaccard_join(odd).collect()
    assert [(r["class_id"], r["n_copies"]) for r in got] == [(3, 3)] * 3


def test_pruning_keeps_pairs_at_the_threshold():
    need = S.matches_needed(128, 0.8, 1e-6)
    r = np.random.RandomState(1)
    for n, m in need.items():
        assert (r.binomial(n, 0.8, 20_000) < m).sum() <= 2
        assert m > 0.4 * n - 8


@pytest.mark.parametrize("seed", range(5))
def test_shared_counts_both_ways(seed):
    r = np.random.RandomState(seed)
    sets = [np.unique(r.randint(0, 60, r.randint(1, 40)).astype(np.uint64)) for _ in range(20)]
    i, j = np.triu_indices(20, 1)
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert S.shared_counts(sets, i, j).tolist() == want
    assert S.shared_counts(sets, i[:3], j[:3]).tolist() == want[:3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 200), (None, 3)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["root"] for r in
           connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200}


def test_repeated_passages(spark):
    r = random.Random(5)

    def sentence(n):
        return " ".join(r.choice(LETTERS) for _ in range(n)) + "."

    passage = " ".join(sentence(9) for _ in range(7))
    near = passage.split()
    near[20] = "other"
    line = sentence(30)
    docs = [(1, f"{sentence(12)} {sentence(25)} {passage} {sentence(14)}"), (2, f"{sentence(40)}\n{passage}"),
            (3, " ".join(near)), (4, f"{sentence(8)} {passage} {sentence(9)}"), (5, line), (5, line),
            (6, "\n".join(sentence(9) for _ in range(6))), (7, None), (8, "x " * 5000), (9, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["doc_id"], x["position"], x["removed"]): x for x in repeated_passages(df).collect()}
    assert {k[0] for k in got} == {1, 2, 3, 4, 5}
    assert got[2, 1, False]["class_id"] == 2 and got[3, 0, True]["class_id"] == 2  # whole lines, nearly equal
    assert got[1, 0, False]["start"] == 37 and got[1, 0, False]["n_words"] == 63   # inside longer lines
    assert got[4, 0, True]["class_id"] == 1 and got[4, 0, True]["n_words"] == 63
    assert got[5, 0, False]["n_occurrences"] == got[5, 0, True]["n_occurrences"] == 2
    left = {x["doc_id"]: x["text"] for x in without_repeats(df).collect()}
    assert left[1] == docs[0][1] and left[6] == docs[6][1] and left[7] is None
    assert passage not in left[4] and len(left[4].split()) == 17 and left[3] == ""


def test_runs_reach_the_least_length(spark):
    df = spark.createDataFrame([(1, "a b c. d e f. g h i. j k")], "doc_id long, text string")
    got = sorted((x["start"], x["n_words"]) for x in sentence_runs(df, least_words=4).collect())
    assert got == [(0, 6), (3, 6), (6, 5)]


def test_surviving_lines_keep_their_runs(spark):
    r = random.Random(8)

    def sentence(n):
        return " ".join(r.choice(LETTERS) for _ in range(n)) + "."

    early, late = (" ".join(sentence(9) for _ in range(5)) for _ in range(2))
    held = f"{sentence(40)} {early} {sentence(41)} {late} {sentence(42)}"
    docs = [(1, f"{sentence(33)} {early} {sentence(34)}"), (2, held), (3, held), (4, f"{sentence(35)} {late} {sentence(36)}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x["doc_id"], x["start"], x["n_words"], x["class_id"], x["n_occurrences"], x["removed"])
                 for x in repeated_passages(df).collect())
    n = len(held.split())
    assert got == [(1, 33, 45, 1, 2, False), (2, 0, n, 2, 2, False), (2, 40, 45, 1, 2, True), (2, 126, 45, 2, 2, False),
                   (3, 0, n, 2, 2, True), (4, 35, 45, 2, 2, True)]
    left = {x["doc_id"]: x["text"] for x in without_repeats(df).collect()}
    assert early in left[1] and early not in left[2] and late in left[2] and left[3] == "" and late not in left[4]


def test_spans_need_no_marks_or_lines(spark):
    r = random.Random(9)
    rand = lambda n: [r.choice(LETTERS) for _ in range(n)]
    passages = [rand(60) for _ in range(4)]
    near = list(passages[1])
    near[33] = "other"
    wrapped = [" ".join(passages[2][i:i + 12]) for i in range(0, 60, 12)]
    docs = [(1, " ".join(rand(40) + passages[0] + rand(30) + passages[1] + rand(35))),
            (2, " ".join(rand(31) + passages[0] + rand(32))), (3, " ".join(rand(33) + near + rand(34))),
            (4, "\n".join([" ".join(rand(11)), *wrapped, " ".join(rand(9))])), (5, " ".join(rand(45) + passages[2] + rand(36))),
            (6, "。 ".join(passages[3]) + "。 " + " ".join(rand(50))), (7, " ".join(rand(51)) + " " + "。 ".join(passages[3]) + "。"),
            (8, "x " * 500), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = repeated_passages(df).collect()
    texts = {d: [x.lower().split() for x in (t or "").split("\n")] for d, t in docs}
    # Brute force: every 50-word window that stands in two texts.
    flat = {d: [w for x in lines for w in x] for d, lines in texts.items()}
    seen = {}
    for d, w in flat.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i:i + 50]), []).append((d, i))
    want = {(d, i + j) for p in seen.values() if len({d for d, _ in p}) > 1 for d, i in p for j in range(50)}
    got = set()
    for x in found:
        before = sum(map(len, texts[x["doc_id"]][:x["position"]]))
        got |= {(x["doc_id"], before + x["start"] + j) for j in range(x["n_words"])}
    assert want and want <= got
    rows = sorted((x["doc_id"], x["position"], x["start"], x["n_words"], x["class_id"]) for x in found if x["removed"])
    assert rows == [(2, 0, 31, 60, 1), (3, 0, 33, 60, 1), (5, 0, 45, 60, 4), (7, 0, 51, 60, 6)]
    kept = sorted((x["doc_id"], x["position"], x["n_words"]) for x in found if x["doc_id"] == 4)
    assert kept == [(4, i, 12) for i in range(1, 6)]


def test_block_pairs_of_a_hot_group_lie_in_many_tasks(spark):
    rows = spark.range(256 * 6).select(F.lit(1).alias("pivot"), F.unhex(F.md5(F.col("id").cast("string"))).alias("node"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = ShingleLinks.block_pairs(rows, "pivot", []).select(
            "x", "y", F.size("members").alias("n"), F.spark_partition_id().alias("task")).collect()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert {(r["x"], r["y"]) for r in got} == {(x, y) for x in range(6) for y in range(x, 6)} and len(got) == 21
    assert len({r["task"] for r in got}) > 6


def test_word_table_agrees_with_a_plain_split():
    texts = ["", "a b\n\nc\x0bété  a", " \t", "\n\nx", "wort" * 50 + " b a", "　 a\nba ab", ""]
    column = pa.array(["skipped", *texts]).slice(1)
    h, of, line, sizes = _words(column)
    plain = [(i, k, w) for i, t in enumerate(texts) for k, part in enumerate(t.split("\n"))
             for w in re.findall("[^\x20\x09-\x0d]+", part)]
    assert list(zip(of, line)) == [p[:2] for p in plain]
    assert list(sizes) == [sum(p[0] == i for p in plain) for i in range(len(texts))]
    names = [p[2] for p in plain]
    assert len(set(zip(names, h))) == len(set(names)) == len(set(h))


def test_lines_are_hashed_as_by_column_expressions(spark):
    lines = ["a b  c\td", "\x0bété " + "wort" * 20 + " ß x ", "", "1 2", "one two three 4"]
    texts = spark.createDataFrame([(7, "\n".join(lines)), (None, "")], "doc_id long, _text string")
    batch = pa.RecordBatch.from_arrays([pa.array([7, None]), pa.array(["\n".join(lines), ""])], names=["doc_id", "_text"])
    got = pa.Table.from_batches(hashed_lines([batch], 3)).to_pylist()
    part = F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    want = (texts.select("doc_id", F.posexplode(F.split("_text", "\n", -1)).alias("position", "line"))
            .select("doc_id", "position", F.size(part).alias("n_words"), F.unhex(F.md5(F.array_join(part, " "))).alias("node"),
                    F.transform(part, lambda w: F.xxhash64(w)).alias("words")).where("n_words >= 3").collect())
    assert [tuple(r.values()) for r in got] == [(*r[:3], bytes(r["node"]), r["words"]) for r in want] and len(got) == 3


def test_groups_stay_together_across_batches():
    values = [1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i:i + 2]), pa.array(range(i, min(i + 2, 13)))], names=["g", "x"])
               for i in range(0, 13, 2)]
    parts = list(whole_groups([batches[0].slice(0, 0), *batches], "g"))
    assert [v for c in parts for v in c["g"]] == values and [x for c in parts for x in c["x"]] == list(range(13))
    seen = [v for c in parts for v in set(c["g"].tolist())]
    assert len(seen) == len(set(seen))


def test_grams_are_one_row_per_text(spark):
    text = "\n".join([" ".join(LETTERS[:9]), "", " ".join(LETTERS[:20])])
    texts = spark.createDataFrame([(3, text, [], [0, 4]), (5, "a b", [], [])],
                                  "t long, _text string, gone array<int>, marks array<int>")
    long, short = grams_near(texts, reach=5).orderBy("t").collect()
    n = len(text.split())
    assert long["line_words"] == [9, 0, n - 9] and long["q"] == list(range(10)) and len(long["g"]) == len(long["again"]) == 10
    assert short["line_words"] == [2] and short["q"] == short["g"] == short["again"] == []


def test_spans_agree_when_nothing_is_broadcast(spark, monkeypatch):
    r = random.Random(12)
    rand = lambda n: [r.choice(LETTERS) for _ in range(n)]
    shared = [rand(50) for _ in range(3)]
    docs = [(d, " ".join(rand(30 + d) + shared[d % 3] + rand(20) + shared[(d + d // 3) % 3] + rand(25))) for d in range(7)]
    docs += [docs[2], (None, docs[4][1] + " z"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    told = lambda: sorted(map(str, repeated_passages(df).collect()))
    want = told()
    for name, value in (("BROADCAST_MARKS", 0), ("BROADCAST_ROWS", 0), ("NUMBER_ROWS", 3)):
        monkeypatch.setattr(passages_module, name, value)
    assert told() == want and any("removed=True" in x for x in want)
    monkeypatch.setattr(passages_module, "BROADCAST_RUNS", 0)
    assert told() == want
