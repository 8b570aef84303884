"""Quality rules, source mix, licences, top-k and toxicity against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from barloom.llm import licences as L
from barloom.llm import topk as K
from barloom.llm import toxicity as T
from barloom.llm.mixing import mix_sources, mixed_documents, sainte_lague
from barloom.llm.quality import keep_good, quality_rules, without_lines
from tests.llm import brute

R = random.Random(11)
WORDS = [a + b + c for a in "bcdfghklmn" for b in "aeiou" for c in "lmnrst"]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def hosted(spark):
    """60 documents of one host that share a menu, 5 that are little else, and odd ones."""
    menu = [text(12), text(15)]
    rows = [(i, "\n".join([menu[0], text(60), menu[1]]), "a") for i in range(60)]
    rows += [(100 + i, "\n".join([*menu, text(25)]), "a") for i in range(5)]
    rows += [(200 + i, rows[0][1], "b") for i in range(70)]  # copies are no boilerplate
    rows += [(300, None, "a"), (301, "", None), (302, "a b a b a b " * 20, None), (303, "#* $ x\n\nx\nx", "a"),
             (304, text(20_000), "c"), (300, None, "a")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_quality_counts_and_verdicts(hosted):
    rows, df = hosted
    texts = {d: t for d, t, _ in rows}
    out = quality_rules(df).collect()
    assert len(out) == len(rows)
    for r in out:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == brute.quality(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["kept"] and by[i]["removed_lines"] == [0, 2] for i in range(60))
    assert not any(by[100 + i]["kept"] for i in range(5)) and by[100]["removed_words"] == 27
    assert all(by[200 + i]["kept"] and not by[200 + i]["removed_lines"] for i in range(70))
    assert by[304]["kept"] and not by[302]["kept"]


def test_quality_keeps_rows_as_they_are(hosted):
    rows, df = hosted
    wide = df.selectExpr("*", "'x' AS _key", "1 AS host")
    out = keep_good(wide)
    kept = {r["doc_id"] for r in quality_rules(df).where("kept").collect()}
    assert out.columns == wide.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, *_ in rows if d in kept)
    assert quality_rules(df.limit(0)).count() == 0


def test_without_lines(spark):
    df = spark.createDataFrame([("a\nb\n\nc", [1, 3])], "t string, n array<int>")
    assert df.select(without_lines(df["t"], df["n"])).first()[0] == "a\n"


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    r = random.Random(seed)
    groups = {g: [float(r.choice([0, 1, 5, 40, 900]) + r.random()) for _ in range(r.randint(1, 9))] for g in "ab"}
    seats = {g: r.randint(0, 200) for g in groups}
    df = spark.createDataFrame([(g, i, v, seats[g]) for g, vs in groups.items() for i, v in enumerate(vs)],
                               "g string, i int, v double, s long")
    got = {(r["g"], r["i"]): r["won"] for r in sainte_lague(df, ["g"], "v", "s", ["i"], "won").collect()}
    for g, vs in groups.items():
        assert [got[g, i] for i in range(len(vs))] == brute.apportion(vs, seats[g])


def test_uneven_parties(spark):
    """One party beside a thousand tiny ones, heavy tails, equal votes, and no seats at all."""
    r = random.Random(8)
    groups = {"giant": ([1000.0] + [0.4] * 1000, 1400), "tail": ([r.paretovariate(0.7) for _ in range(300)], 777),
              "equal": ([2.0] * 500, 250), "few": ([r.random() for _ in range(700)], 40), "none": ([1.0, 2.0], 0),
              "blank": ([0.0, 0.0], 10), "one": ([3.5], 100_000), "null": ([r.random() for _ in range(50)], 60)}
    df = spark.createDataFrame([(g, f"{i:04}" if g != "null" or i else None, v, s, "x") for g, (vs, s) in groups.items()
                                for i, v in enumerate(vs)], "g string, i string, v double, s long, extra string")
    out = sainte_lague(df, ["g"], "v", "s", ["i"], "won")
    assert out.columns == [*df.columns, "won"]
    got = {(x["g"], int(x["i"] or 0)): x["won"] for x in out.collect()}
    assert got["blank", 0] == got["blank", 1] == 0  # parties without votes get none
    for g, (vs, s) in groups.items():
        assert g == "blank" or [got[g, i] for i in range(len(vs))] == brute.apportion(vs, s), g
    assert got["giant", 0] == 1250


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"a b c {i}", "s") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df, shard_rows=100).toPandas()
    assert out["taken"].sum() == pytest.approx(1.5 * 16000, abs=64) and out["taken"].between(0, 8).all()


def test_mix_meets_its_targets(spark):
    r = random.Random(2)
    share = {"a": 3000, "é": 300, "zz": 20, "B": 800, None: 400}
    rows = [(i, " ".join(["x"] * r.randint(0, 400)) or None, s) for s, n in share.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df.selectExpr("*", "source AS s"), shard_rows=500, keep=("s",)).toPandas()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, brute.targets([sizes[s] for s in order])))
    assert (out["taken"] <= 2 * out["size"]).all() and (out["taken"] >= 0).all()
    for s, part in out.groupby(out["s"].map(lambda x: x), dropna=False):
        s = None if s is None or s != s else s
        assert part["source_size"].iloc[0] == sizes[s]
        assert part["target"].iloc[0] == pytest.approx(want[s], rel=1e-12)
        assert part["taken"].sum() == pytest.approx(want[s], rel=0.02, abs=64)
    again = mix_sources(df.repartition(7), shard_rows=500).toPandas()
    assert sorted(again["taken"]) == sorted(out["taken"])


def test_mix_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a"), (2, " ", "a")], schema)
    assert [(r["taken"], r["target"]) for r in mix_sources(blank).collect()] == [(0, 0.0)] * 3
    one = spark.createDataFrame([(1, "a b c", "s"), (None, "d " * 5000, "s")], schema)
    assert sum(r["taken"] for r in mix_sources(one).collect()) == pytest.approx(1.5 * 5003, abs=64)
    wide = one.selectExpr("*", "1 AS size", "2 AS _barloom_draw")
    assert set(mixed_documents(wide).columns) == set(wide.columns)


def words_of(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_licences_against_a_scan(spark):
    r = random.Random(3)
    parts = [*L.BASE, *(t[1] for t in L.TEMPLATES), "under the mit", "cc by", "Apache LICENSE, version 2.0",
             "cc by nc cc by nc", "ünder thé", "x" * 50]
    texts = [None, "", *(" ".join(r.choice(parts) if r.random() < .3 else r.choice(WORDS)
                                  for _ in range(r.randint(1, 60))) for _ in range(200)), text(30_000) + " cc-by-nc"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    out = {x["doc_id"]: x for x in L.scan_licences(df).collect()}
    for i, t in enumerate(texts):
        w = words_of(t)
        at = [(s, label) for p, label in L.BASE.items() for s in range(len(w)) if w[s:s + len(p.split())] == p.split()]
        x = out[i]
        assert (x["n_words"], x["n_base"]) == (len(w), len(at))
        assert (x["first_word"], x["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in at}))
        joined = f" {' '.join(w)} "
        more = {label for label, _, needed in L.TEMPLATES if all(f" {p} " in joined for p in needed)}
        assert x["labels"] == ",".join(sorted(more | {label for _, label in at}))
        assert 0 <= x["score"] <= 1 and (x["score"] > 0) == bool(x["labels"])
    assert L.scan_licences(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["spread", "equal", "grouped"])
def test_top_k_chunk(shape):
    r = np.random.RandomState(4)
    c = {"spread": r.randint(-9, 9, (500, 8)), "equal": np.ones((500, 8), int) * 3,
         "grouped": r.randint(-3, 3, (500, 8)) + 40 * (np.arange(500)[:, None] // 64 == np.arange(8))}[shape].astype(float)
    ids = r.permutation(500).astype(np.int64)
    q, q_ids = c[:40], ids[:40]
    s, i, scored = K.search_chunk(q_ids, q, ids, c, 5, np.full(40, -np.inf), 16)
    for a in range(40):
        want = sorted(((-int(x), int(y)) for x, y in zip(c @ q[a], ids) if y != q_ids[a]))[:5]
        assert [(-int(x), int(y)) for x, y in zip(s[a], i[a])] == want
    if shape == "grouped":
        assert scored < 40 * 32 / 2  # most blocks are never scored


def test_top_k_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, -0.25]), (7, None), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]),
            (10, [1.0]), (11, [0.5, 0.25]), (11, [0.5, 0.25]), (12, [float("inf"), 0.0]), (13, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in K.top_k_search(df, "vec_id", "embedding").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 10, 32768), (0, 2, 11, 20480), (0, 3, 50, 12288),
                   (50, 1, 10, 32768), (50, 2, 0, 12288), (50, 3, 11, 12288)]
    assert K.top_k_search(df.limit(0), "vec_id", "embedding").count() == 0
    big = np.array([[2.0**40, 1.0], [2.0**40 - 1, 7.0]])  # beyond what doubles add exactly
    s, i, _ = K.search_chunk(np.array([5]), np.array([[2.0**20, 1.0]]), np.array([1, 2]), big, 2, np.array([-np.inf]))
    assert s[0].tolist() == [2**60 + 1, 2**60 - 2**20 + 7]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(6)
    bad = ["fool", "scoundrel", "wretch"]
    rows, marks = [], []
    for d in range(900):
        toxic = d % 6 == 0
        w = [r.choice(WORDS) for _ in range(r.randint(20, 120))]
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((d, " ".join(w)))
        if d % 4:
            marks.append((d, 1, int(toxic)))
    rows += [(2000, None), (2001, ""), (2001, ""), (2002, "FOOL! " * 4000), (None, "wretch scoundrel fool")]
    marks += [(3, 1, None), (5, 0, 0), (9999, 0, 1)]
    return (spark.createDataFrame([(d, t, "score") for d, t in rows], "doc_id long, text string, score string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_toxicity_on_held_out_texts(labelled):
    docs, labels = labelled
    out = {(r["doc_id"], i): r for i, r in enumerate(T.score_toxicity(docs, labels).collect())}
    assert len(out) == 905
    right = [(r["predicted"], int(d % 6 == 0)) for (d, _), r in out.items() if d is not None and d < 900 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for (d, _), r in out.items() if d is not None)
    assert len(right) > 200 and np.mean([a == b for a, b in right]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out.values())
    assert len({r["score"] for (d, _), r in out.items() if d in (2000, 2001)}) == 1


def test_toxicity_by_join_agrees(labelled):
    docs, labels = labelled
    a = T.score_toxicity(docs, labels).select("doc_id", "score").collect()
    b = T.score_toxicity(docs, labels, broadcast_entries=-1).select("doc_id", "score").collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert x["doc_id"] == y["doc_id"] and x["score"] == pytest.approx(y["score"], abs=1e-9)


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    assert {r["predicted"] for r in T.score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert T.score_toxicity(docs.limit(0), labels).count() == 0
