"""Periodic runs, exact copies and spelling variants against plain versions."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from barloom.llm import exact_copies as E
from barloom.llm import periodic_runs as P
from barloom.llm import registered
from barloom.llm import spelling as S
from tests.llm import brute

R = random.Random(5)


def plain_runs(w, min_length=6, min_periods=4):
    """Every maximal stretch of every period; the smallest period of equal stretches."""
    n, found = len(w), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_periods * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(n, letters):
    """Random words with repeated stretches, some inside others."""
    w = [R.randrange(letters) for _ in range(n)]
    for _ in range(3):
        a, p = R.randrange(n), 1 + R.randrange(max(1, n // 6))
        end = min(n, a + int(p * R.uniform(2, 9)))
        for i in range(a, end):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least", [(6, 4), (1, 2), (2, 3)])
def test_runs_equal_those_of_every_period(least):
    cases = [periodic(R.randrange(1, 120), R.choice([1, 2, 3, 50])) for _ in range(400)]
    cases += [[], [0], [7] * 3, [7] * 500, [0, 1] * 300 + [2], periodic(2000, 2), periodic(3000, 4)]
    for w in cases:
        assert P.runs_of(np.array(w, np.int64), *least) == plain_runs(w, *least), w


def test_squares_are_caught_at_every_distance():
    for p in itertools.chain(range(1, 70), (127, 128, 129, 1000)):
        for at in (0, 1, 5, 64):
            w = list(range(at)) + [10_000 + i % p for i in range(2 * p)] + [-1, -2]
            assert P.runs_of(np.array(w, np.int64), 1, 2) == [(at, 2 * p, p)]


def test_periodic_rows(spark):
    texts = [None, "", " \n", "a b c", "x " * 40_000, "  " * 7 + "end", "a b\tc a\vb c a b c a b\rc z", "a b c"]
    df = spark.createDataFrame([(i if i != 3 else None, t, i, "c") for i, t in enumerate(texts)],
                               "doc_id long, text string, runs int, _text string")
    out = sorted(P.periodic_runs(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [r["doc_id"] for r in out] == [0, 1, 2, 4, 5, 6, 7, None]
    by = {r["doc_id"]: r for r in out}
    assert [(by[i]["n_words"], by[i]["runs"], by[i]["collapsed"]) for i in (0, 1, 2)] == [(0, [], "")] * 3
    assert [tuple(r) for r in by[4]["runs"]] == [(0, 40_000, 1)] and by[4]["collapsed"] == "x"
    assert by[5]["collapsed"] == "  end" and [tuple(r) for r in by[6]["runs"]] == [(0, 12, 3)]
    assert by[6]["collapsed"] == "a b c z" and by[7]["collapsed"] == by[None]["collapsed"] == "a b c"
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_registered_runs_equal_plain_ones(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in registered.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for d, t in docs:
        w = brute.WORD.findall(t or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        r = got[d]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["start"], r["length"], r["period"]) == best and r["n_runs"] == len(runs)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def plain_copies(rows):
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return {(d, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
            for d, t in rows}


@pytest.mark.parametrize("counters", [1, 3, 256])
def test_copies_equal_plain_groups(spark, counters):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"t{i % 90}") for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, "x" * 200_000), (2003, "Hot")]
    R.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, row int, digest string")
    out = E.exact_copies(df.repartition(7), counters=counters).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out} == plain_copies(rows)
    assert len(out) == len(rows) and all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out)
    kept = E.without_copies(df, counters=counters)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out if r["kept"])


def test_copies_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    out = E.exact_copies(df).collect()
    assert sum(r["kept"] for r in out) == 2 and len(out) == 5
    assert {(r["keep_id"], r["group_size"]) for r in out} == {(1, 3), (None, 2)}
    assert E.exact_copies(df.limit(0)).count() == 0 == E.without_copies(df.limit(0)).count()
    folded = E.exact_copies(spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string"),
                            normalise=lambda t: t.ilike("zz").cast("string"))
    assert {r["keep_id"] for r in folded.collect()} == {2}


def test_summaries_keep_every_frequent_digest(spark):
    names = [f"d{i}".encode() for i in range(60)]
    rows = [n for i, n in enumerate(names) for _ in range(1 + (i < 4) * 90)]
    R.shuffle(rows)
    df = spark.createDataFrame([(bytearray(r),) for r in rows], "digest binary").repartition(130)
    held = {bytes(r["digest"]): r["n"] for r in E.frequent_digests(df, 6).collect()}
    exact = collections.Counter(rows)
    assert len(held) <= 6 and set(names[:4]) <= set(held)
    assert all(exact[d] - len(rows) / 7 <= n <= exact[d] for d, n in held.items())


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def plain_variants(counts, min_chars=5, min_count=3, ratio=2):
    v = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    near = {w: [x for x in v if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in v}
    form = {}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= ratio * n else None
    out = set()
    for w in v:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, v[w], len(near[w]), v.get(form[w])))
    return out


@pytest.mark.parametrize("block", [3, 20_000])
def test_variants_equal_all_pairs(spark, block):
    base = ["".join(R.choice("abé") for _ in range(R.randrange(4, 9))) for _ in range(250)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "\U0001f600aaaa", "\U0001f600aaab", "q" * 3000, "q" * 3001, "q" * 1500 + "z" + "q" * 1499]
    counts = collections.Counter({w: R.choice([1, 3, 4, 6, 9, 30]) for w in base})
    rows = [(w, 1, "x") for w, n in counts.items() for _ in range(n)] + [(None, 1, "x"), ("", 1, "x")] * 3
    df = spark.createDataFrame(rows, "word string, n int, rest string")
    got = S.spelling_variants(df, block_words=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_variants(counts)


def test_variants_of_nothing(spark):
    assert S.spelling_variants(spark.createDataFrame([], "word string")).count() == 0


def test_two_acceptors_give_each_pair_once():
    words = sorted({"".join(R.choice("ab") for _ in range(R.randrange(0, 6))) for _ in range(40)})
    left, right = sorted(R.sample(words, 15)), sorted(R.sample(words, 15))
    a, b = S.Acceptor(left), S.Acceptor(right)
    pairs = S.composed(a, b)
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if one_edit(x, y)}
    own = S.composed(a, a)
    assert sorted(tuple(sorted(p)) for p in own) == [
        (i, j) for i, j in itertools.combinations(range(15), 2) if one_edit(left[i], left[j])]
