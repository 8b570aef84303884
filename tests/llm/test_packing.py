import collections
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import packing as P


def places(histogram, capacity):
    """{sequence: [(offset, length)]} of a plan, with its ranks checked."""
    used, given_ = collections.defaultdict(list), collections.Counter()
    for length, first, n, per, sequence, offset in P.plan(histogram, capacity).tolist():
        assert given_[length] == first
        given_[length] += n
        for q in range(n):
            used[sequence + q // per].append((offset + q % per * length, length))
    assert given_ == collections.Counter({k: v for k, v in histogram.items() if v})
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return used


def fewest(items, capacity):
    """The least number of sequences, by trying."""
    items = sorted(items, reverse=True)
    best = len(items)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                put(i + 1, [*rooms[:rooms.index(r)], *rooms[rooms.index(r) + 1:], r - items[i]])
        put(i + 1, [*rooms, capacity - items[i]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_fixed_sets_never_cost_a_sequence(items):
    left = np.zeros(21, np.int64)
    for x in items:
        left[x] += 1
    fixed = P._sets_that_dominate(left, 20)
    rest = [x for x in range(21) for _ in range(left[x])]
    assert sum(n for *_, n in fixed) + fewest(rest, 20) == fewest(items, 20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_plan_is_gapless(items):
    places(collections.Counter(items), 50)


def test_plan_is_near_the_bound():
    r = random.Random(1)
    items = collections.Counter(min(4096, max(1, int(r.lognormvariate(6.3, 1)))) for _ in range(30_000))
    assert len(places(items, 4096)) <= 1.002 * sum(k * v for k, v in items.items()) / 4096 + 1


def test_documents_round_trip(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public.path(P.VOCABULARY))
    texts = ["It's  a Test,", None, "", "x" * 30, "ÉCOLE ñandú straße ΑΣ İ", "a\x1cb c", "word " * 9000, "dup", "dup",
             "日本 語 é́ ﬁ", "12 3,4 don'T we'LL"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = P.pack_documents(df, with_ids=True).collect()
    by = collections.defaultdict(list)
    for r in rows:
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 4096 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        by[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    for i, t in enumerate(texts):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[i])
        assert sum((p[2] for p in parts), []) == want
        assert [p[1] for p in parts] == list(range(0, len(want), 4096))
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in used.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0] + [n for _, n in items])[:-1].tolist()
    assert len(used) == -(-sum(r["length"] for r in rows) // 4096)


def test_no_documents(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
