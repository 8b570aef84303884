"""Substring dedup by paragraphs: MinHash banding, exact verification, components.

A paragraph is a line of at least `least_words` words. Equal paragraphs are one node,
whatever their number. Passages can also start and end anywhere, inside a line or over several:
grams of words chosen by winnowing are counted over the lines that stay, and around those that
repeat every gram is. Repeated grams that touch are one piece, pieces parted by an edit are one
span, and spans of `WINDOW_WORDS` words are given, one row per line. A text that repeats itself
without a gap is no repeat. The bands are tuned for recall (12 bands of 3 values: a pair at the
threshold is missed once in 5,600 cases, and seldomer above it); colliding paragraphs are
verified by exact Jaccard over five-word shingles, and classes are the components of the
verified links. In each class the first occurrence (smallest document, then position) stays
and the others are removed; runs that overlap are given as one span.

Defined results: null and blank texts have no paragraphs; paragraphs shorter than
`least_words` never repeat; a row that repeats is a further occurrence; rows without an id
come first; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import BROADCAST_ROWS, GAP, settled, small_side, stored
from barloom.llm.components import connected_components
from barloom.llm.shingle_links import ShingleLinks

LEAST_WORDS = 20
WINDOW_WORDS = 30
#: Words of a gram, and the length from which equal stretches surely share an anchor. A passage
#: that is edited to a Jaccard similarity of 0.8 keeps about as many words in one piece.
GRAM_WORDS = 13
SURE_WORDS = 24
#: Words around an anchor in which the passage's ends, and pieces behind an edit, are looked for.
REACH = 64
BROADCAST_MARKS = 50_000
_GRAMS = "t long, line_words array<int>, q array<int>, g array<long>, again array<boolean>"
_TOLD = "t long, at long, n long, first long"
_PIECES = "t long, removed boolean, start long, end long, a long, z long, first long, n long"
_SPANS = "t long, position int, start int, n_words int, first long, n_occurrences long, removed boolean"
#: Rows of a few numbers that go to Python at once.
NUMBER_ROWS = 20_000
#: Repeated runs (two numbers each) that may be sent to every executor.
BROADCAST_RUNS = 2_000_000
_WORD = re.compile("[^\x20\x09-\x0d]+")
_RUNS = "doc_id long, position int, start int, n_words int, hi long, lo long"
BANDS = dict(bands=12, rows=3, values=48)


def _spread(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


_IS_GAP = np.isin(np.arange(256), [32, *range(9, 14)])
#: What a byte of a word counts; gaps count nothing.
_VALUES = np.where(_IS_GAP, np.uint64(0), _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
_POWER = np.uint64(0x2545F4914F6CDD1D)


_LINES = "doc_id long, position int, n_words int, node binary, words array<long>"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def lowered(text: str):
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def hashed_lines(batches, least_words: int, wanted: bool = False):
    """Lines of lower-cased texts (doc_id, _text) that are long enough: doc_id, position, n_words,
    node and the hashes of their words. `wanted`: only those listed in `chosen` as (p, node)."""
    for part in _parts(batches):
        docs = part.column("doc_id").to_pylist()
        out, flat = ([], [], [], []), []
        asked = part.column("chosen").to_pylist() if wanted else repeat(None)
        for doc, text, chosen in zip(docs, part.column("_text").cast(pa.binary()).to_pylist(), asked):
            chosen = chosen and {(c["p"], c["node"]) for c in chosen}
            places = chosen and {p for p, _ in chosen}
            for position, line in enumerate(text.split(b"\n")):
                # Fewer bytes than so many words and gaps take can't be enough; most lines end here.
                if len(line) < 2 * least_words - 1 or wanted and position not in places:
                    continue
                found = line.split()
                if len(found) < least_words:
                    continue
                node = md5(b" ".join(found)).digest()
                if wanted and (position, node) not in chosen:
                    continue
                for column, value in zip(out, (doc, position, len(found), node)):
                    column.append(value)
                flat += found
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat, repeat(42)), np.uint64, len(flat)).view(np.int64)
        ends = np.cumsum([0, *out[2]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes))], names=_names(_LINES))


def sentence_runs(docs: DataFrame, text: str = "text", least_words: int = WINDOW_WORDS) -> DataFrame:
    """Runs of whole sentences inside lines (any equal words count in `repeated_runs`): from every sentence on, until `least_words` are
    reached. Lines that are one run are left out, they are paragraphs themselves."""
    def runs(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for doc, value in zip(part.column("doc_id").to_pylist(), part.column("_text").to_pylist()):
                    for position, line in enumerate((value or "").lower().split("\n")):
                        words = _WORD.findall(line)
                        if len(words) <= least_words:
                            continue
                        ends = [i + 1 for i, w in enumerate(words) if w[-1] in ".!?"]
                        if not ends or ends[-1] < len(words):
                            ends.append(len(words))
                        k = 0
                        for start in [0, *ends[:-1]]:
                            while k < len(ends) and ends[k] - start < least_words:
                                k += 1
                            if k == len(ends):
                                break
                            if ends[k] - start < len(words):
                                h = xxhash.xxh3_128_intdigest(" ".join(words[start:ends[k]]))
                                out.append((doc, position, start, ends[k] - start, (h >> 64) - 2**63,
                                            (h & 2**64 - 1) - 2**63))
                columns = list(zip(*out)) or [[]] * 6
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 names=_names(_RUNS))

    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(runs, _RUNS)


def _parts(batches, rows: int = 200):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _bytes(column):
    """(bytes, offsets) of an Arrow column of strings without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _hashes(data, starts, ends, step: int = 1 << 16):
    """A 64-bit hash of each word: the sum of its bytes' values times powers by place."""
    out = np.empty(len(starts), np.uint64)
    for w in range(0, len(starts), step):
        s, e = starts[w:w + step], ends[w:w + step]
        place = np.arange(s[0], e[-1]) - np.repeat(s, np.diff(np.append(s, e[-1])))
        longest = int((e - s).max())
        powers = np.cumprod(np.full(longest, _POWER))
        x = _VALUES[data[s[0]:e[-1]]] * powers[np.minimum(place, longest - 1)]
        out[w:w + step] = _spread(np.add.reduceat(x, s - s[0]))
    return out


def _words(column):
    """Over all words of the texts: their hashes, text numbers and lines (from 0 in their text);
    and the texts' numbers of words."""
    data, offsets = _bytes(column)
    gap = _IS_GAP[data]
    before, behind = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], behind[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], behind[inner - 1] = True, True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & behind) + 1
    of = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[of]
    return _hashes(data, starts, ends), of, line, np.bincount(of, minlength=len(column))


def _flat(batch, name: str):
    """(text number, value) of a column of lists without nulls."""
    n = batch.column(name).value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _grams(batch, k: int):
    """Per word of a batch (rows with `_text` and the lines `gone`): its index in the text, its
    text's number, the hash of the `k` words from it on, whether these lie in the text and neither
    begin nor end in a line that is gone (such lines are longer than a gram), and the texts' words."""
    words, of, line, sizes = _words(batch.column("_text"))
    at = np.arange(len(words)) - (np.cumsum(sizes) - sizes)[of]
    h = np.zeros(len(words), np.uint64)
    m = max(len(words) - k + 1, 0)
    for i in range(k):
        h[:m] = h[:m] * np.uint64(0x9E3779B97F4A7C15) + words[i:i + m]
    text, position = _flat(batch, "gone")
    gone = np.isin(of << 32 | line, text << 32 | position)
    valid = at + k <= sizes[of]
    valid[:m] &= ~gone[:m] & ~gone[k - 1:]
    return at, of, _spread(h), valid, sizes


def _again(chosen, at, of, h, k: int):
    """Which of the chosen grams overlap the same gram before them."""
    q, text, g = at[chosen], of[chosen], h[chosen]
    order = np.lexsort((q, g, text))
    again = np.zeros(len(q), bool)
    same = (np.diff(text[order]) == 0) & (g[order][1:] == g[order][:-1]) & (np.diff(q[order]) < k)
    again[order[1:][same]] = True
    return again


def _lists(values, of, texts: int):
    """An Arrow column with the values of each text, in the order of `of`."""
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=texts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _chosen(batch, k: int, sure: int):
    """The anchors of a batch and what `_grams` says of them: grams of `k` words chosen by
    winnowing. Of every sure - k + 1 successive ones that with the least hash is one, so equal
    stretches of `sure` words hold an equal anchor."""
    at, of, h, valid, sizes = _grams(batch, k)
    if len(h) < sure:
        return np.zeros(0, np.int64), at, of, h
    starts = np.flatnonzero(at + sure <= sizes[of])
    least = np.lib.stride_tricks.sliding_window_view(h, sure - k + 1).argmin(axis=1)
    found = np.unique(starts + least[starts])
    return found[valid[found]], at, of, h


def anchor_counts(texts: DataFrame, k: int = GRAM_WORDS, sure: int = SURE_WORDS) -> DataFrame:
    """(g, n): how often anchors stand in some texts; a value has several rows."""
    def count(batches):
        for batch in _parts(batches):
            found, at, of, h = _chosen(batch, k, sure)
            g, n = np.unique(h[found[~_again(found, at, of, h, k)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])

    return texts.mapInArrow(count, "g long, n long")


def anchors(texts: DataFrame, k: int = GRAM_WORDS, sure: int = SURE_WORDS) -> DataFrame:
    """The anchors as rows (d, h, q, g)."""
    def choose(batches):
        for batch in _parts(batches):
            found, at, of, h = _chosen(batch, k, sure)
            took = pa.array(of[found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(took), batch.column("h").take(took), pa.array(at[found].astype(np.int32)),
                 pa.array(h[found].view(np.int64))], names=["d", "h", "q", "g"])

    return texts.mapInArrow(choose, "d long, h long, q int, g long")


def grams_near(texts: DataFrame, k: int = GRAM_WORDS, reach: int = REACH) -> DataFrame:
    """Every gram within `reach` words of the anchors at `marks`, one row per text `t` with its
    words per line; `again`: the gram overlaps the same one before it."""
    def near(batches):
        for batch in _parts(batches):
            at, of, h, valid, sizes = _grams(batch, k)
            text, q = _flat(batch, "marks")
            start = (np.cumsum(sizes) - sizes)[text]
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, start + np.maximum(q - reach, 0), 1)
            np.add.at(edge, start + np.minimum(q + reach + 1, sizes[text]), -1)
            chosen = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & valid)
            lines = [[len(line.split()) for line in text.split(b"\n")]
                     for text in batch.column("_text").cast(pa.binary()).to_pylist()]
            columns = [at[chosen].astype(np.int32), h[chosen].view(np.int64), _again(chosen, at, of, h, k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("t"), pa.array(lines, pa.list_(pa.int32())),
                 *(_lists(c, of[chosen], batch.num_rows) for c in columns)], names=_names(_GRAMS))

    return texts.mapInArrow(near, _GRAMS)


def whole_groups(batches, key: str):
    """Rows sorted by `key` as NumPy columns; rows of one value come together."""
    def joined(parts):
        table = pa.Table.from_batches(parts)
        return {name: table.column(name).to_numpy() for name in table.column_names}

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        changes = np.flatnonzero(np.diff(values)) + 1
        if len(changes) or held and values[0] != last:
            cut = int(changes[-1]) if len(changes) else 0
            held.append(batch.slice(0, cut))
            yield joined(held)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = values[-1]
    if held:
        yield joined(held)


def told_grams(grams: DataFrame, bits: int, k: int = GRAM_WORDS) -> DataFrame:
    """The grams that stand in several places: (t, at, n, first). A place is a number, t times
    2^bits and q; `at` is q, and 2^bits more if the gram is to be removed; `first` is its first place."""
    def tell(batches):
        for c in whole_groups(batches, "g"):
            place, again = c["place"] >> 1, c["place"] & 1
            starts = np.flatnonzero(np.append(True, np.diff(c["g"]) != 0))
            n = np.add.reduceat(1 - again, starts)
            sizes = np.diff(np.append(starts, len(place)))
            often = np.repeat(n > 1, sizes)
            place, first, n = place[often], np.repeat(place[starts], sizes)[often], np.repeat(n, sizes)[often]
            t, q = place >> bits, place & (1 << bits) - 1
            removed = (t != first >> bits) | (q >= (first & (1 << bits) - 1) + k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t, removed.astype(np.int64) << bits | q, n, first)],
                                             names=_names(_TOLD))

    flat = grams.select("t", F.inline(F.arrays_zip("g", "q", "again"))).select(
        "g", (F.shiftleft("t", bits + 1) + F.shiftleft(F.col("q").cast("long"), 1) + F.col("again").cast("long"))
        .alias("place"))
    return flat.repartition("g").sortWithinPartitions("g", "place").mapInArrow(tell, _TOLD)


def pieces_of(told: DataFrame, bits: int, k: int = GRAM_WORDS) -> DataFrame:
    """Grams that touch or overlap are one piece, with the first places `a`, `z` of its ends."""
    def join(batches):
        for c in whole_groups(batches, "t"):
            t, first, n = c["t"], c["first"], c["n"]
            removed, q = c["at"] >> bits, c["at"] & (1 << bits) - 1
            apart = (np.diff(t) != 0) | (np.diff(removed) != 0) | (np.diff(q) > k)
            starts = np.flatnonzero(np.append(True, apart))
            ends = np.append(starts[1:], len(t)) - 1
            columns = [t[starts], removed[starts] == 1, q[starts], q[ends] + k, first[starts], first[ends],
                       np.minimum.reduceat(first, starts) >> bits, np.maximum.reduceat(n, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_names(_PIECES))

    return told.repartition("t").sortWithinPartitions("t", "at").mapInArrow(join, _PIECES)


def numbered(texts: DataFrame) -> tuple[DataFrame, int]:
    """A stored copy with numbers `t` from 0 in the order of (d, h), and the rows. The driver sees
    one count per partition."""
    placed = stored(texts.orderBy("d", "h").withColumn("_i", F.monotonically_increasing_id())
                    .withColumn("_part", F.shiftright("_i", 33)))
    starts, n = [], 0
    for part, rows in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):
        starts.append((part, n - (part << 33)))
        n += rows
    begin = texts.sparkSession.createDataFrame(starts, "_part long, _begin long")
    return (placed.join(F.broadcast(begin), "_part").withColumn("t", F.col("_i") + F.col("_begin"))
            .drop("_i", "_part", "_begin")), n


def spans_of(pieces: DataFrame, least_words: int, bits: int, k: int = GRAM_WORDS) -> DataFrame:
    """Spans of rows (t, line_words, pieces), cut at line ends. Pieces that follow each other here
    and at their first places are one span over an edit, as long as the shingles of both sides
    have a Jaccard similarity of 0.8."""
    def join(batches):
        for batch in batches:
            out = []
            for t, lines, found in zip(*(batch.column(c).to_pylist() for c in ("t", "line_words", "pieces"))):
                for removed in (False, True):
                    spans = []
                    for p in sorted((p for p in found if p["removed"] == removed), key=lambda p: p["start"]):
                        a, z = (divmod(p[c], 1 << bits) for c in "az")
                        end_first = z[1] + k
                        if spans:
                            s = spans[-1]
                            gap, other = p["start"] - s["end"], a[1] - s["end_first"]
                            equal = s["equal"] + p["end"] - p["start"] - 4
                            lost = s["lost"] + gap + other + 8
                            if (s["place"] == a[0] and 0 <= gap and 0 <= other
                                    and 5 * equal >= 4 * (equal + lost)):
                                s.update(end=p["end"], end_first=end_first, place=z[0], equal=equal,
                                         lost=lost, first=min(s["first"], p["first"]), n=max(s["n"], p["n"]))
                                continue
                        spans.append(dict(start=p["start"], end=p["end"], end_first=end_first, first=p["first"],
                                          place=z[0], equal=p["end"] - p["start"] - 4, lost=0, n=p["n"]))
                    for s in spans:
                        if s["end"] - s["start"] < least_words:
                            continue
                        at = 0
                        for position, n in enumerate(lines):
                            start, end = max(s["start"], at), min(s["end"], at + n)
                            if start < end:
                                out.append((t, position, start - at, end - start, s["first"], s["n"], removed))
                            at += n
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*out)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=_names(_SPANS))

    return pieces.select("t", "line_words", "pieces").mapInArrow(join, _SPANS)


def repeated_runs(docs: DataFrame, gone: DataFrame, text: str = "text", least_words: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, position, start, n_words, class_id, n_occurrences, removed): spans of equal words,
    wherever they start and end. Words in the lines `gone` (d, position) are no occurrences."""
    lower = lowered(text)
    named = docs.select(F.coalesce("doc_id", F.lit(-2**63)).alias("d"), F.xxhash64(lower).alias("h"),
                        lower.alias("_text"))
    # Anchors are counted, not stored: only those that repeat in lines that stay become rows.
    lines_gone = stored(gone.groupBy("d").agg(F.collect_set("position").alias("gone")))
    few = gone.count() <= BROADCAST_RUNS
    texts = (named.join(F.broadcast(lines_gone) if few else lines_gone, "d", "left")
             .withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))))
    if not few:
        texts = stored(texts)
    often = stored(anchor_counts(texts).groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"))
    marks, n = numbered(anchors(texts).join(small_side(often, BROADCAST_RUNS), "g", "left_semi")
                        .groupBy("d", "h").agg(F.collect_set("q").alias("marks")))
    # Only texts with marks are shuffled, and as such: word hashes take more room than their letters.
    if BROADCAST_MARKS < n <= BROADCAST_RUNS:
        texts = texts.join(F.broadcast(marks.select("d", "h")), ["d", "h"], "left_semi")
    held = texts.join(F.broadcast(marks) if n <= BROADCAST_MARKS else marks, ["d", "h"])
    # One row per text; as rows of their own, grams are a hash and a place, dealt once by the
    # hash, and those that repeat once more by the text.
    grams = stored(grams_near(held))
    bits = 62 - max(n, 1).bit_length()
    pieces = pieces_of(told_grams(grams, bits), bits)
    by_text = stored(pieces.groupBy("t").agg(F.collect_list(F.struct(
        "removed", "start", "end", "a", "z", "first", "n")).alias("pieces")), NUMBER_ROWS)
    lines = grams.select("t", "line_words").dropDuplicates(["t"])
    spans = spans_of(by_text.join(lines, "t"), least_words, bits)
    names = marks.select("t", F.nullif("d", F.lit(-2**63)).alias("doc_id"))
    firsts = names.select(F.col("t").alias("first"), F.col("doc_id").alias("class_id"))
    if n <= BROADCAST_ROWS:
        names, firsts = F.broadcast(names), F.broadcast(firsts)
    return (spans.join(names, "t").join(firsts, "first")
            .select("doc_id", "position", "start", "n_words", "class_id", "n_occurrences", "removed"))


def repeated_passages(docs: DataFrame, text: str = "text") -> DataFrame:
    """Repeated lines, and repeated runs of sentences in the lines that stay."""
    spark = docs.sparkSession
    lines = settled(spark, lambda: repeated_paragraphs(docs, text)).withColumn("start", F.lit(0))
    # The surviving line of a class keeps its runs, also where a copy of its own row goes.
    gone = stored(lines.groupBy(F.coalesce("doc_id", F.lit(-2**63)).alias("d"), "position")
                  .agg(F.bool_and("removed").alias("all")).where("all").drop("all"))
    columns = ["doc_id", "position", "start", "n_words", "class_id", "n_occurrences", "removed"]
    runs = settled(spark, lambda: repeated_runs(docs, gone, text))
    return lines.select(columns).union(runs.select(columns))


def repeated_paragraphs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS,
                        steps: ShingleLinks | None = None) -> DataFrame:
    """One row per occurrence of a paragraph that repeats, equal or nearly so.

    Returns doc_id, position (line from 0), n_words, class_id (the document that holds the
    class's first occurrence), n_occurrences, removed.
    """
    steps = steps or ShingleLinks(**BANDS)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered(text).alias("_text"))
    kept = ["doc_id", "position", "n_words", "node"]
    sketched = stored(named.mapInArrow(
        lambda batches: steps.sketched(hashed_lines(batches, least_words), kept),
        "doc_id long, position int, n_words int, node binary, n long, sig binary"))
    place = F.struct(F.coalesce("doc_id", F.lit(-2**63)).alias("d"), F.col("position").alias("p"))
    where = sketched.groupBy("node").agg(F.min(place).alias("place"))

    def fetch(nodes):
        chosen = stored(where.join(small_side(nodes), "node").select("node", "place.d", "place.p"))
        # Only the documents that hold a chosen line are parted again, and only it is hashed.
        asked = stored(chosen.groupBy("d").agg(F.collect_list(F.struct("p", "node")).alias("chosen")))
        held = (named.withColumn("d", F.coalesce("doc_id", F.lit(-2**63))).join(small_side(asked), "d")
                .select("doc_id", "_text", "chosen"))
        return held.mapInArrow(lambda batches: hashed_lines(batches, least_words, True), _LINES).select("node", "words")

    _, edges = steps.run(sketched, fetch)
    roots = connected_components(edges)
    counts = sketched.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    rooted = stored(counts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    classes = (rooted.groupBy("root").agg(F.sum("n").alias("n_occurrences"), F.min("first").alias("first"))
               .where("n_occurrences > 1"))
    repeated = stored(rooted.select("node", "root").join(classes, "root").select("node", "root", "n_occurrences", "first"))
    rows = sketched.select("doc_id", "position", "n_words", "node", place.alias("place")).join(
        small_side(repeated), "node")
    # A repeated row may hold the first occurrence more than once: only one of them stays.
    # Rows at the first place are as few as that row's copies.
    at_first = F.col("place") == F.col("first")
    once = F.row_number().over(Window.partitionBy("root", "place").orderBy("n_words"))
    firsts = rows.where(at_first).withColumn("removed", once > 1)
    later = rows.where(~at_first).withColumn("removed", F.lit(True))
    return firsts.union(later).select(
        "doc_id", "position", "n_words", F.nullif(F.col("first.d"), F.lit(-2**63)).alias("class_id"),
        "n_occurrences", "removed")


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents without the lines and spans that `repeated_passages` removes.

    Words of a line from which a span was cut are joined by single spaces.
    """
    gone = (repeated_passages(docs, text).where("removed").select(
        "doc_id", F.struct("position", "start", (F.col("start") + F.col("n_words")).alias("end")).alias("g"))
        .groupBy("doc_id").agg(F.collect_set("g").alias("_barloom_gone")))

    def cut(line, i):
        own = F.filter("_barloom_gone", lambda g: g["position"] == i)
        left = F.filter(F.split(F.btrim(F.regexp_replace(line, GAP, " ")), " "),
                        lambda _, k: ~F.exists(own, lambda g: (k >= g["start"]) & (k < g["end"])))
        return F.when(F.size(own) == 0, line).when(F.size(left) > 0, F.array_join(left, " "))

    told = docs.join(gone, "doc_id", "left")
    kept = F.array_join(F.filter(F.transform(F.split(F.col(text), "\n", -1), cut), lambda x: x.isNotNull()), "\n")
    return told.withColumn(text, F.when(F.col("_barloom_gone").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
