"""Best-fit packing of tokenised documents with a dominance reduction before it.

What a packing looks like depends on lengths only, and a length is at most the capacity.
So Spark tokenises and counts pieces per length; the plan is made on that histogram (at
most `capacity` rows, whatever the corpus); and every piece finds its place from its rank
among the pieces of its length. Ranks come from windows over (length, salt), so that a
length which a third of all pieces share is many window partitions.

The plan. First the reduction of Martello and Toth: going down from the longest item, a
set that dominates every other set with that item is fixed for good - the item alone if
nothing fits beside it; with the longest partner if that fills the sequence exactly, if
no two items fit beside it, or if no pair that fits beside it is longer than the partner.
It is repeated until nothing changes. The rest goes by best fit, longest first: always to
the fullest sequence with room. Both work on counts: equal lengths move in one step.

Defined results: a null or empty text is the end token alone; a repeated row is a
document of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import stored

CAPACITY = 4096
END_TOKEN = 1
VOCABULARY = "word_bpe_49k.json"

#: Words, and parts of words, whose ids a Python worker remembers (some 200 bytes each)
#: before it forgets them all.
REMEMBERED_WORDS = 250_000
REMEMBERED_PARTS = 300_000
#: Pieces in one window partition, about.
RANKED_TOGETHER = 65_536

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SEPARATORS = "\x1c\x1d\x1e\x1f"  # white space for str.split, but not for the tokenizer


def _byte_characters() -> dict[int, int]:
    """The public byte-level scheme: bytes that are no visible Latin-1 character, in order, are
    the characters from 256 on; the others are themselves."""
    hidden = [*range(33), *range(127, 161), 173]
    return {byte: 256 + i for i, byte in enumerate(hidden)}


_BYTES = _byte_characters()


class WordIds:
    """Token ids of texts, word by word.

    The vocabulary's splitter never joins across white space, so a text's ids are those
    of its words in turn. A word met for the first time is split further, as that
    splitter does it, and the vocabulary's model gets the parts. Both are remembered.
    """

    #: The splitter's own pattern, used on words up to U+024F in lower case, where
    #: normalisation changes nothing else. Other words go to the tokenizer whole.
    parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    plain = re.compile("[\x21-\x84\x86-\x9f\xa1-\u024f]+")

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(
            vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers."""
        # A text with separators that only Python takes for white space stays whole.
        split = [[t] if any(c in t for c in _SEPARATORS) else t.split() for t in texts]
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        if len(self.known) > REMEMBERED_PARTS:
            self.known.clear()
        new = set().union(*split).difference(self.words)
        odd = [w for w in new if not self.plain.fullmatch(w)]
        for word, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.words[word] = np.asarray(found.ids, "<u4").tobytes()
        for word in new.difference(odd):
            ids = b""
            for part in self.parts.findall(word.lower()):
                own = self.known.get(part)
                if own is None:
                    # The model reads bytes as characters, see `_byte_characters`.
                    read = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
                    own = self.known[part] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(read)])
                ids += own
            self.words[word] = ids
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


@lru_cache(maxsize=1)
def word_ids(vocabulary: str) -> WordIds:
    """One per Python worker, so that what it remembers outlives a task."""
    return WordIds(vocabulary)


def tokenised_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY,
                     end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `capacity` ids; only longer ones are cut.

    Returns doc_id, piece, start, length, ids_crc32 and, if asked for, `ids`.
    """
    end = np.asarray([end_token], "<u4").tobytes()

    def cut(batches):
        encode = word_ids(vocabulary)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = [t or "" for t in texts.slice(at, 256).to_pylist()]
                for doc, data in zip(ids.slice(at, 256).to_pylist(), encode(part)):
                    data += end
                    for piece, start in enumerate(range(0, len(data) // 4, capacity)):
                        own = data[4 * start:4 * (start + capacity)]
                        rows.append((doc, piece, start, len(own) // 4, zlib.crc32(own), own))
                doc, piece, start, length, crc, own = zip(*rows)
                out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in own],
                                        pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _sets_that_dominate(left: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """Fixed sets as (length, partner or 0, how many), taken out of `left` (counts by length)."""
    fixed = []
    present = [int(x) for x in np.flatnonzero(left)]  # ascending

    def take(length, n):
        left[length] -= n
        if not left[length]:
            del present[bisect_left(present, length)]

    def smallest(length):  # the three smallest items beside one of `length`
        out = []
        for x in present:
            out += [x] * min(3 - len(out), int(left[x]) - (x == length))
            if len(out) == 3:
                break
        return out

    def longest_pair(length, room):  # the largest sum of two items beside one of `length` that fits
        beside = [x for x in present if x <= room and left[x] - (x == length) > 0]
        best, i, j = 0, 0, len(beside) - 1
        while i < j:
            total = beside[i] + beside[j]
            if total <= room:
                best, i = max(best, total), i + 1
            else:
                j -= 1
        if i == j and 2 * beside[i] <= room and left[beside[i]] - (beside[i] == length) > 1:
            best = max(best, 2 * beside[i])
        return best

    changed = True
    while changed:
        changed = False
        for length in sorted(present, reverse=True):
            while left[length]:
                room = capacity - length
                small = smallest(length)
                if not small or small[0] > room:
                    fixed.append((length, 0, int(left[length])))
                    take(length, int(left[length]))
                    changed = True
                    continue
                at = bisect_left(present, room + 1) - 1
                if present[at] == length and left[length] == 1:
                    at -= 1
                partner = present[at]
                one_more = len(small) < 2 or small[0] + small[1] > room
                two_more = len(small) < 3 or sum(small) > room
                if not (partner == room or one_more
                        or two_more and partner >= longest_pair(length, room)):
                    break
                n = int(left[length]) // 2 if partner == length else int(min(left[length], left[partner]))
                fixed.append((length, partner, n))
                take(length, n)
                take(partner, n)
                changed = True
    return fixed


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for every item: rows (length, first, n, per, sequence, offset).

    The items of a length with ranks first .. first + n - 1 go to sequences from
    `sequence` on, `per` of them to each, the first at `offset`.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    given = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequence = 0

    def give(length, n, per, first_sequence, offset):
        rows.append((length, int(given[length]), n, per, first_sequence, offset))
        given[length] += n

    for length, partner, n in _sets_that_dominate(left, capacity):
        if partner == length:
            give(length, 2 * n, 2, sequence, 0)
        else:
            give(length, n, 1, sequence, 0)
            if partner:
                give(partner, n, 1, sequence, length)
        sequence += n

    rooms: list[int] = []  # ascending, those with open sequences
    open_by_room: dict[int, deque] = {}  # room: runs (first sequence, how many)

    def put_back(room, first, n):
        if n and room:
            if room not in open_by_room:
                open_by_room[room] = deque()
                insort(rooms, room)
            open_by_room[room].append((first, n))

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_by_room[room].popleft()
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
            else:
                room, first = capacity, sequence
                n = -(-todo // (capacity // length))
                sequence += n
            # A sequence that has just taken one is the fullest with room: it takes on.
            per = min(room // length, todo)
            used = min(n, todo // per)
            give(length, used * per, per, first, capacity - room)
            put_back(room - per * length, first, used)
            todo -= used * per
            put_back(room, first + used, n - used)
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` (a `length` of 1 .. capacity each) with `sequence_id` and `offset`."""
    pieces = stored(pieces)
    counts = pieces.groupBy("length").count().collect()  # one row per length at most
    places = plan({r["length"]: r["count"] for r in counts}, capacity)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    total = sum(r["count"] for r in counts)
    salted = pieces.withColumn("_salt", F.pmod(
        F.xxhash64(*key), F.lit(max(1, -(-total // RANKED_TOGETHER)))))
    upto = Window.partitionBy("length").orderBy("_salt")
    base = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", (F.sum("count").over(upto) - F.col("count")).alias("_base"))
    ranked = (salted.withColumn("_rn", F.row_number().over(
        Window.partitionBy("length", "_salt").orderBy(*key)) - 1)
        .join(base, ["length", "_salt"])
        .select(*pieces.columns, (F.col("_base") + F.col("_rn")).alias("_rank")))
    # Length and rank as one ascending number; ranks stay below 2^48.
    starts = places[:, 0] << 48 | places[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            row = places[np.searchsorted(starts, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence = row[:, 4] + nth // row[:, 3]
            offset = row[:, 5] + nth % row[:, 3] * length
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=[*[n for n in batch.schema.names if n != "_rank"], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY,
                   end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs whole documents."""
    return pack(tokenised_pieces(docs, vocabulary, capacity, end_token, with_ids), capacity)
