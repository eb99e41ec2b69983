"""Packing of tokenised documents into sequences by linear grouping and a few-size configuration programme."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weirflow.llm.common import freeze, id_and_text, slices

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
LARGE = CAPACITY // 3  # at most three large pieces share a sequence; shorter pieces fill what configurations leave
GROUPS = 32
SHARES = (1.0, 0.9, 0.75, 0.5)  # of each configuration's uses that are tried; the rest is left to best fit
SALTS = 256  # a length may be that of a third of all pieces, so ranks are counted per (length, salt)
CACHE_WORDS = 600_000
_BLANK = re.compile("[ \t\n\r]+")
_BEHIND = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which starts tokens of its own

# fixed rule of byte-level tokenizers: printable bytes stand for themselves, the others are signs from 256 on, in order
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


# ---- tokens


class WordIds(dict):
    """Words to the little-endian bytes of their ids.

    The tokenizer drops white space and never joins text across it, so the ids of a text are those of its words, and
    each distinct word is encoded once. Nor does it join letters and punctuation, and it lower-cases: a word of Latin
    letters with punctuation behind is the ids of its lower-case letters and those of its punctuation.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.merges = tokenizer, tokenizer.model

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(_BEHIND)
        if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250" and "\u0130" not in letters):
            low, behind = letters.lower(), word[len(letters):]
            if behind or low != word:
                out = self[word] = self[low] + self[behind] if behind else self[low]
                return out
            seen = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_SIGNS)
            ids = [t.id for t in self.merges.tokenize(seen)]  # one piece: nothing to normalise or to cut
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


def token_bytes(text: str, known: WordIds) -> bytes:
    if len(known) > CACHE_WORDS:
        known.clear()
    # split() also cuts at four control characters that are no white space to the tokenizer
    words = _BLANK.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
    return b"".join(map(known.__getitem__, words)) + np.array([END_ID], "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32`: every document's ids with the end id, cut at `CAPACITY` if longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(Tokenizer.from_file(tokenizer_path))
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = memoryview(token_bytes(text or "", known))
                for n, start in enumerate(range(0, len(ids) // 4, CAPACITY)):
                    cut = ids[4 * start:4 * (start + CAPACITY)]
                    rows.append((doc_id, n, start, len(cut) // 4, zlib.crc32(cut)))
            if rows:
                d, n, s, k, c = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, k, c))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the plan: made from the counts per length alone


def _simplex(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (rows of counts per size) and how often each is used, fractional, by column generation.

    The classical cutting-stock programme: a basis of one configuration per size, prices from its inverse, and a new
    configuration from an unbounded knapsack over the capacity until none is worth more than one sequence.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.nonzero(sizes <= c)[0]
            worth = best[c - sizes[fits]] + price[fits]
            j = int(np.argmax(worth))
            if worth[j] > best[c - 1]:
                best[c], take[c] = worth[j], fits[j]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if take[c] < 0 or best[c] == best[c - 1]:
                c -= 1
            else:
                column[take[c]] += 1
                c -= int(sizes[take[c]])
        way = np.linalg.solve(basis, column)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        x = np.maximum(x - step * way, 0)
        basis[:, out], x[out] = column, step
    return np.rint(basis.T).astype(np.int64), x


class Plan:
    """Stretches of sequences of equal make-up, built from `count[length]` without looking at any document.

    Documents of one length are numbered from 0; a stretch of `n` sequences takes `each` documents of a length per
    sequence, so one row of `placed` states where a whole range of documents goes:
    (length, first number, end number, first sequence, per sequence, offset).
    """

    def __init__(self, count: np.ndarray, configurations: list[tuple[list[tuple[list[int], int]], float]], share: float):
        self.left = count.astype(np.int64).copy()  # documents of each length still to be placed
        self.used = np.zeros_like(self.left)
        self.placed: list[tuple[int, int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = {}  # room left: stretches (first sequence, number)
        self.next = 0
        if self.left[CAPACITY]:
            self.next = int(self.left[CAPACITY])
            self._put(CAPACITY, 0, self.next, 1, CAPACITY)
        for parts, times in configurations:
            self._substitute(parts, int(times * share + 1e-6))
        self._best_fit()

    def _put(self, length: int, first: int, n: int, each: int, room: int) -> None:
        lo = int(self.used[length])
        self.placed.append((length, lo, lo + n * each, first, each, CAPACITY - room))
        self.used[length] += n * each
        self.left[length] -= n * each

    def _keep(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.room.setdefault(room, []).append((first, n))

    def _substitute(self, parts: list[tuple[list[int], int]], n: int) -> None:
        """Fill `n` sequences of one configuration with actual documents, in stretches in which no length runs out."""
        while n > 0:
            take, most = [], n
            for members, k in parts:
                own = k
                for v in members:
                    if not own:
                        break
                    use = min(own, int(self.left[v]))
                    if use:
                        take.append((v, use))
                        own -= use
                if own:
                    return  # a group is used up: what is left goes to best fit
            for v, use in take:
                most = min(most, int(self.left[v]) // use)
            room = CAPACITY
            for v, use in take:
                self._put(v, self.next, most, use, room)
                room -= v * use
            self._keep(room, self.next, most)
            self.next += most
            n -= most

    def _best_fit(self) -> None:
        """Longest first, each document into the sequence with the least room that holds it, else into a new one."""
        rooms = np.zeros(CAPACITY + 1, bool)
        for r in self.room:
            rooms[r] = True
        for v in np.nonzero(self.left)[0][::-1].tolist():
            while self.left[v] > 0:
                at = int(np.argmax(rooms[v:])) + v if rooms[v:].any() else 0
                if not at:
                    at, n = CAPACITY, -(-int(self.left[v]) // (CAPACITY // v))
                    self.room[at] = [(self.next, n)]
                    rooms[at] = True
                    self.next += n
                first, n = self.room[at].pop()
                if not self.room[at]:
                    del self.room[at]
                    rooms[at] = False
                each = min(at // v, int(self.left[v]))
                whole = min(n, int(self.left[v]) // each)
                self._put(v, first, whole, each, at)
                for room, start, number in ((at - v * each, first, whole), (at, first + whole, n - whole)):
                    if room and number:
                        self._keep(room, start, number)
                        rooms[room] = True

    def table(self) -> dict[str, np.ndarray]:
        """`placed` sorted for a search by (length, number)."""
        rows = np.array(sorted(self.placed), np.int64).reshape(-1, 6)
        return {"key": rows[:, 0] << 44 | rows[:, 1], "lo": rows[:, 1], "first": rows[:, 3], "each": rows[:, 4], "offset": rows[:, 5]}


def configurations(count: np.ndarray) -> list[tuple[list[tuple[list[int], int]], float]]:
    """Linear grouping: large lengths, longest first, in groups of equal cardinality, each rounded up to its longest.

    The programme over the groups' sizes gives configurations: lists of (lengths of a group, documents of it per
    sequence), with how often each is used, most used first.
    """
    lengths = np.nonzero(count[LARGE:CAPACITY])[0][::-1] + LARGE
    total = int(count[lengths].sum())
    if not total:
        return []
    before = np.cumsum(count[lengths]) - count[lengths]
    group = np.minimum(before * GROUPS // total, GROUPS - 1)
    names, first = np.unique(group, return_index=True)
    members = [[int(v) for v in lengths[group == g]] for g in names]
    demand = np.array([sum(int(count[v]) for v in m) for m in members], float)
    shapes, times = _simplex(lengths[first].astype(np.int64), demand, CAPACITY)
    order = np.argsort(-times, kind="stable")
    return [([(m, int(k)) for m, k in zip(members, shapes[i]) if k], float(times[i])) for i in order]


def planned(count: np.ndarray) -> Plan:
    """The plan of fewest sequences among the tried shares of the configurations.

    Rounding up costs room when few small documents are there to use it; then fewer documents are left to configurations.
    """
    found = configurations(count)
    return min((Plan(count, found, share) for share in SHARES), key=lambda p: p.next)


def _numbered(cut: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Pieces with `number`, 0 to n - 1 within their length, and the number of pieces of each length.

    Ranks are taken inside (length, salt) and moved by the counts of the lower salts, so a length that a third of all
    pieces share is spread over `SALTS` groups. The counts are at most `CAPACITY` x `SALTS` rows.
    """
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    counts = freeze(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    lower = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "salt", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("shift"))
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(shift, ["length", "salt"])
    total = np.zeros(CAPACITY + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        total[r["length"]] = r["n"]
    return ranked.withColumn("number", F.col("own") + F.col("shift")).drop("salt", "own", "shift"), total


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset`: all documents in few sequences of `CAPACITY`.

    Only documents of more than `CAPACITY` tokens are cut. The counts per length (at most `CAPACITY` numbers, whatever
    the corpus) go to the driver. There, large lengths are rounded up within groups of equal cardinality, a linear
    programme over these few sizes chooses configurations, actual documents take their places and small ones are
    best-fitted. The plan speaks of ranges of equally long documents, so it is bounded too; each piece looks its place up.

    Null or empty text is the one end id. Repeated rows are packed one by one, as are rows with a null id. An empty
    table gives no rows.
    """
    cut = freeze(pieces(docs, tokenizer_path))
    numbered, count = _numbered(cut)
    shared = docs.sparkSession.sparkContext.broadcast(planned(count).table())

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        for part in batches:
            if len(part):
                number = part["number"].to_numpy()
                at = np.searchsorted(plan["key"], part["length"].to_numpy() << 44 | number, "right") - 1
                nth = number - plan["lo"][at]
                part["sequence_id"] = plan["first"][at] + nth // plan["each"][at]
                part["offset"] = plan["offset"][at] + nth % plan["each"][at] * part["length"].to_numpy()
                yield part.drop(columns="number")

    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select(*fields, "number").mapInPandas(place, schema)
