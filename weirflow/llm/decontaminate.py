"""Benchmark decontamination by template canonicalisation, hash joins of template windows and slot consistency."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import freeze, id_and_text, raw_texts, slices
from weirflow.llm.rows import numbered, without

WINDOW = 8  # template tokens of a window; a shorter item is one window
MIN_LITERALS = 4  # literal words of a window that matches with any values (3 in items of fewer than eight tokens); others match with the same
COVERED = 0.8  # share of an item's coverable tokens that one document must hold in one alignment
DRIFT = 5  # parts of an alignment may be shifted against each other by a fifth of the item's tokens and a window
BROADCAST_WINDOWS = 4_000_000  # up to so many benchmark windows (32 MB of hashes) documents are probed before a shuffle
CACHE_WORDS = 300_000
GROUP_WORDS = 1 << 16  # short texts are read together up to so many words, for arrays that are long but stay in cache
PRIME = np.uint64(0x9E3779B97F4A7C15)
STRICT = np.uint64(0x5851F42D4C957F2D)
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3

# fixed values: common units, lower case
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz pound pounds ton tons gram grams "
    b"ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    b"months year years kb mb gb tb hz khz mhz ghz w kw kwh v a j kj cal kcal c f k mph kmh rpm usd eur gbp dollar "
    b"dollars euro euros cent cents percent % $".split()
)
_NUMBER = re.compile(rb"[+-]?[0-9][0-9.,:/-]*(%|st|nd|rd|th)?")
_GLUED = re.compile(rb"([+-]?[0-9][0-9.,:/-]*)([a-z]+)")
_EDGE = b"!\"#$&'()*,-./:;<=>?@[\\]^_`{|}~"


class Words(dict):
    """Word bytes to a row of the attribute columns, filled on the first sight of a word.

    A number with a unit glued to it is two tokens: `unit` is the row of the second, else -1.
    """

    def __init__(self):
        super().__init__()
        self.template, self.value, self.kind, self.ends = array("Q"), array("Q"), array("b"), array("b")
        self.unit = array("q")

    def add(self, low: bytes, kind: int, ends: bool, unit: int = -1) -> int:
        self.template.append(xxhash.xxh64_intdigest(low, 1))
        self.value.append(xxhash.xxh64_intdigest(low, 2) | 1)
        self.kind.append(kind)
        self.ends.append(ends)
        self.unit.append(unit)
        return len(self.kind) - 1

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_EDGE + b"%") or word.strip(_EDGE) or word
        text = bare.decode("utf-8", "replace")
        low = text.lower().encode("utf-8", "surrogatepass")
        ends = word.rstrip(b"\"')]}*#%$&")[-1:] in (b".", b"!", b"?", b":")
        glued = _GLUED.fullmatch(low)
        unit = -1
        if _NUMBER.fullmatch(bare):
            kind = NUMBER
        elif glued and glued[2] in UNITS:
            unit = self.add(glued[2], UNIT, ends)
            low, kind, ends = glued[1].strip(_EDGE), NUMBER, False
        elif low in UNITS and bare != b"a":  # an article
            kind = UNIT
        else:
            kind = NAME if text[:1].isupper() and text[1:2].islower() else LITERAL
        row = self[word] = self.add(low, kind, ends, unit)
        return row

    def renew(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.__init__()


def templates(texts: list[list[bytes]], known: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Template tokens of texts, one after another, and the value in each slot (0 for a literal word), by reading of sentence starts.

    Gives the reading of each text, and of each token its text, the token and the slot. A number, a unit after a number and
    a capitalised word inside a sentence become placeholders; a run of name words is one slot. A capitalised word that
    begins a sentence may be a name or not: in reading 1 it is a literal, lower-cased, in reading 2 a name. A text without
    such words has one template for both, as reading 3.
    """
    known.renew()
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, n.sum())
    own = np.repeat(np.arange(len(texts)), n)
    unit = np.frombuffer(known.unit, np.int64)[at]
    glued = np.nonzero(unit >= 0)[0]
    if len(glued):
        at, own = np.insert(at, glued + 1, unit[glued]), np.insert(own, glued + 1, own[glued])
    kind = np.frombuffer(known.kind, np.int8)[at]
    token = np.frombuffer(known.template, np.uint64)[at]
    value = np.frombuffer(known.value, np.uint64)[at]
    ends = np.frombuffer(known.ends, np.int8)[at]
    first = np.ones(len(at), bool)
    first[1:] = own[1:] != own[:-1]
    after_number = ~first
    after_number[1:] &= kind[:-1] == NUMBER
    first[1:] |= ends[:-1] == 1
    kind = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
    start = (kind == NAME) & first
    two = np.zeros(len(texts), bool)
    two[own[start]] = True
    yield np.where(two, 1, 3), *_slots(np.where(start, LITERAL, kind), token, value, first, own)
    if two.any():
        both = two[own]
        yield np.full(len(texts), 2), *_slots(kind[both], token[both], value[both], first[both], own[both])


def _slots(kind: np.ndarray, token: np.ndarray, value: np.ndarray, first: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    name = kind == NAME
    joined = np.zeros(len(kind), bool)
    joined[1:] = name[1:] & name[:-1] & ~first[1:]
    start = np.nonzero(~joined)[0]
    if len(start) < len(kind):
        value = np.add.reduceat(value, start)
        kind, token, own = kind[start], token[start], own[start]
    slot = kind != LITERAL
    return own, np.where(slot, kind.astype(np.uint64), token), np.where(slot, value, np.uint64(0))


def _groups(texts: list[bytes], most: int) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Places and words of the texts that have any, in groups that reach at least `most` words, but for the last."""
    places, held, n = [], [], 0
    for place, text in enumerate(texts):
        words = text.split()
        if words:
            places.append(place)
            held.append(words)
            n += len(words)
        if n >= most:
            yield places, held
            places, held, n = [], [], 0
    if held:
        yield places, held


def _mixed(out: np.ndarray, token: np.ndarray) -> np.ndarray:
    out = (out ^ token) * PRIME
    return out ^ out >> np.uint64(29)


def windows(token: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of `size` template tokens, and whether it is loose: has literal words enough for any values.

    The hash of a window that is not loose includes the values in its slots, so that only the same values match.
    """
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = _mixed(out, token[k:k + n])
    literal = np.concatenate([[0], np.cumsum(slot == 0)])
    need = MIN_LITERALS if size == WINDOW else min(3, MIN_LITERALS)
    loose = literal[size:] - literal[:-size] >= need
    strict = np.nonzero(~loose)[0]
    if len(strict):
        code = _mixed(out[strict], STRICT)
        for k in range(size):
            code = _mixed(code, slot[strict + k])
        out[strict] = code
    return out, loose


def _rows(docs: DataFrame, probe: np.ndarray | None, sizes: list[int] | None) -> DataFrame:
    """Template windows of `docs(doc_id, text)`: `doc_id, row_id, pos, size, tokens, reading, hash,
    loose, slots`.

    With `probe` (sorted hashes) only windows that occur in it; with `sizes` None each text has its own size, at most
    `WINDOW`, as benchmark items do.
    """
    shared = docs.sparkSession.sparkContext.broadcast(probe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = shared.value, Words()
        if wanted is not None:
            near = np.zeros(1 << 20, bool)
            near[(wanted >> np.uint64(44)).astype(np.int64)] = True
        row = (TaskContext.get().partitionId() << 36) + 1
        for part in slices(batches):
            out = []
            # an item is a group of its own, as its size is
            for places, texts in _groups(raw_texts(part.column("text")), GROUP_WORDS if sizes is not None else 1):
                places = np.array(places)
                for reading, own, token, slot in templates(texts, known):
                    whole = np.bincount(own, minlength=len(texts))
                    end = np.cumsum(whole)
                    for size in sizes if sizes is not None else [min(WINDOW, len(token))]:
                        code, loose = windows(token, slot, size)
                        at = np.arange(len(code))
                        if wanted is not None:
                            at = at[near[(code >> np.uint64(44)).astype(np.int64)]]
                            place = np.minimum(np.searchsorted(wanted, code[at]), len(wanted) - 1)
                            at = at[wanted[place] == code[at]]
                        at = at[at + size <= end[own[at]]]  # a window ends in the text that it begins in
                        if len(at):
                            of = own[at]
                            held = slot[at[:, None] + np.arange(size)]
                            out.append((places[of], size, whole[of], at - (end - whole)[of], code[at], held, loose[at], reading[of]))
            if out:
                n = [len(x[0]) for x in out]
                held = np.concatenate([x[5].ravel() for x in out]).view(np.int64)
                each = np.repeat([x[1] for x in out], n)
                place, tokens, pos, code, loose, reading = (np.concatenate([x[i] for x in out]) for i in (0, 2, 3, 4, 6, 7))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(place)),
                        pa.array(row + place),
                        pa.array(pos),
                        pa.array(each.astype(np.int32)),
                        pa.array(tokens),
                        pa.array(reading.astype(np.int32)),
                        pa.array(code.view(np.int64)),
                        pa.array(loose),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), pa.array(held)),
                    ],
                    ["doc_id", "row_id", "pos", "size", "tokens", "reading", "hash", "loose", "slots"],
                )
            row += part.num_rows

    schema = "doc_id long, row_id long, pos long, size int, tokens long, reading int, hash long, loose boolean, slots array<long>"
    return docs.mapInArrow(run, schema)


def _covered(starts, size):
    """Tokens under the windows of `size` that begin at the given distinct places; null without any."""
    tail = F.slice(starts, F.lit(2), F.size(starts))
    some = size + F.aggregate(
        F.arrays_zip(F.slice(starts, F.lit(1), F.greatest(F.size(starts) - 1, F.lit(0))).alias("a"), tail.alias("b")),
        F.lit(0).cast("long"),
        lambda s, x: s + F.least(x["b"] - x["a"], size.cast("long")),
    )
    return F.when(F.size(starts) > 0, some)


def _places(column: str, only=None):
    return F.sort_array(F.collect_set(F.col(column) if only is None else F.when(only, F.col(column))))


def _edges(at: np.ndarray, slot: np.ndarray, whole: int) -> np.ndarray:
    """Which of the covered tokens at the ascending places are slots at an inner end of an unbroken run."""
    out, literal = np.zeros(len(at), bool), ~slot
    for run in np.split(np.arange(len(at)), np.nonzero(np.diff(at) > 1)[0] + 1):
        fixed = np.nonzero(literal[run])[0]
        if at[run[0]] > 0:
            out[run[: fixed[0] if len(fixed) else len(run)]] = True
        if at[run[-1]] < whole - 1:
            out[run[fixed[-1] + 1 if len(fixed) else 0:]] = True
    return out


def _united(at: np.ndarray, pos: np.ndarray, item: np.ndarray, doc: np.ndarray, whole: int) -> tuple[int, bool]:
    """Tokens that one alignment covers of an item of `whole` tokens, and whether all slot values in it are the same.

    `at` and `pos` are places of equal windows in item and document, `item` and `doc` their slots. The alignment takes
    whole diagonals, the widest first: of each the tokens that lie in the same order in both texts as what is taken,
    unless their values would break the one-to-one map. A slot next to an edit may be part of it ('5' that became
    '1 000' equals both numbers), so one that doesn't fit the map is only not covered.
    """
    order = np.lexsort((at, pos - at))
    at, pos, item, doc = at[order], pos[order], item[order], doc[order]
    diagonals = []
    for own in np.split(np.arange(len(at)), np.nonzero(np.diff(pos - at))[0] + 1):
        places, one = np.unique(at[own][:, None] + np.arange(item.shape[1]), return_index=True)
        a, b = item[own].ravel()[one], doc[own].ravel()[one]
        diagonals.append((-len(places), not (a == b).all(), len(diagonals), int(pos[own[0]] - at[own[0]]), places, a, b))
    taken, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    to, back, edges = {}, {}, []

    def fits(i: int, d: int) -> bool:
        return to.get(i, d) == d and back.get(d, i) == i

    for *_, shift, places, a, b in sorted(diagonals, key=lambda x: x[:3]):
        x, y = np.searchsorted(taken, places), np.searchsorted(held, places + shift)
        free = (x == np.searchsorted(taken, places, "right")) & (y == np.searchsorted(held, places + shift, "right"))
        free &= x == y
        if not free.any():
            continue
        places, a, b = places[free], a[free], b[free]
        edge = _edges(places, a != 0, whole)
        inner = (a != 0) & ~edge
        pairs = set(zip(a[inner].tolist(), b[inner].tolist()))
        if len({i for i, _ in pairs}) == len(pairs) == len({d for _, d in pairs}) and all(fits(i, d) for i, d in pairs):
            to.update(pairs)
            back.update((d, i) for i, d in pairs)
            edges += zip(places[edge].tolist(), (places[edge] + shift).tolist(), a[edge].tolist(), b[edge].tolist())
            taken = np.sort(np.concatenate([taken, places[~edge]]))
            held = np.sort(np.concatenate([held, places[~edge] + shift]))
    own, other = set(taken.tolist()), set(held.tolist())
    for place, there, i, d in edges:
        if place not in own and there not in other and fits(i, d):
            own.add(place)
            other.add(there)
            to[i], back[d] = d, i
    return len(own), all(i == d for i, d in to.items())


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = []
        columns = [part.column(c).to_pylist() for c in ("doc_id", "item_id", "size", "whole", "coverable")]
        for hits, doc_id, item_id, size, whole, coverable in zip(part.column("hits"), *columns):
            at, pos, loose, item, doc = hits.values.flatten()
            at, pos, loose = at.to_numpy(), pos.to_numpy(), loose.to_numpy(zero_copy_only=False)
            item, doc = (x.flatten().to_numpy().reshape(-1, size) for x in (item, doc))
            covered, same = _united(at, pos, item, doc, whole)
            coverage, same = covered / whole, same and covered >= COVERED * whole
            if loose.any():
                most = covered if loose.all() else _united(at[loose], pos[loose], item[loose], doc[loose], whole)[0]
                coverage = max(coverage, most / coverable)
            if coverage >= COVERED:
                rows.append((doc_id, item_id, coverage, same))
        if rows:
            types = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), types)], ["doc_id", "item_id", "coverage", "same"]
            )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id, item_id, coverage, exact`: documents that hold a benchmark item, word for word or re-parameterised.

    Texts become templates: numbers, units after numbers and names turn into typed placeholders. Windows of eight
    template tokens are joined by hash; a window with fewer than `MIN_LITERALS` literal words only matches with the same
    values in its slots. The windows of one alignment of document and item must cover at least `COVERED` of the item, or
    of what the item's windows with enough literal words cover, and the values in the slots must map one to one (the same
    value always became the same other value). An alignment may have tokens inserted, deleted or replaced by another
    number of tokens between windows, up to a shift of a window and a fifth of the item; a part of fewer than `WINDOW`
    tokens between two such edits has no window and is not covered. `exact` says that the alignment covers as much of the whole item with all
    slot values equal too. Whole texts are read and every window counts. A capitalised word at the start of a sentence is
    read once as a literal and once as a name, and either reading may match; `5km` is read as `5 km`.

    Documents are probed against the item hashes before any shuffle while these number at most `BROADCAST_WINDOWS`; a
    larger benchmark is joined by shuffling all windows, with the same result.

    Null or blank texts and items match nothing; an item without a window of enough literal words, such as a list of
    numbers or one of fewer than three words, is only matched word for word. Items or documents
    without an id count under a null id. Repeated documents and items give one row per pair of ids. Empty tables on
    either side give no rows.
    """
    items = id_and_text(benchmark, key="item_id")
    held = freeze(_rows(items, None, None))
    few, sizes = held.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("size"))).first()
    probe = None
    if 0 < few <= BROADCAST_WINDOWS:
        hashes = held.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64).view(np.uint64)
        probe = np.sort(hashes)
    found = _rows(id_and_text(docs), probe, list(sizes or []))
    item = held.groupBy("row_id", "reading", "size").agg(
        F.first("doc_id").alias("item_id"), F.first("tokens").alias("whole"), _places("pos", F.col("loose")).alias("starts")
    )
    item = item.select(F.col("row_id").alias("item_row"), F.col("reading").alias("item_reading"), "item_id", "whole", _covered(F.col("starts"), F.col("size")).alias("coverable"))
    side = held.select(
        "hash",
        "size",
        F.col("row_id").alias("item_row"),
        F.col("reading").alias("item_reading"),
        F.col("pos").alias("item_pos"),
        F.col("slots").alias("item_slots"),
        F.col("tokens").alias("whole"),
    )
    common = F.col("reading").bitwiseAND(F.col("item_reading")) != 0
    pairs = found.join(side, ["hash", "size"]).filter(common)
    half, diagonal = F.expr(f"whole div {DRIFT} + {WINDOW}"), F.col("pos") - F.col("item_pos")
    band = F.array(2 * F.floor(diagonal / (2 * half)), 2 * F.floor((diagonal + half) / (2 * half)) + 1)
    pairs = pairs.withColumn("band", F.explode(band))
    banded = pairs.groupBy("doc_id", "row_id", "reading", "item_row", "item_reading", "size", "whole", "band").agg(
        _places("item_pos").alias("starts"),
        _places("item_pos", F.col("loose")).alias("loose_starts"),
        F.collect_list(F.struct("item_pos", "pos", "loose", "item_slots", "slots")).alias("hits"),
    )
    # what all windows of a band cover together bounds what an alignment in it can cover
    all_ = _covered(F.col("starts"), F.col("size")) >= COVERED * F.col("whole")
    loose = _covered(F.col("loose_starts"), F.col("size")) >= COVERED * F.col("coverable")
    likely = banded.join(item.drop("whole"), ["item_row", "item_reading"]).filter(all_ | F.coalesce(loose, F.lit(False)))
    likely = likely.select("doc_id", "item_id", "size", "whole", "coverable", "hits")
    kept = likely.mapInArrow(_judged, "doc_id long, item_id long, coverage double, same boolean")
    return kept.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.max("same").alias("exact"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a benchmark item, by their own texts, whatever their ids; all columns stay."""
    rows, row = numbered(docs)
    own = rows.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return without(rows, row, leaks(own, benchmark))
