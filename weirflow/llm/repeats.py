"""Removal of passages that repeat across documents: winnowed seeds, joined and extended both ways."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import freeze, raw_texts, slices

LENGTH = 50  # words of the shortest repeat
SEED = 10  # words of an anchor
REACH = LENGTH - SEED  # words on either side that a repeat of LENGTH words around an anchor can have
WINDOW = LENGTH - SEED + 1  # of so many consecutive anchors' hashes the least is kept: every repeat keeps one
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
CACHE_WORDS = 300_000
STRETCH = 1 << 19
LOCAL = 65_536  # anchors of a group that one task settles (50 MB); a larger group is first split by what its anchors differ in


class Hashes(dict):
    """Words to rows of the column of their 64-bit hashes (never 0)."""

    def __init__(self):
        super().__init__()
        self.column = array("Q")

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.column.append(xxhash.xxh64_intdigest(word) | 1)
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.column = array("Q")
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.column, np.uint64)[rows] if words else np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed values: the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hash of any range of words in constant time, from prefix sums of a polynomial."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        power = np.full(n, BASE)
        power[0] = 1
        back = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(words * np.multiply.accumulate(power)[:-1], out=self.prefix[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[hi] - self.prefix[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


def winnowed(codes: np.ndarray) -> np.ndarray:
    """Positions of the least code of every window of `WINDOW` codes, the last one among equals."""
    out = []
    for start in range(0, max(len(codes) - WINDOW + 1, 0), STRETCH):
        part = codes[start:start + STRETCH + WINDOW - 1]
        place = np.arange(len(part), dtype=np.uint64)
        least = part & ~np.uint64(0xFFFFF) | (np.uint64(0xFFFFF) - place)
        size = 1
        while 2 * size <= WINDOW:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = WINDOW - size
        least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
        out.append(np.unique(np.uint64(0xFFFFF) - (least & np.uint64(0xFFFFF))).astype(np.int64) + start)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its word count, the hash of all its words, and its anchors: seed, context and place."""
    known = Hashes()
    for part in slices(batches):
        n, sha, rows = [], [], []
        for doc_id, text in zip(part.column("d").to_pylist(), raw_texts(part.column("text"))):
            words = text.split()
            n.append(len(words))
            sha.append(_digest(words))
            if doc_id is None or len(words) < LENGTH:
                rows.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            ranges = Ranges(known.of(words))
            first = np.arange(len(words) - SEED + 1)
            codes = ranges(first, first + SEED)
            at = winnowed(codes)
            lo, hi = np.maximum(at - REACH, 0), np.minimum(at + SEED + REACH, len(words))
            seed, context = codes[at], _mix(ranges(lo, hi) + (at - lo).astype(np.uint64) * BASE)
            # neighbours of equal seed and surroundings, as in a word said a thousand times, are one anchor
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (seed[1:] != seed[:-1]) | (context[1:] != context[:-1])
            first = np.nonzero(new)[0]
            rows.append((seed[first], context[first], at[first], np.diff(np.append(first, len(at)))))
        ends = pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32))
        seed, context, place, run = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0) for i in range(4))
        yield pa.RecordBatch.from_arrays(
            [
                part.column("d"), part.column("t"), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(seed.astype(np.uint64).view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(context.astype(np.uint64).view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(run.astype(np.int32))),
            ],
            ["d", "t", "n_words", "sha", "seed", "context", "place", "run"],
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes on both sides of each open anchor, nearest first, 0 where the document ends."""
    known, pad, near = Hashes(), np.zeros(REACH, np.uint64), np.arange(REACH)
    for part in slices(batches):
        out: list[tuple] = []
        for d, t, anchors, text in zip(*(part.column(c).to_pylist() for c in ("d", "t", "open_")), raw_texts(part.column("text"))):
            if anchors:
                h = np.concatenate([pad, known.of(text.split()), pad])
                at = np.array([x["p"] for x in anchors]) + REACH
                run = np.array([x["run"] for x in anchors])
                left = np.ascontiguousarray(h[at[:, None] - 1 - near])
                right = np.ascontiguousarray(h[(at + run - 1 + SEED)[:, None] + near])
                out += [(x["seed"], d, t, x["p"], x["run"], u.tobytes(), v.tobytes(), x["n"]) for x, u, v in zip(anchors, left, right)]
        if out:
            k, d, t, p, run, u, v, n = zip(*out)
            zero = pa.array(np.zeros(len(k), np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (k, k, d)), *(pa.array(c, pa.int32()) for c in (t, p, run)), pa.array(u), pa.array(v), zero, zero, pa.array(n, pa.int64())],
                [*_NAMES, "n"],
            )


_NAMES = ["key", "seed", "d", "t", "p", "run", "left", "right", "i", "j"]
_ANCHOR = "key long, seed long, d long, t int, p int, run int, left binary, right binary, i int, j int"


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), REACH)


def _running(words: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, ... words of each row."""
    out = np.zeros((len(words), REACH + 1), np.uint64)
    for k in range(REACH):
        out[:, k + 1] = _mix(out[:, k] * BASE + words[:, k])
    return out


def _matched(left: np.ndarray, right: np.ndarray, first_left: np.ndarray, first_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words to the left and to the right that each anchor has in common with the first one of its group."""
    pairs = ((left, first_left), (right, first_right))
    a, b = (((own == other) & (own != 0)).cumprod(axis=1, dtype=np.int8).sum(axis=1) for own, other in pairs)
    return a, b


def _apart(left, right, hl, hr, seed, i, j, a, b) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups that anchors go on in: (which, key, words known equal to the left, to the right).

    Where an anchor differs from the first one of its group, left or right, it may still have a passage in common with
    those that differ at the same place by the same word; not if both sides together are longer than any passage needs.
    """
    rows = np.arange(len(left))
    for side, words, n in ((0, left, a), (1, right, b)):
        more = (n < REACH) & (words[rows, np.minimum(n, REACH - 1)] != 0)
        u, v = (n + 1, j) if side == 0 else (i, n + 1)
        at = np.nonzero(more & (u + v <= REACH))[0]
        u, v = u[at].astype(np.int64), v[at].astype(np.int64)
        key = _mix(_mix(_mix(seed[at] + (u * 64 + v).astype(np.uint64) * BASE) + hl[at, u]) * BASE + hr[at, v])
        yield at, key.view(np.int64), u, v


def _step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One step over large groups: extend each anchor against the first of its group, and say where it goes on."""
    for x in batches:
        if not len(x):
            continue
        left, right = _words(x["left"]), _words(x["right"])
        a, b = _matched(left, right, _words(x["first_left"]), _words(x["first_right"]))
        p, run = x["p"].to_numpy(), x["run"].to_numpy()
        found = (a + SEED + b >= LENGTH) & (x["first_d"] < x["d"]).to_numpy()
        cover = x[["d", "t"]].assign(lo=p - a, hi=p + run - 1 + SEED + b)[found]
        yield cover.assign(key=None, seed=None, p=None, run=None, left=None, right=None, i=None, j=None)
        seed = x["seed"].to_numpy().view(np.uint64)
        i, j = x["i"].to_numpy(), x["j"].to_numpy()
        for at, key, u, v in _apart(left, right, _running(left), _running(right), seed, i, j, a, b):
            yield x[["d", "t", "seed", "p", "run", "left", "right"]].iloc[at].assign(key=key, i=u, j=v, lo=None, hi=None)


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeats of whole groups of at most `LOCAL` anchors: the same steps in memory, over all groups of a batch at once.

    Rows arrive sorted by key; the last, maybe unfinished, group waits for the next batch.
    """
    rest: pd.DataFrame | None = None

    def covers(x: pd.DataFrame) -> pd.DataFrame:
        left, right, seed = _words(x["left"]), _words(x["right"]), x["seed"].to_numpy().view(np.uint64)
        d, t, p, run = (x[c].to_numpy() for c in ("d", "t", "p", "run"))
        hl, hr = _running(left), _running(right)
        row, rank, out = np.lexsort((p, t, d)), np.empty(len(x), np.int64), []
        rank[row] = np.arange(len(x))  # the first of a group is the one of lowest rank
        key, i, j = x["key"].to_numpy()[row], x["i"].to_numpy(np.int64)[row], x["j"].to_numpy(np.int64)[row]
        while len(row):
            _, first, group, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            many = np.bincount(group, weights=d[row] != d[row[first]][group]) > 0
            keep = many[group] & (np.arange(len(row)) != first[group])
            row, head, i, j = row[keep], row[first[group[keep]]], i[keep], j[keep]
            if not len(row):
                break
            a, b = _matched(left[row], right[row], left[head], right[head])
            found = (a + SEED + b >= LENGTH) & (d[head] < d[row])
            hit = row[found]
            out.append(pd.DataFrame({"d": d[hit], "t": t[hit], "lo": p[hit] - a[found], "hi": p[hit] + run[hit] - 1 + SEED + b[found]}))
            parts = list(_apart(left[row], right[row], hl[row], hr[row], seed[row], i, j, a, b))
            row, key, i, j = np.concatenate([row[q[0]] for q in parts]), *(np.concatenate([q[k] for q in parts]) for k in (1, 2, 3))
            order = np.argsort(rank[row], kind="stable")
            row, key, i, j = row[order], key[order], i[order], j[order]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"d": [], "t": [], "lo": [], "hi": []}).astype({"d": "int64", "t": "int32", "lo": "int32", "hi": "int32"})

    for part in batches:
        x = part if rest is None else pd.concat([rest, part], ignore_index=True)
        if not len(x):
            continue
        cut = int(np.searchsorted(x["key"].to_numpy(), x["key"].iloc[-1]))
        rest = x.iloc[cut:]
        if cut:
            yield covers(x.iloc[:cut])
    if rest is not None and len(rest):
        yield covers(rest.reset_index(drop=True))


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each document that has repeats."""
    for part in slices(batches):
        removed, sha = [], []
        for full, covers, text in zip(*(part.column(c).to_pylist() for c in ("full", "covers")), raw_texts(part.column("text"))):
            words = text.split()
            lo = [x["p"] - REACH for x in full or []] + [x["lo"] for x in covers or []]
            hi = [x["p"] + x["run"] - 1 + SEED + REACH for x in full or []] + [x["hi"] for x in covers or []]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, np.maximum(lo, 0), 1)
            np.add.at(edge, np.minimum(hi, len(words)), -1)
            keep = np.cumsum(edge[:-1]) == 0
            removed.append(int(len(words) - keep.sum()))
            sha.append(_digest([w for w, k in zip(words, keep.tolist()) if k]))
        yield pa.RecordBatch.from_arrays(
            [part.column("d"), part.column("t"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["d", "t", "n_removed", "kept"]
        )


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256`: documents without the passages that a smaller doc_id also has.

    A passage is `LENGTH` or more consecutive words; judged on the input. Seeds are the winnowed `SEED`-word anchors: any
    passage of `LENGTH` words keeps at least one. Anchors are joined across documents. Those whose whole surroundings
    (`REACH` words either way) agree with a smaller document need no more; the rest are extended word by word against
    the first anchor of their group and regrouped by where and how they differ, until no group has two left: in memory
    for groups of at most `LOCAL` anchors, step by step on Spark for larger ones. So no pair of documents is ever
    listed, and a seed that a third of all documents share costs one row for each of them.

    Words are compared by 64-bit hashes. Null text has no words. Rows without an id neither remove nor lose words. Rows
    of equal id do not count as different documents; repeated rows give repeated results. No rows give no rows.
    """
    own = docs.select(F.col(key).cast("long").alias("d"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("t", F.hash("text"))
    lists = "seed array<long>, context array<long>, place array<int>, run array<int>"
    base = freeze(own.mapInArrow(_seeds, "d long, t int, n_words long, sha string, " + lists))
    zipped = F.explode(F.arrays_zip("seed", "context", "place", "run")).alias("z")
    anchors = base.select("d", "t", zipped).select("d", "t", "z.seed", "z.context", F.col("z.place").alias("p"), "z.run")
    # the small sides of these joins are written first, so that a seed with very many anchors can be split in the join
    shared = freeze(anchors.groupBy("seed").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a < b").select("seed"))
    seeds = freeze(anchors.join(shared, "seed"))
    alike = freeze(seeds.groupBy("seed", "context").agg(F.min("d").alias("first_d"), F.count(F.lit(1)).alias("n")))
    many = freeze(alike.groupBy("seed").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n")).filter("classes > 1").select("seed", "n"))
    marked = seeds.join(alike.drop("n"), ["seed", "context"]).join(many, "seed", "left")
    full = F.col("first_d") < F.col("d")
    marked = marked.filter(full | F.col("n").isNotNull())
    told = marked.groupBy("d", "t").agg(
        F.collect_list(F.when(full, F.struct("p", "run"))).alias("full"),
        F.collect_list(F.when(~full, F.struct("p", "run", "seed", "n"))).alias("open_"),
    )
    involved = freeze(own.filter("d is not null").join(told, ["d", "t"]).dropDuplicates(["d", "t"]))

    open_ = freeze(involved.filter(F.size("open_") > 0).mapInArrow(_contexts, _ANCHOR + ", n long"))
    ranges, covers = "d long, t int, lo int, hi int", []
    while True:
        small = open_.filter(F.col("n") <= LOCAL).select(*_NAMES).repartition("key").sortWithinPartitions("key")
        covers.append(freeze(small.mapInPandas(_settle, ranges)))
        large = open_.filter(F.col("n") > LOCAL).select(*_NAMES)
        if large.isEmpty():
            break
        first = large.groupBy("key").agg(F.min(F.struct("d", "t", "p", "left", "right")).alias("f"))
        first = freeze(first.select("key", *[F.col(f"f.{c}").alias(f"first_{c}") for c in ("d", "t", "p", "left", "right")]))
        others = large.join(first, "key").filter("not (d = first_d and t = first_t and p = first_p)")
        step = freeze(others.mapInPandas(_step, ranges + ", key long, seed long, p int, run int, left binary, right binary, i int, j int"))
        covers.append(step.filter("key is null").select("d", "t", "lo", "hi"))
        on = step.filter("key is not null").select(*_NAMES)
        groups = on.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("a"), F.max("d").alias("b")).filter("a < b")
        open_ = freeze(on.join(freeze(groups.select("key", "n")), "key"))
    held = reduce(DataFrame.unionByName, covers).groupBy("d", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("covers"))
    parts = involved.select("d", "t", "text", "full").join(held, ["d", "t"], "left")
    parts = parts.filter((F.size("full") > 0) | F.col("covers").isNotNull())
    left = parts.mapInArrow(_rest, "d long, t int, n_removed long, kept string")
    out = base.select("d", "t", "n_words", "sha").join(left, ["d", "t"], "left")
    return out.select(
        F.col("d").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256")
    )
