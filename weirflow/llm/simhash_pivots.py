"""SimHash near-duplicates through tables of Hamming distances to reference fingerprints (pivots)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import forest, freeze, id_and_text, raw_texts, slices
from weirflow.llm.rows import numbered, without
from weirflow.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
PIVOTS = 16
SEED = 42
CHUNK = 2048
PAIRS_AT_ONCE = 1 << 19
MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)
# six runs of bits; a pair with at most three differing bits is equal in three of them
BLOCKS = [(0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64)]


def _reference_table() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the lower-cased word shingles of `text`; 0 if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)))), len(words) - SHINGLE_WORDS + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 15):
        part = hashes[start:start + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`doc_id, fp` (the unsigned fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(x) for x in raw_texts(part.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return id_and_text(docs, text, key).mapInArrow(run, "doc_id long, fp long")


def distances(fp: np.ndarray) -> np.ndarray:
    """Pivot table: per fingerprint, block and pivot the Hamming distance inside the block (n x blocks x pivots).

    Summed over blocks it is the distance to the pivot, and every entry obeys the triangle inequality of its block.
    """
    xored = fp[:, None] ^ _reference_table()[None, :]
    masks = [np.uint64((1 << hi) - (1 << lo)) for lo, hi in BLOCKS]
    return np.stack([np.bitwise_count(xored & m) for m in masks], axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed values: the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per fingerprint and triple of blocks, keyed by the pivot coordinates of those blocks.

    A pair within three bits differs in at most three blocks, so its coordinates agree in some triple.
    """
    for part in batches:
        fp = part["fp"].to_numpy().view(np.uint64)
        packed = np.ascontiguousarray(distances(fp)).view(np.uint64)  # 16 one-byte coordinates are two words
        block = _mix(_mix(packed[:, :, 0]) + packed[:, :, 1])
        for n, (a, b, c) in enumerate(combinations(range(len(BLOCKS)), 3)):
            key = _mix(_mix(_mix(block[:, a] + np.uint64(n)) + block[:, b]) + block[:, c])
            yield pd.DataFrame({"cell": key.view(np.int64), "fp": part["fp"]})


def _verified(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the pairs of equal `group` (sorted) at `MAX_BITS` or fewer, discarding by pivot coordinates."""
    table = distances(fp).sum(axis=1, dtype=np.int16)
    left = np.searchsorted(group, group, "right") - np.arange(len(group)) - 1  # rows of the group still to come
    u, v, shift, at = [], [], 0, np.nonzero(left > 0)[0]
    while len(at):
        shift += 1
        at = at[left[at] >= shift]
        keep = at
        for j in range(PIVOTS):
            if not len(keep):
                break
            keep = keep[np.abs(table[keep, j] - table[keep + shift, j]) <= MAX_BITS]
        keep = keep[np.bitwise_count(fp[keep] ^ fp[keep + shift]) <= MAX_BITS]
        u.append(fp[keep].view(np.int64))
        v.append(fp[keep + shift].view(np.int64))
        if sum(map(len, u)) > PAIRS_AT_ONCE:
            a, b = forest(np.concatenate(u), np.concatenate(v))
            u, v = [a], [b]
    return forest(np.concatenate(u), np.concatenate(v)) if u else (fp[:0].view(np.int64),) * 2


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of rows that arrive sorted by (cell, a, b); the last, maybe unfinished, group waits for the next batch."""
    rest = pd.DataFrame({"cell": [], "a": [], "b": [], "fp": []}).astype("int64")

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        change = (rows[["cell", "a", "b"]].diff().fillna(0) != 0).any(axis=1)
        u, v = _verified(change.cumsum().to_numpy(), rows["fp"].to_numpy().view(np.uint64))
        return pd.DataFrame({"u": u, "v": v})

    for part in batches:
        rows = pd.concat([rest, part], ignore_index=True)
        if not len(rows):
            continue
        last = (rows[["cell", "a", "b"]] == rows[["cell", "a", "b"]].iloc[-1]).all(axis=1)
        cut = int(np.argmax(last.to_numpy()))
        rest = rows.iloc[cut:]
        if cut:
            yield edges(rows.iloc[:cut])
    if len(rest):
        yield edges(rest)


def links(distinct: DataFrame) -> DataFrame:
    """Spanning edges `u, v` between the distinct fingerprints `fp` that differ in at most `MAX_BITS` bits.

    Cells with one member end after a count. A larger cell is cut into chunks of about `CHUNK` and each pair of chunks
    is a group of its own, so no task holds a whole hot cell; a group gives at most one edge per member.
    """
    cells = distinct.select("fp").mapInPandas(_cells, "cell long, fp long")
    many = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = cells.join(many, "cell").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    member = member.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = member.select("cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = dealt.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    return dealt.mapInPandas(_links, "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`doc_id, fingerprint, component_id`: groups of documents whose fingerprints chain at 3 or fewer differing bits.

    Fingerprints are SimHashes of 3-word shingles (XXH64, seed 42) of whole texts, lower-cased in A-Z. Equal ones are
    one class; links are sought between classes only: a table of distances to `PIVOTS` reference fingerprints, kept per
    block of bits, says where pairs can be (some three blocks have equal coordinates), discards by the largest
    coordinate difference, and the survivors' bits are compared. No pair within the distance is lost.

    Null or blank text has fingerprint 0, linked like any other. Rows with equal ids or equal texts stay separate rows.
    A null doc_id keeps its row and never is a component's id unless no member has one. No rows give no rows.
    """
    prints = freeze(fingerprints(docs, text, key))
    distinct = freeze(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    root = components(links(distinct))
    rooted = distinct.join(root, distinct["fp"] == root["node"], "left")
    rooted = freeze(rooted.select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    group = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    group = rooted.join(group, "root").select("fp", "component_id")
    return prints.join(group, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with one row of each near-duplicate group: the one with the least id, ties and null ids by row number.

    Groups are those of the rows, so rows with a null id or one that others share take part like any other; all columns
    stay, whatever their names.
    """
    rows, row = numbered(docs)
    own = rows.select(F.col(row).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("id"))
    groups = near_duplicates(own).select("doc_id", "component_id")
    place = F.struct(F.col("id").isNull().alias("nil"), "id", "doc_id")
    first = groups.join(own.select("doc_id", "id"), "doc_id").groupBy("component_id").agg(F.min(place)["doc_id"].alias("first"))
    gone = groups.join(first, "component_id").filter(F.col("doc_id") != F.col("first"))
    return without(rows, row, gone)
