"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import id_and_text, raw_texts, slices
from weirflow.llm.rows import numbered, without

TRAIN_ROWS = 6000  # labelled documents that the model is fitted on, at most
TRAIN_CHARS = 20_000  # longer labelled documents are not taken for fitting, so that the sample's size is bounded
DIM = 48
NONZERO = 6
WINDOW = 2
MIN_COUNT = 20
MAX_WORDS = 5000
HIDDEN = 16
EPOCHS = 400
DECAY = 2e-3
REJECT_BELOW = 0.3
HELD_OUT_PART = 5
CACHE_WORDS = 400_000
WORDS_AT_ONCE = 1 << 15

# the kinds of byte that a word's form keeps apart; bytes of non-ASCII letters count as lower case
_FORM = bytes(
    ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c
    for c in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


def form(word: bytes) -> bytes:
    """Shape of a word, runs squeezed: `Rewh.###` gives `Aa.#`."""
    return b"\0" + _RUN.sub(rb"\1", word.translate(_FORM))[:12]


REPEAT = b"\0="  # stands for a word that repeats the one before it


def repeats(words: list[bytes]) -> np.ndarray:
    out = np.zeros(len(words), bool)
    out[1:] = np.fromiter(map(eq, words, words[1:]), bool, len(words) - 1)
    return out


def _index_vectors(items: list[bytes]) -> np.ndarray:
    """The sparse ternary index vector of each item, drawn from its bytes."""
    out = np.zeros((len(items), DIM), np.float32)
    for i, item in enumerate(items):
        rng = np.random.default_rng(list(item))
        out[i, rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


class Rows(dict):
    """Word to its row of the vectors: its own if it is frequent, else that of its form, else the last."""

    def __init__(self, at: dict[bytes, int], rest: int):
        super().__init__()
        self.at, self.rest = at, rest

    def __missing__(self, word: bytes) -> int:
        row = self.at.get(word)
        row = self[word] = self.at.get(form(word), self.rest) if row is None else row
        return row


@dataclass
class Model:
    at: dict[bytes, int]  # frequent words and forms; the last row stands for forms never seen
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pooled(self, text: bytes, cache: Rows) -> np.ndarray:
        """Mean and spread of the word vectors of the whole text; zeros if it has no word."""
        words = text.split()
        if not words:
            return np.zeros(2 * DIM, np.float32)
        counts = np.zeros(len(self.vectors), np.int64)
        for start in range(0, len(words), WORDS_AT_ONCE):
            if len(cache) > CACHE_WORDS:
                cache.clear()
            part = words[start:start + WORDS_AT_ONCE]
            rows = np.fromiter(map(cache.__getitem__, part), np.int64, len(part))
            rows[repeats(part)] = self.at.get(REPEAT, len(self.vectors) - 1)
            counts += np.bincount(rows, minlength=len(counts))
        used = np.nonzero(counts)[0]
        share = (counts[used] / len(words)).astype(np.float32)
        vec = self.vectors[used]
        mean = share @ vec
        return np.concatenate([mean, np.sqrt(np.maximum(share @ (vec * vec) - mean * mean, 0))])

    def rows(self) -> Rows:
        return Rows(self.at, len(self.vectors) - 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _word_vectors(texts: list[list[bytes]]) -> tuple[dict[bytes, int], np.ndarray]:
    """Random indexing: an item's vector sums the index vectors of its neighbours within `WINDOW` words."""
    words = Counter(w for t in texts for w in t)
    frequent = sorted((w for w, n in words.items() if n >= MIN_COUNT), key=lambda w: (-words[w], w))[:MAX_WORDS]
    forms = [REPEAT, *sorted({form(w) for w in words})]
    items = frequent + forms
    at = {w: i for i, w in enumerate(items)}
    index = np.vstack([_index_vectors(items), np.zeros((1, DIM), np.float32)])
    vectors = np.zeros_like(index)
    for t in texts:
        again = repeats(t)
        shape = np.where(again, at[REPEAT], [at[form(w)] for w in t])
        own = np.where(again, -1, [at.get(w, -1) for w in t])
        context = index[shape] + np.where(own[:, None] >= 0, index[own], 0)
        around = np.zeros_like(context)
        for k in range(1, WINDOW + 1):
            around[k:] += context[:-k]
            around[:-k] += context[k:]
        np.add.at(vectors, shape, around)
        np.add.at(vectors, own[own >= 0], around[own >= 0])
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return at, vectors + 0.5 * index  # an item's own index vector keeps rare forms apart


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """Fit word vectors and network on four of five samples, the temperature on the fifth."""
    words = [t.split() for t in texts]
    y = np.array(labels, np.float32)
    if not len(y):  # nothing to learn from: every score is one half
        zero = np.zeros(2 * DIM, np.float32)
        return Model({}, np.zeros((1, DIM), np.float32), zero, zero + 1, np.zeros((2 * DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0)
    at, vectors = _word_vectors([w for w in words if w])
    m = Model(at, vectors.astype(np.float32), 0, 1, 0, 0, 0, 0.0, 1.0)
    cache = m.rows()
    x = np.stack([m.pooled(t, cache) for t in texts])
    calib = np.arange(len(y)) % 5 == 4
    if not calib.any() or calib.all():
        calib = np.zeros(len(y), bool)
    m.mean, m.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 0.1, (2 * DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
    a, b = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z, t = (x[~calib] - m.mean) / m.scale, y[~calib]
    for step in range(1, EPOCHS + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(t)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [z.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)]
        for i, g in enumerate(grads):
            a[i] = 0.9 * a[i] + 0.1 * g
            b[i] = 0.999 * b[i] + 0.001 * g * g
            p[i] = p[i] - 0.02 * (a[i] / (1 - 0.9**step)) / (np.sqrt(b[i] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    if calib.any():
        logit = m.logits(x[calib])
        grid = np.geomspace(0.25, 8, 60)
        loss = [np.mean(np.logaddexp(0, -np.where(y[calib] > 0, logit, -logit) / g)) for g in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
    return m


def part_of(doc_id, parts: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """At most `TRAIN_ROWS` labelled documents outside the held-out part, chosen by a hash of their id."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    ids = ids.filter(F.col("y").isin(0, 1) & (part_of("doc_id", HELD_OUT_PART) != 0))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(TRAIN_ROWS)
    held = id_and_text(docs).filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(ids), "doc_id")
    rows = held.orderBy(F.xxhash64("doc_id"), "text", "y").limit(TRAIN_ROWS).collect()
    return [r["text"].encode() for r in rows], [r["y"] for r in rows]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, score` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = m.rows()
        for part in slices(batches):
            texts = raw_texts(part.column("text"))
            if texts:
                score = m.score(np.stack([m.pooled(t, cache) for t in texts])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id, held_out, score, predicted` for every document.

    Words that the sample has often enough and the forms of all words get random-indexing vectors; a document is the
    mean and spread of its words' vectors; a two-layer network on them is calibrated by a temperature fitted on a fifth
    of the sample. Rows whose crc32(doc_id) mod 5 is 0 are held out of everything that is learned.

    Null or blank text has the zero vector and a score like any other. Repeated rows get equal scores. A null doc_id is
    scored, never held out and never learned from. Without labels every score is 0.5. No documents give no rows.
    """
    model = fit(*training_sample(docs, labels))
    out = scores(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(part_of("doc_id", HELD_OUT_PART) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows that the classifier rejects; all columns stay, whatever their names.

    A row is judged by its own text: rows with a null id or one that others share neither escape nor fall with them.
    """
    model = fit(*training_sample(docs, labels))
    rows, row = numbered(docs)
    own = rows.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return without(rows, row, scores(own, model).filter(F.col("score") < REJECT_BELOW))
