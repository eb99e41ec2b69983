"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import id_and_text, raw_texts, slices
from weirflow.llm.quality_ri import part_of

TRAIN_DOCS = 2000  # labelled documents that the network is fitted on, at most; evenly over languages
TRAIN_CHARS = 20_000  # longer ones are not taken for fitting, so that the sample's size is bounded
HIDDEN = 24
SPAN = 24  # bytes of a sequence at most; the recurrence starts anew at each word and inside longer ones
STEPS = 900
BATCH = 384
RATE = 0.01
SEED = 5
HELD_OUT_PART = 3
SALTS = 64
CACHE_WORDS = 400_000
AT_ONCE = 8192

_LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    languages: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def begin(self, seed: int) -> None:
        r, h, c = np.random.default_rng(seed), HIDDEN, len(self.languages)
        for d in "fb":
            self.p["w" + d] = r.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p["u" + d] = r.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.p["v"] = r.normal(0, 0.2, (2 * h, c)).astype(np.float32)
        self.p["c"] = np.zeros(c, np.float32)

    def _walk(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction at every position of equally long sequences."""
        h, w, u = HIDDEN, self.p["w" + d], self.p["u" + d]
        state = np.zeros((len(x), h), np.float32)
        out = np.zeros((x.shape[1], len(x), h), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a, g = w[x[:, t]], state @ u
            gate = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
            z, r, m = gate[:, :h], gate[:, h:], g[:, 2 * h:]
            new = np.tanh(a[:, 2 * h:] + r * m)
            if keep is not None:
                keep.append((t, state, z, r, m, new))
            state = z * state + (1 - z) * new
            out[t] = state
        return out

    def positions(self, x: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Language probabilities of every position, and the states they come from."""
        both = np.concatenate([self._walk(x, d, kept[i] if kept else None) for i, d in enumerate("fb")], axis=2)
        logit = both @ self.p["v"] + self.p["c"]
        e = np.exp(logit - logit.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), both

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over all positions."""
        kept: tuple[list, list] = ([], [])
        prob, both = self.positions(x, kept)
        slack = prob.copy()
        slack[:, np.arange(len(y)), y] -= 1
        slack /= x.size
        g = {"v": np.einsum("tnh,tnc->hc", both, slack), "c": slack.sum(axis=(0, 1))}
        down = slack @ self.p["v"].T
        h = HIDDEN
        for i, d in enumerate("fb"):
            gw, gu, u = np.zeros_like(self.p["w" + d]), np.zeros_like(self.p["u" + d]), self.p["u" + d]
            ds = np.zeros((len(x), h), np.float32)
            for t, state, z, r, m, new in reversed(kept[i]):
                ds = ds + down[t, :, i * h:(i + 1) * h]
                dn = ds * (1 - z) * (1 - new * new)
                dz = ds * (state - new) * z * (1 - z)
                dr = dn * m * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gw, x[:, t], np.concatenate([dz, dr, dn], axis=1))
                gu += state.T @ dg
                ds = ds * z + dg @ u.T
            g["w" + d], g["u" + d] = gw, gu
        return g

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Per word the sum of the probabilities at its letters, and in the last column their number."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        parts = [(i, w[k:k + SPAN]) for i, w in enumerate(words) for k in range(0, len(w), SPAN)]
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for part in parts:
            by_length.setdefault(len(part[1]), []).append(part)
        for length, group in by_length.items():
            for k in range(0, len(group), AT_ONCE):
                chunk = group[k:k + AT_ONCE]
                x = np.frombuffer(b"".join(w for _, w in chunk), np.uint8).reshape(-1, length)
                prob, _ = self.positions(x)
                letter = _LETTER[x].T[:, :, None]
                sums = np.concatenate([(prob * letter).sum(axis=0), letter.sum(axis=0)], axis=1)
                np.add.at(out, [i for i, _ in chunk], sums)
        return out


def fit(texts: list[bytes], langs: list[str]) -> Network:
    """Train on the words of the sample, each position labelled with its document's language."""
    net = Network(sorted(set(langs)))
    if not net.languages:
        return net
    net.begin(SEED)
    at = {k: i for i, k in enumerate(net.languages)}
    r = np.random.default_rng(SEED)
    pool: dict[int, list[tuple[bytes, int]]] = {}
    for text, lang in zip(texts, langs):
        words = text.split()
        for i in r.permutation(len(words))[:300]:  # a sample of the sample's words: long documents do not outweigh
            w = words[i][:SPAN]
            pool.setdefault(len(w), []).append((w, at[lang]))
    if not pool:
        return net
    grouped = {n: (np.frombuffer(b"".join(w for w, _ in g), np.uint8).reshape(-1, n), np.array([y for _, y in g])) for n, g in sorted(pool.items())}
    share = np.array([len(y) * n for n, (_, y) in grouped.items()], float)
    lengths = list(grouped)
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step, pick in enumerate(r.choice(len(lengths), STEPS, p=share / share.sum()), 1):
        x, y = grouped[lengths[pick]]
        rows = r.integers(0, len(y), min(BATCH, len(y)))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in net.gradients(x[rows], y[rows]).items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            net.p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Seen(dict):
    """Words to rows; new words wait in `fresh` until the network has run over them together."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.fresh.append(word)
        return row


def has_letter(text: bytes) -> bool:
    return text.lower() != text.upper() or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def training_sample(docs: DataFrame) -> tuple[list[bytes], list[str]]:
    """At most `TRAIN_DOCS` documents outside the held-out part, in turn from each language, chosen by a hash of the id."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).filter(F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS) & (part_of("doc_id", HELD_OUT_PART) != 1))
    ids = rows.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id"))
    salted = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h", "doc_id")  # a language may have most rows
    ids = ids.withColumn("turn", F.row_number().over(salted)).filter(F.col("turn") <= TRAIN_DOCS)
    ids = ids.orderBy("turn", "h", "lang", "doc_id").limit(TRAIN_DOCS)
    chosen = F.broadcast(ids.select("doc_id").distinct())
    held = rows.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "lang", "text").limit(TRAIN_DOCS).collect()
    return [r["text"].encode() for r in held], [r["lang"] for r in held]


def identify(docs: DataFrame) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` for every document.

    A two-way gated recurrent network over bytes, trained in numpy by backpropagation through time, labels every
    position; the probabilities at letters are averaged over the document. The recurrence starts anew at each word (and
    every `SPAN` bytes of a longer run), so equal words have equal labels and a task runs each distinct word once.
    Learned from text and language of rows whose crc32(doc_id) mod 3 is not 1.

    `und` with score 0 if the text is null or has no letter, or if nothing could be learned. A null language is never
    learned from; a null id counts as not held out and is not learned from. Repeated rows get equal rows; no rows give
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        seen, table = Seen(), np.zeros((0, len(net.languages) + 1), np.float32)
        for part in slices(batches):
            if len(seen) > CACHE_WORDS:
                seen, table = Seen(), table[:0]
            rows = []
            for text in raw_texts(part.column("text")):
                words = text.split() if net.languages and has_letter(text) else []
                rows.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
            if seen.fresh:
                table = np.vstack([table, net.pooled(seen.fresh)])
                seen.fresh = []
            langs, scores = [], []
            for at in rows:
                total = np.zeros(table.shape[1])
                for k in range(0, len(at), 1 << 16):
                    total += table[at[k:k + (1 << 16)]].sum(axis=0, dtype=np.float64)
                prob = total[:-1] / total[-1] if len(at) and total[-1] else None
                best = None if prob is None else int(np.argmax(prob))
                langs.append("und" if best is None else net.languages[best])
                scores.append(0.0 if best is None else float(min(1.0, prob[best])))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    out = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(part_of("doc_id", HELD_OUT_PART) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
