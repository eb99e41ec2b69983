"""Encoding and decoding with a public byte-pair tokenizer by contiguous rank arrays."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from weirflow.llm.common import id_and_text, slices

TOKENIZER = "word_bpe_49k.json"
SHORT = 128  # parts of a word up to which scanning an array of ranks beats a queue
CACHE_WORDS = 500_000
SLICE_BYTES = 2 << 20
NEVER = 1 << 30
_WORD = re.compile("[^ \t\n\r]+")
_BEHIND = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe, which starts pieces of its own

# fixed rule of byte-level tokenizers: printable bytes stand for themselves, the others are signs from 256 on, in order
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value: the splitter for which words can be cut here


def _plain_rules(spec: dict) -> bool:
    """Whether letters with ASCII punctuation behind are two pieces, lower-cased and shown byte by byte."""
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    first = [s["type"] for s in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
    return first and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT} and steps[0]["invert"]


class RankBpe:
    """Ids of words, each distinct word merged once while it is remembered.

    The file's normaliser and splitter cut a word into pieces; the merges are applied here. Both treat a text word by
    word, since white space is dropped and nothing is composed or joined across it. Added tokens are cut out first.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in added for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        steps = spec["normalizer"] and spec["normalizer"].get("normalizers") or []
        blind = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} in steps
        if model["type"] != "BPE" or odd or spec["decoder"] or not blind:
            raise ValueError(f"{path}: not a byte-pair tokenizer that reads word by word ({', '.join(odd) or model['type']})")
        vocab: dict[str, int] = model["vocab"]
        self.size, suffix = len(vocab), model.get("end_of_word_suffix") or ""
        self.inner = {c: i for c, i in vocab.items() if len(c) == 1}
        self.final = {c: vocab[c + suffix] for c in self.inner}
        self.ranks: dict[int, int] = {}  # of a pair of ids, as one number
        self.joined: list[int] = []  # id that a rank's pair becomes
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[vocab[a] * self.size + vocab[b]] = len(self.joined)
            self.joined.append(vocab[a + b])
        self.added = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if added else None
        self.tokens = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        self.names = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())
        self.named = self.names.is_valid().to_numpy(zero_copy_only=False)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.plain = _plain_rules(spec)

    def merged(self, piece: str) -> list[int]:
        """Ids of one piece. `parts[i]` is the part behind the i-th boundary, `ranks[i]` that of joining it and the next."""
        size, rank, joined = self.size, self.ranks.get, self.joined
        parts = [*map(self.inner.__getitem__, piece[:-1]), self.final[piece[-1]]]
        if len(parts) > SHORT:
            return self._queued(parts)
        ranks = [rank(a * size + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i] = part = joined[least]
            del parts[i + 1], ranks[i]  # the boundary between them
            if i < len(ranks):
                ranks[i] = rank(part * size + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(parts[i - 1] * size + part, NEVER)
        return parts

    def _queued(self, parts: list[int]) -> list[int]:
        """The same for a long piece: a queue of (rank, place) over linked parts, since scans would cost its square."""
        n, size, rank = len(parts), self.size, self.ranks.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = rank(parts[i] * size + parts[j], NEVER)
                if r != NEVER:
                    heapq.heappush(queue, (r, i, j, after[j]))

        for i in range(n):
            offer(i)
        while queue:
            r, i, j, beyond = heapq.heappop(queue)
            if parts[i] < 0 or after[i] != j or after[j] != beyond or rank(parts[i] * size + parts[j], NEVER) != r:
                continue  # one of the two parts has changed since
            parts[i], parts[j], after[i] = self.joined[r], -1, beyond
            if beyond < n:
                before[beyond] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in parts if x >= 0]

    def _piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            out = self.pieces[piece] = np.array(self.merged(piece), "<i4").tobytes()
        return out

    def _word(self, word: str) -> bytes:
        if self.plain:
            letters = word.rstrip(_BEHIND)
            if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250" and "\u0130" not in letters):
                low, behind = letters.lower(), word[len(letters):]
                seen = low if low.isascii() else low.encode().decode("latin-1").translate(_SIGNS)
                return self._piece(seen) + self._piece(behind) if behind else self._piece(seen)
        out = []
        for part in self.cut.split(word) if self.cut else [word]:
            if part in self.added:
                out.append(np.array([self.added[part]], "<i4").tobytes())
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part)
                out += [self._piece(piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        known, words = self.known, _WORD.findall(text)
        if len(known) + len(self.pieces) > CACHE_WORDS:
            known.clear()
            self.pieces.clear()
        for word in set(words).difference(known):
            known[word] = self._word(word)
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        """The tokens with blanks between them: these files name no decoder. Ids without a token are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([t for t in map(self.tokens.get, ids) if t is not None])


    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """`decode` of many lists at once; a null list is empty."""
        flat = ids.flatten().fill_null(-1).to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
        inside = (flat >= 0) & (flat < len(self.names))
        kept = inside & self.named[np.where(inside, flat, 0)]
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.names.take(pa.array(flat[kept])))
        return pc.binary_join(tokens, " ")


@lru_cache(maxsize=2)
def _loaded(path: str) -> RankBpe:
    return RankBpe(path)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """`doc_id, ids`: every document's token ids, without special tokens put around them, truncation or padding.

    One row per input row, repeated rows and null ids included; a null or blank text has no ids, a text of any length is
    encoded whole (a row must hold its ids). Strings of added tokens in a text become these tokens. Ties of ranks go to
    the leftmost pair. Columns other than `doc_id` and `text` are left out, whatever their names. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer_path)
        for part in slices(batches, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _encoded(part, bpe)], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def _encoded(part: pa.RecordBatch, bpe: RankBpe) -> pa.ListArray:
    rows = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
    ends = np.cumsum([0, *[len(r) // 4 for r in rows]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """`doc_id, ids, text`: `encode`, and `decode` of its ids, in one pass over the texts; rows as in `encode`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer_path)
        for part in slices(batches, SLICE_BYTES):
            ids = _encoded(part, bpe)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, bpe.decoded(ids)], ["doc_id", "ids", "text"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, text string")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """`encoded` with `text`, the decoded ids; special tokens are kept, null ids (the array or an element) count as none.

    A column `text` of the input is replaced; other columns stay.
    """
    rest = [c for c in encoded.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "text") + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(tokenizer_path)
        for part in slices(batches, SLICE_BYTES):
            text = bpe.decoded(part.column("ids").cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], text], [*rest, "text"])

    return encoded.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)
