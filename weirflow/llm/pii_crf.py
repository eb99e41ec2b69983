"""Personal data: exact patterns, and a linear-chain CRF over word-shape features that adds what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import crf
from weirflow.llm.common import id_and_text, slices
from weirflow.llm.rows import unused

# base kinds in their listed order, then the kind that only the model adds
KINDS = ["email", "ip", "card", "phone", "id"]
ORDER = {k: i for i, k in enumerate(KINDS)}
STATES = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
REACH = 4  # words on either side of a marked word that the chain covers
TRAIN_SENTENCES = 700
SEED = 11
FEATURE_CACHE = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]|[\[({<]\s?(?:at|dot)\s?[\])}>]|\bdot\b", re.I)
_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, in time linear in the text.

    An e-mail is found from its `@`: the longest run of local-part characters before it that follows the last match.
    An address with numbers begins at the start of a run of digits, as a leftmost match always does.
    """
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), "email"))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() < 64 else ""
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


# ---- features

# fixed values: words that often stand next to personal data, lower case
TRIGGERS = (
    "at dot email e-mail mail contact write phone tel mobile cell call fax whatsapp ssn iban passport id card visa "
    "account number no version page year order total price"
).split()


def _shape(word: str) -> str:
    out = []
    for c in word:
        k = "0" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if k in "aA" and out[-1:] == [k]:
            continue
        out.append(k)
    return re.sub(r"0{5,}", "00000+", "".join(out))[:24]


def word_features(word: str) -> list[str]:
    """What one word says by itself: its shape, its digits, and whether it is a known neighbour of personal data."""
    core = word.strip(".,;:!?*#%$&|\"'")
    digits = _digits(core)
    low = core.lower().strip("[](){}<>")
    n = len(digits)
    out = ["shape=" + _shape(core), "digits=" + str(n if n < 5 else "5-8" if n < 9 else "9-11" if n < 12 else "12-19" if n < 20 else "20+")]
    if "@" in core:
        out.append("has=@")
    if core[:1] in ("+", "("):
        out.append("first=" + core[:1])
    if core[:1] in "[({<" and core[-1:] in "])}>" and core:
        out.append("wrapped")
    if low in TRIGGERS:
        out.append("word=" + low)
    if n >= 12:
        out.append("luhn=" + str(luhn(digits)))
    if any(c.isalpha() for c in core) and n:
        out.append("mixed")
    if core.replace(".", "").replace("-", "").replace("/", "").isdigit() and n < len(core):
        out.append("parted")
    if not core:
        out.append("junk")
    return out


class Features:
    """Feature names to ids: a word's own features and those of its two neighbours on either side."""

    OFFSETS = (-2, -1, 0, 1, 2)
    MOST = 8

    def __init__(self, known: dict[str, int]):
        self.known = known
        self.own = lru_cache(FEATURE_CACHE)(self._own)

    def _own(self, word: str, offset: int) -> tuple[int, ...]:
        ids = [self.known[f] for x in word_features(word) if (f := f"{offset}:{x}") in self.known]
        return tuple((ids + [len(self.known)] * self.MOST)[: self.MOST])

    def rows(self, words: list[str]) -> np.ndarray:
        pad, n = (len(self.known),) * self.MOST, len(words)
        return np.array(
            [sum((self.own(words[i + o], o) if 0 <= i + o < n else pad for o in self.OFFSETS), ()) for i in range(n)]
        ).reshape(n, self.MOST * len(self.OFFSETS))


# ---- the labelled table and the model


def labelled_sentences(n: int, seed: int) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, made by a seeded generator: filler words around personal data and around look-alikes."""
    r = random.Random(seed)
    syllables = "an be co di el fo ga hi in jo ka lu me no or pa qui re su te un vi wo xa ye zu at dot the".split()

    def digits(k):
        return "".join(str(r.randrange(10)) for _ in range(k))

    def filler():
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
        return (w.capitalize() if r.random() < 0.15 else w) + r.choice(["", "", "", "", "", ".", ",", "***", "%%%", "!!"])

    def name():
        return r.choice(["", r.choice("abcdefgh") + "."]) + "".join(r.choice(syllables[:26]) for _ in range(2))

    def card():
        d = r.choice("3456") + digits(r.choice([13, 14, 14, 14]))
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return r.choice([[d], [d[i:i + 4] for i in range(0, len(d), 4)], ["-".join(d[i:i + 4] for i in range(0, len(d), 4))], [".".join(d[i:i + 4] for i in range(0, len(d), 4))]])

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice(
            [[f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["+" + digits(11)], [f"+{r.randint(1, 99)}", a, b, c], ["0" + digits(3), digits(3), digits(4)], [f"+{r.randint(1, 9)}", digits(9)]]
        )

    def email():
        n, d, t = name() + digits(r.choice([0, 0, 2])), name(), r.choice(["com", "org", "net", "de"])
        at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}"), ("at", "dot"), ("AT", "DOT"), ("<at>", "<dot>")])
        return r.choice([[f"{n}@{d}.{t}"], [n, at, d, dot, t], [n, at, d, dot, t], [f"{n}{at}{d}{dot}{t}"] if at[0] in "[({<" else [n, at, d, dot, t], [n, "@", f"{d}.{t}"]])

    def ip():
        return [".".join(str(r.randint(0, 255)) for _ in range(4))]

    def ident():
        return r.choice([[f"{digits(3)}-{digits(2)}-{digits(4)}"], [r.choice(["DE", "FR", "ES"]) + digits(20)], [r.choice(["DE", "FR", "ES"]) + digits(2), *(digits(4) for _ in range(4)), digits(2)]])

    def alike():
        bad = digits(15)
        bad += next(str(c) for c in range(10) if not luhn(bad + str(c)))
        return r.choice(
            [[digits(r.randint(1, 6))], [bad], [f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}"], [f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"], [f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{digits(2)}"], [f"{r.randint(0, 23)}:{r.randint(10, 59)}"], ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'], [f"${digits(3)}.{digits(2)}"], [f"{digits(1)},{digits(3)},{digits(3)}"], ["version", digits(1) + "." + digits(1)], [f"({digits(1)})"], ["(" + digits(4) + ")"], [f"{digits(1)}-{digits(1)}"], [bad[:4], bad[4:8], bad[8:12], bad[12:]], ["at", filler()], ["a", "dot", "of"], ["dot", "at"], [f"@{name()}"], [digits(r.randint(20, 30))], [f"x{digits(2)}y{digits(3)}"], [f"{digits(2)}%"], [digits(3), digits(3)], ["page", digits(3)], ["Version", "2.0."]]
        )

    cue = {"email": ["email", "mail", "contact", "write"], "ip": ["from", "host"], "card": ["card", "visa"], "phone": ["call", "tel", "phone:", "mobile"], "id": ["ssn", "iban", "id"]}
    make = {"email": email, "ip": ip, "card": card, "phone": phone, "id": ident}
    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(r.randint(1, 3)):
            k = r.randint(0, 6)
            words += [filler() for _ in range(k)]
            tags += ["O"] * k
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                if r.random() < 0.4:
                    words.append(r.choice(cue[kind]))
                    tags.append("O")
                part = make[kind]()
                tags += ["B-" + kind] + ["I-" + kind] * (len(part) - 1)
                part[-1] += r.choice(["", "", ".", ",", "***", "%%%"])
            else:
                part = alike()
                tags += ["O"] * len(part)
            words += part
        k = r.randint(0, 4)
        words += [filler() for _ in range(k)]
        tags += ["O"] * k
        out.append((words, tags))
    return out


def fit(sentences: list[tuple[list[str], list[str]]]) -> tuple[dict[str, int], crf.Chain]:
    seen: dict[str, int] = {}
    for words, _ in sentences:
        for w in words:
            for x in word_features(w):
                for o in Features.OFFSETS:
                    seen[f"{o}:{x}"] = seen.get(f"{o}:{x}", 0) + 1
    known = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 4))}
    at = Features(known)
    state = {s: i for i, s in enumerate(STATES)}
    x = [at.rows(w) for w, _ in sentences]
    y = [np.array([state[t] for t in tags]) for _, tags in sentences]
    return known, crf.fit(x, y, len(known), len(STATES))


def _plausible(kind: str, words: list[str]) -> bool:
    """The last word on a decoded span: has it what its kind cannot be without?"""
    s = " ".join(words)
    n = len(_digits(s))
    if kind == "email":
        return "@" in s and "." in s or len(_MARK.findall(s)) > 0 and bool(re.search(r"(?i)\bat\b", s) and re.search(r"(?i)\bdot\b", s))
    if kind == "phone":
        return 9 <= n <= 15
    if kind == "card":
        return 12 <= n <= 19 and luhn(_digits(s))
    if kind == "ip":
        return bool(re.fullmatch(r"\D*(\d{1,3}\.){3}\d{1,3}\D*", s))
    return 9 <= n <= 30


def _decoded(texts: list[str], taken: list[list[tuple[int, int, str]]], at: Features, chain: crf.Chain) -> list[list[tuple[int, int, str]]]:
    """Spans that the chain adds to the base spans of each text: none that touches one of them."""
    seqs, rows, places = [], [], []
    for n, text in enumerate(texts):
        if not _MARK.search(text):
            continue
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        marked = [m.start() for m in _MARK.finditer(text)]
        hit = np.unique(np.searchsorted([e for _, e in words], marked, "right"))
        lo = np.maximum(hit - REACH, 0)
        hi = np.minimum(hit + REACH + 1, len(words))
        new = np.nonzero(np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1]]))[0]
        ends = np.concatenate([new[1:] - 1, [len(hit) - 1]])
        for a, b in zip(lo[new], hi[ends]):
            part = words[a:b]
            rows.append(at.rows([text[s:e] for s, e in part]))
            seqs.append(len(part))
            places.append((n, part))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not seqs:
        return out
    labels = chain.decode(np.concatenate(rows), np.array(seqs))
    done = 0
    for (n, part), length in zip(places, seqs):
        own, i = [STATES[k] for k in labels[done:done + length]], 0
        done += length
        while i < length:
            if own[i] == "O":
                i += 1
                continue
            kind, j = own[i][2:], i + 1
            while j < length and own[j] == "I-" + kind:
                j += 1
            text = texts[n]
            start, end = part[i][0], part[j - 1][1]
            while end > start and text[end - 1] in ".,;:!?*#%$&|\"'":
                end -= 1
            while start < end and text[start] in ",;:!?*#%$&|\"'":
                start += 1
            free = all(e <= start or s >= end for s, e, _ in taken[n])
            if end > start and free and _plausible(kind, text[start:end].split()):
                out[n].append((start, end, kind))
            i = j
    return out


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _each(docs: DataFrame, schema: str, make, column: str) -> DataFrame:
    known, chain = fit(labelled_sentences(TRAIN_SENTENCES, SEED))
    shared = docs.sparkSession.sparkContext.broadcast((known, chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        at = Features(names)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = _decoded(texts, base, at, model)
            spans = [sorted(b + a, key=lambda s: (s[0], ORDER[s[2]], s[1])) for b, a in zip(base, added)]
            yield make(batch, texts, base, spans)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame) -> DataFrame:
    """`doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans` of every whole text.

    The counts and the hash are those of the fixed patterns. `spans` also lists what the chain adds, as
    `kind:start:end` in code points: spelled-out e-mail addresses, telephone and card numbers in other notations, and
    identity numbers (kind `id`). The chain is trained here on a small labelled table from a seeded generator; it covers
    every word with a digit, an `@` or a spelled-out `dot`, and `REACH` words on either side.

    Null text counts as empty: zero counts and no span. Repeated rows and null ids each give their own row; no rows
    give no rows.
    """

    def make(batch, texts, base, spans):
        count = [[sum(k == kind for _, _, k in b) for b in base] for kind in KINDS[:4]]
        digest = [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(digest), pa.array([_listed(s) for s in spans])],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return _each(id_and_text(docs), schema, make, "text")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done, end, kind = [], 0, -1, ""
    for s, e, k in spans:
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(f"[{kind.upper()}]")
            done = end
        out.append(text[done:s])
        end, kind = e, k
    if end >= 0:
        out.append(f"[{kind.upper()}]")
        done = end
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs`, all columns, with the personal data in `text` replaced; null stays null. `n_chars`, if there, follows."""
    names, read = docs.columns, unused(docs, "text_read")
    written = unused(docs, "text_redacted")

    def make(batch, texts, base, spans):
        old = batch.column(batch.schema.get_field_index(read))
        new = pa.array([redacted(t, s) for t, s in zip(texts, spans)], old.type)
        whole = pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, written])
        return whole

    from_ = docs.withColumn(read, F.col(f"`{text}`").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_.schema.fields) + f", {written} string"
    out = _each(from_, schema, make, read)
    changed = {text: F.when(F.col(read).isNotNull(), F.col(written))}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col(read).isNull(), F.col("n_chars")).otherwise(F.length(written).cast("long"))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in names))
