"""Collocations by set-oriented mining: occurrence relations joined with themselves, length by length.

An occurrence relation lies in chunks: rows with one array that holds, by position, the code of the phrase that begins
there. Arrays are kept as bytes, as only Python tasks look into them: the executors' JVM would hold levels and boxes for
every number of them. Pieces stand one behind the other in a chunk with a gap between, so a relation is sorted by piece and position,
and the merge-join of a relation with itself on adjacent positions compares an array with its own shift. Chunks tell
their phrases by local codes and count them, so a count shuffles a phrase once per chunk at most, however common it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import freeze, raw_texts, slices
from weirflow.operators.positions import number_rows

MOST_WORDS = 4
LEAST = 30  # occurrences of a candidate
ABSORBED = 80  # percent of a candidate's occurrences that lie inside one longer candidate, from which on it is dropped
TOP = 2000
SCALE = 2_000_000
CHUNK = 1 << 18  # words
FLUSH_BYTES = 2 << 20  # of one language, after which a task makes chunks of them
HELD_BYTES = 8 << 20  # over all languages
ROWS_OUT = 1 << 15  # phrases that a task hands on at a time
BROADCAST_WORDS, BROADCAST_PAIRS = 1_000_000, 4_000_000  # frequent words or pairs up to which every task gets all of them
SALTS = 64
UNKNOWN = "und"

_GAP = b"\xff"  # in no UTF-8 text
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _GAP * 10 + b" ")
_BETWEEN = b" " + _GAP + b" "
_SEQ_BITS = 20  # chunk ids are (partition, number in the partition)
_ID_BITS = 31  # a pair is one number: the ids of its two phrases, which count from 1

_CODES, _COUNTS, _PAIR = "<i4", "<i4", "<i8"  # what the bytes are; words are joined by spaces
_RELATION = "chunk long, own int, codes binary, counts binary"
_WORDS = _RELATION + ", lang string, size long, words binary"
_PAIRS = _RELATION + ", pairs binary"


def _sum(n: Column) -> Column:
    return F.sum(n).cast("long")


def _bytes(values: np.ndarray, kind: str) -> pa.Array:
    """A column of one row, whose value is the array."""
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def _array(batch: pa.RecordBatch | pa.Table, name: str, kind: str, i: int = 0) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _phrases(batch: pa.RecordBatch, phrase: str, i: int) -> pa.Array:
    """The phrases of codes 1, 2 … of a chunk."""
    if phrase == "words":
        return pc.split_pattern(batch.column(phrase).slice(i, 1), b" ").flatten()
    return pa.array(_array(batch, phrase, _PAIR, i))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """Prepared texts as chunks: own positions, codes by position (0: a gap), the words of codes 1, 2 … and their counts.

    Positions from `own` on are the first of the next chunk: they extend phrases that begin before, and count there.
    """
    coded = pc.split_pattern(pa.array([_BETWEEN.join(texts)], pa.binary()), b" ").flatten().dictionary_encode()
    codes, dictionary = coded.indices.to_numpy(), coded.dictionary
    empty, gap = (pc.index(dictionary, pa.scalar(x, pa.binary())).as_py() for x in (b"", _GAP))
    codes = codes[codes != empty]
    for start in range(0, len(codes), CHUNK):
        part = codes[start:start + CHUNK + MOST_WORDS - 1]
        own = min(CHUNK, len(codes) - start)
        known, local = np.unique(part, return_inverse=True)
        word = known != gap
        place = np.where(word, np.cumsum(word), 0)[local].astype(np.int32)
        counts = np.bincount(place[:own], minlength=int(word.sum()) + 1)[1:]
        if len(counts):
            yield own, place, dictionary.take(pa.array(known[word])), counts


def words(docs: DataFrame) -> DataFrame:
    """The relation of single words: chunks of one language each, with their words (of codes 1, 2 …) and counts.

    Pieces are kept apart by gaps. A text's bytes are lower-cased, and delimiters turned into gaps, at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def given(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            del size[lang]
            for own, codes, known, counts in _chunks(held.pop(lang)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(pid << _SEQ_BITS) + seq], pa.int64()), pa.array([own], pa.int32()), _bytes(codes, _CODES), _bytes(counts, _COUNTS),
                     pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([b" ".join(known.to_pylist())], pa.binary())],
                    ["chunk", "own", "codes", "counts", "lang", "size", "words"])
                seq += 1
            pa.default_memory_pool().release_unused()

        for part in slices(batches, FLUSH_BYTES):
            for lang, text in zip(part.column("lang").to_pylist(), raw_texts(part.column("text"))):
                held.setdefault(lang, []).append(text.lower().translate(_CUT).replace(_GAP, _BETWEEN))
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] > FLUSH_BYTES:
                    yield from given(lang)
                elif sum(size.values()) > HELD_BYTES:
                    yield from given(max(size, key=size.get))
        for lang in list(held):
            yield from given(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    rows = docs.select(lang, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _WORDS)


def _longer(chunk: int, own: int, codes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
    """A chunk of the relation of phrases one word longer: merge-join on adjacent positions.

    `ids` gives the id of each code's phrase, 0 for those not frequent. Two phrases of k words at adjacent positions make
    one of k + 1, which can only be frequent if both are.
    """
    place = ids[codes]
    first, second = place[:-1], place[1:]
    spots = np.nonzero((first > 0) & (second > 0))[0]
    known, inverse = np.unique((first[spots] << _ID_BITS) + second[spots], return_inverse=True)
    if not len(known):
        return None
    out = np.zeros(len(codes), np.int32)
    out[spots] = inverse + 1
    counts = np.bincount(inverse[spots < own], minlength=len(known))
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([own], pa.int32()), _bytes(out, _CODES), _bytes(counts, _COUNTS), _bytes(known, _PAIR)],
        ["chunk", "own", "codes", "counts", "pairs"])


def _extended_here(relation: DataFrame, frequent: DataFrame, phrase: str) -> DataFrame:
    """Semi-join and extension where every task gets all frequent phrases: no row is shuffled."""
    spark = relation.sparkSession
    if phrase == "words":
        table = frequent.select("lang", "word", "id").toArrow()  # at most BROADCAST_WORDS rows
        langs = [x.as_py() for x in table.column("lang").unique()]
        parts = [table.filter(pc.equal(table.column("lang"), lang)) for lang in langs]
        shared = spark.sparkContext.broadcast({
            lang: (part.column("word").combine_chunks(), part.column("id").to_numpy()) for lang, part in zip(langs, parts)})
    else:
        table = frequent.select("pair", "id").toArrow()  # at most BROADCAST_PAIRS rows
        pair, number = (table.column(c).to_numpy() for c in ("pair", "id"))
        order = np.argsort(pair)
        shared = spark.sparkContext.broadcast((pair[order], number[order]))

    def found(batch: pa.RecordBatch, i: int) -> np.ndarray:
        own = _phrases(batch, phrase, i)
        if phrase == "words":
            known = shared.value.get(batch.column("lang")[i].as_py())
            if known is None:
                return np.zeros(len(own), np.int64)
            at = pc.index_in(own, value_set=known[0]).fill_null(-1).to_numpy()
            return np.where(at >= 0, known[1][at], 0)
        keys, numbers = shared.value
        at = np.minimum(np.searchsorted(keys, own.to_numpy()), max(len(keys) - 1, 0))
        return np.where(keys[at] == own.to_numpy(), numbers[at], 0) if len(keys) else np.zeros(len(own), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = _array(batch, "codes", _CODES, i)
                out = _longer(batch.column("chunk")[i].as_py(), batch.column("own")[i].as_py(), codes, np.concatenate([[0], found(batch, i)]))
                if out is not None:
                    yield out
                pa.default_memory_pool().release_unused()

    return relation.select("chunk", "own", "codes", phrase, *(["lang"] if phrase == "words" else [])).mapInArrow(run, _PAIRS)


def _extended_by_join(relation: DataFrame, frequent: DataFrame, phrase: str) -> DataFrame:
    """The same for any number of frequent phrases: chunks meet theirs by two shuffles, each phrase once per chunk."""
    key = ["lang", "word"] if phrase == "words" else ["pair"]
    local = _local(relation, phrase).select("chunk", "code", *key)
    back = local.join(frequent.select(*key, "id").hint("shuffle_hash"), key).select(F.col("chunk").alias("of"), "code", "id")

    def join(row: pa.Table, names: pa.Table) -> pa.Table:
        if row.num_rows and names.num_rows:
            codes, code = _array(row, "codes", _CODES), names.column("code").to_numpy()
            ids = np.zeros(max(int(codes.max()), int(code.max())) + 1, np.int64)
            ids[code] = names.column("id").to_numpy()
            out = _longer(row.column("chunk")[0].as_py(), row.column("own")[0].as_py(), codes, ids)
            if out is not None:
                return pa.Table.from_batches([out])
        return empty

    empty = pa.schema({"chunk": pa.int64(), "own": pa.int32(), "codes": pa.binary(), "counts": pa.binary(), "pairs": pa.binary()}).empty_table()
    rows = relation.select("chunk", "own", "codes").groupBy("chunk")
    return rows.cogroup(back.groupBy("of")).applyInArrow(join, _PAIRS)


def _local(relation: DataFrame, phrase: str) -> DataFrame:
    """One row per chunk and phrase: `chunk, code, n` and the phrase."""
    own = ["lang"] if phrase == "words" else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                phrases, n = _phrases(batch, phrase, i), _array(batch, "counts", _COUNTS, i)
                for at in range(0, len(n), ROWS_OUT):
                    part = n[at:at + ROWS_OUT]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.repeat(batch.column(c)[i], len(part)) for c in ("chunk", *own)),
                         pa.array(np.arange(at + 1, at + len(part) + 1, dtype=np.int32)), phrases.slice(at, len(part)), pa.array(part.astype(np.int64))],
                        ["chunk", *own, "code", phrase[:-1], "n"])
                pa.default_memory_pool().release_unused()

    kinds = "chunk long, lang string, code int, word binary, n long" if own else "chunk long, code int, pair long, n long"
    return relation.select("chunk", *own, phrase, "counts").mapInArrow(run, kinds)


def _frequent(relation: DataFrame, phrase: str, least: int) -> DataFrame:
    """Group-count: the frequent phrases with their number `f` and an `id` from 1 on, written once."""
    key = ["lang", "word"] if phrase == "words" else ["pair"]
    groups = _local(relation, phrase).groupBy(*key).agg(_sum(F.col("n")).alias("f")).filter(F.col("f") >= least)
    return freeze(number_rows(groups, "id").withColumn("id", F.col("id") + 1))


def mine(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The word count per language, and the phrases of 2 to `MOST_WORDS` words with at least `least` occurrences.

    The phrases have `lang, id, length, phrase, f`, the ids `left` and `right` of the phrases without the last and the
    first word, and `heads` and `tails`: the counts of what begins and of what ends the phrase, by number of words.
    """
    relation = freeze(words(docs))
    totals = relation.groupBy("lang").agg(_sum(F.col("size")).alias("total"))
    frequent = _frequent(relation, "words", least)
    none = F.array().cast("array<long>")
    firsts = frequent.select("lang", "id", F.col("word").cast("string").alias("phrase"), "f", none.alias("heads"), none.alias("tails"))
    phrases, kind, limit = None, "words", BROADCAST_WORDS
    for length in range(2, MOST_WORDS + 1):
        extend: Callable = _extended_here if frequent.count() <= limit else _extended_by_join
        relation = freeze(extend(relation, frequent, kind))
        kind, limit = "pairs", BROADCAST_PAIRS
        frequent = _frequent(relation, kind, least)
        begin = firsts.select("lang", F.col("id").alias("left"), F.col("phrase").alias("p"), F.concat("heads", F.array("f")).alias("heads"))
        end = firsts.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("q"), F.concat("tails", F.array("f")).alias("tails"))
        split = frequent.select("id", "f", F.shiftright("pair", _ID_BITS).alias("left"), F.col("pair").bitwiseAND((1 << _ID_BITS) - 1).alias("right"))
        firsts = freeze(
            split.join(begin, "left").join(end, "right")
            .select("lang", "id", "left", "right", F.concat_ws(" ", "p", "q").alias("phrase"), "f", "heads", "tails"))
        here = firsts.select("lang", "id", "left", "right", F.lit(length).alias("length"), "phrase", "f", "heads", "tails")
        phrases = here if phrases is None else phrases.unionByName(here)
    return totals, phrases


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: each language's best `top` phrases of 2 to 4 words.

    `a` counts the phrase, `l` and `r` what lies before and behind the cut with the lowest score (the first of them),
    `n` all words of the language; the score is floor(2000000 a / (l + r)). Phrases with less than `least` occurrences
    are no candidates; one with 80 % of its occurrences or more inside a longer candidate is dropped. Ranks go by score,
    then a, both descending, then phrase in byte order, so there are no ties.

    Null language counts as `und`, null and blank texts hold no words, repeated rows count each time, columns other than
    `lang` and `text` are left out. Texts of any length are read whole: what a chunk cannot hold goes on in the next
    one. No rows, or no frequent phrases, give no rows.
    """
    totals, phrases = mine(docs, least)
    wide = "decimal(20,0)"
    a, k = F.col("f").cast("decimal(20,0)"), F.col("length")
    cuts = F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.struct(i.alias("i"), F.element_at("heads", i).alias("l"), F.element_at("tails", k - i).alias("r")))
    scored = F.transform(cuts, lambda c: F.struct(
        F.call_function("div", a * SCALE, c["l"].cast(wide) + c["r"]).alias("score"), c["i"], c["l"], c["r"]))
    # a phrase inside one of two words more lies inside the one between as often or more, so one word more will do
    inside = phrases.select((k - 1).alias("length"), F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("longer"))
    inside = inside.groupBy("length", "id").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inside, ["length", "id"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < a * ABSORBED))
    rows = kept.select("lang", "phrase", "f", F.array_min(scored).alias("c")).select(
        "lang", "phrase", F.col("f").alias("a"), F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).join(totals.withColumnRenamed("total", "n"), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


# the same in SQL: every window of 1 to 4 words is counted as a list
ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) i from worded),
sizes as (select unnest([1, 2, 3, 4]) k),
counts as (select lang, k, w[i:i + k - 1] words, count(*) a from starts, sizes where i + k - 1 <= len(w) group by all),
totals as (select lang, sum(a)::bigint n from counts where k = 1 group by lang),
candidates as (select * from counts where k > 1 and a >= 30),
cuts as (select *, unnest(range(1, k)) j from candidates),
scored as (
  select c.lang, c.words, c.a, c.j, l.a l, r.a r, (2000000::hugeint * c.a // (l.a + r.a))::bigint score
  from cuts c join counts l on l.lang = c.lang and l.words = c.words[1:c.j] join counts r on r.lang = c.lang and r.words = c.words[c.j + 1:]),
best as (select * from scored qualify row_number() over (partition by lang, words order by score, j) = 1),
lengths as (select lang, words, a, k, unnest(range(2, k)) m from candidates),
places as (select *, unnest(range(1, k - m + 2)) i from lengths),
longer as (select lang, words[i:i + m - 1] words, max(a) most from places group by all),
kept as (select b.*, array_to_string(b.words, ' ') phrase from best b left join longer o on o.lang = b.lang and o.words = b.words
  where o.most is null or 100::hugeint * o.most < 80::hugeint * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select t.lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n, score
from ranked k join totals t on t.lang = k.lang where rank <= 2000
"""
