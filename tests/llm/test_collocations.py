"""Collocations against a plain count of all windows, with chunks of every size, and against the SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from weirflow.llm import collocations as co

LINES = "doc_id long, text string, lang string, phrase string, chunk long"


def brute(rows, least, top):
    f, out, low = Counter(), [], str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    total, candidates = Counter(), {}
    for (lang, w), n in f.items():
        if len(w) == 1:
            total[lang] += n
        elif n >= least:
            candidates[lang, w] = n
    gone = set()
    for (lang, w), n in candidates.items():
        for k in range(2, len(w)):
            gone |= {(lang, w[i:i + k]) for i in range(len(w) - k + 1) if 100 * n >= 80 * f[lang, w[i:i + k]]}
    for lang in total:
        rows = []
        for (x, w), a in candidates.items():
            if x == lang and (x, w) not in gone:
                s, _, lo, hi = min((2000000 * a // (f[x, w[:k]] + f[x, w[k:]]), k, f[x, w[:k]], f[x, w[k:]]) for k in range(1, len(w)))
                rows.append((-s, -a, " ".join(w).encode(), lo, hi))
        out += [(lang, i + 1, p.decode(), -a, lo, hi, total[lang], -s) for i, (s, a, p, lo, hi) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def lines(seed):
    r = random.Random(seed)
    words = ["a", "B", "cé", "d\xa0d", "Éa", "e\x00", "x", "y", "z'", "中"]
    rows = []
    for i in range(120):
        t = "".join(r.choice(words[: r.randint(1, 10)]) + r.choice(["  ", " ", " ", "\t", " ", ", ", ".", "\n", " \x0b"]) for _ in range(r.randint(0, 60)))
        rows.append((i, t, r.choice(["en", "en", "de", None, "und"]), "p", i))
    rows += [(900, None, "en", "p", 0), (901, "", "fr", "p", 0), (902, " \t\n.,", "en", "p", 0), (None, "a b " * 3000, "en", "p", 0), rows[0], rows[0]]
    rows.append((903, "one two three four five six " * 40, "de", None, None))
    return rows


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("chunk, flush, held, shared, top", [(7, 1 << 22, 1 << 25, 10**6, 2000), (64, 500, 900, 0, 2000), (1 << 19, 1 << 22, 1 << 25, 10**6, 5)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, chunk, flush, held, shared, top):
    monkeypatch.setattr(co, "BROADCAST_WORDS", shared)  # 0: chunks meet their frequent phrases by shuffles
    monkeypatch.setattr(co, "BROADCAST_PAIRS", shared)
    monkeypatch.setattr(co, "CHUNK", chunk)
    monkeypatch.setattr(co, "FLUSH_BYTES", flush)
    monkeypatch.setattr(co, "HELD_BYTES", held)
    rows = lines(4)
    want = brute(rows, 12, top)
    assert len(want) > (10 if top == 5 else 60)
    assert got(co.collocations(spark.createDataFrame(rows, LINES).repartition(3), 12, top)) == want


def test_sql_says_the_same(spark):
    documents = spark.createDataFrame([r for x in range(8) for r in lines(x)], LINES).toPandas()  # noqa: F841 (read by DuckDB)
    want = sorted(duckdb.sql(co.ORACLE_SQL).fetchall())
    assert want == got(co.collocations(spark.createDataFrame(documents.astype(object).where(documents.notna(), None), LINES))) and want


def test_products_past_64_bits(spark):
    big = 9 * 10**18 // 4
    row = spark.createDataFrame([(big, big + 1)], "f long, l long")
    score = row.selectExpr(f"cast(f as decimal(20,0)) * {co.SCALE} div (cast(l as decimal(20,0)) + l) as s").first()["s"]
    assert score == co.SCALE * big // (2 * (big + 1))


def test_no_rows_and_no_frequent_phrases(spark):
    assert co.collocations(spark.createDataFrame([], LINES)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, "a b c", "en", "", 0)], LINES)).count() == 0


def test_relations_hold_bytes_and_no_arrays(spark):
    docs = spark.createDataFrame([(i, "a b c d, a b", "en", "", 0) for i in range(40)], LINES)
    relation = co.words(docs)
    frequent = co._frequent(relation, "words", 30)
    for extended in (co._extended_here(relation, frequent, "words"), co._extended_by_join(relation, frequent, "words")):
        for df in (relation, extended):
            assert not [c for c, kind in df.dtypes if kind.startswith("array")]
        assert sorted(r["n"] for r in co._local(extended, "pairs").groupBy("pair").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()) == [40, 40, 80]
