"""The corpus pipeline stage by stage: each decision against a plain version, on rows with clashing names and faulty ids."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from weirflow.llm import decontaminate, pii_crf, quality_ri, simhash_pivots
from weirflow.llm.common import tokenizer_path
from weirflow.llm.packing import CAPACITY, END_ID, TOKENIZER

CLASHES = ["row", "ROW_0", "text_read", "text_redacted", "rejected_id", "leaked_id", "dropped_id", "copy_number__", "fp", "component_id"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
ITEM = "A farmer has 17 baskets with 23 apples each and gives 5 baskets to the neighbour; how many apples remain with the farmer?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, shared and missing ids, copies, near copies, a leak, personal data, junk and one long text."""
    r = random.Random(8)
    syllables = "an be co di el fo ga hi in jo ka lu me no or pa qui re su te".split()

    def prose(n):
        return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ".", ","]) for _ in range(n))

    good = [prose(r.randint(30, 90)) for _ in range(60)]
    junk = [" ".join(r.choice(["zz9", "$$$", "click!!", "9999", "xxx"]) for _ in range(r.randint(30, 90))) for _ in range(60)]
    texts = [t for pair in zip(good, junk) for t in pair]
    texts += [good[3], good[3] + " or", None, "", " \n", prose(9000), good[5] + " " + ITEM, "Write to ann.lee@example.org or 192.168.7.9 " + good[7]]
    ids = [*range(len(texts))]
    ids[-2] = ids[-1] = None  # the leak and the personal data have no id
    ids[1] = ids[0]  # a junk row shares a good one's id
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c}{n}" for c in CLASHES]) for n, (i, t) in enumerate(zip(ids, texts))]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    marks = [(i, int(t in good), 0) for i, t in enumerate(texts[:120])]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def frame(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]


def test_quality_judges_each_row_by_its_text(spark, folder):
    path, rows = folder
    docs = frame(spark, path)
    kept = corpus_pipeline.quality(spark, docs, path)
    assert kept.columns == docs.columns
    model = quality_ri.fit(*quality_ri.training_sample(docs, spark.read.parquet(f"{path}/labels.parquet")))
    cache = model.rows()
    score = model.score(np.stack([model.pooled((r[1] or "").encode(), cache) for r in rows]))
    want = {r for r, x in zip(rows, score) if x >= quality_ri.REJECT_BELOW}
    assert {tuple(x) for x in kept.collect()} == want
    assert rows[0] in want and rows[1] not in want and rows[0][0] == rows[1][0]  # a good row stays though a junk row has its id


def test_near_duplicates_keep_one_row_of_each_group(spark, folder):
    path, rows = folder
    docs = frame(spark, path)
    kept = corpus_pipeline.near_duplicates(spark, docs, path)
    assert kept.columns == docs.columns
    prints = [simhash_pivots.fingerprint((r[1] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = {g: min((r[0] is None, r[0] or 0) for r, x in zip(rows, group) if x == g) for g in group}
    got = [tuple(x) for x in kept.collect()]
    assert sorted(group[rows.index(x)] for x in got) == sorted(want)
    assert all((x[0] is None, x[0] or 0) == want[group[rows.index(x)]] for x in got)


def test_decontamination_drops_the_leak_without_an_id(spark, folder):
    path, rows = folder
    docs = frame(spark, path)
    kept = corpus_pipeline.decontamination(spark, docs, path)
    assert kept.columns == docs.columns
    assert {tuple(x) for x in kept.collect()} == {r for r in rows if ITEM not in (r[1] or "")}


def test_pii_changes_texts_and_nothing_else(spark, folder):
    path, rows = folder
    docs = frame(spark, path)
    out = corpus_pipeline.pii(spark, docs, path)
    assert out.columns == docs.columns
    got = sorted((tuple(x) for x in out.collect()), key=lambda x: x[5:])
    old = sorted(rows, key=lambda x: x[5:])
    assert [(x[0], *x[2:4], *x[5:]) for x in got] == [(x[0], *x[2:4], *x[5:]) for x in old]
    for new, was in zip(got, old):
        assert new[4] == (len(new[1]) if new[1] is not None else was[4])
        base = pii_crf.base_spans(was[1] or "")
        assert not [was[1][s:e] for s, e, _ in base if new[1] and was[1][s:e] in new[1]] and (new[1] is None) == (was[1] is None)
        if not re.search(r"[@\d]|dot", was[1] or ""):
            assert new[1] == was[1]


def test_run_packs_what_is_left_without_gaps(spark, folder):
    path, rows = folder
    pieces = corpus_pipeline.run(spark, path).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(n for _, n in parts) <= CAPACITY
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    docs = frame(spark, path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    lengths = sorted(len(tokenizer.encode(x["text"] or "", add_special_tokens=False).ids) + 1 for x in docs.collect())
    whole = {}
    for p in pieces:
        whole.setdefault(p.doc_id, []).append(p.length)
    assert sum(lengths) == sum(p.length for p in pieces) and END_ID == 1
    assert len(by_sequence) >= -(-sum(lengths) // CAPACITY)


def test_stages_of_an_empty_table(spark, folder, tmp_path):
    path, _ = folder
    empty = frame(spark, path).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, path)
        assert out.columns == empty.columns and out.count() == 0
    assert decontaminate.without_leaks(empty, spark.read.parquet(f"{path}/benchmark.parquet")).count() == 0
