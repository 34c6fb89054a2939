"""Each stage of the corpus pipeline on its own input, and the pipeline as a whole."""

import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from fleetlens.llm.cotraining import classify_quality
from fleetlens.llm.frames import table
from fleetlens.session import scratch_path, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def inputs(spark, sf):
    """The input of each stage, and what the last one returns."""
    docs, out = table(spark, sf, "documents"), {}
    for name, stage in pipeline.STAGES:
        out[name] = docs
        docs = stored(stage(spark, docs, sf), scratch_path(spark, name))
    out["end"] = docs
    return out


def test_stages_keep_the_columns(inputs):
    assert [n for n, _ in pipeline.STAGES] == list(inputs)[:-1]
    assert all(inputs[n].columns == COLUMNS for n, _ in pipeline.STAGES)


def test_rejected_documents_go(spark, sf, inputs):
    judged = classify_quality(inputs["quality_classifier"], table(spark, sf, "labels"))
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    assert {r["doc_id"] for r in inputs["line_dedup"].collect()} == kept


def test_one_document_of_each_group_stays(inputs):
    from test_llm import components, slow_fingerprint

    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in inputs["simhash_near_dedup"].collect()}
    part = components(set(prints.values()))
    first = {}
    for i in sorted(prints):
        first.setdefault(part[prints[i]], i)
    assert sorted(r["doc_id"] for r in inputs["benchmark_decontamination"].collect()) == sorted(first.values())


def test_no_window_of_a_benchmark_item_is_left(spark, sf, inputs):
    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = re.findall(word, r["text"].translate(lower))
        windows |= {tuple(w[k:k + 10]) for k in range(len(w) - 9)}

    def clean(text):
        w = re.findall(word, text.translate(lower))
        return not any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9))

    before = {r["doc_id"]: clean(r["text"]) for r in inputs["benchmark_decontamination"].collect()}
    assert {r["doc_id"] for r in inputs["bpe_encoding"].collect()} == {i for i, x in before.items() if x}


def test_the_end_has_the_ids(inputs):
    own = Tokenizer.from_file(pipeline.TOKENIZER)
    texts = {r["doc_id"]: r["text"] for r in inputs["bpe_encoding"].collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in inputs["end"].collect()}
    assert got == {i: own.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_stages_take_repeated_rows_nulls_and_empty_tables(spark, sf):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (1, text, "en", None, 3), (2, text, None, "a", 3), (None, None, None, None, None), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__doc", F.lit("clash"))
    docs = stored(docs.drop("__doc"), scratch_path(spark, "odd"))
    assert sorted(r["doc_id"] for r in pipeline.simhash_near_dedup(spark, docs, sf).collect()) == [1, 3]
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        stage(spark, docs, sf).collect()


def test_near_copies_beyond_two_bits_go(spark, sf):
    import numpy as np

    rng = np.random.default_rng(3)
    words, rows = [f"word{i}" for i in range(5000)], []
    for i in range(30):
        base = list(rng.choice(words, int(rng.integers(60, 400))))
        rows.append((i, " ".join(base)))
        for copy in range(1, 4):  # a changed word in 60 touches five of its shingles
            text = list(base)
            for k in rng.choice(len(text), len(text) // 60, replace=False):
                text[k] = f"other{rng.integers(10**9)}"
            rows.append((100 * copy + i, " ".join(text)))
        rows.append((1000 + i, " ".join(base[:len(base) // 2] + list(rng.choice(words, len(base))))))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = stored(docs, scratch_path(spark, "near"))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    first, part = {}, {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and part[i] != part[j]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = {k: new if v == old else v for k, v in part.items()}
    for i in sorted(sets):
        first.setdefault(part[i], i)
    assert len(first) < 100
    assert sorted(r["doc_id"] for r in pipeline.simhash_near_dedup(spark, docs, sf).collect()) == sorted(first.values())
