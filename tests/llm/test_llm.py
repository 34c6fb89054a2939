"""The training-data operators against brute force, on odd rows and on the given tables."""

import hashlib
import json
import re
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_oracle import TABLES, rows_of  # noqa: E402

from fleetlens.llm import bpe, catalog, cotraining, decontaminate, licenses, line_dedup, quality_rules, sharding, simhash, token_files, url_filter  # noqa: E402
from fleetlens.llm.components import connected_components  # noqa: E402
from fleetlens.llm.frames import table  # noqa: E402

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, IDS string, Kept string, Fingerprint string, N_words int"
PROSE = "the cat sat on a mat and looked at seven grey birds while rain fell over the old town hall near a river"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"{w}{i}" for i in range(3000) for w in ("alpha", "Beta."))
    texts = [None, "", " \n\t ", PROSE, PROSE.upper(), PROSE, "<|endoftext|> don't 'we're  !!'s\n\n x", "漢字 かな。é", long, "x", "a b", PROSE + "\n" + PROSE]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "c", "d", "e", 1) for i, t in enumerate(texts)]
    rows += [(3, PROSE, "en", "s1", 1, "c", "d", "e", 1)] * 2 + [(None, "Only here null id", "en", "s1", 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df, cur = catalog.queries()[name](spark, sf), con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


# -- 1: licenses -------------------------------------------------------------------------------------------------------

def phrase_places(text):
    words = re.findall(WORD, low(text))
    found = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split())
    return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_licenses_match_brute_force(spark, sf, docs):
    got = {r[0]: tuple(r[1:]) for r in rows(catalog.op1_license_scan(spark, sf), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")}
    assert got == {i: phrase_places(t) for i, t in docs}


def test_license_phrases_inside_templates_and_spans(spark):
    cut = licenses.TEMPLATES["gpl"].replace("redistribute it and/or", "share it or")
    texts = ["see cc by mit license MIT License apache gnu general public license", "x the gnu general public license y", licenses.TEMPLATES["apache"], "intro words " + cut + " tail", "gnu general public"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id int, text string, spans int")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], ",".join(got[i]["base_labels"])) == phrase_places(t)
    assert [s["label"] for s in got[2]["spans"]] == ["apache"] and got[2]["spans"][0]["cover"] == 1.0
    assert [s["label"] for s in got[3]["spans"]] == ["gpl"] and got[3]["spans"][0]["start"] == 2
    assert not got[0]["spans"] and not got[4]["spans"]


def test_matching_statistics_of_the_automaton():
    rng = np.random.default_rng(3)
    words = [[bytes([97 + x]) for x in rng.integers(0, 3, n)] for n in (9, 14, 1, 20)]
    auto = licenses.Automaton(words)
    for _ in range(200):
        text = [bytes([97 + x]) for x in rng.integers(0, 4, 12)]
        state = got = 0
        for i, w in enumerate(text):
            while state and w not in auto.next[state]:
                state = auto.link[state]
                got = auto.length[state]
            state, got = (auto.next[state][w], got + 1) if w in auto.next[state] else (0, 0)
            want = max((n for n in range(i + 2) if any(t[k:k + n] == text[i + 1 - n:i + 1] for t in words for k in range(len(t) - n + 1))), default=0)
            assert got == want


# -- 2 and 10: token files, BPE ----------------------------------------------------------------------------------------

def tokenizer():
    return Tokenizer.from_file(catalog.TOKENIZER)


def test_bpe_matches_the_library(spark, sf, docs):
    own = tokenizer()
    want = {}
    for i, t in docs:
        ids = own.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in rows(catalog.op10_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")} == want


def test_bpe_on_random_and_odd_texts(odd):
    rng = np.random.default_rng(1)
    letters = [*"aAb1 2\n\t'!.,<|>_é漢　\x1c\x85\xa0s tre-", "<|endoftext|>", "'re", "  "]
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 3000)]
    texts += [r["text"] or "" for r in odd.collect()]
    own, lib = bpe.Encoder(catalog.TOKENIZER), tokenizer()
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids, t
        assert own.decode(ids) == t
    done = bpe.encode_decode(odd, catalog.TOKENIZER)
    assert done.columns == [*[c for c in odd.columns if c != "IDS"], "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in done.collect()) and done.count() == odd.count()
    assert bpe.encode_decode(odd.limit(0), catalog.TOKENIZER).count() == 0


def test_a_full_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 2)
    own, lib = bpe.Encoder(catalog.TOKENIZER), tokenizer()
    for t in [PROSE, "", "a long tail " * 50, PROSE]:
        assert own.encode([t.encode()])[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_a_fragment_of_very_many_tokens():
    from array import array
    from types import SimpleNamespace

    own, n = bpe.Encoder(catalog.TOKENIZER), (1 << 24) + 3
    many = SimpleNamespace(ids=array("I", [7]) * n)
    own.tokenizer = SimpleNamespace(model=own.tokenizer.model, encode_batch_fast=lambda found, add_special_tokens: [many for _ in found])
    ids, ends = own.encode_flat(["漢字".encode()])
    assert len(ids) == n and (ids == 7).all() and ends.tolist() == [n]


def test_token_files_match_the_library(spark, sf, docs):
    own, start, want = tokenizer(), 0, []
    for i, t in docs:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(rows(catalog.op2_token_files(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_token_files_of_odd_rows_and_random_access(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 64)
    manifest = token_files.write_token_files(odd, catalog.TOKENIZER, str(tmp_path / "odd"))
    writer = token_files.FileWriter(str(tmp_path / "one.zst"), 2)
    arrays = [np.arange(n, dtype="<u4") for n in (0, 1, 200, 63, 64, 0)]
    for i, a in enumerate(arrays):
        writer.add(None if i == 3 else i, a)
    assert writer.close()[:2] == (6, 328)
    for k, ids in enumerate(token_files.read_documents(spark, str(tmp_path / "one.zst"), range(6))):
        assert ids.tolist() == arrays[k].tolist()
    assert token_files.FileReader(str(tmp_path / "one.zst")).doc_ids == [0, 1, 2, None, 4, 5]
    raw = bytearray((tmp_path / "one.zst").read_bytes())
    table_at = len(raw) - 9 - 12 * 6
    raw[table_at + 8] ^= 1  # the first frame's checksum
    (tmp_path / "bad.zst").write_bytes(raw)
    with pytest.raises(ValueError, match="checksum"):
        token_files.FileReader(str(tmp_path / "bad.zst")).document(1)
    monkeypatch.undo()
    manifest = token_files.write_token_files(odd, catalog.TOKENIZER, str(tmp_path / "all"))
    got = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got][0] is None and [r["doc_id"] for r in got][1:] == sorted(r["doc_id"] for r in odd.collect() if r["doc_id"] is not None)
    assert [r["start"] for r in got] == np.cumsum([0, *(len(r["ids"]) // 4 for r in got)])[:-1].tolist()
    empty = token_files.write_token_files(odd.limit(0), catalog.TOKENIZER, str(tmp_path / "none"))
    assert token_files.read_token_files(empty).count() == 0


# -- 3: shards ---------------------------------------------------------------------------------------------------------

def test_shards_are_exact_and_gapless(spark, sf, docs):
    got = catalog.op3_shuffle_shards(spark, sf).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs]
    by = Counter(r["shard"] for r in got)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    again = catalog.op3_shuffle_shards(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_communication_matrix():
    sizes = sharding.shard_sizes(103, 8)
    total = np.zeros((3, 8))
    for seed in range(400):
        m = sharding.communication_matrix([50, 0, 53], sizes, seed)
        assert m.sum(axis=1).tolist() == [50, 0, 53] and m.sum(axis=0).tolist() == sizes.tolist()
        total += m
    assert abs(total[0] / 400 - 50 * sizes / 103).max() < 0.5
    rng = np.random.default_rng(0)
    draws = [sharding._hypergeometric(rng, 6 * 10**8, 9 * 10**8, 10_000) for _ in range(300)]
    assert abs(np.mean(draws) - 4000) < 12 and 40 < np.std(draws) < 58
    assert sharding._hypergeometric(rng, 5, 2 * 10**9, 2 * 10**9 + 5) == 5


def test_shards_of_odd_rows(odd, tmp_path, monkeypatch):
    odd.write.parquet(str(tmp_path / "t"))
    df = odd.sparkSession.read.parquet(str(tmp_path / "t")).withColumn("Shard", F.lit("x"))
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 2)
    got = sharding.shuffle_into_shards(df, 4).collect()
    assert Counter(r["shard"] for r in got) == {0: 4, 1: 4, 2: 4, 3: 3}
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s in range(4) for k in range(4 if s < 3 else 3)]
    assert Counter(r["text"] for r in got) == Counter(r["text"] for r in odd.collect())
    assert sharding.shuffle_into_shards(df.limit(0), 4).count() == 0


# -- 4: urls -----------------------------------------------------------------------------------------------------------

def test_components_of_any_shape(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 5), (7, None)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(60)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in (e for e in edges if None not in e):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges + edges[:5], "src long, dst long")
    assert sorted(rows(connected_components(df), "node", "component")) == sorted((x, find(x)) for x in root)
    assert connected_components(df.limit(0)).count() == 0


def test_url_rules_match_brute_force(spark, sf):
    pages = duckdb.sql(f"SELECT page_id, url FROM '{sf}/pages.parquet'").fetchall()
    got = {r["page_id"]: r for r in catalog.op4_url_filter(spark, sf).collect()}
    assert len(got) == len(pages)
    for i, url in pages:
        _, mark, rest = (url or "").partition("://")
        host = re.match("[^/?#]*", rest)[0] if mark else ""
        path = re.match("[^?#]*", rest[len(host):])[0] if mark else ""
        host = low(host)
        fits = [(len(h + p), k, h + p) for k, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[2] if fits else None)
        if fits:
            assert got[i]["verdict"] == max(fits)[1]


def test_decisions_follow_redirects(spark):
    canon = '<head><link rel="canonical" href="{}"></head>'.format
    refresh = "<META HTTP-EQUIV=refresh content='0; url={}'>".format
    data = [
        (1, "http://a.org/x", canon("https://b.org/y")), (2, "http://b.org/y/", refresh("http://c.net/es/1")), (3, "http://c.net/es/1", ""),
        (4, "http://d.org/1?utm_source=f", canon("/2")), (5, "https://D.org/2#top", canon("http://www.example.com/en/7")), (6, "http://e.org/1", canon("http://d.org/2")),
        (7, "http://e.org/1", canon("http://x.net/fr/3")), (8, "http://f.org/", None), (9, None, canon("http://x.net/fr/")), (10, "no scheme", ""), (11, "http://only.target.org/", canon("http://q.net/fr/9")),
        (11, "http://only.target.org/", canon("http://q.net/fr/9")), (12, "http://A.org/x/#z", ""), (13, "http://g.org/p?id=1&ref=x", ""), (14, "http://g.org/p?ref=y&id=2", canon("http://c.net/es/1"))]
    df = spark.createDataFrame([(*r, "v", "r") for r in data], "page_id int, url string, html string, Verdict string, RULE string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert url_filter.judge_urls(df).count() == len(data)
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"),
                   8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "block"), 12: (None, "block"), 13: (None, "allow"), 14: (None, "block")}
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_links_of_every_form_are_followed(spark):
    canon = '<link rel="canonical" href="{}">'.format
    refresh = """<meta http-equiv="refresh" content="0; url='{}'">""".format
    target = "http://c.net/es/1"
    data = [
        ("http://a.org/d/x", canon("next.html"), "http://a.org/d/next.html"), ("http://b.org", canon("page2"), "http://b.org/page2"), ("http://c.org/d/x?a=1", canon("?id=3"), "http://c.org/d/x?id=3"),
        ("http://d.org/d/e/x", canon("../y?q=1"), "http://d.org/d/y?q=1"), ("http://e.org/d/x", canon("./y"), "http://e.org/d/y"), ("http://f.org/x", canon("/a/../y"), "http://f.org/y"),
        ("http://g.org/x", refresh("http://other.org/1"), "http://other.org/1"), ("http://h.org/x", canon("http://other.org/2") + canon("http://other.org/3"), "http://other.org/3"),
        ("http://i.org/x", refresh("http://other.org/4") + refresh("/y"), "http://i.org/y"), ("http://j.org/x", canon("z?u=http://k.org/"), "http://j.org/z?u=http://k.org/")]
    rows = [(k, u, h) for k, (u, h, _) in enumerate(data)] + [(100 + k, t, canon(target)) for k, (_, _, t) in enumerate(data)]
    rows += [(200, "http://l.org/x", canon("#top") + canon("mailto:x@c.net") + canon("javascript:void")), (300, target, "")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df).collect()}
    assert {i for i, v in got.items() if v != "block"} == {200}


# -- 5: lines ----------------------------------------------------------------------------------------------------------

def test_repeated_chunks_go_but_first_places_stay(spark, odd):
    lines = [f"line number {i} of the passage" for i in range(40)]
    shared = "\n".join(lines)
    texts = {1: "head one\n" + shared + "\ntail", 2: "other\nhead two\nmore\n" + shared, 3: "nothing shared\nhere", 4: shared}
    df = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, text string, N_lines int")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_chunks(df).collect()}
    assert got[1]["text"] == texts[1] and got[3]["text"] == texts[3] and got[1]["n_removed_chunks"] == 0
    assert got[2]["n_removed_lines"] > 20 and got[4]["n_removed_lines"] > 20  # boundaries come back in step after a shift
    for i in (2, 4):
        assert len(got[i]["text"].split("\n")) * bool(got[i]["text"]) == got[i]["n_lines"] - got[i]["n_removed_lines"]
    out = line_dedup.drop_repeated_chunks(odd).collect()
    assert len(out) == odd.count() and [r["text"] for r in out if r["doc_id"] == 0] == [None]
    assert line_dedup.drop_repeated_chunks(odd.limit(0)).count() == 0


def slow_passages(texts):
    """Lines that every shared run of 50 words or more leaves, by comparison of all runs with all earlier places."""
    gone, seen = {}, {}
    for d in sorted(texts):
        lines, out = texts[d].split("\n"), set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                body = tuple(lines[i:j + 1])
                if len(re.findall(r"[^ \t\r]+", " ".join(body))) < 50 or not body[0].strip() or not body[-1].strip():
                    continue
                e, s = seen.setdefault(body, (d, i))
                if (e, s) != (d, i):
                    out |= set(range(max(i, s + len(body)) if e == d else i, j + 1))
        gone[d] = out
    return gone


def test_passages_of_few_lines_go_whole(spark, odd):
    rng, texts, spans = np.random.default_rng(5), {}, {}
    line = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**9, n))
    for trial, (n, words) in enumerate([(1, 60), (2, 30), (3, 20), (4, 15), (4, 45), (6, 10), (8, 10), (10, 12), (50, 1), (5, 11)] * 4):
        shared = [line(words) for _ in range(n)]
        shared.insert(n // 2, "") if n > 1 and trial % 2 else None
        for copy in (0, 1, 2):
            before = [line(int(rng.integers(1, 40))) for _ in range(int(rng.integers(0, 5)))]
            d = 1000 * copy + trial
            texts[d] = "\n".join(before + shared + [line(9) for _ in range(int(rng.integers(0, 4)))])
            spans[d] = range(len(before), len(before) + len(shared))
    texts[5000] = "\n".join(["again and again"] * 60)  # overlaps itself: 17 lines have 50 words
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_passages(df).collect()}
    want = slow_passages({d: t for d, t in texts.items() if d != 5000})
    for d, t in texts.items():
        lines = t.split("\n")
        if d < 1000:
            assert got[d]["text"] == t and got[d]["n_removed_lines"] == 0
        elif d < 5000:
            assert want[d] == set(spans[d])
            assert got[d]["text"] == "\n".join(x for i, x in enumerate(lines) if i not in want[d]) and got[d]["n_removed_lines"] == len(want[d])
    assert set(got[5000]["text"].split("\n")) == {"again and again"} and 0 < got[5000]["n_removed_lines"] <= 59
    out = line_dedup.drop_repeated_passages(odd).collect()
    assert len(out) == odd.count() and [r["text"] for r in out if r["doc_id"] == 0] == [None]
    assert line_dedup.drop_repeated_passages(odd.limit(0)).count() == 0


# -- 6: quality rules --------------------------------------------------------------------------------------------------

def test_statistics_match_brute_force(docs, odd):
    for text in [t for _, t in docs] + [r["text"] for r in odd.collect()] + ["a b c a b c", "a a a a", "x y z w x y z"]:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        runs = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {k + d for k in range(len(words) - 2) if runs[tuple(words[k:k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert quality_rules.statistics(text.encode()) == want


def test_mcd_finds_planted_outliers(spark, odd):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(3000)]
    data = [(i, " ".join(rng.choice(vocab, int(rng.integers(80, 400)))), "en", "big" if i % 3 else f"small{i % 40}") for i in range(400)]
    data += [(1000 + i, " ".join(x + "###" for x in rng.choice(vocab, 200)), "en", "big") for i in range(12)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert not any(got[1000 + i]["kept"] for i in range(12)) and all(got[i]["kept"] for i in range(400))
    out = quality_rules.quality_rules(odd).collect()  # too few rows for an estimate: base rules only
    assert len(out) == odd.count() and all(r["kept"] != r["base_failed"] and r["distance"] is None for r in out)
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


# -- 7: SimHash --------------------------------------------------------------------------------------------------------

def slow_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", low(text))
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in root}


def test_simhash_matches_brute_force(spark, sf, docs, odd):
    prints = {i: slow_fingerprint(t) for i, t in docs}
    part = components(set(prints.values()))
    low_id = {}
    for i in sorted(prints):
        low_id.setdefault(part[prints[i]], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalog.op7_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", low_id[part[f]]) for i, f in prints.items()}
    out = simhash.near_components(odd).collect()
    assert len(out) == odd.count() and {r["component_id"] for r in out if not (r["text"] or "").strip()} == {0}
    assert {r["component_id"] for r in out if low(r["text"]) == PROSE} == {3}
    assert simhash.near_components(odd.limit(0)).count() == 0


def test_links_of_dense_and_sparse_fingerprints(spark):
    rng = np.random.default_rng(7)
    near = [0] + [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 4) for _ in range(150)]
    far = [int(x) for x in rng.integers(0, 2**63, 300)]
    chain = [far[0] ^ (2**(2 * k) - 1) << 10 for k in range(12)]
    prints = sorted({*near, *far, *chain})
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in prints], "fingerprint long").repartition(4)
    got = {}
    for node, part in rows(connected_components(simhash.links(df)), "node", "component"):
        got.setdefault(part, set()).add(node % 2**64)
    want = {}
    for f, part in components(prints).items():
        want.setdefault(part, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_every_word_has_an_anchor_within_one_bit():
    x = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    anchors, members = simhash.anchors_of(x)
    away = np.bitwise_count(anchors ^ members)
    assert away.max() <= 2 and not simhash.syndromes(anchors).any()
    assert len(np.unique(members[away <= 1])) == len(np.unique(x))
    assert np.unique(members, return_counts=True)[1].max() == 33


# -- 8: decontamination ------------------------------------------------------------------------------------------------

def test_every_window_is_found(spark, odd):
    rng = np.random.default_rng(4)
    items = [(1, " ".join(f"q{i}" for i in range(30))), (2, "Short Item, five words"), (3, " ".join(["same"] * 12)), (4, None), (5, "!!"), (2, "another text under id two with some eleven words in it"), (None, "no id but it hits")]
    docs = [(100 + k, f"lead {' '.join(items[0][1].split()[k:k + n])} tail") for k in range(0, 20, 3) for n in (9, 10, 11, 20)]
    docs += [(1, "x short item five words y"), (2, "same " * 40), (3, "same " * 9), (4, "another text under id two with some eleven words in it"), (5, "no ID but it hits"), (6, " ".join(f"q{rng.integers(30)}" for _ in range(500)))]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, Item_ids string").unionByName(odd.select("doc_id", "text", F.lit("z").alias("Item_ids")))
    got = decontaminate.mark_contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == df.count()
    for r in got:
        words, hit, ids = re.findall(WORD, low(r["text"])), set(), set()
        for i, t in items:
            own = re.findall(WORD, low(t))
            n = min(10, len(own))
            for q in range(len(own) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p:p + n] == own[q:q + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(i)} - {"None"}
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) == (len(words), len(hit), sorted(ids), bool(hit)), r["text"]
    none = decontaminate.mark_contaminated(odd, spark.createDataFrame([], "item_id long, text string"))
    assert none.count() == odd.count() and none.where("contaminated").count() == 0
    assert decontaminate.mark_contaminated(odd.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# -- 9: classifier -----------------------------------------------------------------------------------------------------

def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    train = labels.where("doc_id % 4 <> 1")
    held = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in labels.where("doc_id % 4 = 1").collect()}
    got = {r["doc_id"]: r for r in cotraining.classify_quality(docs, train).collect()}
    assert len(got) == docs.count()
    right = [got[i]["kept"] == good for i, good in held.items()]
    assert len(right) > 60 and np.mean(right) > 0.8
    assert np.mean([got[i]["kept"] for i, good in held.items() if good]) > 0.93


def test_a_bounded_sample_still_has_both_sides(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "MAX_LABELLED", 270)  # two thirds of the labelled rows
    sf = "/root/testdata/sf0.01"
    got = cotraining.classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert got.select("score").distinct().count() > 100 and got.where("not kept").count() < 400


def test_a_bounded_sample_rejects_some(spark, monkeypatch):
    assert (cotraining.MAX_LABELLED, cotraining.FIT_STEPS) == (20_000, 120)
    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(cotraining, "MAX_LABELLED", 270)
    got = cotraining.classify_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert 0 < got.where("not kept").count() < 400


def test_classifier_without_labels_and_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = cotraining.classify_quality(odd, none).collect()
    assert len(out) == odd.count() and all(r["kept"] is True and r["score"] == 1.0 for r in out)
    one = spark.createDataFrame([(3, 1, None), (3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in cotraining.classify_quality(odd, one).collect())
    assert cotraining.classify_quality(odd.limit(0), one).count() == 0


def test_registered_queries_read_tables():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == set(map(str, range(1, 14)))
    assert "pipeline" in names and json.dumps(sorted(entry.oracle_sql()))
