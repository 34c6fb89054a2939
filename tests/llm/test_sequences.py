"""Conversation repair, substring dedup and phrase mining against brute force, on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import collocations, conversations, substring_dedup
from fleetlens.llm.word_windows import Bits

LOW = {c: c + 32 for c in range(65, 91)}
SPACE = r"[^\x20\x09-\x0d]+"


# -- conversation repair ---------------------------------------------------------

MOVES = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(cost, audit, lines) over all edits of (role, text, fault), audits compared as whole strings."""
    later = None
    for i in range(len(rows), -1, -1):
        now = {"": (0, "", ()), "a": (0, "", ())} if i == len(rows) else {}

        def take(state, value, now=now):
            if state not in now or value[:2] < now[state][:2]:
                now[state] = value
                return True
            return False

        if i < len(rows):
            role, text, fault = rows[i]
            for state in ("", "s", "u", "a"):
                if state in later:
                    cost, audit, rest = later[state]
                    take(state, (cost + 2, "D" + audit, rest))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault == "truncated" else 0
                for letter, new, paid in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    after = MOVES.get((state, new[:1]))
                    if after in later:
                        cost, audit, rest = later[after]
                        take(state, (cost + paid + more, letter + audit, ((new, text), rest)))
        while any([take(s, (now[t][0] + 5, "I" + now[t][1], ((new, ""), now[t][2])))
                   for s in ("", "s", "u", "a") for new in ("user", "assistant") for t in [MOVES.get((s, new[0]))] if t in now]):
            pass
        later = now
    cost, audit, rest = later[""]
    lines = []
    while rest:
        lines.append(":".join(rest[0]))
        rest = rest[1]
    return cost, audit, lines


def slow_repair(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else x
        role, text, kind = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = [r[0] for r in g if r[0] is not None]
        seen, faults = set(), []
        for _, role, text in g:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(g, g[1:]))
        cost, audit, lines = cheapest([(r[1], r[2], f) for r, f in zip(g, faults)])
        n = Counter(faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def repaired(df, **options):
    done = conversations.with_digest(conversations.repair(conversations.damaged(df), **options))
    return [tuple(r) for r in done.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.fixture(scope="module")
def talks(spark):
    """Nulls, ties, repeated rows (one 5,000 times), one long conversation that never converges, odd roles, clashing names."""
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(25)]:
        for turn in range(rng.choice([1, 3, 20, 120])):
            rows.append((conv, None if rng.random() < 0.05 else rng.randrange(60) if rng.random() < 0.3 else turn,
                         rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]),
                         rng.choice([None, "", " \n", "Hi.", "Yes", "xxxxx?", f"text {rng.randrange(50)}", f"say {rng.randrange(50)}! "])))
    rows += [(7, 3, "user", "same.")] * 5000
    rows += [(8, i, "user", f"cut {i}") for i in range(300)]
    rows += [(9, 1, "user", "long. " * 50_000)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, Audit string").repartition(5)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 7}])
def test_repair_is_the_cheapest_and_least(talks, options):
    want = slow_repair([tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()])
    assert by_id(repaired(talks, **options)) == by_id(want)


def test_repair_query_on_the_table(spark, sf):
    from fleetlens.llm.catalog import queries
    from fleetlens.llm.frames import table

    df = queries()["op11_conversation_repair"](spark, sf)
    want = slow_repair([tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()])
    assert by_id([tuple(r) for r in df.collect()]) == by_id(want)


def test_repair_of_nothing(talks):
    assert repaired(talks.limit(0)) == []
    done = conversations.repair(conversations.plain(talks.where("conv_id = 8").limit(3)))
    assert done.rows.columns == ["conv", "part", "seq", "pos", "role", "text"]


def test_vectors_are_few_and_steps_exact():
    assert len(conversations.KINDS) < 100
    rng = random.Random(1)
    for _ in range(300):
        codes = bytes(rng.randrange(conversations.NONE + 1) for _ in range(rng.randrange(12)))
        maps = conversations._converged(codes)
        for end in range(len(conversations.KINDS)):
            kind = end
            for c in reversed(codes):
                kind = conversations.STEP[kind][c]
            assert maps[end] == kind


# -- substring dedup ---------------------------------------------------------------

def slow_substrings(rows, size=substring_dedup.WINDOW):
    age = lambda i: substring_dedup.LAST if i is None else i
    texts, first = [re.findall(SPACE, t or "") for _, t in rows], {}
    for (i, _), w in zip(rows, texts):
        for p in range(len(w) - size + 1):
            k = tuple(w[p:p + size])
            first[k] = min(first.get(k, age(i)), age(i))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = {q for p in range(len(w) - size + 1) if first[tuple(w[p:p + size])] < age(i) for q in range(p, p + size)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return out


@pytest.fixture(scope="module")
def passages(spark):
    """Shared runs of 48 to 120 words at odd places, near copies, exact copies, runs that repeat inside one document, nulls, repeated ids."""
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(2000)
    shared = [[word() for _ in range(n)] for n in (48, 49, 50, 51, 74, 75, 120)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(6)):
            parts += [word() for _ in range(rng.randrange(40))] + rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", "\t ", "  "]).join(parts)))
    base = [word() for _ in range(400)]
    for i in range(60, 90):
        near = list(base)
        near[rng.randrange(400)] = "edit"
        rows.append((i, " ".join(near)))
    rows += [(90 + i, " ".join(base)) for i in range(20)] + [(3, rows[5][1]), (3, rows[3][1]), (None, rows[3][1]), (None, " ".join(base)), (200, None), (201, ""), (202, " \n ")]
    rows += [(300, " ".join(["a"] * 200)), (301, " ".join(["a"] * 60)), (302, " ".join(["b c"] * 40)), (303, " ".join(word() for _ in range(200_000)) + " " + " ".join(base[7:80]))]
    return spark.createDataFrame([(i, t, 1, "c", "d", 2) for i, t in rows], "doc_id long, text string, o int, Gone string, t string, N_words int").repartition(4)


def test_substrings_go_where_an_earlier_document_has_them(passages):
    want = slow_substrings([tuple(r) for r in passages.select("doc_id", "text").collect()])
    done = substring_dedup.drop_repeated_substrings(passages)
    assert done.columns == ["doc_id", "text", "o", "Gone", "t", "n_words", "n_removed"]
    got = [tuple(r) for r in done.select("doc_id", "n_words", "n_removed", "text").collect()]
    assert by_id(sorted(got, key=str)) == by_id(sorted(want, key=str))
    assert done.agg(F.min("o"), F.max("Gone"), F.max("t")).first() == (1, "c", "d")


def test_substrings_of_nothing(passages):
    assert substring_dedup.drop_repeated_substrings(passages.limit(0)).count() == 0


# -- phrases ---------------------------------------------------------------------------

def slow_phrases(rows, least, top=collocations.TOP):
    f, n, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang in f:
        c = {p: a for p, a in f[lang].items() if a >= least and len(p) > 1}
        gone = {q[i:j] for q, a in c.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                if j - i < len(q) and 100 * a >= 100 * c[q[i:j]]}
        best = []
        for p, a in c.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("sample", [30, 1_000_000])
def test_phrases_are_exact_whatever_the_sample(spark, sf, sample):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, None), (1, "", "en"), (2, None, "fr"), (3, "New York, new  york\tNEW york! a b c d e f. " * 400, None), (3, "New York, new  york\tNEW york! a b c d e f. " * 400, None), (4, "x y é ß. " * 50, "und")]
    df = df.select("doc_id", "text", "lang", F.lit(1).alias("key"), F.lit(2).alias("Phrase")).unionByName(
        spark.createDataFrame([(*r, 1, 2) for r in odd], "doc_id long, text string, lang string, key int, Phrase int"))
    got = sorted(tuple(r) for r in collocations.collocations(df, least=12, sample_docs=sample).collect())
    assert got == slow_phrases([tuple(r) for r in df.select("text", "lang").collect()], 12)


def test_a_sample_that_misses_costs_passes(spark):
    rows = [(i, "alpha beta gamma delta epsilon zeta." if i % 2 else f"word{i} other{i}.", "en") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    full = collocations.frequent_phrases(df, least=20, sample_docs=400)
    poor = collocations.frequent_phrases(df, least=20, sample_docs=1)
    assert full[1] == 1 and poor[1] > 1
    key = lambda d: sorted((r["phrase"], r["k"], r["f"]) for r in d.collect())
    assert key(full[0]) == key(poor[0])


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(df).count() == 0


def test_filter_holds_every_key(spark):
    keys = [0, -1, 1 << 62, -(1 << 63), 12345, (1 << 36) - 1]
    bits = Bits.of(spark.createDataFrame([(k,) for k in keys], "key long"))
    import numpy as np

    assert bits.has(np.array(keys, dtype=np.int64).view(np.uint64)).all()
    unsigned = [k % (1 << 64) for k in keys]
    assert int(np.unpackbits(bits.data).sum()) == len({k >> 36 for k in unsigned} | {k & ((1 << 28) - 1) for k in unsigned})
    other = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 1_000_000).view(np.uint64)
    assert bits.has(other).sum() == 0


def test_a_sentence_of_all_items_is_one_window(spark):
    from fleetlens.llm.decontaminate import mark_contaminated

    sentence = "which of these eleven words stands in every single item here"
    items = spark.createDataFrame([(i, f"{sentence} item{i} asks{i} for{i}") for i in range(3000)], "item_id long, text string")
    rows = [(i, f"some words before {sentence} and after {i}", "x") for i in range(200)] + [(200, f"{sentence} item7 asks7 for7", "x"), (201, "nothing", "x"), (202, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumns({"__doc": F.lit(1), "t": F.lit(2), "Row": F.lit(3)})
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), r.contaminated, r["key"], r["__doc"], r.t, r.Row) for r in mark_contaminated(docs, items).collect()}
    assert got[5] == (17, 11, 3000, True, "x", 1, 2, 3) and got[200] == (14, 14, 3000, True, "x", 1, 2, 3)
    assert got[201][:4] == (1, 0, 0, False) and got[202][:4] == (0, 0, 0, False) and len(got) == 203
