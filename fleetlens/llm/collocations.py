"""Phrase collocations by Toivonen's sampling.

A sample of the documents proposes phrases, found at a lowered threshold. One
pass over all documents then counts these exactly, and with them their negative
border: every phrase whose parts (all words but the last, all words but the
first) are proposed, and every single word. A border phrase that turns out to be
frequent was missed by the sample: it is proposed too, and a further pass counts
what that brings within reach, until nothing new is frequent. A part of a
frequent phrase is frequent, so no frequent phrase can be missed; the sample
decides how many passes there are, never what is found.

The proposed phrases are known to the tasks as a bit filter of fixed size
(``Bits``); a phrase in it by chance is counted as well, and is then too rare or
rightly frequent. These passes count by a 64-bit key of language and words: two
phrases of one key could only make the key look frequent. A last pass counts the
phrases of the frequent keys by their words, so what is returned is exact.
Counts are made per slice of text in numpy, then summed in Spark, partially
before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.frames import chunks_of_bytes
from fleetlens.llm.word_windows import Bits, Words, buffer_of, byte_table, gathered, mixed, window_hashes
from fleetlens.session import scratch_path, stored

#: Words of the longest phrase, and the least count of a candidate.
LONGEST = 5
FREQUENT = 100
#: Documents the sample has (about; chosen by the hash of id and text), and how many standard deviations below the expected count it still proposes a phrase.
SAMPLE_DOCS = 20_000
LOWERED = 2.0
TOP = 2_000
#: log2 of the bits of the filter of proposed phrases: 8 MB.
FILTER_BITS = 26
#: What ends a piece, and what stands between words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
BREAK, APART = byte_table(BREAKS), byte_table(BREAKS + SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AT_ONCE = 1 << 20
#: Parts into which a language is dealt before its best phrases are chosen.
DEALT = 64


class Slice:
    """The words of one slice of text, lower-cased, with the piece and the language of each."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = buffer_of(texts)
        data = LOWER[data]
        self.words = words = Words.of(data, offsets, APART)
        coded = pc.fill_null(langs, "und").dictionary_encode()
        self.names = coded.dictionary.cast(pa.string())
        self.lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), words.counts).astype(np.int64)
        # a phrase lies in one piece: no break between its first and its last word, and one row
        breaks = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(BREAK[data], out=breaks[1:])
        self.piece = breaks[words.starts] + np.repeat(np.arange(len(words.counts)), words.counts)
        # codes of languages are those of the slice, so the name itself goes into the keys
        seeds = [mixed(np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little")], dtype=np.uint64))[0] for n in self.names.to_pylist()]
        self.salt = np.array([*seeds, 0], dtype=np.uint64)[self.lang]
        self.first = words.hashes(0)

    def keys(self, k: int) -> np.ndarray:
        """A key of the language and the ``k`` words from each word on."""
        found = window_hashes(self.first, k)
        return mixed(found ^ self.salt[:len(found)])

    def whole(self, k: int) -> np.ndarray:
        n = max(len(self.words) - k + 1, 0)
        return self.piece[k - 1:k - 1 + n] == self.piece[:n]


def _reach(proposed: Bits, parts: np.ndarray, n: int) -> np.ndarray:
    has = proposed.has(parts)
    return has[:n] & has[1:1 + n]


def _key_counts(part: Slice, old: Bits | None, new: Bits | None) -> pa.RecordBatch:
    """Counts by key of the phrases within reach of ``new`` but not of ``old``; with no ``old`` of all words too."""
    keys, sizes, counts, before = [], [], [], None
    for k in range(1, (LONGEST if new is not None else 1) + 1):
        key = part.keys(k)
        if k == 1:
            wanted = key if old is None else key[:0]
        else:
            inside = part.whole(k) & _reach(new, before, len(key))
            if old is not None:
                inside &= ~_reach(old, before, len(key))
            wanted = key[inside]
        found, c = np.unique(wanted, return_counts=True)
        keys.append(found.view(np.int64))
        sizes.append(np.full(len(found), k, dtype=np.int32))
        counts.append(c)
        before = key
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, sizes, counts)], names=["key", "k", "c"])


def _named(part: Slice, frequent: Bits) -> Iterator[pa.RecordBatch]:
    """The phrases whose keys may be frequent, counted by their words; and the number of words of each language as the phrase of no word."""
    spaced, offsets = part.words.spaced()
    second = part.words.hashes(1)
    for k in range(1, LONGEST + 1):
        key = part.keys(k)
        at = np.flatnonzero(part.whole(k) & frequent.has(key))
        other = window_hashes(second, k, 1)[at] ^ part.salt[at]
        found, first, back, counts = np.unique(key[at], return_index=True, return_inverse=True, return_counts=True)
        if not np.array_equal(other, other[first][back]):
            # two phrases share a key: both hashes tell them apart
            _, first, counts = np.unique(np.stack([key[at], other], axis=1), axis=0, return_index=True, return_counts=True)
        where = at[first]
        lengths = offsets[where + k] - 1 - offsets[where]
        ends = np.zeros(len(where) + 1, dtype=np.int64)
        np.cumsum(lengths, out=ends[1:])
        phrase = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(ends), pa.py_buffer(gathered(spaced, offsets[where], lengths)))
        yield pa.RecordBatch.from_arrays(
            [part.names.take(pa.array(part.lang[where])), phrase.cast(pa.string()), pa.array(np.full(len(where), k, dtype=np.int32)), pa.array(counts)], names=["lang", "phrase", "k", "c"])
    n = len(part.names)
    yield pa.RecordBatch.from_arrays(
        [part.names, pa.array([""] * n, pa.string()), pa.array(np.zeros(n, dtype=np.int32)), pa.array(np.bincount(part.lang, minlength=n))], names=["lang", "phrase", "k", "c"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for part in chunks_of_bytes(batch, "text", AT_ONCE):
            yield Slice(part.column("text"), part.column("lang"))
        pa.default_memory_pool().release_unused()  # a batch's texts do not stay in the worker


def _counting(old, new) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield _key_counts(part, old and old.value, new and new.value)

    return run


def _naming(frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield from _named(part, frequent.value)

    return run


def _closed(docs: DataFrame, least: int, proposed: Bits | None) -> tuple[DataFrame, Bits, int]:
    """((key, k) of all phrases that occur ``least`` times, proposals, passes): passes over ``docs`` go on until the border holds none that is not proposed."""
    spark = docs.sparkSession
    share = lambda bits: None if bits is None else spark.sparkContext.broadcast(bits)
    known = proposed if proposed is not None else Bits(log2=FILTER_BITS)
    root, old, new, passes = scratch_path(spark, "phrases"), None, share(proposed), 0
    while True:
        counted = docs.mapInArrow(_counting(old, new), "key long, k int, c long").groupBy("key", "k").agg(F.sum("c").alias("f"))
        found = stored(counted.where(F.col("f") >= least), f"{root}/pass={passes}")
        passes += 1
        grown = known | Bits.of(found.where(F.col("k") < LONGEST), log2=FILTER_BITS)
        if old is not None:
            old.destroy()
        if np.array_equal(grown.data, known.data):
            return spark.read.parquet(root).drop("pass"), known, passes
        # words are counted in the first pass; from now on only what is newly within reach
        old, new = new if new is not None else share(known), share(grown)
        known = grown


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: int = FREQUENT, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, int]:
    """((lang, phrase, k, f), passes over all documents): every phrase of 1 to 5 words that occurs ``least`` times in its language.

    k = 0 holds the number of words of a language. The counts are whole and exact whatever the sample is.
    """
    slim = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    n = slim.count()
    fraction = min(1.0, sample_docs / max(n, 1))
    chosen = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(1 << 32)) < F.lit(int(fraction * (1 << 32)))
    sample = stored(docs.where(chosen).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")), scratch_path(docs.sparkSession, "sample"))
    expected = least * fraction
    low = max(2, int(expected - LOWERED * expected ** 0.5)) if fraction < 1 else least
    _, proposed, _ = _closed(sample, low, None)
    keys, _, passes = _closed(slim, least, proposed)
    named = slim.mapInArrow(_naming(docs.sparkSession.sparkContext.broadcast(Bits.of(keys, log2=FILTER_BITS))), "lang string, phrase string, k int, c long")
    sums = named.groupBy("lang", "phrase", "k").agg(F.sum("c").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))
    return stored(sums, scratch_path(docs.sparkSession, "named")), passes


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", least: int = FREQUENT, top: int = TOP, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to 5 words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``BREAKS``; a phrase lies in
    one piece. A phrase's score is that of its worst cut, floor(1000 * a * n / (l * r))
    in decimals of 38 digits (beyond them the job fails, it does not round). A phrase
    goes if one with a word more has its count: any longer phrase of that count has
    one of these inside. A null text is empty, a null language ``und``; a copy counts
    as often as it stands there; an empty table gives an empty result. Other columns
    are not read.
    """
    found, _ = frequent_phrases(docs, text, lang, doc_id, least, sample_docs)
    words = found.where("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    known = found.where("k > 0").select("lang", "phrase", "k", "f")
    candidates = known.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    part = lambda name: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))

    # a longer phrase of the same count: one more word in front or behind
    w = F.split("phrase", " ")
    inner = candidates.where("k > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(w, 1, F.col("k") - 1), " "), F.array_join(F.slice(w, 2, F.col("k") - 1), " "))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a").drop("longer")

    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(w, 1, F.col("cut")), " "), "right": F.array_join(F.slice(w, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    cuts = cuts.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"]).join(words, "lang")
    big = lambda c: f"cast({c} as decimal(18,0))"
    score = F.expr(f"(1000 * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})")
    worst = cuts.select("lang", "phrase", "a", "n", "l", "r", "cut", score.alias("score")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("s")).select("lang", "phrase", "s.*")

    # a language may hold most of the phrases: its best ones are chosen among the best of its parts
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    some = worst.withColumn("part", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
