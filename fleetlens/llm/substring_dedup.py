"""Substring dedup by fixed-block anchors.

Every document's words are cut into blocks of ``BLOCK`` words that do not
overlap; the blocks are the index. ``WINDOW`` words hold a whole block of any
document they are copied from, wherever they start (2 * BLOCK - 1 <= WINDOW), so
probing the index with every rolling window of ``BLOCK`` words finds each repeat
of ``WINDOW`` words or more. Hits are extended: around each block that occurs in
two documents all windows of ``WINDOW`` words are told apart by 128 bits, and
those that start in an earlier document too are joined to maximal exact repeats.

Nothing is paired: a key or a window meets only the smallest document that has
it, so a passage in n documents costs n rows. Documents of equal words are found
first and take no further part but for the smallest one.

Most rolling windows hit nothing. They are held back in the tasks by a bit filter
of fixed size (``Bits``); what it lets through by chance is settled by the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.frames import bounded_side, chunks_of_bytes, without
from fleetlens.llm.word_windows import Bits, Words, buffer_of, byte_table, gathered, lists, window_hashes
from fleetlens.session import scratch_path, stored

BLOCK = 25
WINDOW = 50
#: What stands between words.
SPACE = byte_table(b" \t\n\x0b\x0c\r")
#: Text bytes that are taken apart at a time; a longer text is taken alone.
AT_ONCE = 2 << 20
#: The place of a row without an id: after all others.
LAST = (1 << 63) - 1


def _pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for part in chunks_of_bytes(batch, column, AT_ONCE):
            yield part, Words.of(*buffer_of(part.column(column)), SPACE)


def _row_of(words: Words, n: int) -> np.ndarray:
    """The row of each of the first ``n`` words."""
    return np.repeat(np.arange(len(words.counts)), words.counts)[:n]


def _inside(words: Words, size: int) -> np.ndarray:
    """The words at which a window of ``size`` words starts that ends in the same row."""
    n = max(len(words) - size + 1, 0)
    return np.arange(n) + size <= words.first[1:][_row_of(words, n)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, words in _pieces(batches):
        a, b = words.hashes(0), words.hashes(1)
        counts = np.where(words.counts >= WINDOW, words.counts // BLOCK, 0)
        at = np.repeat(words.first[:-1] - (np.cumsum(counts) - counts) * BLOCK, counts) + np.arange(counts.sum()) * BLOCK
        keys = window_hashes(a, BLOCK)[at] if len(at) else np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [part.column("o"), part.column("t"), pa.array(words.counts.astype(np.int64)),
             pa.array(words.whole(a, 0).view(np.int64)), pa.array(words.whole(b, 1).view(np.int64)), lists(keys.view(np.int64), counts)],
            names=["o", "t", "n", "w1", "w2", "keys"])


def _probes(index) -> Callable:
    """For every rolling window whose key may be in the index: its key (a document's own blocks are there already)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _pieces(batches):
            keys = window_hashes(words.hashes(), BLOCK)
            rows = _row_of(words, len(keys))
            hit = _inside(words, BLOCK) & (words.counts[rows] >= WINDOW) & ((np.arange(len(keys)) - words.first[rows]) % BLOCK != 0)
            hit[hit] = index.value.has(keys[hit])
            counts = np.bincount(rows[hit], minlength=part.num_rows)
            some = pa.array(counts > 0)
            done = pa.RecordBatch.from_arrays([part.column("o"), part.column("t"), lists(keys[hit].view(np.int64), counts)], names=["o", "t", "keys"])
            yield done.filter(some)

    return run


def _windows(shared) -> Callable:
    """The windows of ``WINDOW`` words around each block whose key may be shared: where they start, and 128 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _pieces(batches):
            a = words.hashes(0)
            keys = window_hashes(a, BLOCK)
            marks = np.zeros(len(keys) + 1, dtype=np.int64)
            np.cumsum(shared.value.has(keys) & _inside(words, BLOCK), out=marks[1:])
            near = _inside(words, WINDOW)
            near &= marks[np.arange(len(near)) + WINDOW - BLOCK + 1] > marks[:len(near)]
            at = np.flatnonzero(near)
            if not len(at):
                continue
            rows = _row_of(words, len(near))[at]
            counts = np.bincount(rows, minlength=part.num_rows)
            place = (at - words.first[rows]).astype(np.int32)
            h1, h2 = window_hashes(a, WINDOW)[at], window_hashes(words.hashes(1), WINDOW, 1)[at]
            done = pa.RecordBatch.from_arrays(
                [part.column("o"), part.column("t"), lists(place, counts), lists(h1.view(np.int64), counts), lists(h2.view(np.int64), counts)],
                names=["o", "t", "at", "h1", "h2"])
            yield done.filter(pa.array(counts > 0))

    return run


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each text: its words without those in the windows that go, joined by one space."""
    for part, words in _pieces(batches):
        column = part.column("gone")
        rows = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        spans = pc.list_flatten(column)
        start = words.first[rows] + pc.struct_field(spans, "start").to_numpy()
        size = len(words) + 1
        gone = np.bincount(start, minlength=size) - np.bincount(start + pc.struct_field(spans, "length").to_numpy(), minlength=size)
        stays = np.cumsum(gone)[:-1] == 0
        kept = np.bincount(_row_of(words, len(words))[stays], minlength=part.num_rows)
        spaced, at = words.spaced()
        lengths = (at[1:] - at[:-1])[stays]
        text = gathered(spaced, at[:-1][stays], lengths)
        # each word brings the space after it; the last one of a row goes without
        ends = np.cumsum(np.bincount(_row_of(words, len(words))[stays], weights=lengths, minlength=part.num_rows)).astype(np.int64)
        some = kept > 0
        keep = np.ones(len(text), dtype=bool)
        keep[ends[some] - 1] = False
        offsets = np.concatenate([[0], ends - np.cumsum(some)])
        texts = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(text[keep]))
        yield pa.RecordBatch.from_arrays(
            [part.column("d"), texts.cast(pa.string()), pa.array(words.counts.astype(np.int64)), pa.array((words.counts - kept).astype(np.int64))],
            names=["d", "kept", "n", "removed"])


def _runs(windows: Column) -> Column:
    """Sorted window starts as (start, length) of the stretches of words they cover."""
    def grow(runs: Column, q: Column) -> Column:
        last = F.element_at(runs, -1)
        touches = (F.size(runs) > 0) & (q <= last["start"] + last["length"])
        longer = F.struct(last["start"].alias("start"), (q + WINDOW - last["start"]).alias("length"))
        return F.when(touches, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(
            F.concat(runs, F.array(F.struct(q.alias("start"), F.lit(WINDOW).alias("length")))))

    return F.aggregate(F.array_sort(windows), F.array().cast("array<struct<start:int,length:int>>"), grow)


def repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(o, t, gone) of the documents that lose words; ``gone`` lists (start, length) in words.

    ``o`` is the doc_id as a long (a row without one comes after all others), ``t`` the text's hash.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("o"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    blocks = stored(
        slim.mapInArrow(_blocks, "o long, t long, n long, w1 long, w2 long, keys array<long>").where(F.col("n") >= WINDOW),
        scratch_path(spark, "blocks"))

    # equal documents: all but the smallest go whole
    groups = blocks.groupBy("w1", "w2", "n").agg(F.min("o").alias("m"), F.max("o").alias("x")).where("m < x").drop("x")
    copies = blocks.drop("keys").join(groups, ["w1", "w2", "n"]).where("o > m").select("o", "t", F.col("n").cast("int").alias("n")).distinct()
    copies = stored(copies, scratch_path(spark, "copies"))
    away = bounded_side(copies.select("o", "t"))
    single = lambda df: df.join(away, ["o", "t"], "left_anti")

    index = single(blocks.select("o", "t", "keys")).select("o", F.explode("keys").alias("key"))
    first = spark.sparkContext.broadcast(Bits.of(index))
    probes = stored(single(slim.mapInArrow(_probes(first), "o long, t long, keys array<long>")), scratch_path(spark, "probes"))
    both = index.unionByName(probes.select("o", F.explode("keys").alias("key")))
    shared = both.groupBy("key").agg(F.min("o").alias("m"), F.max("o").alias("x")).where("m < x").select("key")
    second = spark.sparkContext.broadcast(Bits.of(shared))

    found = slim.mapInArrow(_windows(second), "o long, t long, at array<int>, h1 array<long>, h2 array<long>")
    found = stored(single(found), scratch_path(spark, "windows"))
    windows = found.select("o", "t", F.explode(F.arrays_zip("at", "h1", "h2")).alias("w")).select("o", "t", "w.at", "w.h1", "w.h2")
    firsts = windows.groupBy("h1", "h2").agg(F.min("o").alias("m"), F.max("o").alias("x")).where("m < x").drop("x")
    again = windows.join(firsts, ["h1", "h2"]).where("o > m").groupBy("o", "t").agg(F.collect_set("at").alias("at"))
    gone = again.select("o", "t", _runs(F.col("at")).alias("gone"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("length")))
    return stored(gone.unionByName(copies.select("o", "t", whole.alias("gone"))), scratch_path(spark, "gone"))


def drop_repeated_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Replaces ``text`` by the words that stay, joined by one space, and adds n_words and n_removed.

    A word goes if a window of ``WINDOW`` words over it starts in a document with
    a smaller doc_id too, judged on the input. A null text has no words and becomes
    empty. Rows of one doc_id are of one age: none is removed because of another,
    and rows that repeat an id and its text are treated alike. A row without an id
    comes after all that have one. ``doc_id`` is an integer. Columns named like the
    new ones are replaced, all others stay; an empty table gives an empty result.
    """
    docs = without(docs, "n_words", "n_removed")
    gone = repeated_windows(docs, text, doc_id)
    every = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("o"),
        F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    every = every.join(bounded_side(gone, F.size("gone") * 8), ["o", "t"], "left").select("d", "text", "gone")
    out = T.StructType([every.schema["d"], T.StructField("kept", T.StringType()), T.StructField("n", T.LongType()), T.StructField("removed", T.LongType())])
    done = every.mapInArrow(_left, out)
    return done.select(
        *[F.col("kept").alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns], F.col("n").alias("n_words"), F.col("removed").alias("n_removed"))
