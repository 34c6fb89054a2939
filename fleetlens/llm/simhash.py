"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at two or fewer differing bits. The anchors are a
covering code of the 64-bit words: the perfect Hamming code of length 63 with
the last bit free, so every word lies within R = 1 bit of an anchor. If x and y
differ in two bits or fewer, some word z differs from each in one bit at most,
and z's anchor is within R + 1 of both: each fingerprint goes to all anchors
within R plus half the threshold, 33 at most, and x and y meet at one of them.

An anchor has 2,081 words within two bits, so no group of distinct fingerprints
is larger, however many documents or near copies there are; copies of a
fingerprint are reduced to one row before. Per anchor all pairs are compared and
one link from each fingerprint to the smallest of its own component goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.components import connected_components
from fleetlens.llm.frames import chunks_of_bytes, text_key, texts_of, with_columns, without
from fleetlens.llm.near_copies import band_keys, shingle_set, similar_links
from fleetlens.session import scratch_path, stored

AT_ONCE = 1 << 22
THRESHOLD = 2
SEED = 42


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bits set in over half the hashes of the word shingles; zero without words."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, keep_text: bool = True, similar_size: int | None = None) -> DataFrame:
    """Adds ``fingerprint`` (long, the 64 bits as they are) to every row, and with ``similar_size`` the ``__bands`` of shingles of so many words; a null text has no words."""
    docs = without(docs, "fingerprint")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of_bytes(batch, text, AT_ONCE):
                texts = texts_of(part.column(text).to_pylist())
                added = {"fingerprint": pa.array(np.array([fingerprint(t, size) for t in texts], dtype=np.uint64).view(np.int64))}
                if similar_size:
                    added["__bands"] = pa.array([band_keys(shingle_set(t, similar_size)) for t in texts], pa.list_(pa.int64()))
                yield with_columns(part if keep_text else part.drop_columns([text]), added)

    bands = [T.StructField("__bands", T.ArrayType(T.LongType()))] if similar_size else []
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("fingerprint", T.LongType()), *bands]))


def anchor_masks() -> list[np.ndarray]:
    """For each syndrome (exclusive or of the places, from 1, of a word's first 63 bits that are set): what leads from the word to its anchors."""
    bit = [0, *(1 << i for i in range(63))]
    out = [np.array([0, 1 << 63], dtype=np.uint64)]
    for s in range(1, 64):
        pairs = [bit[i] ^ bit[i ^ s] for i in range(1, 64) if i < i ^ s]
        out.append(np.array([bit[s], bit[s] ^ 1 << 63, *pairs], dtype=np.uint64))
    return out


def syndromes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(6):
        places = np.uint64(sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1))
        out |= (np.bitwise_count(x & places).astype(np.int64) & 1) << k
    return out


def anchors_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for every anchor within two bits of the midpoints' reach of each fingerprint."""
    masks, s = anchor_masks(), syndromes(x)
    anchors, members = [], []
    for k in np.unique(s):
        own = x[s == k]
        anchors.append((own[:, None] ^ masks[k][None, :]).ravel())
        members.append(np.repeat(own, len(masks[k])))
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *anchors]), np.concatenate([none, *members])


def links_of_cell(members: np.ndarray, threshold: int) -> np.ndarray:
    """For each distinct fingerprint of a cell the smallest one of its component there."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= threshold
    root = np.arange(len(members))
    while True:
        low = np.where(near, root[None, :], len(members)).min(axis=1)
        if (low == root).all():
            return root
        root = low


def cell_links(anchor: np.ndarray, member: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all cells; rows are sorted by anchor, then by member (unsigned)."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(starts, append=len(anchor))
    two = starts[sizes == 2]
    a, b = member[two], member[two + 1]
    near = np.bitwise_count(a ^ b) <= threshold
    left, right = [b[near]], [a[near]]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        own = member[s:s + n]
        root = links_of_cell(own, threshold)
        other = root != np.arange(n)
        left.append(own[other])
        right.append(own[root[other]])
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame) -> DataFrame:
    """(src, dst) that tie together all fingerprints of a component; ``distinct`` has one row for each ``fingerprint``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(x), 4096):
                anchor, member = anchors_of(x[i:i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(member.view(np.int64))], ["anchor", "fingerprint"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))

        def out(anchor: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
            src, dst = cell_links(anchor, member, THRESHOLD)
            pairs = np.unique(np.stack([src, dst], axis=1), axis=0) if len(src) else np.zeros((0, 2), dtype=np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in range(2)], ["src", "dst"])

        for batch in batches:
            now = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64)]) for i, r in enumerate(rest)]
            last = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if len(now[0]) and (now[0] != now[0][-1]).any() else 0
            if last:
                yield out(now[0][:last], now[1][:last])
            rest = (now[0][last:], now[1][last:])  # the last cell may go on in the next batch
        if len(rest[0]):
            yield out(*rest)

    cells = distinct.select("fingerprint").mapInArrow(spread, "anchor long, fingerprint long")
    cells = cells.repartition("anchor").sortWithinPartitions("anchor", "fingerprint")
    return cells.mapInArrow(compare, "src long, dst long")


def near_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 3, keep_text: bool = True, similar: float | None = None, similar_size: int = 5) -> DataFrame:
    """Adds ``fingerprint`` (long) and ``component_id`` to every row; without ``keep_text`` the text goes and is not written again.

    Documents whose fingerprints differ in at most two bits are linked, and with
    ``similar`` also those whose shingles of ``similar_size`` words have that Jaccard
    similarity or more (``near_copies``);
    ``component_id`` is the smallest doc_id that links lead to. Texts without
    words, nulls included, have fingerprint 0 and are linked like others. Equal
    texts and repeated rows share a fingerprint, and so a component. A null
    doc_id never is the smallest one; a component of null ids only has a null
    id. Columns named like the new ones are replaced; an empty table gives an
    empty result.
    """
    docs = without(docs, "fingerprint", "component_id")
    spark = docs.sparkSession
    keyed = docs.withColumn("__key", text_key(F.col(text))) if similar else docs
    known = stored(fingerprints(keyed, text, size, keep_text, similar_size if similar else None), scratch_path(spark, "fingerprints"))
    one = stored(known.groupBy("fingerprint").agg(F.min(doc_id).alias("__first")), scratch_path(spark, "distinct"))
    tied = links(one)
    if similar:
        tied = tied.unionByName(similar_links(docs, known, text, similar_size, similar))
    parts = connected_components(tied).select(F.col("node").alias("fingerprint"), F.col("component").alias("__root"))
    rooted = one.join(parts, "fingerprint", "left").select("fingerprint", "__first", F.coalesce("__root", "fingerprint").alias("__root"))
    low = rooted.groupBy("__root").agg(F.min("__first").alias("component_id"))
    named = rooted.join(low, "__root").select("fingerprint", "component_id")
    keep = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text]
    return known.join(named, "fingerprint").select(*keep, "fingerprint", "component_id")


def hex_of(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
