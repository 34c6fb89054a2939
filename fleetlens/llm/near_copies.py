"""Near copies by the exact Jaccard similarity of their word shingles.

Min-wise hashes choose what is compared: ``BANDS`` keys of ``ROWS`` minima each.
Two texts of similarity s share a key with 1 - (1 - s**ROWS)**BANDS, at 0.8 that
is 0.9996, and more above. Keys whose texts all have one fingerprint are left
out, so exact copies and texts that are linked anyway are not compared. Whoever
shares a key with another one is compared with all of that key's texts, by the
whole shingle sets; what goes on are links that span each component, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import chunks_of_bytes, small_side, text_key, texts_of
from fleetlens.session import scratch_path, stored

AT_ONCE = 1 << 22
SEED = 42
BANDS, ROWS = 20, 5
_RNG = np.random.default_rng(SEED)
MULTIPLY, FLIP = (_RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
#: Entries of posting lists that are counted at a time.
COUNTED = 1 << 20


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.unique(np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED))), dtype=np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    import xxhash

    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        mixed = (shingles[i:i + 4096, None] ^ FLIP) * MULTIPLY
        low = np.minimum(low, (mixed ^ mixed >> np.uint64(29)).min(axis=0))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def links_of_key(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links that span the components of all pairs with a Jaccard similarity of ``similar`` or more."""
    sizes, n = np.array([len(s) for s in sets]), len(sets)
    _, names = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(n), sizes)[np.argsort(names, kind="stable")]
    counts = np.bincount(names)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    root, out = np.arange(n), []
    for i in range(n):
        own, common = names[ends[i] - sizes[i]:ends[i]], np.zeros(n, dtype=np.int64)
        for part in np.split(own, np.flatnonzero(np.diff(np.cumsum(counts[own]) // COUNTED)) + 1):
            many = counts[part]
            at = np.repeat(starts[part] - np.cumsum(many) + many, many) + np.arange(many.sum())
            common += np.bincount(owners[at], minlength=n)
        near = np.flatnonzero(common >= similar * (sizes[i] + sizes - common))
        roots, first = np.unique(root[near], return_index=True)
        out += [(i, int(near[k])) for r, k in zip(roots, first, strict=True) if r != root[i]]
        root[np.isin(root, roots)] = roots[0]
    return out


def similar_links(docs: DataFrame, known: DataFrame, text: str, size: int, similar: float) -> DataFrame:
    """(src, dst) fingerprints of texts that are similar; ``known`` has ``__key``, ``fingerprint`` and ``__bands`` of every row of ``docs``."""
    spark = docs.sparkSession
    rows = known.select("__key", "fingerprint", F.explode("__bands").alias("band"))
    often = rows.groupBy("band").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("a <> b").select("band")
    often = stored(often, scratch_path(spark, "shared_keys"))
    members = stored(rows.join(small_side(often, often.count()), "band", "left_semi").distinct(), scratch_path(spark, "members"))
    wanted = stored(members.select("__key").distinct(), scratch_path(spark, "compared"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of_bytes(batch, "__all", AT_ONCE):
                sets = [shingle_set(t, size).tobytes() for t in texts_of(part.column("__all").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(sets, pa.binary())], ["__key", "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, prints, sets = None, [], []

        def out() -> pa.RecordBatch:
            pairs = np.array([(prints[i], prints[j]) for i, j in links_of_key(sets, similar)], dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], ["src", "dst"])

        for batch in batches:
            for b, p, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if b != band:
                    if len(sets) > 1:
                        yield out()
                    band, prints, sets = b, [], []
                prints.append(p)
                sets.append(np.frombuffer(s, dtype=np.uint64))
        if len(sets) > 1:
            yield out()

    texts = docs.select(text_key(F.col(text)).alias("__key"), F.col(text).alias("__all"))
    sets = texts.join(small_side(wanted, wanted.count()), "__key", "left_semi").mapInArrow(sets_of, "__key string, set binary")
    sets = stored(sets.dropDuplicates(["__key"]), scratch_path(spark, "sets"))
    rows = members.join(sets, "__key").select("band", "fingerprint", "set").repartition("band").sortWithinPartitions("band")
    return stored(rows.mapInArrow(compare, "src long, dst long"), scratch_path(spark, "similar"))
