"""BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be
merged, so a text may be cut between them: both sides are encoded on their own
and the ids are put together. Of these pairs only those are used at which the
splitting pattern of byte-level vocabularies ends a piece anyway, whatever
follows, so that no fragment is split in another way than the whole text:

* white space (ASCII) after anything but ASCII white space: the pattern never
  runs from other characters into white space, and white space cut from white
  space outside ASCII is split the same way on both sides;
* letters, digits and other printable ASCII characters next to one another,
  but not after an apostrophe, which may begin a contraction ('s, 're).

Added tokens count as tokens, so none of them is cut. Fragments are mostly
words: each distinct one is encoded by the tokenizers library once per worker
and looked up afterwards.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm.frames import chunks_of_bytes, texts_of, with_columns, without

#: Distinct fragments a worker keeps. A full store is emptied: this bounds memory and changes no result.
STORE = 250_000
#: Fragments that the splitting pattern takes as one piece: a space or none, then Latin letters, ASCII digits or other ASCII characters.
SINGLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch
#: Of the 64 bits that hold a fragment's place and count. A token has a byte at least and an Arrow text under 2**31, so neither outgrows its share.
COUNT_BITS = 32
#: Text bytes that are taken apart at a time.
AT_ONCE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    out: dict[int, bytes] = {}
    for token, i in spec["model"]["vocab"].items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    for added in spec["added_tokens"]:
        out[added["id"]] = added["content"].encode()
    return [out.get(i, b"") for i in range(max(out) + 1)]


def cut_table(tokens: list[bytes]) -> np.ndarray:
    """True at ``256 * left + right`` where a text may be cut between the two bytes."""
    inside = np.zeros(65536, dtype=bool)
    for token in tokens:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int64)
            inside[b[:-1] * 256 + b[1:]] = True
    kind = np.zeros(256, dtype=np.int8)  # 0: control character, 1: white space, 2: letter, 3: digit, 4: other, 5: not ASCII
    kind[33:127] = 4
    kind[[9, 10, 11, 12, 13, 32]] = 1
    kind[48:58] = 3
    kind[65:91] = kind[97:123] = 2
    kind[128:] = 5
    left, right = kind[:, None], kind[None, :]
    safe = (left >= 2) & (right == 1)
    safe |= (left >= 2) & (left <= 4) & (right >= 2) & (right <= 4) & (left != right)
    safe[ord("'"), kind != 1] = False
    return safe.ravel() & ~inside


def distinct(lo: np.ndarray, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each distinct key (one or two words of 64 bits), and for each key the number of its own."""
    if hi is not None:
        lo, hi = np.unique(lo, return_inverse=True)[1], np.unique(hi, return_inverse=True)[1]
        lo = lo * (int(hi.max()) + 1) + hi
    _, first, own = np.unique(lo, return_index=True, return_inverse=True)
    return first, own


class Encoder:
    """Encodes whole texts by fragments.

    Ids of known fragments stand in ``pool``; ``store`` maps a fragment to its
    place and length there. The fragments of about a megabyte of text are first
    reduced to distinct ones, short ones as numbers that hold all their bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = token_bytes(path)
        self.cuts = cut_table(self.tokens)
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
        self._empty()

    def _empty(self) -> None:
        self.store: dict[bytes, int] = {}
        self.pool, self.filled = np.zeros(1 << 16, dtype="<u4"), 0

    def _learn(self, new: list[bytes]) -> None:
        """Encodes fragments by the tokenizers library; one that is a single piece goes to its model directly."""
        one, rest, ids = self.tokenizer.model.tokenize, [], array("I")
        for f in new:
            if SINGLE(f):
                got = [t.id for t in one(f.decode("latin-1").translate(self.letters))]
                self.store[f] = (self.filled + len(ids) << COUNT_BITS) + len(got)
                ids.extend(got)
            else:
                rest.append(f)
        for f, e in zip(rest, self.tokenizer.encode_batch_fast([f.decode() for f in rest], add_special_tokens=False), strict=True):
            self.store[f] = (self.filled + len(ids) << COUNT_BITS) + len(e.ids)
            ids.extend(e.ids)
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled:self.filled + len(ids)] = np.frombuffer(ids, dtype=np.uint32)
        self.filled += len(ids)

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids end."""
        data = b"".join(texts)
        n, text_ends = len(data), np.cumsum([0, *map(len, texts)])
        if not n:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        padded = data + bytes(16)
        b = np.frombuffer(data, dtype=np.uint8)
        begin = np.empty(n, dtype=bool)
        begin[0] = True
        begin[1:] = self.cuts[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        begin[text_ends[:-1][text_ends[:-1] < n]] = True
        starts = np.flatnonzero(begin)
        sizes = np.diff(starts, append=n)
        words = np.ndarray((n + 8,), dtype="<u8", buffer=padded, strides=(1,))
        places, counts = np.empty(len(starts), dtype=np.int64), np.empty(len(starts), dtype=np.int64)
        for low, high in ((1, 7), (8, 15), (16, n)):
            at = np.flatnonzero((sizes >= low) & (sizes <= high))
            if not len(at):
                continue
            s, k = starts[at], sizes[at]
            if high == 7:
                first, own = distinct(words[s] & self.masks[k] | k.astype(np.uint64) << np.uint64(56))
            elif high == 15:
                first, own = distinct(words[s], words[s + 8] & self.masks[k - 8] | k.astype(np.uint64) << np.uint64(56))
            else:
                first = own = np.arange(len(at))
            found = [data[x:x + y] for x, y in zip(s[first].tolist(), k[first].tolist(), strict=True)]
            known = list(map(self.store.get, found))
            if None in known:
                self._learn(list({f for f, x in zip(found, known, strict=True) if x is None}))
                known = list(map(self.store.__getitem__, found))
            known = np.array(known, dtype=np.int64)
            places[at], counts[at] = known[own] >> COUNT_BITS, known[own] & ((1 << COUNT_BITS) - 1)
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(places - ends + counts, counts) + np.arange(ends[-1])]
        if len(self.store) > STORE or self.filled > 8 * STORE:
            self._empty()
        of_text = np.searchsorted(starts, text_ends[1:], side="left")
        return ids, np.concatenate([[0], ends])[of_text]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        ids, ends = self.encode_flat(texts)
        return np.split(ids, ends[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) and ``decoded`` (string decoded from them) to every row.

    One pass without a shuffle; each row stands for itself, so repeated rows,
    ties and empty tables need no rule. A null text counts as empty (no ids,
    an empty string). Columns named like the new ones are replaced, all others
    are kept. ``tokenizer`` is the path of a byte-level BPE file of the
    tokenizers library that every executor can open.
    """
    docs = without(docs, "ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for part in chunks_of_bytes(batch, text, AT_ONCE):
                ids = own.encode(texts_of(part.column(text).to_pylist()))
                yield with_columns(part, {"ids": lists_of(ids), "decoded": pa.array([own.decode(x) for x in ids], pa.string())})

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(run, schema)
