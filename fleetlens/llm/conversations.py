"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation is to read ``(s?(ua)+)?`` by its roles' initials. Rows may be kept
(free), given another role (1), deleted (2) and inserted (5); a row that is cut
off costs 5 more unless it is deleted. The cheapest edits are a shortest path
through four states (``NEXT``), found backwards: a vector holds the cost to the
end from each state.

Rows are sorted by range partitions, so a conversation of any length lies in many
tasks, and cut into chunks of at most one Arrow batch, one byte a row. A chunk
does not know the vector at its end. Up to a constant only finitely many vectors
occur (``KINDS``), so it starts from all of them as speculation and follows those
that still differ by more than a constant; after a few rows mostly one is left
(rank convergence) and the vector at its start is known. Fix-up passes rerun on
the chunks that have not converged: each takes in the stretch behind it, twice as
many chunks with every pass, until its vectors differ only by constants or the
conversation's end is reached. The stitched vectors then drive the tracing: from
each state a chunk writes the least audit, letter by letter (D < I < K < R), and
the states at the chunks' starts are stitched by the same passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.frames import small_side
from fleetlens.session import scratch_path, stored

# The costs of the edits.
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
#: States are (nothing yet, after s, after u, after a); a conversation may end in the first and the last.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
STATES = range(4)
#: What is inserted, or written by a rerole, from a state on, and the state it leads to.
WRITES = {0: "u", 1: "u", 2: "a", 3: "u"}
AFTER = {0: 2, 1: 2, 2: 3, 3: 2}
#: Codes of a row: 3 * role + fault for the roles s, u, a and others; GONE (blank or duplicate) must be deleted, NONE is no row.
ROLES = "sua"
WHOLE, BROKEN, GONE = 0, 1, 2
NONE = 12
#: Rows of a sorted range partition (about).
ROWS_A_TASK = 200_000
#: White space of the contract.
SPACE = " \t\n\x0b\x0c\r"


def _inserted(cost: list) -> tuple:
    """The vector if rows may be inserted before going on; less its least entry."""
    out = []
    for s in STATES:
        best, at, paid = cost[s], s, 0
        for _ in range(2):  # a third insertion is back at a state seen before
            at, paid = AFTER[at], paid + INSERT
            best = min(best, cost[at] + paid)
        out.append(best)
    return tuple(x - min(out) for x in out)


FINAL = _inserted([0 if s in ENDS else 1 << 20 for s in STATES])


def _options(code: int, s: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of a row from a state, least letter first."""
    role, fault = divmod(code, 3)
    out = [("D", DELETE, s)]
    if fault != GONE:
        more = CUT_OFF if fault == BROKEN else 0
        after = NEXT[ROLES[role]].get(s) if role < 3 else None
        out += [("K", more, after)] if after is not None else []
        out += [("R", more + REROLE, AFTER[s])]
    return out


def _before(vector: tuple, code: int) -> tuple:
    """The vector before a row, from the one behind it."""
    if code == NONE or code % 3 == GONE:
        return vector  # every way pays the same
    return _inserted([min(c + vector[t] for _, c, t in _options(code, s)) for s in STATES])


def _kinds() -> list[tuple]:
    """All vectors that can occur, up to a constant, in a fixed order."""
    found, new = [FINAL], [FINAL]
    while new:
        reached = {_before(v, code) for v in new for code in range(NONE)} - set(found)
        new = sorted(reached)
        found += new
    return found


KINDS = _kinds()
KIND_OF = {v: i for i, v in enumerate(KINDS)}
STEP = [[KIND_OF[_before(v, code)] for code in range(NONE + 1)] for v in KINDS]


def _trace_row(kind: int, code: int, s: int) -> tuple[str, int]:
    """The least letters of a row (insertions before it included) on a cheapest way from a state, and the state after; ``kind`` is the vector behind the row."""
    if code == NONE:
        return "", s
    vector = KINDS[kind]
    here = [min(c + vector[t] for _, c, t in _options(code, x)) for x in STATES]
    best = list(here)
    for x in STATES:
        at, paid = x, 0
        for _ in range(2):
            at, paid = AFTER[at], paid + INSERT
            best[x] = min(best[x], here[at] + paid)
    letters = ""
    while True:
        ways = [(letter, t) for letter, c, t in _options(code, s) if c + vector[t] == best[s]]
        if best[AFTER[s]] + INSERT == best[s]:
            ways.append(("I", None))
        letter, after = min(ways)
        letters += letter
        if letter != "I":
            return letters, after
        s = AFTER[s]


TRACE = [[[_trace_row(k, code, s) for s in STATES] for code in range(NONE + 1)] for k in range(len(KINDS))]
#: What is inserted at the end, by state.
TAIL = {0: "", 1: "II", 2: "I", 3: ""}


# -- rows ------------------------------------------------------------------------

def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) after the damage of the contract; a null counts as one space, a dropped row has 0 copies."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    return rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(said(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text)).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def plain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of rows as they are."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"), F.lit(1).alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """One row for each row after damage (conv, turn, role, hash, copy, code); the rows of a conversation without any are kept as NONE."""
    spark = rows.sparkSession
    seen = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select(
        "conv", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"), F.col("copies").cast("long").alias("copies"),
        F.when(seen == "", GONE).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), WHOLE).otherwise(BROKEN).alias("fault"), (seen == "").alias("blank"))
    # equal rows are counted, not gathered: a group of copies may hold a large share of a table
    equal = slim.groupBy("conv", "turn", "role", "hash", (F.col("copies") > 0).alias("there")).agg(
        F.sum("copies").alias("copies"), F.first("fault").alias("fault"), F.first("blank").alias("blank"))
    equal = stored(equal, scratch_path(spark, "rows"))
    turns = F.struct(F.col("turn").isNotNull().alias("is"), F.col("turn").alias("turn"))
    again = equal.where("there").groupBy("conv", "role", "hash").agg(F.min(turns).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = stored(again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first"), scratch_path(spark, "again"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))
    met = equal.join(small_side(again, again.count()), same, "left").withColumn("later", F.col("first").isNotNull() & (turns > F.col("first")))
    # copies are told apart in two steps, so that none makes a long array
    much = 4096
    wide = met.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest((F.col("copies") - 1), F.lit(0)).cast("long"), F.lit(much).cast("long"))).alias("base"))
    single = wide.select("*", F.explode(F.sequence(F.col("base"), F.greatest(F.least(F.col("base") + much, F.col("copies")) - 1, F.col("base")))).alias("copy"))
    duplicate = ~F.col("blank") & (F.col("later") | (F.col("copy") > 0))
    role = F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    role = F.when(F.col("role") == "", 3).otherwise(role)
    code = F.when(~F.col("there"), NONE).otherwise(3 * role + F.when(duplicate, GONE).otherwise(F.col("fault")))
    return single.select("conv", "turn", "role", "hash", "copy", code.cast("byte").alias("code"), (F.col("there") & duplicate).alias("duplicate"))


def _chunks(chunk_rows: int) -> Callable:
    """Runs of rows of one conversation inside an Arrow batch; ``edge`` tells that the conversation may go on outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, chunk_rows):
                piece = batch.slice(start, chunk_rows)
                runs = pc.run_end_encode(piece.column("conv"))
                conv, ends = runs.values, np.asarray(runs.run_ends)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                size = len(ends)
                codes = np.asarray(piece.column("code")).astype(np.uint8)
                edge = np.zeros(size, dtype=bool)
                edge[[0, -1]] = True
                turn, there = piece.column("turn"), codes != NONE
                known = np.asarray(turn.is_valid()) & there
                values = turn.fill_null(0).to_numpy()
                inside = np.repeat(np.arange(size), np.diff(offsets))
                # rows are sorted by turn, so distinct turns are the changes; the one before may lie in the chunk before
                first, last, changes = [None] * size, [None] * size, np.zeros(size, dtype=np.int64)
                at = np.flatnonzero(known)
                if len(at):
                    new = np.ones(len(at), dtype=bool)
                    new[1:] = (values[at][1:] != values[at][:-1]) | (inside[at][1:] != inside[at][:-1])
                    changes = np.bincount(inside[at][new], minlength=size)
                    for i in np.unique(inside[at], return_index=True)[1]:
                        first[inside[at[i]]] = int(values[at[i]])
                    for i in len(at) - 1 - np.unique(inside[at][::-1], return_index=True)[1]:
                        last[inside[at[i]]] = int(values[at[i]])
                # adjacent roles, of the rows that are there
                at = np.flatnonzero(there)
                kind = codes[at] // 3
                good = np.isin(kind[:-1] * 4 + kind[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]) if len(at) else np.zeros(0, dtype=bool)
                pair = inside[at][1:] == inside[at][:-1]
                illegal = np.bincount(inside[at][1:][pair & ~good], minlength=size)
                fore, aft = np.full(size, -1), np.full(size, -1)
                aft[inside[at]] = kind
                fore[inside[at][::-1]] = kind[::-1]
                count = lambda which: pa.array(np.bincount(inside[which], minlength=size))  # noqa: E731, B023
                duplicate = np.asarray(piece.column("duplicate"))
                as_list = lambda name: pa.ListArray.from_arrays(pa.array(offsets), piece.column(name))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([
                    conv, pa.array([part] * size, pa.int32()), pa.array(np.arange(seq, seq + size)), pa.array(edge),
                    pa.array([codes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                    as_list("turn"), as_list("role"), as_list("hash"), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(changes),
                    count((codes % 3 == GONE) & there & ~duplicate), count(duplicate), count((codes % 3 == BROKEN) & there), pa.array(illegal),
                    pa.array(fore.astype(np.int32)), pa.array(aft.astype(np.int32)), count(there)], names=CHUNK_COLUMNS)
                seq += size

    return run


CHUNK_COLUMNS = [
    "conv", "part", "seq", "edge", "codes", "turns", "roles", "hashes", "first_turn", "last_turn", "turns_seen",
    "blank", "duplicate", "truncated", "illegal", "fore", "aft", "rows"]


def _chunk_schema(conv: T.DataType) -> T.StructType:
    kinds = [conv, T.IntegerType(), T.LongType(), T.BooleanType(), T.BinaryType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType()), T.ArrayType(T.BinaryType()),
             *[T.LongType()] * 7, *[T.IntegerType()] * 2, T.LongType()]
    return T.StructType([T.StructField(n, k) for n, k in zip(CHUNK_COLUMNS, kinds)])


# -- vectors and states --------------------------------------------------------------

def _free(codes: bytes) -> bytes:
    """The rows at which ways differ."""
    return bytes(c for c in codes if c != NONE and c % 3 != GONE)


def _converged(codes: bytes) -> list[int]:
    """Which vector a chunk has at its start, for every one it may have at its end."""
    now, rest = list(range(len(KINDS))), _free(codes)
    for i in range(len(rest) - 1, -1, -1):
        now = [STEP[k][rest[i]] for k in now]
        if len(set(now)) == 1:
            kind = now[0]
            for c in reversed(rest[:i]):
                kind = STEP[kind][c]
            return [kind] * len(KINDS)
    return now


def _behind(codes: bytes, kind: int) -> list[int]:
    """The vector behind each row, from the one at the chunk's end."""
    out = [kind] * len(codes)
    for i in range(len(codes) - 1, 0, -1):
        kind = out[i - 1] = STEP[kind][codes[i]]
    return out


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [_converged(c) for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "no", "at")), pa.array(maps, pa.list_(pa.int32()))], names=["conv", "no", "at", "map"])


def _pass_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk: the state behind it, for every one before it."""
    for batch in batches:
        maps = []
        for codes, kind in zip(batch.column("codes").to_pylist(), batch.column("kind").to_pylist()):
            now = list(STATES)
            for c, k in zip(codes, _behind(codes, kind)):
                now = [TRACE[k][c][s][1] for s in now]
            maps.append(now)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "no", "at")), pa.array(maps, pa.list_(pa.int32()))], names=["conv", "no", "at", "map"])


def _stitched(maps: DataFrame, given: int) -> DataFrame:
    """(conv, at, value): what comes out of each chunk, when chunk 0 takes in ``given`` and each other what comes out of the one before.

    A pass lets every chunk whose values still differ take in twice as many chunks; it ends when none is left.
    """
    spark, span = maps.sparkSession, 1
    while True:
        fixed = F.transform("map", lambda _: F.get("map", F.lit(given)))
        maps = stored(maps.withColumn("map", F.when(F.col("at") < span, fixed).otherwise(F.col("map"))), scratch_path(spark, "stitch"))
        unlike = F.size(F.array_distinct("map")) > 1
        if not maps.where(unlike).limit(1).count():
            return maps.select("conv", "at", F.get("map", F.lit(0)).alias("value"))
        before = maps.select(F.col("conv").alias("c"), (F.col("at") + span).alias("a"), F.col("map").alias("m"))
        met = maps.where(unlike).join(before, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")))
        met = met.select("conv", "no", "at", F.transform("m", lambda x: F.get("map", x)).alias("map"))
        maps, span = met.unionByName(maps.where(~unlike)), 2 * span


def _taken_in(chain: DataFrame, out: DataFrame, given: int, name: str) -> DataFrame:
    """Adds to each chunk of a chain what the one before it (by ``at``) gives out."""
    out = out.select(F.col("conv").alias("c"), (F.col("at") + 1).alias("a"), F.col("value").alias(name))
    met = chain.join(out, F.col("conv").eqNullSafe(F.col("c")) & (F.col("at") == F.col("a")), "left")
    return met.drop("c", "a").withColumn(name, F.coalesce(name, F.lit(given)))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least audit of each chunk, its cost, and the rows that are left: their role (null: the row's own) and the row they come from (-1: inserted)."""
    names = {"u": "user", "a": "assistant"}
    for batch in batches:
        audits, costs, roles, sources = [], [], [], []
        for codes, kind, s, closes in zip(*(batch.column(c).to_pylist() for c in ("codes", "kind", "state", "closes"))):
            audit, cost, to, source = [], 0, [], []
            for i, (c, k) in enumerate(zip(codes, _behind(codes, kind))):
                letters, after = TRACE[k][c][s]
                audit.append(letters)
                for x in letters:
                    if x == "D":
                        cost += DELETE
                    elif x == "I":
                        to.append(names[WRITES[s]])
                        source.append(-1)
                        cost, s = cost + INSERT, AFTER[s]
                    else:
                        to.append(names[WRITES[s]] if x == "R" else None)
                        source.append(i)
                        cost += (REROLE if x == "R" else 0) + (CUT_OFF if c % 3 == BROKEN else 0)
                s = after
            if closes:
                for _ in TAIL[s]:
                    audit.append("I")
                    to.append(names[WRITES[s]])
                    source.append(-1)
                    cost, s = cost + INSERT, AFTER[s]
            audits.append("".join(audit))
            costs.append(cost)
            roles.append(to)
            sources.append(source)
        made = [pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(roles, pa.list_(pa.string())), pa.array(sources, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), *made], names=["part", "seq", "audit", "cost", "to", "source"])


@dataclass
class Repair:
    """``conversations``: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit); ``rows``: (conv, part, seq, pos, role, text) in that order."""

    conversations: DataFrame
    rows: DataFrame


def _row_key(turn: Column, role: Column, text_hash: Column) -> Column:
    said = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(said(F.col("conv")), F.lit(":"), said(turn), F.lit(":"), F.hex(text_hash), role).cast("binary")))


def repair(rows: DataFrame, chunk_rows: int = 10_000, rows_a_task: int = ROWS_A_TASK) -> Repair:
    """The cheapest repair of every conversation of (conv, turn, role, text, copies), see ``damaged`` and ``plain``.

    Rows go by turn (null first), then role, then the hash of the text. A role
    counts by its first letter; an empty one has none and is never kept. A null
    conv is one conversation of its own. A conversation whose rows have 0 copies
    only has zeros and an empty audit. Of each row's faults the first counts: blank,
    duplicate (role and text stand earlier), cut off. An empty table gives empty results.
    """
    spark = rows.sparkSession
    faults = _faults(rows)
    order = ["conv", "turn", "role", "hash", "copy"]
    n = stored(faults, scratch_path(spark, "faults"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n.count() // rows_a_task)
    laid = n.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    chunks = stored(laid.mapInArrow(_chunks(chunk_rows), _chunk_schema(rows.schema["conv"].dataType)), scratch_path(spark, "chunks"))

    # conversations that go over the edge of a chunk
    whole = Window.partitionBy("conv")
    line = whole.orderBy("part", "seq")
    edges = chunks.where("edge").select("conv", "part", "seq", "codes", "first_turn", "last_turn", "fore", "aft")
    chain = edges.withColumns({"no": F.row_number().over(line) - 1, "of": F.count("*").over(whole)}).where("of > 1")
    met = line.rowsBetween(Window.unboundedPreceding, -1)
    left, turn = (F.last(F.when(F.col(c).isNotNull() if c == "last_turn" else F.col(c) >= 0, F.col(c)), True).over(met) for c in ("aft", "last_turn"))
    pair = F.concat(left.cast("string"), F.col("fore").cast("string"))
    chain = chain.withColumns({
        "at": (F.col("of") - 1 - F.col("no")).cast("int"),
        "same_turn": F.coalesce((turn == F.col("first_turn")).cast("long"), F.lit(0)),
        "bad_pair": F.coalesce(((F.col("fore") >= 0) & ~pair.isin("01", "12", "21")).cast("long"), F.lit(0))})
    chain = stored(chain.select("conv", "part", "seq", "codes", "no", "of", "at", "same_turn", "bad_pair"), scratch_path(spark, "chain"))
    ids = f"conv {rows.schema['conv'].dataType.simpleString()}, no int, at int, map array<int>"
    starts = _stitched(chain.select("conv", "no", "at", "codes").mapInArrow(_speculate, ids), KIND_OF[FINAL])
    known = stored(_taken_in(chain, starts, KIND_OF[FINAL], "kind"), scratch_path(spark, "vectors"))
    onward = known.withColumn("at", F.col("no"))
    states = _stitched(onward.select("conv", "no", "at", "codes", "kind").mapInArrow(_pass_states, ids), 0)
    placed = _taken_in(onward, states, 0, "state").select(
        F.col("part").alias("p"), F.col("seq").alias("q"), "kind", "state", (F.col("no") == F.col("of") - 1).alias("closes"), "same_turn", "bad_pair")
    placed = stored(placed, scratch_path(spark, "placed"))

    same = (F.col("part") == F.col("p")) & (F.col("seq") == F.col("q"))
    placed = small_side(placed, placed.count())
    ready = chunks.select("part", "seq", "codes").join(placed, same, "left").select(
        "part", "seq", "codes", F.coalesce("kind", F.lit(KIND_OF[FINAL])).alias("kind"), F.coalesce("state", F.lit(0)).alias("state"), F.coalesce("closes", F.lit(True)).alias("closes"))
    traced = stored(ready.mapInArrow(_audits, "part int, seq long, audit string, cost long, to array<string>, source array<int>"), scratch_path(spark, "audits"))

    sums = chunks.drop("codes", "turns", "roles", "hashes").join(placed.select("p", "q", "same_turn", "bad_pair"), same, "left").drop("p", "q").join(
        traced.select("part", "seq", "audit", "cost"), ["part", "seq"])
    total = lambda c: F.sum(c).cast("long")
    gaps = F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("turns_seen") - F.coalesce("same_turn", F.lit(0)))
    conversations = sums.groupBy("conv").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), total("blank").alias("blank"), total("duplicate").alias("duplicate"),
        total("truncated").alias("truncated"), total(F.col("illegal") + F.coalesce("bad_pair", F.lit(0))).alias("illegal"), total("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "").alias("audit"))

    left_rows = chunks.select("conv", "part", "seq", "turns", "roles", "hashes").join(traced.select("part", "seq", "to", "source"), ["part", "seq"])
    left_rows = left_rows.select("conv", "part", "seq", "turns", "roles", "hashes", F.posexplode(F.arrays_zip("to", "source")).alias("pos", "edit"))
    at = F.col("edit.source")
    at = F.when(at >= 0, at)
    left_rows = left_rows.select(
        "conv", "part", "seq", "pos", F.coalesce("edit.to", F.get("roles", at)).alias("role"), at.isNull().alias("inserted"),
        F.when(at.isNotNull(), _row_key(F.get("turns", at), F.get("roles", at), F.get("hashes", at))).alias("key"))
    key = _row_key(F.col("turn"), F.col("role"), F.unhex(F.md5(F.col("text").cast("binary"))))
    texts = rows.where("copies > 0").select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    own = left_rows.where("not inserted").join(texts, "key").select("conv", "part", "seq", "pos", "role", "text")
    new = left_rows.where("inserted").select("conv", "part", "seq", "pos", "role", F.lit("").alias("text"))
    return Repair(stored(conversations, scratch_path(spark, "conversations")), own.unionByName(new))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's lines, in a stream: a conversation is never held as a whole."""
    current, digest, convs, out = None, None, [], []
    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        runs = pc.run_end_encode(batch.column("conv"))
        lines = batch.column("line").to_pylist()
        start = 0
        for conv, end in zip(runs.values.to_pylist(), np.asarray(runs.run_ends)):
            if digest is not None and conv == current:
                digest.update(b"\n")
            else:
                if digest is not None:
                    convs.append(current)
                    out.append(digest.hexdigest())
                current, digest = conv, hashlib.sha256()
            digest.update("\n".join(lines[start:end]).encode())
            start = end
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(out)], names=["conv", "sha"])
            convs, out = [], []
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([*convs, current], kind), pa.array([*out, digest.hexdigest()])], names=["conv", "sha"])


def with_digest(done: Repair) -> DataFrame:
    """The conversations with the sha256 of their repaired ``role:text`` lines.

    A hash has to read its lines one after another, so a conversation's lines
    stream through one task; nothing else of the repair does.
    """
    lines = done.rows.select("conv", "part", "seq", "pos", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "part", "seq", "pos").select("conv", "line")
    kind = done.conversations.schema["conv"].dataType.simpleString()
    found = lines.mapInArrow(_digests, f"conv {kind}, sha string").select(F.col("conv").alias("c"), "sha")
    met = done.conversations.join(found, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    return met.withColumn("repaired_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256))).drop("sha")
