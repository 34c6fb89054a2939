"""Line dedup by content-defined chunks of lines (native: DataFrame functions only).

Every line is hashed; a rolling hash over the last ``ROLL`` line hashes ends a
chunk at about one line in four. Boundaries follow from the lines around them,
so a passage that is copied to another place is cut in the same way there,
however many lines stand before it. A line of ``LONG_WORDS`` words or more is a
passage of its own: it ends the chunk before it and is a chunk alone.

Chunks of two lines or more, and long lines, whose bytes occur at several places
of the corpus stay at the first place (smallest doc_id, then text, then
position) and are removed at all others. This rule (``drop_repeated_chunks``) is
what the SQL of ``op5_line_dedup`` says. Chunks that reach over the edge of a
shared passage hide it, so most shared passages of a few short lines stay.

``drop_repeated_passages`` closes that gap: besides the chunks it compares, from
each line forwards and from each line backwards, the shortest run of lines that
has ``LONG_WORDS`` words. Of a shared run of lines with that many words or more,
the runs from its first lines forwards and the one from its last line backwards
lie inside, so together they cover all of it, whatever stands around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import let, small_side, text_key, upto, without
from fleetlens.session import scratch_path, stored

ROLL = 2
LONG_WORDS = 50
#: First hex digits of a rolling hash that end a chunk.
CUT_BELOW = "4"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def is_long(line: Column) -> Column:
    return (F.char_length(line) >= 2 * LONG_WORDS - 1) & (F.regexp_count(line, F.lit(r"[^ \t\r]+")) >= LONG_WORDS)


def chunks_of(lines: Column) -> Column:
    """Array of (no, start, n_lines, passage, body) of the chunks in order; ``passage`` tells whether it may be removed."""

    def cut(hashes: Column, long: Column) -> Column:
        n = F.size(hashes)

        def ends(i: Column) -> Column:
            roll = F.md5(F.concat(*(F.get(hashes, i - k) for k in reversed(range(ROLL)))).cast("binary"))
            by_hash = (i >= ROLL - 1) & (F.substring(roll, 1, 1) < CUT_BELOW)
            return (i == n - 1) | F.get(long, i) | F.coalesce(F.get(long, i + 1), F.lit(False)) | F.coalesce(by_hash, F.lit(False))

        last = F.filter(upto(n), ends)
        return let(last, lambda e: F.transform(e, lambda end, k: let(
            F.when(k > 0, F.get(e, k - 1) + 1).otherwise(F.lit(0)),
            lambda start: let(F.array_join(F.slice(lines, start + 1, end - start + 1), "\n"), lambda body: F.struct(
                k.alias("no"), start.alias("start"), (end - start + 1).alias("n_lines"),
                (((end > start) | F.get(long, start)) & (F.trim(F.regexp_replace(body, r"\s+", "")) != "")).alias("passage"), body.alias("body"))))))

    hashes = F.transform(lines, lambda x: F.md5(x.cast("binary")))
    return let(hashes, lambda h: let(F.transform(lines, is_long), lambda g: cut(h, g)))


def drop_repeated_chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Replaces ``text`` by what stays of it and adds n_lines, n_removed_lines, n_removed_chunks.

    Chunks are told apart by their hash first and by their bytes then: only
    chunks whose bytes are equal are copies. Rows that repeat a doc_id and its
    text count as one document and are treated alike (they keep a first place
    all of them). A null text stays null (no lines); a text of which nothing
    stays becomes empty. Chunks of white space only are never removed. Columns
    named like the new ones are replaced; an empty table gives an empty result.
    """
    docs = without(docs, "n_lines", "n_removed_lines", "n_removed_chunks")
    spark = docs.sparkSession
    place = [F.col(doc_id).alias("__doc"), text_key(F.col(text)).alias("__text")]
    chunks = docs.where(F.col(text).isNotNull()).select(*place, F.explode(let(lines_of(F.col(text)), chunks_of)).alias("c")).where("c.passage")
    chunks = chunks.select("__doc", "__text", F.col("c.no").alias("__no"), F.col("c.n_lines").alias("__lines"), F.md5(F.col("c.body").cast("binary")).alias("__key"), F.col("c.body").alias("__body"))

    known = stored(chunks.drop("__body").distinct(), scratch_path(spark, "chunks"))
    often = stored(known.groupBy("__key").count().where("count > 1").select("__key"), scratch_path(spark, "repeated"))
    n_often = often.count()

    # bytes: a hash stands for one body only, or its chunks stay
    first = F.min(F.struct("__doc", "__text", "__no")).alias("__first")
    bodies = chunks.join(small_side(often, n_often), "__key", "left_semi").groupBy("__key", "__body").agg(first)
    proven = bodies.groupBy("__key").agg(F.count("*").alias("n"), F.min("__first").alias("__first")).where("n = 1").select("__key", "__first")
    proven = stored(proven, scratch_path(spark, "proven"))
    copies = known.join(small_side(proven, n_often), "__key").where(~F.struct("__doc", "__text", "__no").eqNullSafe(F.col("__first")))
    gone = copies.groupBy("__doc", "__text").agg(F.collect_set("__no").alias("__gone"), F.sum("__lines").alias("__n"))
    gone = stored(gone, scratch_path(spark, "removed"))

    kept = let(lines_of(F.col(text)), lambda lines: F.transform(
        F.filter(chunks_of(lines), lambda c: ~F.array_contains(F.col("__gone"), c["no"])), lambda c: c["body"]))
    left = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    every = docs.withColumns({"__d": F.col(doc_id), "__t": text_key(F.col(text))})
    out = every.join(small_side(gone, gone.count()), F.col("__d").eqNullSafe(F.col("__doc")) & (F.col("__t") == F.col("__text")), "left")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines_of(F.col(text)))).cast("long")
    return out.select(
        *[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], n_lines.alias("n_lines"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_removed_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed_chunks"))


def shortest_runs(lines: Column) -> Column:
    """Coded (start << 32 | end): for each line with words the shortest run of ``LONG_WORDS`` words that starts there, and the one that ends there."""

    def reach(words: Column) -> Column:
        """Lines taken until there are enough words; null if they never are."""
        took = F.aggregate(
            words, F.struct(F.lit(0).alias("w"), F.lit(0).alias("n")),
            lambda a, w: F.when(a["w"] >= LONG_WORDS, a).otherwise(F.struct((a["w"] + w).alias("w"), (a["n"] + 1).alias("n"))))
        return let(took, lambda t: F.when(t["w"] >= LONG_WORDS, t["n"]))

    def runs(at: Column, words: Column) -> Column:
        # a line with words has one at least, so LONG_WORDS of them are always enough
        code = lambda a, b: F.shiftleft(F.get(at, a).cast("long"), 32).bitwiseOR(F.get(at, b).cast("long"))
        onward = F.transform(at, lambda _, k: F.when(F.get(words, k) >= LONG_WORDS, code(k, k)).otherwise(
            let(reach(F.slice(words, k + 1, LONG_WORDS)), lambda n: code(k, k + n - 1))))
        back = F.transform(at, lambda _, k: F.when(F.get(words, k) < LONG_WORDS, let(
            reach(F.reverse(F.slice(words, F.greatest(k + 2 - LONG_WORDS, F.lit(1)), F.least(k + 1, F.lit(LONG_WORDS))))), lambda n: code(k - n + 1, k))))
        return F.filter(F.concat(onward, back), lambda x: x.isNotNull())

    counts = F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"[^ \t\r]+")))
    return let(counts, lambda w: let(
        F.filter(upto(F.size(w)), lambda i: F.get(w, i) > 0), lambda at: let(F.transform(at, lambda i: F.get(w, i)), lambda words: runs(at, words))))


def units_of(lines: Column) -> Column:
    """Array of (start, end, key) of all that is compared: the shortest runs and the chunks that are passages."""
    chunks = F.transform(F.filter(chunks_of(lines), lambda c: c["passage"]), lambda c: F.shiftleft(c["start"].cast("long"), 32).bitwiseOR((c["start"] + c["n_lines"] - 1).cast("long")))
    hashes = F.transform(lines, lambda x: F.md5(x.cast("binary")))

    def unit(h: Column, code: Column) -> Column:
        start, end = F.shiftright(code, 32).cast("int"), code.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.struct(start.alias("start"), end.alias("end"), F.md5(F.array_join(F.slice(h, start + 1, end - start + 1), "").cast("binary")).alias("key"))

    return let(hashes, lambda h: F.transform(F.array_distinct(F.concat(shortest_runs(lines), chunks)), lambda code: unit(h, code)))


def drop_repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Replaces ``text`` by what stays of it and adds n_lines and n_removed_lines.

    Every line-aligned run of ``LONG_WORDS`` words or more that stands at an
    earlier place too goes, whatever surrounds it, and so do repeated chunks. What
    goes always has an equal copy at an earlier place. A run that overlaps its
    own first place goes from the end of that on, so the first place stays whole.
    Keys and bytes, repeated rows, nulls, columns and empty tables as in
    ``drop_repeated_chunks``.
    """
    docs = without(docs, "n_lines", "n_removed_lines")
    spark = docs.sparkSession
    place = [F.col(doc_id).alias("__doc"), text_key(F.col(text)).alias("__text")]
    units = docs.where(F.col(text).isNotNull()).select(*place, F.explode(let(lines_of(F.col(text)), units_of)).alias("u"))
    known = stored(units.select("__doc", "__text", F.col("u.start").alias("__start"), F.col("u.end").alias("__end"), F.col("u.key").alias("__key")).distinct(), scratch_path(spark, "units"))
    often = stored(known.groupBy("__key").count().where("count > 1").select("__key"), scratch_path(spark, "repeated"))
    n_often = often.count()
    repeated = stored(known.join(small_side(often, n_often), "__key", "left_semi"), scratch_path(spark, "places"))

    # bytes: a hash stands for one body only, or its runs stay
    wanted = stored(repeated.groupBy("__doc", "__text").agg(F.collect_list(F.struct("__key", "__start", "__end")).alias("__units")), scratch_path(spark, "wanted"))
    every = docs.withColumns({"__d": F.col(doc_id), "__t": text_key(F.col(text))})
    same = F.col("__d").eqNullSafe(F.col("__doc")) & (F.col("__t") == F.col("__text"))
    found = every.select("__d", "__t", F.col(text).alias("__all")).join(small_side(wanted, wanted.count()), same)
    bodies = let(lines_of(F.col("__all")), lambda lines: F.transform(F.col("__units"), lambda u: F.struct(
        u["__key"].alias("key"), u["__start"].alias("start"), F.array_join(F.slice(lines, u["__start"] + 1, u["__end"] - u["__start"] + 1), "\n").alias("body"))))
    bodies = found.select("__doc", "__text", F.explode(bodies).alias("b")).groupBy(F.col("b.key").alias("__key"), F.col("b.body").alias("__body"))
    bodies = bodies.agg(F.min(F.struct("__doc", "__text", F.col("b.start").alias("__start"))).alias("__first"))
    proven = bodies.groupBy("__key").agg(F.count("*").alias("n"), F.min("__first").alias("__first")).where("n = 1").select("__key", "__first")
    proven = stored(proven, scratch_path(spark, "proven"))

    copies = repeated.join(small_side(proven, n_often), "__key").where(~F.struct("__doc", "__text", "__start").eqNullSafe(F.col("__first")))
    own = F.col("__doc").eqNullSafe(F.col("__first.__doc")) & (F.col("__text") == F.col("__first.__text"))
    since = F.when(own, F.greatest(F.col("__start"), F.col("__first.__start") + F.col("__end") - F.col("__start") + 1)).otherwise(F.col("__start"))
    gone = copies.groupBy("__doc", "__text").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence(since, F.col("__end"))))).alias("__gone"))
    gone = stored(gone, scratch_path(spark, "removed"))

    kept = let(lines_of(F.col(text)), lambda lines: F.transform(F.array_except(upto(F.size(lines)), F.col("__gone")), lambda i: F.get(lines, i)))
    left = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    out = every.join(small_side(gone, gone.count()), same, "left")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines_of(F.col(text)))).cast("long")
    return out.select(
        *[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], n_lines.alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed_lines"))
