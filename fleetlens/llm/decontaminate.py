"""Benchmark decontamination by winnowing (native: DataFrame functions only).

Of the hashes of all ``GRAM`` consecutive words, the smallest one in each run
of ``SPAN - GRAM + 1`` is kept, for documents and for benchmark items: a shared
span of ``SPAN`` words has the same run on both sides and so shares the hash
that is kept from it. Hashes are joined; around each hit the document's windows of
``SPAN`` words that hold it are looked up among the distinct windows of all items
and compared as texts, so what counts is exact and no window of a longer span is
missed. A sentence that many items share is one window: which items have it is
added at the end, so documents and items are never paired.

Items of fewer words are one window of their own length; for each such length
that occurs (nine at most) all runs of that many words are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.frames import bounded_side, exact_lower, let, text_key, upto, without
from fleetlens.session import scratch_path, stored

SPAN, GRAM = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(exact_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def gram_hashes(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` consecutive words."""
    return F.transform(upto(F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.lit(size), *(F.get(hashes, i + k) for k in range(size))))


def winnowed(grams: Column) -> Column:
    """The smallest hash of every run of SPAN - GRAM + 1."""
    run = SPAN - GRAM + 1
    return F.array_distinct(F.transform(upto(F.size(grams) - (run - 1)), lambda i: F.least(*(F.get(grams, i + k) for k in range(run)))))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows_of(words: Column) -> Column:
    """The windows of an item as texts: all runs of SPAN words, or the whole item where it has fewer."""
    size = F.least(F.lit(SPAN), F.size(words))
    return F.transform(upto(F.size(words) - size + 1), lambda q: F.array_join(F.slice(words, q + 1, size), " "))


def candidates(words: Column, prints: Column, lengths: list[int]) -> Column:
    """(p, size, window) of the document's windows that hold a run of words whose hash is among ``prints``; ``lengths`` are those of short items."""
    def around(size: int, gram: int) -> Column:
        def starts(grams: Column) -> Column:
            hits = F.filter(upto(F.size(grams)), lambda j: F.array_contains(prints, F.get(grams, j)))
            near = F.transform(hits, lambda j: F.filter(F.sequence(j - (size - gram), j), lambda p: (p >= 0) & (p <= F.size(words) - size)))
            return F.transform(F.array_distinct(F.flatten(near)), lambda p: F.struct(
                p.alias("p"), F.lit(size).alias("size"), F.array_join(F.slice(words, p + 1, size), " ").alias("window")))

        return let(hashes_of(words), lambda h: let(gram_hashes(h, gram), starts))

    return F.concat(around(SPAN, GRAM), *[around(n, n) for n in lengths])


def mark_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds n_words, n_hit, item_ids (array of string, sorted), contaminated to every row.

    A document word is hit if it stands in any occurrence of a window of any
    item. A null text has no words, an item without words has no window. Rows
    that repeat a doc_id and its text get the same values each; an item whose
    id is null makes hits but is not listed, and items that share an id count
    once. Columns named like the new ones are replaced; an empty table of
    documents or items gives an empty result, or one without hits.
    """
    docs = without(docs, "n_words", "n_hit", "item_ids", "contaminated")
    spark = docs.sparkSession

    # the windows of all items, each once, with the items that have it; and the hashes that stand for them
    own = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), words_of(F.col(f"`{item_text}`")).alias("item")).where(F.size("item") > 0)
    own = stored(own.groupBy("item").agg(F.collect_set("id").alias("ids")), scratch_path(spark, "items"))
    lengths = sorted(r[0] for r in own.where(F.size("item") < SPAN).select(F.size("item")).distinct().collect())  # nine at most
    listed = own.select("ids", F.explode(F.array_distinct(windows_of(F.col("item")))).alias("window"))
    windows = listed.groupBy("window").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("key", F.md5(F.col("window").cast("binary")))
    windows = stored(windows, scratch_path(spark, "windows"))
    hashes = hashes_of(F.col("item"))
    prints = let(hashes, lambda h: let(gram_hashes(h, GRAM), winnowed))
    for n in lengths:
        prints = F.when(F.size("item") == n, let(hashes, lambda h: gram_hashes(h, n))).otherwise(prints)
    by_hash = stored(own.select(F.explode(prints).alias("h")).distinct(), scratch_path(spark, "prints"))

    # documents that share a kept hash, with the hashes they share
    key = [F.col(f"`{doc_id}`").alias("doc"), text_key(F.col(f"`{text}`")).alias("t")]

    def kept(h: Column) -> Column:
        all_of = [let(gram_hashes(h, GRAM), winnowed), *(gram_hashes(h, n) for n in lengths)]
        return F.array_distinct(F.concat(*all_of)) if lengths else all_of[0]

    seen = docs.select(*key, F.explode(let(hashes_of(words_of(F.col(f"`{text}`"))), kept)).alias("h"))
    shared = seen.join(bounded_side(by_hash), "h", "left_semi").groupBy("doc", "t").agg(F.collect_set("h").alias("prints"))
    shared = stored(shared.select(F.col("doc").alias("d"), F.col("t").alias("k"), "prints"), scratch_path(spark, "shared"))

    # their windows around these hashes, compared as texts; no document meets an item before its windows are known
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("t") == F.col("k"))
    texts = docs.select(*key, F.col(f"`{text}`").alias("text")).join(bounded_side(shared, F.size("prints") * 8), same).dropDuplicates(["doc", "t"])
    texts = texts.select("doc", "t", "prints", words_of(F.col("text")).alias("words"))
    near = texts.select("doc", "t", F.explode(candidates(F.col("words"), F.col("prints"), lengths)).alias("c")).select(
        "doc", "t", "c.*", F.md5(F.col("c.window").cast("binary")).alias("key"))
    known = bounded_side(windows.select("key", F.col("window").alias("own")), F.octet_length("own"))
    hits = near.join(known, "key").where(F.col("window") == F.col("own")).select("doc", "t", "p", "size", "key")
    hits = stored(hits, scratch_path(spark, "hits"))
    places = hits.groupBy("doc", "t").agg(F.size(F.array_distinct(F.flatten(F.collect_set(
        F.sequence(F.col("p"), F.col("p") + F.col("size") - 1))))).cast("long").alias("n"))
    ids = hits.select("doc", "t", "key").distinct().join(bounded_side(windows.select("key", "ids"), F.size("ids") * 16), "key")
    ids = ids.groupBy("doc", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("found"))
    both = places.join(ids.select(F.col("doc").alias("d"), F.col("t").alias("k"), "found"), same).select(F.col("doc").alias("d"), F.col("t").alias("k"), "n", "found")
    both = stored(both, scratch_path(spark, "marks"))

    # the row is packed, so no column of it meets a name from here
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key, F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("n_words"))
    out = every.join(bounded_side(both, F.size("found") * 16), same, "left")
    return out.select(
        *[F.col(f"row.`{c}`") for c in docs.columns], "n_words", F.coalesce("n", F.lit(0)).alias("n_hit"),
        F.coalesce("found", F.array().cast("array<string>")).alias("item_ids"), F.col("n").isNotNull().alias("contaminated"))
