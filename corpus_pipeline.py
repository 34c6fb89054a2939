"""From raw documents to token ids: the stages of the corpus pipeline.

Each stage takes the documents that its predecessor kept (a table in files) and
returns what stays; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.bpe import encode_decode
from fleetlens.llm.cotraining import classify_quality
from fleetlens.llm.decontaminate import mark_contaminated
from fleetlens.llm.frames import small_side, table, text_key
from fleetlens.llm.line_dedup import drop_repeated_passages
from fleetlens.llm.simhash import near_components
from fleetlens.session import scratch_path, stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Jaccard similarity of five-word shingles from which documents are near copies.
SIMILAR = 0.8


def _row() -> list:
    """What names a row in the joins of a stage; rows equal in these are treated alike."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in ("lang", "source")]
    return [F.col("doc_id").alias("__doc"), F.md5(F.concat_ws("\x02", text_key(F.col("text")), *parts).cast("binary")).alias("__row")]


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], *_row())


def _of(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with named rows, in a table whose rows are counted."""
    rows = stored(rows.select(F.col("__doc").alias("__d"), F.col("__row").alias("__r")).distinct(), scratch_path(docs.sparkSession, "rows"))
    named = _named(docs)
    match = named["__doc"].eqNullSafe(F.col("__d")) & (named["__row"] == F.col("__r"))
    return named.join(small_side(rows, rows.count()), match, how).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    judged = classify_quality(_named(docs).select("doc_id", "text", "lang", "source", "__doc", "__row"), table(spark, sf_dir, "labels"))
    return _of(docs, judged.where(~F.col("kept")), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document of which no more than white space stays is a copy and goes."""
    done = drop_repeated_passages(docs)
    changed = F.col("n_removed_lines") > 0
    done = done.where(~(changed & ~F.col("text").rlike(r"\S")))
    chars = F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (2 bits, or ``SIMILAR`` by five-word shingles), once (of rows with that id, the smallest name)."""
    linked = near_components(_named(docs).select("doc_id", "text", "__doc", "__row"), keep_text=False, similar=SIMILAR)
    linked = stored(linked.select("__doc", "__row", "component_id"), scratch_path(spark, "linked"))
    heads = linked.where(F.col("__doc").eqNullSafe(F.col("component_id"))).groupBy("__doc").agg(F.min("__row").alias("__row"), F.count("*").alias("__n"))
    heads = stored(heads, scratch_path(spark, "heads"))
    # what goes is far less than what stays: texts need not be shuffled to find it
    head = heads.select(F.col("__doc").alias("__d"), F.col("__row").alias("__r"))
    kept = _of(docs, linked.join(head, F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")), "left_anti"), "left_anti")
    again = heads.where("__n > 1").select("__doc")  # ids that occur in several rows
    if not again.limit(1).count():
        return kept
    once = kept.join(again, kept["doc_id"].eqNullSafe(again["__doc"]), "left_anti")
    return once.unionByName(kept.join(again, kept["doc_id"].eqNullSafe(again["__doc"]), "left_semi").dropDuplicates(["doc_id"]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    marked = mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left; a document that does not decode to its text fails the job."""
    done = encode_decode(docs.select("doc_id", "text", "lang", "source", "n_chars"), TOKENIZER)
    same = F.assert_true(F.col("decoded") == F.coalesce("text", F.lit("")), "a text differs after decoding")
    return done.where(same.isNull()).select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can express neither the classifier nor the encoding; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), scratch_path(spark, name))
    return docs
