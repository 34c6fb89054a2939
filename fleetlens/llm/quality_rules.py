"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Five statistics of each text are transformed (logarithms of sizes, square roots
of shares). Per language and source the MCD estimate is the mean and covariance
of the 75 % of rows with the smallest determinant; rows far from it by
Mahalanobis distance are rejected. Every step covers all rows and is a sum with
partial results, so a source with a third of all rows is no hot group:

* two starts per group, spread by the median deviations and by unit scale,
  both around the medians;
* concentration steps: sums by distance, of which those up to the 75 % quantile
  give a new mean and covariance (none raises the determinant);
* the start with the smaller determinant stands; its distances are scaled so
  that their median is that of the chi-square law.

Quantiles come from counts on a fixed fine grid, exact up to the grid's step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.frames import chunks_of_bytes, small_side, texts_of, with_columns, without
from fleetlens.session import scratch_path, stored

AT_ONCE = 1 << 22
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: Rows that a group needs for an estimate of its own; smaller ones are pooled by language, then all together.
LEAST_ROWS = 50
SHARE, STEPS, GRID = 0.75, 5, 64
#: Least standard deviation by dimension: a statistic that hardly varies in a group must not reject what any text may have.
FLOOR = (0.5, 0.1, 0.15, 0.1, 0.15)
#: Quantiles of the chi-square law with five degrees of freedom at 0.5 and 1 - 1e-9.
MEDIAN, FAR = 4.3515, 50.7
DIMS = [f"__x{i}" for i in range(5)]


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()  # bytes: ASCII white space only
    chars = len(b"".join(words).decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    runs = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(runs)) < len(runs):
        seen: dict[tuple, int] = {}
        for r in runs:
            seen[r] = seen.get(r, 0) + 1
        covered = 0  # words before this place are counted
        for i, r in enumerate(runs):
            if seen[r] > 1:
                repeated += i + 3 - max(covered, i)
                covered = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by the five statistics (a null text has none: all zero)."""
    docs = without(docs, *STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of_bytes(batch, text, AT_ONCE):
                rows = [statistics(t) for t in texts_of(part.column(text).to_pylist())]
                added = {n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(STATS)}
                yield with_columns(part.drop_columns([text]), added)

    kept = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in STATS)]))


def transformed() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"), F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n)]


def grid_quantile(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """keys, ``name``: the smallest grid value with at least ``share`` of the group's rows at or below it."""
    counts = df.groupBy(*keys, F.ceil(F.col(value) * GRID).alias("__bin")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    below = counts.withColumns({"__cum": F.sum("__n").over(w.orderBy("__bin")), "__all": F.sum("__n").over(w)})
    return below.where(F.col("__cum") >= F.col("__all") * share).groupBy(*keys).agg((F.min("__bin") / GRID).alias(name))


def grouped(known: DataFrame) -> DataFrame:
    """Adds ``__group``: language and source, the language's pool of small sources, or the pool of all (null if that is small too)."""
    spark = known.sparkSession
    lang, source = F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    known = known.withColumns({"__l": lang, "__s": source})
    count = known.where("n_words > 0").groupBy("__l", "__s").agg(F.count("*").alias("__n"))
    own, by_lang = F.col("__n") >= LEAST_ROWS, Window.partitionBy("__l")
    count = count.withColumn("__p", F.sum(F.when(own, 0).otherwise(F.col("__n"))).over(by_lang))
    pool = count.where(~own & (F.col("__p") < LEAST_ROWS)).agg(F.sum("__n")).first()[0] or 0
    rest = F.lit("pool of all") if pool >= LEAST_ROWS else F.lit(None).cast("string")
    named = count.withColumn("__group", F.when(own, F.to_json(F.array("__l", "__s"))).when(F.col("__p") >= LEAST_ROWS, F.to_json(F.array("__l"))).otherwise(rest))
    named = stored(named.select("__l", "__s", "__group"), scratch_path(spark, "groups"))
    return known.join(small_side(named, named.count()), ["__l", "__s"], "left").drop("__l", "__s")


MODEL = "__group string, __start int, center array<double>, inverse array<double>, logdet double"


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean, inverse and determinant from the sums of a group's rows (one row a group and start)."""
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    for frame in frames:
        rows = []
        for r in frame.to_dict("records"):
            mean = np.array([r[f"s{i}"] for i in range(5)]) / r["n"]
            cov = np.zeros((5, 5))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"p{i}{j}"] / r["n"] - mean[i] * mean[j]
            cov += np.diag(np.square(FLOOR))
            rows.append((r["__group"], r["__start"], mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(rows, columns=["__group", "__start", "center", "inverse", "logdet"])


def distance() -> Column:
    """Squared Mahalanobis distance from ``center`` by ``inverse``."""
    d = [F.col(x) - F.get("center", F.lit(i)) for i, x in enumerate(DIMS)]
    return sum((d[i] * d[j] * F.get("inverse", F.lit(5 * i + j)) for i in range(5) for j in range(5)), F.lit(0.0))


def mcd(rows: DataFrame) -> DataFrame:
    """MODEL with one row for each ``__group`` of rows that have ``DIMS``."""
    spark = rows.sparkSession
    rows = rows.select("__group", *DIMS)
    long = lambda df: df.select("__group", F.posexplode(F.array(*DIMS)).alias("__d", "__v"))
    medians = stored(grid_quantile(long(rows), ["__group", "__d"], "__v", 0.5, "__m"), scratch_path(spark, "medians"))
    apart = long(rows).join(small_side(medians, medians.count()), ["__group", "__d"]).withColumn("__v", F.abs(F.col("__v") - F.col("__m")))
    spread = grid_quantile(apart, ["__group", "__d"], "__v", 0.5, "__s")
    both = medians.join(spread, ["__group", "__d"]).groupBy("__group").agg(F.array_sort(F.collect_list(F.struct("__d", "__m", "__s"))).alias("__a"))
    floor = F.array(*(F.lit(x) for x in FLOOR))
    diagonal = lambda a, start: F.transform(F.sequence(F.lit(0), F.lit(24)), lambda k: F.when(
        k % 6 == 0, F.lit(1.0) if start else 1 / (F.pow(1.4826 * F.get(a["__s"], (k / 6).cast("int")), 2) + F.pow(F.get(floor, (k / 6).cast("int")), 2))).otherwise(0.0))
    model = both.select("__group", F.explode(F.array(*(
        F.struct(F.lit(s).alias("__start"), F.col("__a")["__m"].alias("center"), diagonal(F.col("__a"), s).alias("inverse"), F.lit(0.0).alias("logdet"))
        for s in (0, 1)))).alias("m")).select("__group", "m.*")
    model = stored(model, scratch_path(spark, "model"))
    n = model.count()
    powers = {f"s{i}": F.col(x) for i, x in enumerate(DIMS)}
    powers |= {f"p{i}{j}": F.col(DIMS[i]) * F.col(DIMS[j]) for i in range(5) for j in range(i, 5)}
    of = Window.partitionBy("__group", "__start")
    for _ in range(STEPS):
        # sums by grid step of the distance, then those of the steps up to the quantile: one pass over the rows
        apart = rows.join(small_side(model, n), "__group").withColumn("__bin", F.ceil(F.log(distance() + 1e-6) * GRID))
        steps = apart.groupBy("__group", "__start", "__bin").agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in powers.items()))
        before = F.coalesce(F.sum("n").over(of.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = steps.withColumns({"__before": before, "__all": F.sum("n").over(of)}).where(F.col("__before") < F.col("__all") * SHARE)
        sums = near.groupBy("__group", "__start").agg(*(F.sum(k).alias(k) for k in ("n", *powers)))
        model = stored(sums.mapInPandas(_estimates, MODEL), scratch_path(spark, "model"))
    best = model.groupBy("__group").agg(F.min_by(F.struct("center", "inverse"), F.struct("logdet", "__start")).alias("m")).select("__group", "m.*")
    return stored(best, scratch_path(spark, "mcd"))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Statistics of each row's text with base_failed, distance (squared, scaled) and kept; the text itself is not returned.

    ``kept`` is false for texts under 50 words, texts of which over half the
    words stand in repeated runs of three, and outliers of their language and
    source. Rows without words count in no estimate; a row whose group and
    pools have under 50 rows has no distance and is judged by the base rules
    only. Null language or source are groups of their own. Repeated rows and
    ties are rows like others; columns named like the new ones are replaced; an
    empty table gives an empty result.
    """
    docs = without(docs, *STATS, "base_failed", "distance", "kept")
    spark = docs.sparkSession
    known = stored(text_statistics(docs, text), scratch_path(spark, "statistics"))
    rows = grouped(known).withColumns(dict(zip(DIMS, transformed(), strict=True)))
    fitted = rows.where("n_words > 0 and __group is not null")
    model = mcd(fitted)
    n = model.count()
    apart = rows.join(small_side(model, n), "__group", "left").withColumn("__d2", F.when(F.col("n_words") > 0, distance()))
    middle = grid_quantile(apart.where("__d2 is not null").withColumn("__log", F.log(F.col("__d2") + 1e-6)), ["__group"], "__log", 0.5, "__mid")
    middle = stored(middle, scratch_path(spark, "middle"))
    out = apart.join(small_side(middle, n), "__group", "left").withColumn("distance", F.col("__d2") * MEDIAN / F.greatest(F.exp("__mid"), F.lit(MEDIAN / 4)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > FAR, F.lit(False))).select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text], *STATS, "base_failed", "distance", "kept")
