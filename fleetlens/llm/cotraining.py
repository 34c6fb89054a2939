"""Quality classifier by co-training two views of a document.

The text view knows which words occur (hashed). The metadata view knows
language, source, length and layout: line and word lengths, shares of capitals,
marks and digits. Both start from labelled rows. In each round every unlabelled
document is scored by both views; documents of which one view is sure and the
other is not are taught to the other. At the end both views are calibrated and
combined on labelled rows held out from training, and all documents are scored.

Features are computed once, in tasks, and written; scoring is one pass over
them. Fitting is bounded by parameters whatever the corpus, so it runs on the
driver: ``MAX_LABELLED`` of the labelled rows (those with the smallest hash of
their id) and ``TAUGHT`` pseudo-labels a round, class and view (the smallest
hashes among the sure ones, one of equal texts, so that groups of copies do not
fill them). Everything else covers all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.bpe import lists_of
from fleetlens.llm.frames import chunks_of_bytes, text_key, texts_of, with_columns, without
from fleetlens.session import scratch_path, stored

AT_ONCE = 1 << 22
MAX_LABELLED, TAUGHT, ROUNDS = 20_000, 1_000, 2
#: A view is sure above this probability of a class.
SURE = 0.95
#: Documents below this score are rejected.
KEEP_FROM = 0.5
WORD_BITS, META_BITS = 17, 12
#: Strength of the squared penalty, steps of a fit, and the range of log odds that calibration sees.
PENALTY, FIT_STEPS, ODDS = 1.0, 120, 8.0
VIEWS = ("text", "meta")
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CLASSES = {"capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": b"#*$%&!<>{}[]=_~^", "bars": b"|", "digits": b"0123456789", "odd": b"\\@/+;:"}


def word_features(text: bytes) -> np.ndarray:
    found = set(WORD.findall(text.lower()))
    return np.unique(np.fromiter(map(zlib.crc32, found), dtype=np.int64, count=len(found)) & ((1 << WORD_BITS) - 1))


def meta_features(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    n, lines, words = max(1, len(text)), text.count(b"\n") + 1, text.count(b" ") + 1
    named = [f"lang {lang}", f"source {source}", f"length {int(math.log2(n))}", f"lines {int(math.log2(lines))}",
             f"line length {int(math.log2(n / lines + 1))}", f"word length {int(2 * n / words) if n < 40 * words else 80}"]
    named += [f"{k} {int(10 * math.sqrt((len(text) - len(text.translate(None, v))) / n))}" for k, v in CLASSES.items()]
    return np.unique(np.array([zlib.crc32(x.encode()) & ((1 << META_BITS) - 1) for x in named], dtype=np.int64))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by ``__text`` and ``__meta``, arrays of feature numbers; needs lang and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks_of_bytes(batch, text, AT_ONCE):
                texts = texts_of(part.column(text).to_pylist())
                meta = [meta_features(*x) for x in zip(texts, part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)]
                yield with_columns(part.drop_columns([text]), {"__text": lists_of([word_features(t) for t in texts]), "__meta": lists_of(meta)})

    kept = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(run, T.StructType([*kept, *(T.StructField(f"__{v}", T.ArrayType(T.IntegerType())) for v in VIEWS)]))


#: Feature numbers of many rows one after another, and how many each row has.
Rows = tuple[np.ndarray, np.ndarray]


def rows_of(frame: pa.Table, view: str) -> Rows:
    lists = frame.column(f"__{view}").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def chosen(rows: Rows, which: np.ndarray) -> Rows:
    return rows[0][np.repeat(which, rows[1])], rows[1][which]


def joined(a: Rows, b: Rows) -> Rows:
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])


class Logistic:
    """Logistic regression on sparse presence features, by scaled gradient steps with momentum."""

    def __init__(self, size: int) -> None:
        self.weights, self.bias = np.zeros(size), 0.0

    def odds(self, rows: Rows) -> np.ndarray:
        flat, sizes = rows
        sums = np.concatenate([[0.0], np.cumsum(self.weights[flat])])
        ends = np.cumsum(sizes, dtype=np.int64)
        return sums[ends] - sums[ends - sizes] + self.bias

    def fit(self, rows: Rows, y: np.ndarray, weight: np.ndarray) -> Logistic:
        flat, sizes = rows
        own = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        first, second, n = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1), len(self.weights)
        for step in range(1, FIT_STEPS + 1):
            wrong = (1 / (1 + np.exp(-np.clip(self.odds(rows), -30, 30))) - y) * weight
            grad = np.append(np.bincount(flat, wrong[own], minlength=n) + PENALTY * self.weights, wrong.sum())
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            move = 0.1 * (1 - step / (FIT_STEPS + 1)) * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            self.weights -= move[:-1]
            self.bias -= move[-1]
        return self


def calibrate(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of the score's log odds, by Newton steps on the clipped log odds of the views."""
    x = np.column_stack([np.clip(odds, -ODDS, ODDS), np.ones(len(y))])
    w = np.array([0.5] * odds.shape[1] + [0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), grad)
    return w


def with_odds(known: DataFrame, models: dict[str, Logistic]) -> DataFrame:
    """Replaces the feature columns by ``__o_text`` and ``__o_meta``, the log odds of each view."""
    shared = known.sparkSession.sparkContext.broadcast({v: (m.weights, m.bias) for v, m in models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {}
        for v, (weights, bias) in shared.value.items():
            own[v] = Logistic(0)
            own[v].weights, own[v].bias = weights, bias
        for batch in batches:
            added = {}
            for v in VIEWS:
                lists = batch.column(f"__{v}")
                added[f"__o_{v}"] = pa.array(own[v].odds((lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))))
            yield with_columns(batch.drop_columns([f"__{v}" for v in VIEWS]), added)

    kept = [f for f in known.schema.fields if f.name not in ("__text", "__meta")]
    return known.mapInArrow(run, T.StructType([*kept, *(T.StructField(f"__o_{v}", T.DoubleType()) for v in VIEWS)]))


def _order(*columns: str) -> Column:
    return F.md5(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))


class CoTrained:
    """Both views' models and the weights that combine their log odds; without models every document gets ``base``."""

    def __init__(self, models: dict[str, Logistic], combined: np.ndarray | None, base: float) -> None:
        self.models, self.combined, self.base = models, combined, base

    def score(self, known: DataFrame) -> DataFrame:
        """p_text, p_meta, score and kept in the place of the features."""
        if self.combined is None:
            even = F.lit(self.base)
            return known.drop("__text", "__meta").withColumns({"p_text": even, "p_meta": even, "score": even, "kept": F.lit(True)})
        p = lambda odds: 1 / (1 + F.exp(-odds))
        clipped = [F.greatest(F.least(F.col(f"__o_{v}"), F.lit(ODDS)), F.lit(-ODDS)) for v in VIEWS]
        score = p(clipped[0] * float(self.combined[0]) + clipped[1] * float(self.combined[1]) + float(self.combined[2]))
        rows = with_odds(known, self.models).withColumns({"p_text": p(F.col("__o_text")), "p_meta": p(F.col("__o_meta")), "score": score})
        return rows.withColumn("kept", F.col("score") >= KEEP_FROM).drop("__o_text", "__o_meta")


def co_train(known: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> CoTrained:
    """Fits on ``known`` (``__id``, ``__key``, features) and labels (doc_id, quality, toxic).

    A row is good if its quality is 1 and it is not toxic. Labels with a null id
    or quality are not used, nor are those of an id that has both. Without good
    and bad rows on both sides of the hold-out there is nothing to learn: every
    document gets the share of good labels (1 without labels) and is kept.
    """
    spark = known.sparkSession
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    labels = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__i"), good.cast("double").alias("__y")).where("__y is not null")
    labels = labels.groupBy("__i").agg(F.min("__y").alias("__y"), F.max("__y").alias("__other")).where("__y = __other").drop("__other")
    ids = known.select("__id", "__key").join(labels, F.col("__id") == F.col("__i")).drop("__i")  # narrow: features take part in no shuffle

    own = ["__y", *(f"__{v}" for v in VIEWS)]
    # the order takes the smallest hashes, so the hold-out goes by their last digit
    sample = ids.withColumn("__order", _order("__id", "__key")).orderBy("__order").limit(MAX_LABELLED)
    sample = stored(sample.select(F.col("__id").alias("__i"), F.col("__key").alias("__k"), "__y", (F.substring("__order", 32, 1) < "4").alias("__held")).distinct(), scratch_path(spark, "sample"))
    match = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k"))
    # rows that repeat an id and its text are one row of the sample
    taught = known.join(F.broadcast(sample), match).dropDuplicates(["__id", "__key"]).select("__held", *own).toArrow()
    held, y = taught.column("__held").to_numpy(), taught.column("__y").to_numpy()
    if any(len({*y[side]}) < 2 for side in (held, ~held)):
        return CoTrained({}, None, float(y.mean()) if len(y) else 1.0)
    size, every = {"text": 1 << WORD_BITS, "meta": 1 << META_BITS}, {v: rows_of(taught, v) for v in VIEWS}
    train = {v: (chosen(every[v], ~held), y[~held], np.ones((~held).sum())) for v in VIEWS}
    every = {v: chosen(every[v], held) for v in VIEWS}
    del taught
    models = {v: Logistic(size[v]).fit(*train[v]) for v in VIEWS}

    edge = math.log(SURE / (1 - SURE))
    # pseudo-labels of a class never outnumber its labelled rows, so that few labels cannot drift
    most = {side: min(TAUGHT, int((y[~held] == side).sum())) for side in (True, False)}
    for _ in range(ROUNDS):
        scored = with_odds(known, models).where(" or ".join(f"abs(__o_{v}) >= {edge}" for v in VIEWS))
        scored = scored.join(labels, F.col("__id") == F.col("__i"), "left_anti")
        scored = stored(scored.withColumn("__order", _order("__key")), scratch_path(spark, "scored"))
        picks = []
        for view, other in (VIEWS, VIEWS[::-1]):
            for sign in (1, -1):
                sure = scored.where((F.col(f"__o_{view}") * sign >= edge) & (F.col(f"__o_{other}") * sign < edge))
                sure = sure.groupBy("__order", "__key").agg(F.min("__id").alias("__i")).orderBy("__order").limit(most[sign > 0])
                picks.append(sure.select(F.lit(other).alias("__to"), F.lit(float(sign > 0)).alias("__yy"), "__i", F.col("__key").alias("__k")))
        picked = stored(picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3]), scratch_path(spark, "picked"))
        more = known.join(F.broadcast(picked), match).dropDuplicates(["__to", "__key"]).select("__to", "__yy", "__text", "__meta").toArrow()  # 4 x TAUGHT rows at most
        for v in VIEWS:
            to = more.column("__to").to_numpy() == v
            new_y = more.column("__yy").to_numpy()[to]
            old, old_y, old_weight = train[v]
            train[v] = (joined(old, chosen(rows_of(more, v), to)), np.append(old_y, new_y), np.append(old_weight, np.full(len(new_y), 0.5)))
            models[v] = Logistic(size[v]).fit(*train[v])

    odds = np.column_stack([models[v].odds(every[v]) for v in VIEWS])
    return CoTrained(models, calibrate(odds, y[held]), float(y.mean()))


def classify_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """p_text, p_meta, score and kept beside all columns of ``docs`` but the text; needs lang and source.

    Fits on ``docs`` and ``labels`` and scores every row. Equal rows get equal
    scores; null and empty texts are scored by their metadata, a null language
    or source is a value like others. Columns named like the new ones are
    replaced; an empty table gives an empty result.
    """
    docs = without(docs, "p_text", "p_meta", "score", "kept")
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.withColumns({"__id": F.col(doc_id), "__key": text_key(F.col(text))})
    known = stored(features(rows, text), scratch_path(docs.sparkSession, "features"))
    model = co_train(known.select("__id", "__key", "__text", "__meta"), labels, doc_id)
    return model.score(known).select(*keep, "p_text", "p_meta", "score", "kept")
