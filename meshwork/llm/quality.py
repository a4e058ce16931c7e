"""Quality by co-training: a text-content view and a metadata view teach each other, then score together.

Each view is a ridge logistic regression. The text view reads a text's words, as shares of WORDS hashed buckets, and ten
measures of its surface; the metadata view reads source, lang and n_chars. Labelled rows come to the driver as a
bounded sample (SAMPLE of either class, the first by a hash of doc_id, features only), weighted to the true rate.
In every round each view labels all unlabelled documents of which it is sure, and these join the other view's
training set: their features stay in Spark, where every Newton step (STEPS at most in a round, from the last round's
weights) sums loss, gradient and curvature, by partition and then by groups of partitions. Both views are then calibrated (Platt) on labelled rows that neither was
trained on, and a logistic regression over the calibrated logits combines them. Features of every text are made once
and kept (under 600 bytes a document, as 32-bit floats): labelled rows are taken out of them, not of the
texts, by one join on ids that shuffles features only, and `classify` scores them as they are. `score`, for models at
hand, is one SQL expression: no shuffle, no Python.

Defined results: null text counts as empty, null metadata as a category of its own, null n_chars as 0; rows
of labels without a label are ignored; without labels of both classes every document scores the base rate
(1.0 if there are no labels) and is kept; of rows that share a doc_id one is learned from; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwork.llm.text import settled, word_array
from meshwork.session import cut, release

#: Labelled rows of each class; rounds; least certainty of a label that a view passes on.
SAMPLE, ROUNDS, STEPS, SURE = 8000, 3, 4, 0.95
#: Buckets that words are hashed to; words without a bucket that every text has besides, so that few words tell little.
WORDS, DAMP = 128, 20.0
KEEP_FROM = 0.3
BUCKETS = {"source": 64, "lang": 16}
FEATURED = "__mw_id long, x binary, size double, source int, lang int"
TEXT = ("words", "word_chars", "symbols", "upper", "line_words", "distinct", "letters", "digits", "stops", "repeats")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WORDS)).cast("int")


def text_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, an array of the text's surface measures under __mw_text_x, and its words under __mw_w."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(*keep, t.alias("__mw_t"))
    own = own.withColumns({"__mw_w": word_array(F.col("__mw_t")), "__mw_l": F.regexp_replace("__mw_t", r"[^\p{L}]+", "")})
    own = own.withColumns({"__mw_n": F.size("__mw_w"), "__mw_d": F.size(F.array_distinct("__mw_w")), "__mw_len": F.length("__mw_t"), "__mw_u": F.length(F.regexp_replace("__mw_l", r"[^\p{Lu}]+", "")), "__mw_k": F.length("__mw_l")})
    n = F.greatest(F.col("__mw_n"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("__mw_len"), F.lit(1)).cast("double")
    without = lambda of: F.col("__mw_len") - F.length(F.translate("__mw_t", of, ""))
    x = {
        "words": F.log1p(F.col("__mw_n").cast("double")),
        "word_chars": F.least(F.col("__mw_len") / n, F.lit(50.0)),
        "symbols": F.least(without("#*$%&|<>!~^=_{}[]@\\") / n, F.lit(5.0)),
        "upper": F.col("__mw_u") / F.greatest(F.col("__mw_k"), F.lit(1)),
        "line_words": F.log1p(n / (without("\n") + 1)),
        "distinct": F.col("__mw_d") / n,
        "letters": F.col("__mw_k") / chars,
        "digits": without("0123456789") / chars,
        "stops": F.least(without(".,;:?") / n, F.lit(3.0)),
        "repeats": F.greatest(F.log1p(n) - F.log1p(F.col("__mw_d").cast("double")), F.lit(0.0)),
    }
    assert tuple(x) == TEXT
    return own.select(*keep, F.array(*(v.cast("double") for v in x.values())).alias("__mw_text_x"), "__mw_w")


def featured(docs: DataFrame) -> DataFrame:
    """(__mw_id, x, size, source, lang, doc_id): x holds TEXT and the shares of WORDS buckets as 32-bit floats."""
    schema = T.StructType([*T.StructType.fromDDL(FEATURED).fields, docs.schema["doc_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            surface = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(TEXT))
            lists = b.column(2)
            n = np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(b.num_rows), n) * WORDS + lists.flatten().to_numpy(zero_copy_only=False)
            shares = np.bincount(at, minlength=b.num_rows * WORDS).reshape(b.num_rows, WORDS) / (n + DAMP)[:, None]
            x = np.hstack([surface, shares]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([row.tobytes() for row in x], pa.binary()), *b.columns[3:]], schema.names)

    rows = docs.withColumns({"__mw_id": F.col("doc_id").cast("long"), "__mw_meta": meta_features(docs.columns)})
    rows = text_features(rows, ["__mw_id", "__mw_meta", "doc_id"])
    return rows.select("__mw_id", "__mw_text_x", F.transform("__mw_w", _bucket).alias("b"), "__mw_meta.*", "doc_id").mapInArrow(run, schema)


def _matrix(x: list[bytes] | pa.Array) -> np.ndarray:
    """Rows of 32-bit floats as a matrix."""
    parts = x.to_pylist() if isinstance(x, pa.Array) else x
    return np.frombuffer(b"".join(parts), np.float32).reshape(len(parts), len(TEXT) + WORDS).astype(float)


def _slots(name: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\0"))), F.lit(BUCKETS[name])).cast("int")


def meta_features(cols: list[str]) -> Column:
    """struct(size, source, lang): log of n_chars and the hashed categories; columns that are missing are constant."""
    size = F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))) if "n_chars" in cols else F.lit(0.0)
    return F.struct(size.alias("size"), *((_slots(c) if c in cols else F.lit(0)).alias(c) for c in BUCKETS))


@dataclass
class Model:
    """Weights on raw features, calibrations folded in; scored(x) = sigmoid of the combined logit."""

    text: list[float]
    text_bias: float
    size: tuple[float, float]
    source: list[float]
    lang: list[float]
    meta_bias: float
    combine: tuple[float, float, float]

    def logits(self, text: Column, words: Column, meta: Column) -> tuple[Column, Column]:
        t = F.lit(self.text_bias)
        for i, w in enumerate(self.text[: len(TEXT)]):
            t = t + F.lit(w) * text[i]
        of_bucket = F.array(*map(F.lit, self.text[len(TEXT) :]))
        told = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.element_at(of_bucket, _bucket(w) + 1))
        t = t + told / (F.size(words) + F.lit(DAMP))
        m = F.lit(self.meta_bias) + F.lit(self.size[0]) * meta["size"] + F.lit(self.size[1]) * meta["size"] * meta["size"]
        for name, ws in (("source", self.source), ("lang", self.lang)):
            m = m + F.element_at(F.array(*map(F.lit, ws)), meta[name] + 1)
        return t, m


    def scores(self, x: np.ndarray, size: np.ndarray, source: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, that of the text view and that of the metadata view, each row's sum in one order whatever its batch."""
        clip = lambda z: np.clip(z, -30, 30)
        t = clip(self.text_bias + (x * np.array(self.text)).sum(1))
        m = clip(self.meta_bias + self.size[0] * size + self.size[1] * size * size + np.array(self.source)[source] + np.array(self.lang)[lang])
        a, b, c = self.combine
        return tuple(1 / (1 + np.exp(-z)) for z in (clip(a * t + b * m + c), t, m))


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature at w (bias last) in one array."""
    x = np.hstack([x, np.ones((len(x), 1))])
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = weight @ (np.logaddexp(0, z) - y * z)
    return np.concatenate([[loss], x.T @ (weight * (p - y)), ((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x).ravel()])


def _newton(sums: Callable[[list[np.ndarray]], list[np.ndarray]], start: list[np.ndarray], ridge: float = 1.0, steps: int = 30) -> list[np.ndarray]:
    """Weights of several regressions, a pass over their rows for each step of all; a step that loses is halved."""
    ws, last = list(start), [(np.inf, w, w) for w in start]
    done = [False] * len(ws)
    for _ in range(steps):
        for k, total in enumerate(sums(ws)):
            if done[k]:
                continue
            w, d = ws[k], len(ws[k])
            penalty = np.full(d, ridge)
            penalty[-1] = 1e-6
            loss = total[0] + penalty @ (w * w) / 2
            if loss > last[k][0] + 1e-9 * abs(last[k][0]):
                step = last[k][2] / 2
                last[k] = (last[k][0], last[k][1], step)
            else:
                step = np.linalg.solve(total[d + 1 :].reshape(d, d) + np.diag(penalty), total[1 : d + 1] + penalty * w)
                last[k] = (loss, w, step)
            ws[k] = last[k][1] - step
            done[k] = bool(np.abs(step).max() < 1e-5)
        if all(done):
            break
    return ws


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, bias last, of rows at hand."""
    return _newton(lambda ws: [_sums(x, y, weight, ws[0])], [np.zeros(x.shape[1] + 1)])[0]


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _passed(pool: tuple[np.ndarray, np.ndarray], history: list[list[np.ndarray]]) -> list[np.ndarray]:
    """For each view the labels that the other gave its rows, by the first of its models that was sure; NaN without one."""
    out = []
    for k in range(2):
        y = np.full(len(pool[k]), np.nan)
        for models in history:
            p = 1 / (1 + np.exp(-_apply(models[1 - k], pool[1 - k])))
            y = np.where(~np.isnan(y), y, np.where(p >= SURE, 1.0, np.where(1 - p >= SURE, 0.0, np.nan)))
        out.append(y)
    return out


def _pool_sums(pool: tuple[np.ndarray, np.ndarray], history: list[list[np.ndarray]], ws: list[np.ndarray]) -> list[np.ndarray]:
    return [_sums(x[has], y[has], np.ones(has.sum()), w) for x, y, w in zip(pool, _passed(pool, history), ws, strict=True) for has in (~np.isnan(y),)]


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool, calibrate: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(weights of each view with its calibration folded in, weights of the combination).

    pool is the unlabelled rows of both views, or a function of (history, weights) that sums over them.
    """
    y, weight = y.astype(float), np.ones(len(y)) if weight is None else weight
    far = pool if callable(pool) else lambda history, ws: _pool_sums(pool, history, ws)
    train = ~calibrate
    near = lambda ws: [_sums(v[train], y[train], weight[train], w) for v, w in zip(views, ws, strict=True)]
    models = _newton(near, [np.zeros(v.shape[1] + 1) for v in views])
    history: list[list[np.ndarray]] = []
    for _ in range(ROUNDS):
        history.append(models)
        models = _newton(lambda ws: [a + b for a, b in zip(near(ws), far(history, ws), strict=True)], models, steps=STEPS)
    held, logits = y[calibrate], []
    for k, (m, v) in enumerate(zip(models, views, strict=True)):
        a, b = _logistic(_apply(m, v[calibrate])[:, None], held, weight[calibrate])
        models[k] = np.append(m[:-1] * a, m[-1] * a + b)
        logits.append(_apply(models[k], v[calibrate]))
    return models, _logistic(np.stack(logits, 1), held, weight[calibrate])


def _arrays(text: np.ndarray, size: np.ndarray, source: np.ndarray, lang: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows."""
    hot = [np.eye(BUCKETS[c])[v.astype(int)] for c, v in (("source", source), ("lang", lang))]
    return (text - mean) / dev, np.hstack([size[:, None] / 5, size[:, None] ** 2 / 50, *hot])


def _summed(pool: DataFrame, mean: np.ndarray, dev: np.ndarray) -> Callable[[list[list[np.ndarray]], list[np.ndarray]], list[np.ndarray]]:
    """_pool_sums over the rows of pool (x, size, source, lang): rows of sums by partition, then by so many groups as there
    are partitions in a group, which is what comes to the driver."""
    groups = math.isqrt(pool.rdd.getNumPartitions()) + 1

    def sums(history: list[list[np.ndarray]], ws: list[np.ndarray]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = None
            for b in batches:
                if b.num_rows:
                    views = _arrays(_matrix(b.column(0)), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)), mean, dev)
                    new = _pool_sums(views, history, ws)
                    totals = new if totals is None else [x + y for x, y in zip(totals, new, strict=True)]
            if totals is not None:
                yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in totals], ["a", "b"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = None
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True):
                    new = [np.frombuffer(x) for x in row]
                    totals = new if totals is None else [x + y for x, y in zip(totals, new, strict=True)]
            if totals is not None:
                yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in totals], ["a", "b"])

        totals = [np.zeros(1 + len(w) + len(w) ** 2) for w in ws]
        by_part = pool.mapInArrow(run, "a binary, b binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
        for row in by_part.repartition(groups, "g").mapInArrow(add, "a binary, b binary").collect():
            totals = [t + np.frombuffer(x) for t, x in zip(totals, row, strict=True)]
        return totals

    return sums


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | float:
    """A model, or the base rate where labels hold fewer than two classes."""
    features = cut(featured(docs))
    model = learn(features, labels, label, sample)
    release(features)
    return model


def learn(features: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | float:
    """fit, from features that are kept."""
    spark = features.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    by = F.xxhash64("doc_id", F.lit(7))
    marked: dict[int, int] = {}
    share: dict[int, float] = {}
    for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy("y").collect():
        # by a threshold of the hash first, so that partitions send their share of the sample and not the sample each
        likely = known.where((F.col("y") == r.y) & (F.pmod(by, F.lit(1 << 30)) <= int((1 << 30) * min(1.0, (2 * sample + 100) / r.n))))
        found = [x.doc_id for x in likely.orderBy(by, "doc_id").limit(sample).collect()]
        marked |= dict.fromkeys(found, r.y)
        share[r.y] = r.n / len(found)
    wanted = spark.createDataFrame([(i,) for i in sorted(marked)] or [(-1,)], T.StructType([T.StructField("__mw_wanted", T.LongType())]))
    rows = features.join(F.broadcast(wanted), F.col("__mw_id") == F.col("__mw_wanted"))
    # of rows that share a doc_id one: the bound of the sample holds for what comes to the driver
    data = rows.groupBy("__mw_id").agg(F.min(F.struct("x", "size", "source", "lang")).alias("r")).select("__mw_id", "r.*").orderBy("__mw_id").toPandas()
    if not len(data):
        return 1.0
    y = data["__mw_id"].map(marked).to_numpy(float)
    has = ~np.isnan(y)
    # a class of which the sample holds a part weighs as much as all of it
    weight = np.array([share.get(v, 1.0) for v in y])
    weight[has] /= weight[has].mean() if has.any() else 1.0
    rate = float(np.average(y[has], weights=weight[has])) if has.any() else 1.0
    if len(np.unique(y[has])) < 2 or min((y[has] == 0).sum(), (y[has] == 1).sum()) < 10:
        return rate
    text = _matrix([bytes(x) for x in data["x"]])
    # a bucket of few words gets little weight, not a large scale
    mean, dev = text.mean(0), text.std(0) + np.where(np.arange(text.shape[1]) < len(TEXT), 1e-6, 1e-2)
    x, meta = _arrays(text, *(data[c].to_numpy(float) for c in ("size", "source", "lang")), mean, dev)
    # a row calibrates by its id, so that copies of a row stay on one side
    side = np.array([(int(i) * 2654435761 >> 7) % 4 == 0 for i in data["__mw_id"]])
    if len(np.unique(y[has & side])) < 2 or len(np.unique(y[has & ~side])) < 2:
        return rate
    # rows without an id have no label, and would all meet in one task of the join; the join is the same at every size
    known = known.select(F.col("doc_id").alias("__mw_known")).distinct().hint("merge")
    others = features.where("__mw_id is not null").join(known, F.col("__mw_id") == F.col("__mw_known"), "left_anti")
    pool = cut(others.unionAll(features.where("__mw_id is null")).select("x", "size", "source", "lang"))
    (wt, wm), wc = co_train((x[has], meta[has]), y[has], _summed(pool, mean, dev), side[has], weight[has])
    release(pool)
    raw = wt[:-1] / dev
    s, la = BUCKETS["source"], BUCKETS["lang"]
    return Model([float(w) for w in raw], float(wt[-1] - raw @ mean), (float(wm[0] / 5), float(wm[1] / 50)), [float(w) for w in wm[2 : 2 + s]], [float(w) for w in wm[2 + s : 2 + s + la]], float(wm[-1]), (float(wc[0]), float(wc[1]), float(wc[2])))


def score(docs: DataFrame, model: Model | float, keep: list[str]) -> DataFrame:
    """The columns keep of docs, then __mw_score, __mw_text_score and __mw_meta_score in 0..1."""
    if not isinstance(model, Model):
        return docs.select(*keep, *(F.lit(float(model)).alias(c) for c in ("__mw_score", "__mw_text_score", "__mw_meta_score")))
    names = [c for c in docs.columns if c in keep]
    rows = docs.withColumn("__mw_meta", meta_features(docs.columns))
    # text is read by the features and may also be kept
    rows = text_features(rows.select(*names, *([] if "text" in names else ["text"]), "__mw_meta"), [*names, "__mw_meta"])
    t, m = model.logits(F.col("__mw_text_x"), F.col("__mw_w"), F.col("__mw_meta"))
    rows = rows.select(*names, t.alias("__mw_lt"), m.alias("__mw_lm"))
    clip = lambda c: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c))
    sigmoid = lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-c))
    rows = rows.select(*names, clip(F.col("__mw_lt")).alias("__mw_lt"), clip(F.col("__mw_lm")).alias("__mw_lm"))
    a, b, c = model.combine
    both = clip(F.lit(a) * F.col("__mw_lt") + F.lit(b) * F.col("__mw_lm") + F.lit(c))
    return rows.select(*names, sigmoid(both).alias("__mw_score"), sigmoid(F.col("__mw_lt")).alias("__mw_text_score"), sigmoid(F.col("__mw_lm")).alias("__mw_meta_score"))


def classify(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, score, text_score, meta_score, kept) for every row of docs."""
    features = cut(featured(docs))
    model = learn(features, labels)
    if not isinstance(model, Model):
        return features.select("doc_id", *(F.lit(float(model)).alias(c) for c in ("score", "text_score", "meta_score")), F.lit(True).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model.scores(_matrix(b.column(1)), *(b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found), pa.array(found[0] >= keep_from)], schema.names)

    schema = T.StructType([features.schema["doc_id"], *T.StructType.fromDDL("score double, text_score double, meta_score double, kept boolean").fields])
    return features.select("doc_id", "x", "size", "source", "lang").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """docs without the documents that the classifier rejects."""
    model = fit(docs, labels)
    if not isinstance(model, Model):
        return docs
    scored = score(docs, model, docs.columns).withColumn("__mw_score", settled(F.col("__mw_score")))
    return scored.where(F.col("__mw_score") >= keep_from).select(*docs.columns)
