import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from meshwork.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(seed=1, n=400):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        text = " ".join(words) + "." if good else " ".join(f"{w.upper()}!! ###" for w in words[:20]) * 3
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["good.org", "any"] if good else ["junk.biz", "any"]), len(text)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_on_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.fit(docs, labels.where(~apart))
    out = quality.score(docs, model, ["doc_id"]).join(labels.where(apart), "doc_id").toPandas()
    kept = out["__mw_score"] >= quality.KEEP_FROM
    good = out["quality"] == 1
    assert (kept & good).sum() >= 0.995 * good.sum() and (~kept & ~good).sum() >= 0.95 * (~good).sum()


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    text = rng.normal(0, 1, (3000, 3)) + 2.5 * y[:, None]
    meta = rng.normal(0, 1, (3000, 2)) + 1.5 * y[:, None]
    few = np.arange(40)
    (wt, wm), wc = quality.co_train((text[few], meta[few]), y[few], (text[40:1500], meta[40:1500]), few % 4 == 0)
    z = np.stack([quality._apply(wt, text[1500:]), quality._apply(wm, meta[1500:])], 1)
    assert (((z @ wc[:-1] + wc[-1]) > 0) == y[1500:]).mean() > 0.95


def slow_score(model, row):
    """A document's score from its columns, word by word."""
    doc_id, text, lang, source, n_chars = row[:5]
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    letters = [c for c in t if unicodedata.category(c)[0] == "L"]
    n, chars, distinct = max(len(words), 1), max(len(t), 1), len(set(words))
    x = [
        math.log1p(len(words)), min(len(t) / n, 50), min(sum(c in "#*$%&|<>!~^=_{}[]@\\" for c in t) / n, 5), sum(unicodedata.category(c) == "Lu" for c in letters) / max(len(letters), 1),
        math.log1p(n / (t.count("\n") + 1)), distinct / n, len(letters) / chars, sum(c in "0123456789" for c in t) / chars, min(sum(c in ".,;:?" for c in t) / n, 3), max(math.log1p(n) - math.log1p(distinct), 0),
    ]
    slot = lambda s, n: signed(xxhash.xxh64_intdigest(s.encode(), seed=42)) % n
    shares = Counter(slot(w, quality.WORDS) for w in words)
    logit = model.text_bias + sum(a * b for a, b in zip(model.text, x)) + sum(model.text[len(x) + b] * k for b, k in shares.items()) / (len(words) + quality.DAMP)
    size = math.log1p(max(n_chars or 0, 0))
    meta = model.meta_bias + model.size[0] * size + model.size[1] * size * size
    for value, name, ws in ((source, "source", model.source), (lang, "lang", model.lang)):
        meta += ws[slot("\0" if value is None else value, quality.BUCKETS[name])]
    clip = lambda z: max(-30, min(30, z))
    a, b, c = model.combine
    return 1 / (1 + math.exp(-clip(a * clip(logit) + b * clip(meta) + c)))


def signed(h):
    return h - 2**64 if h >> 63 else h


def test_scores_agree_with_slow_ones_and_survive_odd_rows(spark):
    rows, labels = made()
    odd = [(None, None, None, None, None), (900, "", "en", "good.org", 0), (901, "x" * 200_000, None, "any", -5), (902, None, "zz", None, None), (0, *rows[0][1:])]
    docs = spark.createDataFrame(rows + odd, DOCS).selectExpr("*", "'s' as score", "1 as kept", "2 as words", "array(1) as extra", "3 as x", "4 as b", "'l' as r")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, lab)
    assert any(abs(w) > 1e-3 for w in model.text[len(quality.TEXT) :])
    for r, row in zip(quality.score(docs, model, ["doc_id"]).collect(), rows + odd, strict=True):
        assert r.doc_id == row[0] and abs(r["__mw_score"] - slow_score(model, row)) < 1e-9
    out = quality.classify(docs, lab).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert all(by[i].kept == (i % 4 != 0) for i in range(len(rows)))
    kept = quality.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


def test_without_labels_or_rows(spark):
    rows, labels = made(n=40)
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept and r.score == 1.0 for r in quality.classify(docs, none).collect())
    one = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, quality int")
    assert all(r.kept for r in quality.classify(docs, one).collect())
    assert quality.classify(docs.limit(0), one).count() == 0
    assert quality.keep_good(docs, none).count() == len(rows)
    assert quality.classify(docs.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 40


def test_all_sure_rows_reach_the_other_view(spark):
    """Sums in Spark over every unlabelled row are those of numpy, without a bound on rows passed on."""
    rng = np.random.default_rng(3)
    n, width = 30_000, len(quality.TEXT) + quality.WORDS
    text, size = rng.normal(0, 1, (n, width)).astype(np.float32), rng.normal(0, 1, n)
    source, lang = rng.integers(0, 64, n), rng.integers(0, 16, n)
    mean, dev = np.zeros(width), np.ones(width)
    pool = quality._arrays(text.astype(float), size, source, lang, mean, dev)
    ws = [rng.normal(0, 2, v.shape[1] + 1) for v in pool]
    rows = spark.createDataFrame([(t.tobytes(), float(s), int(a), int(b)) for t, s, a, b in zip(text, size, source, lang, strict=True)], "x binary, size double, source int, lang int")
    got, want = quality._summed(rows.repartition(5), mean, dev)([ws], ws), quality._pool_sums(pool, [ws], ws)
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))
    assert all((~np.isnan(y)).sum() > 500 for y in quality._passed(pool, [ws]))


def test_a_rare_class_is_learned_from(spark):
    """The labelled sample is drawn per class: 30 bad documents beside 3,000 good ones, a sample of 200."""
    rows, _ = made(n=400)
    bad = [r for r in rows if r[0] % 4 == 0][:30]
    good = [(1000 + i, *rows[1 + 4 * (i % 90)][1:]) for i in range(3000)]
    docs = spark.createDataFrame(bad + good, DOCS)
    labels = spark.createDataFrame([(r[0], 0) for r in bad] + [(r[0], 1) for r in good], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample=200)
    assert isinstance(model, quality.Model)
    out = quality.score(docs, model, ["doc_id"]).collect()
    assert all((r["__mw_score"] >= quality.KEEP_FROM) == (r.doc_id >= 1000) for r in out)
