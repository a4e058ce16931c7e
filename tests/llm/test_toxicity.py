import zlib

import numpy as np
import pyarrow as pa

from meshwork.llm import toxicity as T


def test_gradients():
    rng = np.random.default_rng(0)
    net = T.Network(rng)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = rng.normal(size=(9, T.INPUTS))
    index = rng.integers(0, 9, (6, 4))
    mask, y = index < 8, np.array([1.0, 0, 1, 0])
    g, _ = net.gradients(x, index, mask, y)
    for k, w in net.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        was, eps = w[at], 1e-3
        w[at] = was + eps
        up = net.gradients(x, index, mask, y)[1]
        w[at] = was - eps
        down = net.gradients(x, index, mask, y)[1]
        w[at] = was
        assert abs(g[k][at] - (up - down) / 2 / eps) < 1e-5


def test_windows_cover_every_word():
    for counts in ([0, 1, 63, 64, 65, 96, 97, 1000], [0], [5]):
        counts = np.array(counts)
        words = np.arange(counts.sum())
        index, doc = T.windows(counts, len(words), words)
        first = np.cumsum(counts) - counts
        for d, n in enumerate(counts):
            mine = index[:, doc == d]
            assert mine.shape[1] >= 1 and set(mine[mine < len(words)].ravel()) == set(range(first[d], first[d] + n))
            assert n <= T.WINDOW or mine.shape[1] > 1


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = T.score(docs, T.fit(docs, labels)).join(labels, "doc_id").toPandas()
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id])
    held = out[out.held_out]
    hit = (held.predicted == 1) & (held.toxic == 1)
    assert hit.sum() >= 0.85 * (held.toxic == 1).sum() and hit.sum() >= 0.8 * (held.predicted == 1).sum()


def test_learns_nothing_from_held_out_rows(spark):
    rows = [(i, ("fine words here " * 5) + ("awful" if i % 3 == 0 else "nice")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    true = [(i, int(i % 3 == 0)) for i, _ in rows]
    lies = [(i, 1 - y if held(i) else y) for i, y in true]
    a, b = (T.score(docs, T.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).orderBy("doc_id").collect() for x in (true, lies))
    assert [r.score for r in a] == [r.score for r in b]
    assert np.mean([r.predicted == y for r, (_, y) in zip(a, true, strict=True)]) > 0.95


def test_odd_rows(spark):
    rows = [(i, ("quite plain text " * 4) + ("horrid" if i % 2 else "good")) for i in range(80)]
    docs = spark.createDataFrame([*rows, (None, None), (500, ""), (501, "horrid " * 50_000), (0, rows[0][1])], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as toxic", "2 as held_out")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    out = T.score(docs, model).collect()
    assert len(out) == 84 and all(0 <= r.score <= 1 for r in out) and {r.predicted for r in out if r.doc_id == 501} == {1}
    assert len({r.score for r in out if r.doc_id == 0}) == 1 and [r.held_out for r in out if r.doc_id is None] == [False]
    assert T.score(docs.limit(0), model).count() == 0
    assert T.fit(docs, labels.limit(0)) == 0.0 and T.score(docs, 0.0).count() == 84
    assert len(model.scores(pa.array([], pa.string()))) == 0
