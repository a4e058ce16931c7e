"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are word-level (log-odds and a hashed code of the whole word) and character-level (log-odds
and a hashed code of its n-grams of 3 to 5 letters, word bounds included), so that a word never seen is known by its parts. A
text is read in windows of WINDOW words, one every STRIDE, all of it; the network reads each window both
ways, pools its states by attention and gives a logit. A document's score is the calibrated logit of its
worst window.

Training is on the driver, over a bounded sample: SAMPLE documents of either label, the first by a hash of
doc_id, never those held out, BYTES in all, none longer than LONGEST (documents are taken whole or not at all). Log-odds are cross-fitted in two folds, so that the network doesn't trust what
it only saw once. Windows of clean documents are clean; of toxic ones, the two of most evidence are toxic. A
quarter of the sample only calibrates, towards the true rate of the label.

Defined results: null and empty texts are one window without words; rows of labels without a label or doc_id
are ignored; without both labels every text scores the base rate; equal texts score alike; an empty table gives
an empty result. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.text import slices

WINDOW, STRIDE, HIDDEN, ATTENTION, CODE = 64, 32, 8, 8, 3
SAMPLE, STEPS, BATCH, RATE, SEED = 2000, 300, 256, 0.02, 7
#: Bytes of the longest text, and of all texts, that are learned from.
LONGEST, BYTES = 1 << 20, 16 << 20
BUCKETS, GRAMS, THRESHOLD, FOLDS, HELD = 1 << 18, (3, 4, 5), 0.3, 4, 2
EDGES = " .,;:!?$#%&*|\"'()[]{}<>«»…-–_"
INPUTS = 3 + 2 * CODE


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


class Words:
    """Distinct words as buckets: one of the whole word, and those of its character n-grams, word after word."""

    def __init__(self, words: list[str]):
        clean = [w.strip(EDGES) for w in words]
        codes = np.frombuffer("".join(f"\2{w}\3" for w in clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, clean), np.int64, len(clean)) + 2
        starts = np.cumsum(sizes) - sizes
        self.n = len(words)
        if not self.n:
            self.word, self.gram, self.of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        owner = np.repeat(np.arange(self.n), sizes)
        place = (np.arange(len(codes)) - starts[owner]).astype(np.uint64)
        whole = np.add.reduceat(_mix(codes + place * np.uint64(0x100000001B3)), starts)
        self.word = (_mix(whole) >> np.uint64(46)).astype(np.int32) & BUCKETS - 1
        grams, of = [], []
        for n in GRAMS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for j in range(n):
                h = _mix(h + codes[j : len(codes) - n + 1 + j])
            inside = owner[: len(h)] == owner[n - 1 :]
            grams.append((h[inside] >> np.uint64(40)).astype(np.int64) & BUCKETS - 1)
            of.append(owner[: len(h)][inside])
        self.gram, self.of = (np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int32) for x in (grams, of))


@dataclass
class Evidence:
    """Log-odds of word and n-gram buckets between toxic and other documents."""

    word: np.ndarray
    gram: np.ndarray

    def inputs(self, words: Words) -> np.ndarray:
        """n x INPUTS, with a row of zeros for padding last."""
        out = np.zeros((words.n + 1, INPUTS), np.float32)
        if not words.n:
            return out
        code = np.random.default_rng(SEED).normal(0, 0.3, (1024, CODE)).astype(np.float32)
        out[:-1, 0] = self.word[words.word]
        out[:-1, 3 : 3 + CODE] = code[words.word & 1023]
        lo = self.gram[words.gram]
        count = np.maximum(np.bincount(words.of, minlength=words.n), 1)
        np.maximum.at(out[:, 1], words.of, lo)
        out[:-1, 2] = np.bincount(words.of, lo, words.n) / count
        for k in range(CODE):
            out[:-1, 3 + CODE + k] = np.bincount(words.of, code[words.gram & 1023, k], words.n) / count
        return out


def _evidence(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Evidence:
    tables = []
    for which in (0, 1):
        n = np.zeros((2, BUCKETS))
        for d, label in zip(docs, y, strict=True):
            n[int(label), d[which]] += 1
        size = np.bincount(y.astype(int), minlength=2)
        lo = np.log((n[1] + 0.5) / (size[1] + 1)) - np.log((n[0] + 0.5) / (size[0] + 1))
        seen = n.sum(0)
        tables.append((np.clip(lo, -2, 6) * seen / (seen + 4)).astype(np.float32))
    return Evidence(*tables)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights by name; forward() for many windows at once, gradients() for training."""

    def __init__(self, rng: np.random.Generator):
        h, d = HIDDEN, INPUTS
        f = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32)
        self.w = {"va": f(ATTENTION), "wa": f(2 * h, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "wo": f(2 * h), "bo": np.zeros(1, np.float32)}
        for side in "fb":
            self.w |= {f"x{side}": f(d, 3 * h) / 2, f"b{side}": np.zeros(3 * h, np.float32), f"u{side}": f(h, 3 * h)}

    def _run(self, side: str, proj: np.ndarray, index: np.ndarray, mask: np.ndarray | None, tape: list | None) -> np.ndarray:
        """States (steps, windows, HIDDEN) of one direction; proj are the words' inputs times x plus b."""
        h2, u = 2 * HIDDEN, self.w[f"u{side}"]
        steps = range(index.shape[0]) if side == "f" else range(index.shape[0] - 1, -1, -1)
        h = np.zeros((index.shape[1], HIDDEN), np.float32)
        out = np.empty((*index.shape, HIDDEN), np.float32)
        for t in steps:
            x, hu = proj[index[t]], h @ u
            gates = _sigmoid(x[:, :h2] + hu[:, :h2])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, h2:] + r * hu[:, h2:])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if tape is not None:
                tape.append((t, h, z, r, n, hu[:, h2:]))
            h = out[t] = new
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, tapes: dict | None = None) -> np.ndarray:
        """A logit per window. x: inputs of words, index: (steps, windows) into x, mask: which are words (None: all)."""
        w = self.w
        states = [self._run(s, x @ w[f"x{s}"] + w[f"b{s}"], index, mask, None if tapes is None else tapes.setdefault(s, [])) for s in "fb"]
        s = np.concatenate(states, 2)
        a = np.tanh(s @ w["wa"] + w["ba"])
        e = a @ w["va"]
        if mask is not None:
            e = np.where(mask, e, np.float32(-1e9))
        p = np.exp(e - e.max(0))
        p /= p.sum(0)
        pooled = np.einsum("tb,tbh->bh", p, s)
        if mask is not None:
            pooled *= mask.any(0)[:, None]
        if tapes is not None:
            tapes["attention"] = (s, a, p, pooled)
        return pooled @ w["wo"] + w["bo"][0]

    def gradients(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean log loss; x are fixed inputs."""
        w, tapes = self.w, {}
        logit = self.forward(x, index, mask, tapes)
        p1 = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = ((p1 - y) / len(y)).astype(np.float32)
        s, a, p, pooled = tapes["attention"]
        g = {"wo": pooled.T @ d, "bo": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * w["wo"]
        ds = p[:, :, None] * dpool
        dp = np.einsum("tbh,bh->tb", s, dpool)
        de = p * (dp - (p * dp).sum(0))
        g["va"] = np.einsum("tb,tba->a", de, a)
        da = de[:, :, None] * w["va"] * (1 - a * a)
        g["wa"] = np.einsum("tbh,tba->ha", s, da)
        g["ba"] = da.sum((0, 1))
        ds += da @ w["wa"].T
        h2 = 2 * HIDDEN
        for k, side in enumerate("fb"):
            u, own = w[f"u{side}"], ds[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            gu, dh = np.zeros_like(u), np.zeros_like(own[0])
            dx = np.zeros((*index.shape, 3 * HIDDEN), np.float32)
            for t, h, z, r, n, hn in reversed(tapes[side]):
                dh = dh + own[t]
                m = mask[t][:, None]
                dn = dh * (1 - z) * (1 - n * n) * m
                dz = dh * (h - n) * z * (1 - z) * m
                dr = dn * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                dx[t, :, :h2], dx[t, :, h2:] = dhu[:, :h2], dn
                gu += h.T @ dhu
                dh = np.where(m, dh * z, dh) + dhu @ u.T
            g[f"u{side}"], g[f"b{side}"] = gu, dx.sum((0, 1))
            g[f"x{side}"] = np.tensordot(x[index], dx, ((0, 1), (0, 1)))
        return g, loss


def windows(counts: np.ndarray, pad: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps x windows index of words, padded, document of each window) for texts of `counts` words, one after the other in words."""
    per = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
    doc = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = np.cumsum(counts) - counts
    inside = nth * STRIDE + np.arange(WINDOW)[:, None]
    at = np.minimum(first[doc] + inside, max(len(words) - 1, 0))
    index = np.where(inside < counts[doc], words[at] if len(words) else pad, pad).astype(np.int32)
    return index, doc


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word in order, words by text)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(), np.diff(lists.offsets.to_numpy())


@dataclass
class Model:
    evidence: Evidence
    net: Network
    slope: float
    bias: float

    def raw(self, texts: pa.Array, evidence: Evidence | None = None) -> np.ndarray:
        """The largest window logit by text."""
        names, index, counts = split(texts)
        x = (evidence or self.evidence).inputs(Words(names))
        at, doc = windows(counts, len(names), index)
        logits = np.empty(len(doc), np.float32)
        for k in range(0, len(doc), 4096):
            part = at[:, k : k + 4096]
            mask = part < len(names)
            logits[k : k + 4096] = self.net.forward(x, part, None if mask.all() else mask)
        return np.maximum.reduceat(logits, np.searchsorted(doc, np.arange(len(counts))))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts).astype(float) + self.bias, -30, 30)))


def train(texts: list[str], y: np.ndarray, rate: float) -> Model:
    """A model of labelled texts; rate: the share of label 1 in the population."""
    rng = np.random.default_rng(SEED)
    names, index, counts = split(pa.array(texts, pa.string()))
    words = Words(names)
    ends = np.cumsum(counts)
    grams = np.split(words.gram[np.argsort(words.of, kind="stable")], np.cumsum(np.bincount(words.of, minlength=words.n))[:-1])
    docs = []
    for a, z in zip(ends - counts, ends, strict=True):
        own = np.unique(index[a:z])
        docs.append((np.unique(words.word[own]), np.unique(np.concatenate([np.zeros(0, np.int32), *(grams[i] for i in own)]))))
    del grams
    calibrate = rng.random(len(y)) < 0.25
    fold = rng.integers(0, 2, len(y))
    at, doc = windows(counts, words.n, index)
    inputs, picks, target = [], [], []
    for k in (0, 1):
        others = ~calibrate & (fold != k)
        ev = _evidence([docs[i] for i in np.flatnonzero(others)], y[others])
        inputs.append(ev.inputs(words))
        proof = inputs[k][:, :2].max(1)
        proof[-1] = -9  # padding
        best = np.concatenate([proof[at[:, i : i + 8192]].max(0) for i in range(0, at.shape[1], 8192)])
        for i in np.flatnonzero(~calibrate & (fold == k)):
            lo, hi = np.searchsorted(doc, [i, i + 1])
            order = lo + np.argsort(-best[lo:hi], kind="stable")
            mine = order[:2] if y[i] else np.unique(np.concatenate([order[:2], rng.choice(order, min(2, len(order)), replace=False)]))
            if y[i] and len(mine) > 1 and best[mine[1]] < 0.5 * best[mine[0]]:
                mine = mine[:1]
            picks += [(k, m) for m in mine]
            target += [float(y[i])] * len(mine)
    picks, target = np.array(picks), np.array(target, np.float32)
    x = np.concatenate(inputs)
    net = Network(rng)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(a) for k, a in net.w.items()}
    sides = [np.flatnonzero(target == 0), np.flatnonzero(target == 1)]
    for step in range(1, STEPS + 1):
        batch = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        own = at[:, picks[batch, 1]]
        g, _ = net.gradients(x, own + picks[batch, 0] * (words.n + 1), own < words.n, target[batch])
        lr = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for name, d in g.items():
            m[name] = 0.9 * m[name] + 0.1 * d
            v[name] = 0.98 * v[name] + 0.02 * d * d
            net.w[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    known = ~calibrate
    model = Model(_evidence([docs[i] for i in np.flatnonzero(known)], y[known]), net, 1.0, 0.0)
    held = calibrate if len(np.unique(y[calibrate])) == 2 else np.ones(len(y), bool)
    raw = np.clip(model.raw(pa.array([texts[i] for i in np.flatnonzero(held)], pa.string())).astype(float), -12, 12)
    # Platt, ridged towards slope 1; then from the sample's rate to the true one
    t, w = y[held].astype(float), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * raw + w[1], -30, 30)))
        a = np.stack([raw, np.ones_like(raw)], 1)
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag([1.0, 0.01])
        step = np.linalg.solve(h, a.T @ (p - t) + np.array([1.0, 0.01]) * (w - [1.0, 0.0]))
        w = w - step * min(1.0, 0.5 / (np.abs(step).max() + 1e-9))
    share = min(max(t.mean(), 1e-3), 1 - 1e-3)
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    shift = np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    # all evidence of this sample stays in the final model, calibration rows included
    return Model(model.evidence, net, float(max(w[0], 0.05)), float(w[1] + shift))


def held_out(doc_id: Column, folds: int = FOLDS, held: int = HELD) -> Column:
    """Rows whose crc32(doc_id as text) mod folds is held are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == held


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model | float:
    """A model, or the base rate (0 without labels) where fewer than two documents of a label can be learned from."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = counts.get(1, 0) / max(sum(counts.values()), 1)
    by = F.xxhash64("doc_id", F.lit(SEED))
    marked: dict[int, int] = {}
    for y, n in sorted(counts.items()):
        # by a threshold of the hash first, so that partitions send their share of the sample and not the sample each
        likely = known.where((F.col("y") == y) & (F.pmod(by, F.lit(1 << 30)) <= int((1 << 30) * min(1.0, (2 * sample + 100) / n))))
        marked |= {r.doc_id: y for r in likely.orderBy(by, "doc_id").limit(sample).collect()}
    wanted = spark.createDataFrame(sorted(marked.items()) or [(-1, 0)], "__mw_id long, __mw_y int")
    rows = docs.select(F.col("doc_id").cast("long").alias("__mw_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__mw_text")).join(F.broadcast(wanted), F.col("__mw_doc") == F.col("__mw_id"))
    # repeated doc_ids could exceed the sample, and long texts the driver: rows are taken by hash while they fit, whole or not at all
    order = [F.xxhash64("__mw_id", F.lit(SEED)), F.col("__mw_id"), F.xxhash64("__mw_text")]
    rows = rows.select("__mw_id", "__mw_y", "__mw_text", F.octet_length("__mw_text").alias("__mw_bytes")).where(F.col("__mw_bytes") <= LONGEST)
    fit_in = rows.select("__mw_id", "__mw_y", "__mw_bytes", *(c.alias(f"__mw_o{k}") for k, c in enumerate(order))).orderBy("__mw_o0", "__mw_o1", "__mw_o2").limit(2 * sample).collect()
    total, last = 0, None
    for r in fit_in:
        total += r["__mw_bytes"]
        if total > BYTES:
            break
        last = r["__mw_o0"]
    got = rows.where(order[0] <= F.lit(last)).orderBy(*order).limit(2 * sample).select("__mw_id", "__mw_y", "__mw_text").collect() if last is not None else []
    y = np.array([r[1] for r in got])
    if len(y) == 0 or np.bincount(y, minlength=2).min() < 8:
        return float(rate)
    return train([r[2] for r in got], y, rate)


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text); no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if isinstance(model, Model):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = 0
                for part in slices(b.column(1), 2 << 20):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(model.scores(part), pa.float64())], ["doc_id", "score"])
                    at += len(part)

        rows = rows.mapInArrow(run, "doc_id long, score double")
    else:
        rows = rows.select("doc_id", F.lit(float(model)).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
