"""De Bruijn graphs of reads: k-mers packed by numpy, and counts and components of graphs too large to be written as edges.

A vertex is the lesser of a k-mer and its reverse complement, A, C, G, T packed as 0..3 in two bits each. The large way keeps
runs of successive k-mers together (super-k-mers, as in minimum substring partitioning): every k-mer goes to the bucket of its
least m-mer in a random order, which successive k-mers mostly share, so that a k-mer costs about a byte and equal k-mers still
meet in one bucket, whichever read and strand they come from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.operators.components import forest, sequential_components
from meshwork.session import cut

#: Letters that a task packs at a time.
LETTERS = 1 << 21
#: Buckets of minimizers, and letters of a minimizer.
BUCKETS, MINIMIZER = 1 << 11, 11
#: k-mers that a task compares at a time; in all a task gets about twice as many, while there are buckets enough.
AT_ONCE = 1 << 21

CODES = np.full(256, 4, np.uint8)
CODES[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2


def _check(k: int) -> None:
    if not 1 <= k <= 31:
        raise ValueError("a k-mer of 2k bits must fit a long")


def _fit(k: int, codes: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The packed k letters from each place at on."""
    power, size = codes.astype(np.uint32), 1
    while 2 * size <= k:
        power = power[:-size] << np.uint32(2 * size) | power[size:]
        size *= 2
    rest = k - size
    ahead = slice(at.start + rest, at.stop + rest) if isinstance(at, slice) else at + rest
    return power[at].astype(np.uint64) << np.uint64(2 * rest) | power[ahead].astype(np.uint64) & np.uint64((1 << 2 * rest) - 1)


def canonical(x: np.ndarray, k: int) -> np.ndarray:
    """The lesser of packed k-mers and their reverse complements."""
    r = ~x
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        r = r >> np.uint64(shift) & np.uint64(mask) | (r & np.uint64(mask)) << np.uint64(shift)
    return np.minimum(x, r.byteswap() >> np.uint64(64 - 2 * k))


def _clear(codes: np.ndarray, w: int) -> np.ndarray:
    """Whether the w letters from each place on are all of ACGT."""
    bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int32)])
    return bad[w:] == bad[:-w]


def _pieces(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[np.ndarray]:
    """Codes of reads, kept apart by one that is no letter's, about size at a time. A longer read comes in pieces that share k
    letters, so that each window of k + 1 is in one."""
    held, n = [], 0
    for b in batches:
        for seq in b.column(0):
            whole = seq.as_buffer().to_pybytes() if seq.is_valid else b""
            for at in range(0, len(whole) - k, size):
                held.append(whole[at : at + size + k])
                n += len(held[-1]) + 1
                if n >= size:
                    yield CODES[np.frombuffer(b"\n".join(held), np.uint8)]
                    held, n = [], 0
    if held:
        yield CODES[np.frombuffer(b"\n".join(held), np.uint8)]


def edges(reads: DataFrame, k: int = 31) -> DataFrame:
    """(src, dst) both ways for each two successive k-mers of reads (seq). Windows with any other letter make no k-mer."""
    _check(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _pieces(batches, k, LETTERS // 4):
            both = _clear(codes, k + 1)
            x = canonical(_fit(k, codes & 3, slice(0, len(codes) - k + 1)), k).view(np.int64)
            a, b = x[:-1][both], x[1:][both]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))], ["src", "dst"])

    return reads.select(F.col("seq").cast("binary").alias("seq")).mapInArrow(run, "src long, dst long")


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """A bijection of 32 bits."""
    x = x * np.uint32(by)
    return x ^ x >> np.uint32(15)


def _bucket(codes: np.ndarray, k: int) -> np.ndarray:
    """The bucket of the k-mer at each place: that of the least of its canonical m-mers in a random order."""
    m = min(MINIMIZER, k)
    low = _mixed(canonical(_fit(m, codes, slice(0, len(codes) - m + 1)), m).astype(np.uint32), 0x9E3779B1)
    size, w = 1, k - m + 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if w > size:
        low = np.minimum(low[: size - w], low[w - size :])
    return (_mixed(low, 0x85EBCA6B) * np.uint32(0xC2B2AE35) >> np.uint32(32 - (BUCKETS - 1).bit_length())).astype(np.int32)


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] times, then from start[1] on, and so on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def super_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(bucket, base, own, n, letters, kmers, edges) of reads (seq): the super-k-mers of a block of reads in one bucket; of each the
    number less base of the stretch of letters that it is from, its number of k-mers (32 bits both), and their letters, four to a
    byte. Only k-mers that have a neighbour count. In edges one row of a block has its windows of k + 1."""
    schema = "bucket int, base long, own binary, n binary, letters binary, kmers long, edges long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        for codes in _pieces(batches, k, LETTERS):
            both = _clear(codes, k + 1)
            if not both.any():
                continue
            vertex = np.concatenate([both, [False]])
            vertex[1:] |= both
            # k-mers at successive places have an edge between them
            stretch = np.cumsum(np.diff(vertex, prepend=False) & vertex)
            codes = codes & 3
            bucket = _bucket(codes, k)
            bucket[~vertex] = -1
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            n = np.diff(first, append=len(bucket))
            real = bucket[first] >= 0
            first, n = first[real], n[real]
            order = np.argsort(bucket[first], kind="stable")
            first, n = first[order], n[order]
            at = bucket[first]
            own = stretch[first].astype(np.uint32)
            cuts = [*np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist(), len(at)]
            rows = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                x = codes[_ragged(first[i:j], n[i:j] + (k - 1))]
                x = np.concatenate([x, np.zeros(-len(x) % 4, np.uint8)])
                x = x[0::4] << 6 | x[1::4] << 4 | x[2::4] << 2 | x[3::4]
                rows.append((int(at[i]), base, own[i:j].tobytes(), n[i:j].astype(np.uint32).tobytes(), x.tobytes(), int(n[i:j].sum()), 0 if i else int(both.sum())))
            base += int(stretch[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64()), strict=True)], [c.split()[0] for c in schema.split(", ")])

    return reads.select(F.col("seq").cast("binary").alias("seq")).mapInArrow(run, schema)


def _read_back(batches: Iterator[pa.RecordBatch], k: int, number: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(k-mers, numbers of their stretches) of rows (base, own, n, letters, kmers), about AT_ONCE at a time."""
    held, total = [], 0

    def block() -> tuple[np.ndarray, np.ndarray | None]:
        n = [np.frombuffer(r["n"], np.uint32).astype(np.int64) for r in held]
        start, at = [], 0
        for r, x in zip(held, n, strict=True):
            start.append(at + np.cumsum(x + (k - 1)) - x - (k - 1))
            at += 4 * len(r["letters"])
        n, start = np.concatenate(n), np.concatenate(start)
        packed = np.frombuffer(b"".join(r["letters"] for r in held), np.uint8)
        codes = np.empty(4 * len(packed) + 32, np.uint8)
        codes[4 * len(packed) :] = 0
        for i, shift in enumerate((6, 4, 2, 0)):
            codes[i : 4 * len(packed) : 4] = packed >> shift & 3
        x = canonical(_fit(k, codes, _ragged(start, n)), k).view(np.int64)
        return x, np.repeat(np.concatenate([np.frombuffer(r["own"], np.uint32).astype(np.int64) + r["base"] for r in held]), n) if number else None

    for b in batches:
        for r in b.to_pylist():
            held.append(r)
            total += r["kmers"]
            if total >= AT_ONCE:
                yield block()
                held, total = [], 0
    if held:
        yield block()


def _bucketed(reads: DataFrame, k: int) -> tuple[DataFrame, dict]:
    """Super-k-mers of reads (seq), equal k-mers in one partition, and how many k-mers and edges there are."""
    _check(k)
    kept = cut(super_kmers(reads, k), kmers=F.sum("kmers"), edges=F.sum("edges"))
    parts = min(max(-(-(kept.marks["kmers"] or 0) // (2 * AT_ONCE)), 1), BUCKETS)
    return kept.repartition(parts, "bucket").select("base", "own", "n", "letters", "kmers"), kept.marks


def _distinct(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(n): how many k-mers the rows of a partition have."""
    seen = np.zeros(0, np.int64)
    for x, _ in _read_back(batches, k, False):
        seen = np.concatenate([seen, x])
        seen.sort()
        seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])]
    yield pa.RecordBatch.from_arrays([pa.array([len(seen)], pa.int64())], ["n"])


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(a, b, n) of a partition's rows: links a - b of stretches with n = 0; then of stretches a, to each of which go n k-mers, the
    least b of these."""
    seen = least = np.zeros(0, np.int64)
    out = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "n"])
    for x, own in _read_back(batches, k, True):
        x, own = np.concatenate([seen, x]), np.concatenate([least, own])
        order = np.argsort(x)
        x, own = x[order], own[order]
        first = np.concatenate([[True], x[1:] != x[:-1]])
        at = np.flatnonzero(first)
        seen, least = x[at], np.minimum.reduceat(own, at)
        low = least[np.cumsum(first) - 1]
        apart = low != own
        a, b = forest(own[apart], low[apart])
        yield out(a, b, np.zeros(len(a), np.int64))
    names, at, n = np.unique(least, return_index=True, return_counts=True)
    yield out(names, seen[at], n)


def counts(reads: DataFrame, k: int = 31) -> DataFrame:
    """One row (n_edges, n_vertices) of what edges(reads, k) has: its rows, and distinct vertices."""
    rows, marks = _bucketed(reads, k)
    per = rows.mapInArrow(lambda batches: _distinct(batches, k), "n long")
    return per.agg(F.lit(2 * (marks["edges"] or 0)).cast("long").alias("n_edges"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_vertices"))


def component_sizes(reads: DataFrame, k: int = 31) -> DataFrame:
    """(component, n): the least vertex and the number of vertices of each component of edges(reads, k).

    A stretch of a read without other letters is connected, so that stretches are joined where they share a k-mer: in each
    partition a k-mer goes to the least of its stretches, which the others are linked to. What is joined then are these links
    between stretches, one spanning forest for each AT_ONCE k-mers; k-mers are counted where they are.
    """
    rows, _ = _bucketed(reads, k)
    met = cut(rows.mapInArrow(lambda batches: _met(batches, k), "a long, b long, n long"))
    joined = sequential_components(met.where("n = 0").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    per = met.where("n > 0").groupBy(F.col("a").alias("own")).agg(F.min("b").alias("least"), F.sum("n").alias("n"))
    of = per.join(joined, F.col("own") == F.col("vertex"), "left")
    return of.groupBy(F.coalesce("component", "own").alias("root")).agg(F.min("least").alias("component"), F.sum("n").alias("n")).select("component", "n")
