"""De Bruijn graphs against brute force over strings."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwork.operators import components, edges, kmers
from meshwork.plans import queries as Q

ONE = str.maketrans("ACGT", "TGCA")


def reads(seed):
    """Reads that share stretches on either strand, with other letters, repeats, a palindrome, short ones and none."""
    rng = random.Random(seed)
    whole = ["".join(rng.choice("ACGT") for _ in range(300)) for _ in range(6)]
    out = [w[i : i + rng.randint(20, 120)] for w in whole for i in range(0, 250, 40)]
    out += [x[::-1].translate(ONE) for x in out[::3]]
    out += [out[0] + "N" + out[9], out[3][:10] + "-é-" + out[5].lower(), "A" * 200, "ACGT" * 30, "ACGTA", "", None, whole[0] + whole[1]]
    return out


def brute(seqs, k):
    pairs = []
    for s in seqs:
        s = (s or "").upper()
        for i in range(len(s) - k):
            w = s[i : i + k + 1]
            if set(w) <= set("ACGT"):
                pairs.append(tuple(int(min(x, x[::-1].translate(ONE)).translate(str.maketrans("ACGT", "0123")), 4) for x in (w[:-1], w[1:])))
    return pairs


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def groups(pairs):
    return Counter(union_find(pairs).values())


@pytest.mark.parametrize(("k", "small"), [(31, False), (31, True), (16, True), (15, False), (5, True), (1, False)])
def test_edges_counts_and_components(spark, monkeypatch, k, small):
    seqs = reads(k)
    df = spark.createDataFrame([(x,) for x in seqs], "seq string").repartition(3)
    pairs = brute(seqs, k)
    if small:  # on the driver: more partitions
        monkeypatch.setattr(kmers, "AT_ONCE", 50)
    got = [tuple(r) for r in kmers.edges(df, k).collect()]
    assert Counter(got) == Counter(pairs) + Counter((b, a) for a, b in pairs)
    assert kmers.counts(df, k).collect() == [(2 * len(pairs), len({x for p in pairs for x in p}))]
    assert {r.component: r.n for r in kmers.component_sizes(df, k).collect()} == groups(pairs)


def test_blocks_of_any_size(spark, monkeypatch):
    """Long reads in pieces, and chunks of few k-mers, hold the same k-mers and join the same stretches."""
    seqs = [x for x in reads(7) if x] * 2
    pairs = brute(seqs, 15)
    batch = [pa.RecordBatch.from_arrays([pa.array([x.encode() for x in seqs], pa.binary())], ["seq"])]
    for size in (1, 20, 33, 10_000):
        found = []
        for codes in kmers._pieces(iter(batch), 15, size):
            x = kmers.canonical(kmers._fit(15, codes & 3, slice(0, len(codes) - 14)), 15)
            both = kmers._clear(codes, 16)
            found += list(zip(x[:-1][both].tolist(), x[1:][both].tolist(), strict=True))
        assert sorted(found) == sorted(pairs)
    rows = kmers.super_kmers(spark.createDataFrame([(x,) for x in seqs], "seq string").repartition(2), 15).select("base", "own", "n", "letters", "kmers").toArrow()
    for chunk in (1, 300, 1 << 21):
        monkeypatch.setattr(kmers, "AT_ONCE", chunk)
        # all buckets as one partition
        assert [b["n"].to_pylist() for b in kmers._distinct(iter(rows.to_batches()), 15)] == [[len({x for p in pairs for x in p})]]
        met = [r for b in kmers._met(iter(rows.to_batches()), 15) for r in b.to_pylist()]
        of = {}
        for r in met:
            if r["n"]:
                of.setdefault(r["a"], []).append((r["b"], r["n"]))
        links = [(r["a"], r["b"]) for r in met if not r["n"]] + [(a, a) for a in of]
        up = union_find(links)
        sizes = Counter()
        for a, found in of.items():
            sizes[up[a]] += sum(n for _, n in found)
        assert sorted(sizes.values()) == sorted(groups(pairs).values())


def test_no_row_for_each_kmer(spark, sf_dir):
    """A k-mer costs about a byte on its way, not the rows of its edges."""
    df = Q._reads(spark, sf_dir)
    rows = kmers.super_kmers(df, 31)
    n, kept, size = rows.agg(F.count(F.lit(1)), F.sum("kmers"), F.sum(F.length("letters") + F.length("own") + F.length("n"))).first()
    assert 0 < n < kept / 20 and size < 2.5 * kept


def test_both_ways_agree_on_documents(spark, sf_dir):
    df = Q._reads(spark, sf_dir).limit(40)
    slow = edges.component_sizes(components.contract_components(kmers.edges(df, 31)))
    assert {tuple(r) for r in kmers.component_sizes(df, 31).collect()} == {tuple(r) for r in slow.collect()}


def test_counts_make_no_row_for_each_kmer(spark, sf_dir):
    """debruijn_counts reads its FASTQ without exploding windows or aggregating k-mers as rows."""
    told = Q.QUERIES["debruijn_counts"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in told and "MapInArrow" in told
