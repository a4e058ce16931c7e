"""SimHash near-duplicates: Golay-code keys of fingerprint segments, joined and verified.

A 64-bit fingerprint is cut into A (23 bits), B (23) and C (18); A1, A2, B1, B2, C1, C2 are their halves and
g() is a Golay key, which two segments at most 2 bits apart share. Let a, b, c be the differing bits of two
fingerprints in A, B, C, at most 4 together. Each case has a key on which both agree:

* a, b <= 2 and c <= 1: one half of C is equal: (gA, gB, C1) or (gA, gB, C2);
* c >= 2, hence a + b <= 2: (A, gB) if a = 0, (gA, B) if b = 0, and (Ai, Bj, gC) for some i, j if a = b = 1;
* a >= 3, hence b + c <= 1: (B, gC) or (gB, C);
* b >= 3, hence a + c <= 1: (A, gC) or (gA, C).

A fingerprint has about 110 keys of 30 to 35 bits, so that unrelated ones seldom meet. The cases are taken in ROUNDS,
those of few keys first: near copies mostly meet there, and the many keys of the later ones matter only where they
hold fingerprints of different components. In a round

1. a partial aggregate finds the keys that hold several components, and the smallest fingerprint of each (its hub);
2. all other members are compared with their hub, a number of pairs that is linear in the group; what is near is merged.
   A sieve of fixed size, a bit for each place of a hashed key, keeps most keys without a hub out of that join's shuffle;
3. keys whose other members are still in several components are torn. Of these only members outside the component
   that has most of the key are taken, and compared with the members of other components: where they are FEW with all of
   these, else with those with which they agree in one of five parts of the fingerprint, as two at most 4 bits apart must.
   An outlier in a group of n near copies costs n comparisons at most; two members of the largest component never meet.

No bucket is capped and no link between components is lost.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like
any other; equal fingerprints share a component; a null doc_id is never a component's id unless all are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm import golay
from meshwork.operators.components import contract_components
from meshwork.session import cut, cut_counted

SEED, SHINGLE, DISTANCE = 42, 4, 4
BLOCK = 1 << 15
#: Fingerprints whose keys one task makes.
PER_TASK = 20_000
#: A sieve of keys has 2^25 bits, four megabytes.
SIEVE_BITS = 25
#: Members of a torn key outside its main component up to which all others are compared with them: as many as a fingerprint has
#: parts, so that no member takes part in more comparisons than it would have rows by parts.
FEW = 5
#: The key cases in the order in which they are taken, those of few keys first.
ROUNDS = ((3, 4, 9, 10, 11, 12), (1, 2, 5, 6, 7, 8))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text in UTF-8. A-Z fold; bytes.split() splits at exactly the six blanks."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        cuts = [line[a:b] for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(seed)), np.uint64, len(cuts))
        votes += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and the long columns also): fp holds the 64 bits as a signed long. One pass, no shuffle, a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *also])

    schema = ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in also)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *also).mapInArrow(run, schema)


def key_rows(fp: np.ndarray, cases: tuple[int, ...] = tuple(range(1, 13))) -> tuple[np.ndarray, np.ndarray]:
    """(key, row number) of the cases' keys of signed fingerprints; the case is in a key's top bits."""
    u = fp.view(np.uint64)
    a, b, c = (u & 0x7FFFFF).astype(np.int64), (u >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64), (u >> np.uint64(46)).astype(np.int64)
    (ka, na), (kb, nb), (kc, nc) = golay.keys(a), golay.keys(b), golay.keys(c)
    six = np.arange(6)
    ua, ub, uc = (six < n[:, None] for n in (na, nb, nc))
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(case: int, key: np.ndarray, use: np.ndarray) -> None:
        rows = np.broadcast_to(np.arange(len(fp)).reshape(-1, *[1] * (use.ndim - 1)), use.shape)[use]
        parts.append((np.broadcast_to(key, use.shape)[use] | case << 48, rows))

    if 1 in cases or 2 in cases:
        pair, both = ka[:, :, None] << 12 | kb[:, None, :], ua[:, :, None] & ub[:, None, :]
    halves = ((a & 0xFFF, b & 0xFFF), (a & 0xFFF, b >> 12), (a >> 12, b & 0xFFF), (a >> 12, b >> 12))
    for case in cases:
        match case:
            case 1:
                add(1, pair << 9 | (c & 0x1FF)[:, None, None], both)
            case 2:
                add(2, pair << 9 | (c >> 9)[:, None, None], both)
            case 3:
                add(3, a[:, None] << 12 | kb, ub)
            case 4:
                add(4, ka << 23 | b[:, None], ua)
            case 5 | 6 | 7 | 8:
                x, y = halves[case - 5]
                add(case, (x << 12 | y)[:, None] << 12 | kc, uc)
            case 9:
                add(9, b[:, None] << 12 | kc, uc)
            case 10:
                add(10, kb << 18 | c[:, None], ub)
            case 11:
                add(11, a[:, None] << 12 | kc, uc)
            case 12:
                add(12, ka << 18 | c[:, None], ua)
    return np.concatenate([k for k, _ in parts]), np.concatenate([r for _, r in parts])


def _place(key: np.ndarray, bits: int) -> np.ndarray:
    """Where a key stands in a sieve of 2^bits places."""
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _sieve(keys: DataFrame, log: int) -> np.ndarray:
    """A bit for each place that a key of (key) has: 2^log of them, whatever the number of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << log, bool)
        for b in batches:
            bits[_place(b.column(0).to_numpy(zero_copy_only=False), log)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bits"])

    out = np.zeros(1 << log - 3, np.uint8)
    for r in keys.coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r.bits, np.uint8)
    return out


def _keys(nodes: DataFrame, cases: tuple[int, ...], sieve: Broadcast | None = None) -> DataFrame:
    """(key, fp, comp) for nodes (fp, comp); a comp that is fp itself is null, for the shuffle's sake. With a sieve, keys that
    it doesn't hold stay out; some that it shouldn't hold come through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, comps = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(fps), 1000):
                part, comp = fps[at : at + 1000], comps[at : at + 1000]
                key, row = key_rows(part, cases)
                if sieve is not None:
                    place = _place(key, (8 * len(sieve.value)).bit_length() - 1)
                    held = sieve.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                    key, row = key[held], row[held]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(comp[row], mask=(comp == part)[row])], ["key", "fp", "comp"])

    # a fingerprint makes up to 2,500 bytes of keys: what one task reads is set by their number, not by the files' size
    return nodes.select("fp", "comp").repartition(max(-(-nodes.marks["n"] // PER_TASK), 1), "fp").mapInArrow(run, "key long, fp long, comp long")


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def met(nodes: DataFrame, cases: tuple[int, ...], distance: int) -> DataFrame:
    """(key, fp, comp, hub_comp, near): members of keys that hold several components, all but the hub; near: the hub is.

    Of keys with two members only those that are near and of different components: with the hub compared they are done.
    """
    own = F.coalesce("comp", "fp")
    per = _keys(nodes, cases).groupBy("key").agg(F.min("fp").alias("hub"), F.min_by(own, F.col("fp")).alias("hub_comp"), F.min(own).alias("lo"), F.max(own).alias("hi"), F.count(F.lit(1)).alias("n"))
    hubs, n = cut_counted(per.where("lo <> hi").select("key", "hub", "hub_comp", (F.col("n") > 2).alias("more")))
    # what meets no hub needn't be shuffled to find that out; beyond as many hubs as the sieve has places it would hold everything
    sieve = nodes.sparkSession.sparkContext.broadcast(_sieve(hubs.select("key"), SIEVE_BITS)) if n < 1 << SIEVE_BITS else None
    links = _near("fp", "hub", distance) & (own != F.col("hub_comp"))
    rows = _keys(nodes, cases, sieve).join(hubs.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("fp") != F.col("hub")) & (F.col("more") | links))
    return rows.select("key", "fp", own.alias("comp"), "hub_comp", links.alias("near"), "more")


def _parts(fp: Column, of: int = 5) -> Column:
    """The bits of a fingerprint dealt to so many parts, each with its number: two at most 4 bits apart agree in one of 5."""
    masks = [sum(1 << bit for bit in range(k, 64, of)) for k in range(of)]
    return F.array(*(F.struct(F.lit(k).alias("part"), fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("bits")) for k, m in enumerate(masks)))


def torn_pairs(rows: DataFrame) -> DataFrame:
    """(fp, comp, fp2, comp2): what is left to compare of rows (key, fp, comp): pairs of different components in one key, at least
    one of the two outside the component that has most members in the key. In keys with at most FEW members outside it that is
    all of them, which are FEW to a member at most; in others those that agree in one part of the fingerprint."""
    per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"), (F.sum("n") - F.max("n")).alias("out"), F.count(F.lit(1)).alias("c")).where("c > 1")
    torn = cut(per.select(F.col("key").alias("k"), "most", (F.col("out") <= FEW).alias("few")), many=F.count_if(~F.col("few")))

    def pairs(held: DataFrame, at: list[str]) -> DataFrame:
        a = held.where("comp <> most").select(*at, "fp", "comp")
        b = held.select(*at, F.col("fp").alias("fp2"), F.col("comp").alias("comp2"), (F.col("comp") == F.col("most")).alias("main"))
        return a.join(b, at).where("main or comp < comp2").select("fp", "comp", "fp2", "comp2")

    held = rows.join(torn, F.col("key") == F.col("k"))
    out = pairs(held.where("few"), ["key"])
    if torn.marks["many"]:
        dealt = held.where("not few").select("key", "fp", "comp", "most", F.explode(_parts(F.col("fp"))).alias("p")).select("key", "fp", "comp", "most", "p.part", "p.bits")
        out = out.unionAll(pairs(dealt, ["key", "part", "bits"]))
    return out


def _merge(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (fp, comp) with comp replaced by the smallest comp that the links (src, dst) reach."""
    links = cut(links.distinct(), n=F.count(F.lit(1)))
    if not links.marks["n"]:
        return nodes
    to = contract_components(links).where("vertex <> component")
    return cut(nodes.join(to, nodes.comp == to.vertex, "left").select("fp", F.coalesce("component", "comp").alias("comp")), n=F.count(F.lit(1)))


def components(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, comp) for the distinct fingerprints of (doc_id, fp): comp names the component, itself a fingerprint."""
    if not 0 <= distance <= 4:
        raise ValueError("the key cases cover distances up to 4")
    nodes = cut(fps.select("fp", F.col("fp").alias("comp")).distinct(), n=F.count(F.lit(1)))
    for cases in ROUNDS:
        rows = cut(met(nodes, cases, distance), left=F.count_if("more"))
        nodes = _merge(nodes, rows.where("near").select(F.col("comp").alias("src"), F.col("hub_comp").alias("dst")))
        if rows.marks["left"]:
            left = rows.where("more").select("key", "fp").join(nodes.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).select("key", "fp", "comp")
            pairs = torn_pairs(cut(left)).where(_near("fp", "fp2", distance))
            nodes = _merge(nodes, pairs.select(F.col("comp").alias("src"), F.col("comp2").alias("dst")))
    return nodes


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    fps = cut(fingerprints(docs))
    nodes = components(fps, distance)
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    lowest = nodes.join(least, "fp")
    # kept apart from the join, so that the members of a large component may be split over tasks there
    roots = cut(lowest.groupBy("comp").agg(F.min("least").alias("component_id")))
    of = nodes.join(roots, "comp").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: that of least doc_id (null: last), then of least hash over its columns.

    Every row takes part, those without a doc_id too. A row is known by its doc_id and hash; who stays is found among
    these and the fingerprints, and texts move once, to the join with the answer. Rows that agree in both are copies of
    one row, of which one stays: only such rows are grouped, after a partial aggregate.
    """
    names = docs.columns
    plain = [f.name for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    stamped = docs.withColumns({"__mw_id": F.col("doc_id").cast("long"), "__mw_h": F.xxhash64(*(F.col(f"`{c}`") for c in plain))})
    seen = cut(fingerprints(stamped, also=("__mw_h",)))
    nodes = components(seen, distance)
    row = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("__mw_h").alias("h"), F.col("m").alias("m"))
    # by fingerprint first, then by component: both minima combine before they are shuffled
    least = seen.groupBy("doc_id", "fp", "__mw_h").agg(F.count(F.lit(1)).alias("m")).groupBy("fp").agg(F.min(row).alias("row"))
    stay = nodes.withColumnRenamed("fp", "node").join(least, F.col("node") == F.col("fp")).groupBy("comp").agg(F.min("row").alias("row"))
    stay = cut(stay.select(F.col("row.id").alias("__mw_stay"), F.col("row.h").alias("__mw_stay_h"), F.col("row.m").alias("__mw_m")), many=F.count_if(F.col("__mw_m") > 1))
    same = F.col("__mw_id").eqNullSafe(F.col("__mw_stay")) & (F.col("__mw_h") == F.col("__mw_stay_h"))
    left = stamped.join(stay.where("__mw_m = 1"), same, "left_semi").select(*names)
    if stay.marks["many"]:
        left = left.unionAll(stamped.join(stay.where("__mw_m > 1"), same, "left_semi").dropDuplicates(["__mw_id", "__mw_h"]).select(*names))
    return left
