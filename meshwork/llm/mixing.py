"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

A source's target is its share of all words by weight, at most cap times its own size. Its documents have
target / size expected copies each: the whole part is certain, the fractional parts are rounded dependently.
Two documents of sizes s and t with probabilities p and q trade mass so that s*p + t*q stays, until one of
them is 0 or 1; which way the mass goes is random with the odds that keep every expected value. Documents meet
in blocks of about BLOCK, dealt by a hash; a block's fold leaves one undecided document, and the undecided
of BLOCK blocks meet in the next level of a reduction tree, up to one per source. That one is taken with its
probability. What this misses of the target is then traded once more, with a reserve of documents already decided, which
blocks hand up the tree (RESERVE of a block, POOL at the root, the first by a hash that is blind to size): taken ones go where
too many words are taken, others come where too few are. Either happens with the odds of the other's words, so that expected
copies stay as they are where documents share one rate. Only where one of the two ways out misses the target by more than
NEAR of it, the nearer way is taken: a source of few documents, one of which outweighs the rest, comes near its target, and
that document's copies are then not random.

Equal (source, doc_id, size) rows are one unit of m copies: of their expected total the whole part is certain
and one row stays fractional, so that a hot document is a single row here. All randomness is a hash of the ids
and the seed: reruns and lost executors change nothing.

Defined results: null text has size 0 and takes nothing; null sources are one source, the last by order;
a source of size 0 has target 0; an empty table gives an empty result; null doc_ids are one unit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwork.llm.text import word_count
from meshwork.session import cut

WEIGHTS, CAP, BLOCK, SEED = (1, 2, 3), 3, 128, 42
RESERVE, POOL, NEAR = 256, 1024, 0.02
#: Probabilities nearer than this to 0 or 1 are there: what is left of sums of doubles.
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of (source, source_size), a row per source.

    Resharing ends where target = min(cap * size, level * weight) for one level. With the k sources of least
    cap * size / weight capped, the others would need level (total - their caps) / (weights left); the targets'
    sum is concave in the level, so the true level is the largest of these.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    rows = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double").alias("w"))
    everything = W.partitionBy(F.lit(0))
    rows = rows.select("*", F.sum("source_size").over(everything).cast("double").alias("total"), F.sum("w").over(everything).alias("all_w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    before = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def _hash(*of) -> Column:
    return F.xxhash64(F.lit(SEED), *of)


def _uniform(*of) -> Column:
    """In [0, 1), from a hash."""
    return F.pmod(_hash(*of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _fold(units: Column) -> Column:
    """One pass over a block: struct(done: units decided, left: the one that is not, or null)."""

    def snap(p: Column) -> Column:
        return F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)

    def unit(u: Column, p: Column) -> Column:
        return F.struct(u["key"].alias("key"), u["size"].alias("size"), p.alias("p"))

    def pair(acc: Column, u: Column) -> Column:
        c = acc["left"]
        # mass in words that may go from u to c, and from c to u
        up = F.least((1 - c["p"]) * c["size"], u["p"] * u["size"])
        down = F.least(c["p"] * c["size"], (1 - u["p"]) * u["size"])
        to_c = _uniform(c["key"], u["key"]) * (up + down) < down
        move = F.when(to_c, up).otherwise(-down)
        pc, pu = snap(c["p"] + move / c["size"]), snap(u["p"] - move / u["size"])
        a, b = unit(c, pc), unit(u, pu)
        whole = lambda p: (p == 0.0) | (p == 1.0)
        one = F.struct(F.concat(acc["done"], F.array(F.when(whole(pc), a).otherwise(b))).alias("done"), F.when(whole(pc), b).otherwise(a).alias("left"))
        first = F.struct(acc["done"].alias("done"), unit(u, u["p"]).alias("left"))
        settled = F.struct(F.concat(acc["done"], F.array(unit(c, c["p"]))).alias("done"), unit(u, u["p"]).alias("left"))
        return F.when(c.isNull(), first).when(whole(c["p"]), settled).otherwise(one)

    kind = "struct<key:bigint,size:bigint,p:double>"
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("left"))
    return F.aggregate(units, zero, pair)


UNITS = "array<struct<key:bigint,size:bigint,p:double>>"


def _by_hash(units: Column) -> Column:
    """Units in the order of a hash, blind to size."""
    placed = F.array_sort(F.transform(units, lambda u: F.struct(_hash(F.lit("turn"), u["key"]).alias("at"), u["key"].alias("key"), u["size"].alias("size"), u["p"].alias("p"))))
    return F.transform(placed, lambda u: F.struct(u["key"].alias("key"), u["size"].alias("size"), u["p"].alias("p")))


def _turned(pool: Column, miss: Column) -> Column:
    """struct(miss, out): the pool with units turned over in order wherever that lessens the words missed."""

    def turn(acc: Column, u: Column) -> Column:
        after = acc["miss"] + F.when(u["p"] > 0.5, -u["size"]).otherwise(u["size"])
        better = F.abs(after) < F.abs(acc["miss"])
        new = F.struct(u["key"].alias("key"), u["size"].alias("size"), F.when(better, 1 - u["p"]).otherwise(u["p"]).alias("p"))
        return F.struct(F.when(better, after).otherwise(acc["miss"]).alias("miss"), F.concat(acc["out"], F.array(new)).alias("out"))

    return F.aggregate(pool, F.struct(miss.cast("double").alias("miss"), F.array().cast(UNITS).alias("out")), turn)


def _rooted(rows: DataFrame) -> DataFrame:
    """(source, units): all decided units of rows (source, target, pool, left) at the roots of their trees."""
    last = lambda p: F.array(F.struct(F.col("left.key").alias("key"), F.col("left.size").alias("size"), F.lit(p).alias("p")))
    ways = rows.where("left is not null").select(
        "source", "target", "left", F.slice("pool", POOL + 1, F.greatest(F.size("pool") - POOL, F.lit(1))).alias("rest"),
        _turned(F.slice("pool", 1, POOL), F.col("left.size") * (1 - F.col("left.p"))).alias("up"), _turned(F.slice("pool", 1, POOL), -F.col("left.size") * F.col("left.p")).alias("down"),
    )
    near = F.greatest(F.abs(F.col("up.miss")), F.abs(F.col("down.miss"))) <= NEAR * F.col("target")
    taken = F.when(near, _uniform(F.lit("root"), F.col("left.key")) < F.col("left.p")).otherwise(F.abs(F.col("up.miss")) < F.abs(F.col("down.miss")))
    out = ways.select("source", F.concat("rest", F.when(taken, F.concat(F.col("up.out"), last(1.0))).otherwise(F.concat(F.col("down.out"), last(0.0)))).alias("units"))
    return out.unionAll(rows.where("left is null").select("source", F.col("pool").alias("units")))


def units(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, doc_id, size, m, source_size, target, copies): copies is the total for the m equal rows of a unit."""
    unit = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"))
    unit = cut(unit)
    aims = targets(unit.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, cap)
    per_source = unit.groupBy(F.col("source").alias("src")).agg(F.count(F.lit(1)).alias("n_units"))
    aims = cut(aims.join(per_source, F.col("source").eqNullSafe(F.col("src"))).drop("src"))
    aims2 = aims.withColumnRenamed("source", "src")
    rate = F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))
    unit = unit.join(aims2, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    mean = F.when(F.col("size") > 0, F.col("m") * rate).otherwise(F.lit(0.0))
    unit = unit.withColumn("mean", mean).withColumn("sure", F.floor(F.col("mean") + EPS))
    unit = unit.withColumn("p", F.greatest(F.col("mean") - F.col("sure"), F.lit(0.0)))
    unit = unit.withColumn("key", _hash("source", "doc_id", "size"))
    unit = cut(unit)
    most = aims.agg(F.max("n_units")).first()[0] or 0
    open_ = unit.where(F.col("p") >= EPS).select("source", "target", "key", "size", "p", F.array().cast(UNITS).alias("reserve"), F.ceil(F.col("n_units") / BLOCK).alias("blocks"))
    decided: list[DataFrame] = []
    level = 0
    while True:
        block = F.pmod(_hash(F.lit(level), "key"), F.col("blocks"))
        folded = open_.groupBy("source", "target", "blocks", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("by"), "key", "size", "p", "reserve"))).alias("units"))
        folded = folded.select("source", "target", "blocks", _fold(F.transform("units", lambda u: F.struct(u["key"].alias("key"), u["size"].alias("size"), u["p"].alias("p")))).alias("f"), F.flatten(F.transform("units", lambda u: u["reserve"])).alias("reserve"))
        folded = cut(folded.select("source", "target", "blocks", F.col("f.left").alias("left"), _by_hash(F.concat("f.done", "reserve")).alias("pool")))
        # a source is at its root where one block holds it, whatever the size of others
        decided.append(_rooted(folded.where("blocks = 1")).select("source", F.explode("units").alias("d")).select("source", "d.key", "d.p"))
        inner = folded.where("blocks > 1")
        held = F.when(F.col("left").isNull(), F.col("pool")).otherwise(F.slice("pool", RESERVE + 1, F.greatest(F.size("pool") - RESERVE, F.lit(1))))
        decided.append(inner.select("source", F.explode(held).alias("d")).select("source", "d.key", "d.p"))
        if most <= BLOCK:
            break
        open_ = inner.where("left is not null").select("source", "target", "left.*", F.slice("pool", 1, RESERVE).alias("reserve"), F.ceil(F.col("blocks") / BLOCK).alias("blocks"))
        most = -(-most // BLOCK)
        level += 1
    up = decided[0]
    for d in decided[1:]:
        up = up.union(d)
    up = up.where("p > 0.5").select(F.col("source").alias("src"), F.col("key").alias("k"))
    joined = unit.join(up, F.col("source").eqNullSafe(F.col("src")) & (F.col("key") == F.col("k")), "left")
    return joined.select("source", "doc_id", "size", "m", "source_size", "target", (F.col("sure") + F.when(F.col("k").isNotNull(), 1).otherwise(0)).cast("long").alias("copies"))


def _per_row(i: Column) -> Column:
    """Copies of the i-th (from 0) of the m equal rows of a unit."""
    return F.expr("copies div m") + F.when(i < F.col("copies") % F.col("m"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs (doc_id, text, source)."""
    u = units(docs.select("source", "doc_id", word_count(F.col("text")).alias("size")), weights, cap)
    rows = u.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
    copies = _per_row(F.col("i")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs with each row repeated as often as the mix takes it.

    A row is known by source, doc_id, size and a hash of its text. The copies of a unit of several rows are dealt to its
    hashes by keys alone, so that texts move once, to the join with the answer; rows that agree in all four share
    their copies, and one of them is repeated for all.
    """
    names = docs.columns
    sized = docs.withColumns({"__mw_size": word_count(F.col("text")), "__mw_h": F.xxhash64("text")})
    u = units(sized.select("source", "doc_id", F.col("__mw_size").alias("size")), weights, cap).where("copies > 0")
    of = ["source", "doc_id", "size"]
    texts = sized.groupBy("source", "doc_id", F.col("__mw_size").alias("size"), F.col("__mw_h").alias("h")).agg(F.count(F.lit(1)).alias("k"))
    same_unit = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in of))
    own = texts.join(u.select(*(F.col(c).alias(f"u_{c}") for c in of), "m", "copies"), same_unit).select(*of, "h", "k", "m", "copies")
    # a unit's rows are numbered through its texts: those of one text have the numbers from `before` on
    before = F.coalesce(F.sum("k").over(W.partitionBy(*of).orderBy("h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = F.greatest(F.least(F.col("copies") % F.col("m") - F.col("before"), F.col("k")), F.lit(0))
    dealt = own.withColumn("before", before).withColumn("__mw_copies", F.expr("copies div m") * F.col("k") + first).where("__mw_copies > 0")
    dealt = cut(dealt.select(F.col("source").alias("__mw_source"), F.col("doc_id").alias("__mw_doc"), F.col("size").alias("__mw_usize"), F.col("h").alias("__mw_uh"), F.col("k").alias("__mw_k"), "__mw_copies"), many=F.count_if(F.col("__mw_k") > 1))
    same = F.col("source").eqNullSafe(F.col("__mw_source")) & F.col("doc_id").eqNullSafe(F.col("__mw_doc")) & (F.col("__mw_size") == F.col("__mw_usize")) & (F.col("__mw_h") == F.col("__mw_uh"))
    rows = sized.join(dealt.where("__mw_k = 1"), same).select(*names, F.col("__mw_copies").alias("__mw_n"))
    if dealt.marks["many"]:
        several = sized.join(dealt.where("__mw_k > 1"), same)
        # equal rows, one of which stands for all: it is repeated as often as all of them are taken
        one = several.dropDuplicates(["__mw_source", "__mw_doc", "__mw_usize", "__mw_uh"])
        rows = rows.unionAll(one.select(*names, F.col("__mw_copies").alias("__mw_n")))
    return rows.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mw_n")))).select(*names)
