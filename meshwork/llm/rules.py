"""Quality rules as a bitmask ledger: measure once, store failure bits, apply versioned policies, ablate.

ledger() evaluates every rule once per document and stores its measurements and one long whose bit r says
that rule r failed. A policy is a mask of the rules that reject, under a version; its verdict is one
bitwise AND, so that a new policy, or one without some rule, never reads a text again.

Defined results: a null or empty text has no words and measures zero everywhere; ratios of nothing are zero;
a null doc_id is kept as it is; repeated rows are measured each by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.llm.text import settled, word_array

#: Name and failing condition of each rule over the measurements; the position is the rule's bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "10 * word_chars < 25 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    ("shouting", "100 * n_upper > 60 * n_letters"),
)
BITS: dict[str, int] = {name: bit for bit, (name, _) in enumerate(RULES)}
#: Version of a policy: the rules that reject. Version 1 is the base of the contract.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_windows"),
    2: tuple(name for name, _ in RULES),
}
CURRENT = 2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")


def mask_of(names: tuple[str, ...]) -> int:
    return sum(1 << BITS[n] for n in names)


def _let(value: Column, body) -> Column:
    """body(value), the value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(windows: Column) -> Column:
    """Words inside 3-word windows found twice or more, of the hashes of all windows in order.

    A text whose windows all differ is done by one hash set. Else hashes are sorted with their positions; equal
    neighbours mark positions, and each marked position, in order, covers min(3, gap to the one before) words.
    """
    same = lambda x, r, k: F.coalesce(x["h"] == F.get(r, k)["h"], F.lit(False))
    twins = lambda r: F.filter(r, lambda x, k: same(x, r, k - 1) | same(x, r, k + 1))
    ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    marked = F.sort_array(F.transform(_let(ranked, twins), lambda x: x["i"]))
    step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(i - acc["at"], F.lit(3))).alias("n"))
    covered = F.aggregate(marked, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered).cast("long")


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns keep of docs, and MEASURES of text under prefix."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    p = lambda n: f"{prefix}{n}"
    own = docs.select(*keep, text.alias("__mw_text"))
    lines = F.filter(F.split("__mw_text", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    own = own.withColumns({"__mw_words": word_array(F.col("__mw_text")), "__mw_lines": lines})
    letters = F.regexp_replace("__mw_text", r"[^\p{L}]+", "")
    own = own.withColumns({"__mw_hash": F.transform("__mw_words", lambda w: F.xxhash64(w)), "__mw_letters": letters})
    n = F.size("__mw_words")
    h = F.col("__mw_hash")
    rest = lambda k: F.slice(h, k, F.greatest(n - 2, F.lit(0)))
    pairs = F.zip_with(rest(1), rest(2), lambda a, b: F.xxhash64(a, b))
    own = own.withColumn("__mw_windows", F.zip_with(pairs, rest(3), lambda ab, c: F.xxhash64(ab, c)))
    return own.select(
        *keep,
        n.cast("long").alias(p("n_words")),
        F.length(F.translate("__mw_text", " \t\n\x0b\x0c\r", "")).cast("long").alias(p("word_chars")),
        (F.length("__mw_text") - F.length(F.translate("__mw_text", "#*$%&|<>", ""))).cast("long").alias(p("n_symbols")),
        F.size("__mw_lines").cast("long").alias(p("n_lines")),
        (F.size("__mw_lines") - F.size(F.array_distinct("__mw_lines"))).cast("long").alias(p("n_dup_lines")),
        _repeat_words(F.col("__mw_windows")).alias(p("n_repeat_words")),
        F.length("__mw_letters").cast("long").alias(p("n_letters")),
        F.length(F.regexp_replace("__mw_letters", r"[^\p{Lu}]+", "")).cast("long").alias(p("n_upper")),
    )


def failures(prefix: str = "") -> Column:
    """The mask of failed rules, from MEASURES under prefix."""
    bits = []
    for bit, (_, failed) in enumerate(RULES):
        for name in sorted(MEASURES, key=len, reverse=True):
            failed = failed.replace(name, f"{prefix}{name}") if prefix else failed
        bits.append(F.when(F.expr(failed), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, MEASURES, failed): every rule evaluated once per row; no shuffle."""
    return measured(docs).withColumn("failed", failures())


def verdict(failed: Column, version: int = CURRENT) -> Column:
    """True if a policy keeps a document."""
    return failed.bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0


def kept_documents(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """docs without the documents that a policy rejects; no shuffle."""
    rows = measured(docs, tuple(docs.columns), "__mw_m_")
    rows = rows.withColumn("__mw_failed", settled(failures("__mw_m_")))
    return rows.where(verdict(F.col("__mw_failed"), version)).select(*docs.columns)


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, n_failed, n_alone): documents that fail a rule of a policy, and that it alone rejects.

    The ledger first shrinks to one row per mask (2^rules at most), by partial aggregation.
    """
    mask = mask_of(POLICIES[version])
    by = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in POLICIES[version])))
    each = by.select("hit", "n", rules.alias("r")).select("hit", "n", "r.*")
    has, alone = F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("hit") == F.col("bit")
    return each.groupBy("rule").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_alone"))
