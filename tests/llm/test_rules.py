import re
from collections import Counter

from meshwork.llm import rules

TEXTS = [None, "", " ", " a ", "a b c a b c", "a a a", "a a a a", "x\n \nx\n\ty\r\n", "a b \x0b\x0c c d", "# $ | <x>", "A B C d", "é ñ Ü", "w " * 20_000, "l\n" * 300, " ".join(f"w{i}" for i in range(60)), "a b", "a b c\nd e f\na b c"]


def brute(x):
    x = x or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", x)
    c = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {k for i in range(len(ws) - 2) if c[tuple(ws[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [y for y in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", x)), len(lines), len(lines) - len(set(lines)), len(covered), sum(ch.isalpha() for ch in x), sum(ch.isupper() for ch in x)


def frame(spark):
    rows = [*enumerate(TEXTS), (None, "null id"), (4, TEXTS[4])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_measures_and_bits(spark):
    for r in rules.ledger(frame(spark)).join(frame(spark), "doc_id").collect():
        got = tuple(r[m] for m in rules.MEASURES)
        assert got == brute(r.text), r.text
        env = dict(zip(rules.MEASURES, got, strict=True))
        want = sum(1 << b for b, (_, cond) in enumerate(rules.RULES) if eval(cond, {}, env))
        assert r.failed == want


def test_documents_sample(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = rules.ledger(df).join(df.select("doc_id", "text"), "doc_id").collect()
    assert rows and all(tuple(r[m] for m in rules.MEASURES)[:6] == brute(r.text)[:6] for r in rows)


def test_policies_and_ablation(spark):
    led = rules.ledger(frame(spark)).cache()
    masks = [r.failed for r in led.collect()]
    for version, names in rules.POLICIES.items():
        full = rules.mask_of(names)
        out = {r.rule: (r.n_failed, r.n_alone) for r in rules.ablation(led, version).collect()}
        assert out == {n: (sum(bool(m >> rules.BITS[n] & 1) for m in masks), sum(m & full == 1 << rules.BITS[n] for m in masks)) for n in names}
        kept = led.where(rules.verdict(led["failed"], version)).count()
        assert kept == sum(m & full == 0 for m in masks)


def test_empty_and_clashing_columns(spark):
    assert rules.ledger(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = frame(spark).selectExpr("*", "1 as n_words", "'x' as failed", "2 as n_lines")
    assert rules.ledger(df).count() == df.count()
    assert rules.kept_documents(df).columns == df.columns
    assert {r.doc_id for r in rules.kept_documents(df).collect()} == {r.doc_id for r in rules.ledger(frame(spark)).where("failed = 0").collect()}
