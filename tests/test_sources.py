import struct

import pytest
from pyspark.sql import functions as F

from meshwork.operators import matrix as M
from meshwork.sources import generators, readers, sinks


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_reader_of_a_directed_chain(spark, tmp_path):
    (tmp_path / "chain.txt").write_text("% a\n% b\n" + "".join(f"{i} {i + 1}\n" for i in range(1, 1201)))
    got = pairs(readers.read_edge_list(spark, str(tmp_path / "chain.txt")))
    assert len(got) == 2400
    forward = [e for e in got if e[0] < e[1]]
    assert forward == [(i, i + 1) for i in range(1, 1201)] and sorted(e[::-1] for e in got) == got


def test_reader_edge_cases(spark, tmp_path):
    f = tmp_path / "e.txt"
    f.write_bytes(b"% c\n\n1 2\r\n2\t3\n3  4\n4 5 0.5\n5 5\n1 2\n-6 7\nx y\n99999999999999999999 1\n8 9")
    strict = pairs(readers.read_edge_list(spark, str(f), add_reverse=False))
    assert strict == [(-6, 7), (1, 2), (1, 2), (5, 5), (8, 9)]
    lenient = pairs(readers.read_edge_list(spark, str(f), add_reverse=False, strict=False))
    assert lenient == [(-6, 7), (1, 2), (1, 2), (2, 3), (3, 4), (4, 5), (5, 5), (8, 9)]


def test_matrix_market(spark, tmp_path):
    f = tmp_path / "m.mtx"
    f.write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n3 3 4\n1 1 2.5\n2 1 1\n3 3 4\n3 3 4\n")
    a, m, n = readers.read_matrix_market(spark, str(f))
    assert (m, n) == (3, 3) and pairs(a) == [(0, 0, 2.5), (0, 1, 1.0), (1, 0, 1.0), (2, 2, 8.0)]
    f.write_text("%%MatrixMarket matrix coordinate pattern general\n2 3 2\n1 3\n2 1\n")
    assert pairs(readers.read_matrix_market(spark, str(f))[0]) == [(0, 2, 1), (1, 0, 1)]


def test_triples(spark, tmp_path):
    f = tmp_path / "t.txt"
    f.write_text("3\t3\t3\n1 2 7\n3 3 3\n2\t1  0.5\n")
    # the header's own line is no entry, an entry equal to it is one
    assert pairs(readers.read_triples(spark, str(f))[0]) == [(0, 1, 7.0), (1, 0, 0.5), (2, 2, 3.0)]
    twice = readers.read_triples(spark, str(f), parse=lambda x: F.get(x, F.lit(0)).cast("double") * 2)[0]
    assert (0, 1, 14.0) in pairs(twice)
    assert (1, 0, 7.0) in pairs(readers.read_triples(spark, str(f), transpose=True)[0])


def test_binary_matrix_is_checked(spark, tmp_path):
    a = M.from_edges(generators.chain(spark, 300))
    path = str(tmp_path / "a.bin")
    sinks.write_binary_matrix(a, path, 300, 300)
    b, m, n = readers.read_binary_matrix(spark, path)
    assert (m, n) == (300, 300) and pairs(b) == [(r, c, float(v)) for r, c, v in pairs(a)]
    (tmp_path / "bad").write_bytes(b"XXXX" + bytes(48))
    with pytest.raises(ValueError):
        readers.read_binary_matrix(spark, str(tmp_path / "bad"))


def test_binary_edges(spark, tmp_path):
    (tmp_path / "e32").write_bytes(struct.pack("<6I", 1, 2, 3, 4, 4_000_000_000, 6))
    assert pairs(readers.read_binary_edges(spark, str(tmp_path / "e32"), 32)) == [(1, 2), (3, 4), (4_000_000_000, 6)]
    sinks.write_binary(generators.chain(spark, 500), str(tmp_path / "out"))
    assert pairs(readers.read_binary_edges(spark, str(tmp_path / "out"))) == [(i, i + 1) for i in range(499)]


def test_attributed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("9 9 2\n1 2 1 3 2010-05-01 10:20:30\n2 3 0 0\n")
    a, b = readers.read_attributed_edges(spark, str(tmp_path / "a.txt")).collect()
    assert (a.src, a.dst, a.follower, a["count"], str(a.latest)) == (0, 1, True, 3, "2010-05-01 10:20:30") and b.latest is None
    (tmp_path / "a.bin").write_bytes(struct.pack("<qqqhB", 4, 5, 0, 1, 1) + struct.pack("<qqqhB", 6, 7, 9, 0, 0))
    rows = readers.read_attributed_binary(spark, str(tmp_path / "a.bin")).collect()
    assert [(r.src, r.dst, r.follower, r.latest is None) for r in rows] == [(4, 5, True, False), (6, 7, False, True)]


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r1\nACGTA\n+\n@IIII\n@r2\nACNGT\n+\nIIIII\n@r3\nACGTA\n+\nIIIII")
    got = pairs(readers.read_fastq_debruijn(spark, str(tmp_path / "r.fq"), 4))
    code = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    a, b = code("ACGT"), code("CGTA")  # CGTA's reverse complement is TACG
    assert got == sorted([(a, b), (b, a)] * 2)


def test_kronecker(spark):
    g = generators.kronecker(spark, 9, 8, seed=3)
    assert g.count() == 2 * 8 * 512
    assert pairs(g) == pairs(generators.kronecker(spark, 9, 8, seed=3))
    for scale in (1, 2, 7, 8):
        ids = spark.range(1 << scale).select(generators._scramble(F.col("id"), scale, 5).alias("x"))
        assert sorted(r.x for r in ids.collect()) == list(range(1 << scale))
    # without renaming, the first quadrant holds about its share of edges
    raw = generators.kronecker(spark, 9, 16, seed=3, permute=False, both=False)
    share = raw.where("src < 256 and dst < 256").count() / raw.count()
    assert abs(share - 0.57) < 0.03


def test_a_header_after_many_comments_and_lines_of_many_fields(spark, tmp_path):
    at = tmp_path / "a.mtx"
    at.write_text("%%MatrixMarket matrix coordinate real general\n" + "% told\n" * 3000 + "2 2 1\n1 2 " + " ".join(map(str, range(1500))) + "\n")
    a, m, n = readers.read_triples(spark, str(at), parse=lambda f: F.size(f))
    assert (m, n) == (2, 2) and [tuple(r) for r in a.collect()] == [(0, 1, 1500)]
    b, _, _ = readers.read_matrix_market(spark, str(at))
    assert b.count() == 1


def test_parts_instead_of_one_file(spark, tmp_path):
    a = spark.createDataFrame([(i, i % 7, float(i)) for i in range(300)], "row long, col long, val double")
    sinks.write_matrix_market(a, str(tmp_path / "m"), 300, 7, single=False)
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "m").glob("part-*")) == 302
    g = a.select(F.col("row").alias("src"), (F.col("row") + 1).alias("dst"))
    sinks.write_dot(g, str(tmp_path / "g"), single=False)
    lines = [x for f in sorted((tmp_path / "g").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == "graph G {" and lines[-1] == "}" and lines[1:-1] == [f"{i} -- {i + 1};" for i in range(300)]


def test_ids_that_do_not_fit_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="more than 32 bits"):
        sinks.write_binary(spark.createDataFrame([(1, 1 << 33)], "src long, dst long"), str(tmp_path / "e"), 32)
