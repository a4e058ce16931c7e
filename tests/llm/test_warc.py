import hashlib

import pytest
import zstandard

from meshwork.llm import warc

SCHEMA = "page_id long, url string, html string"


def want(rows, least=1000):
    same = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            same.setdefault(h, []).append(i)
    out = []
    for i, _, h in rows:
        ids = [x for x in same.get(h, []) if x is not None]
        top = max(ids) if ids and len(same[h]) > 1 else None
        b = (h or "").encode()
        revisit = top is not None and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    big, other = "é" * 700, "<p>" + "x" * 5000
    rows = [(1, "http://a/?q=1#f", big), (2, "b c", big), (9, None, big), (9, "d\r\ne", big), (None, "q", big), (3, "s", "short"), (4, "s", "short"), (5, "n", None), (6, "e", ""), (7, "o", other), (None, None, "y" * 2000), (None, "z", "y" * 2000), (8, "t", "w" * 999), (10, "t", "w" * 999), (11, "u", "v" * 300_000)]
    rows += [(100 + i, f"http://x/{i}", f"<html>{i}" + "common words of a page " * 60) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as payload", "'d' as digest", "2 as refers_to")
    got = warc.read(warc.write(df)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == want(rows)
    html = {r[0]: r[2] for r in rows}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in got if r.payload is not None and r.page_id is not None)
    assert {r.url for r in got if r.page_id == 1} == {"http://a/?q=1#f"}


def test_empty(spark):
    assert warc.read(warc.write(spark.createDataFrame([], SCHEMA))).count() == 0


def test_rolls_over_and_reads_only_the_manifest(spark, monkeypatch, tmp_path):
    import random

    rng = random.Random(0)
    rows = [(i, "u", "".join(rng.choices("abcdefghij ", k=3000))) for i in range(60)]
    (tmp_path / "part-00000-99-0000.warc.zst").write_bytes(b"left by a lost task")
    manifest = warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path))
    assert manifest.agg({"records": "sum"}).first()[0] == 60
    assert warc.read(manifest).count() == 60


def archive(records, samples=None):
    a = warc.Archive(warc._dictionary(samples) if samples else None)
    for r in records:
        a.add(r)
    return b"".join(a.parts)


def test_dictionary_comes_first_and_each_frame_is_a_record():
    records = [warc.record(i, "http://x", f"<p>{i} words of a page that is like the others".encode() * 20, len(f"<p>{i} words of a page that is like the others".encode() * 20), hashlib.sha1(f"<p>{i} words of a page that is like the others".encode() * 20).hexdigest(), None) for i in range(200)]
    data = archive(records, records)
    assert data[:4] == warc.SKIPPABLE
    dictionary, spans = warc.frames(data)
    assert dictionary and len(spans) == 200 and spans[-1][1] == len(data)
    of = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    assert [of.decompress(data[a:b]) for a, b in spans] == records
    # a dictionary may itself be compressed
    packed = zstandard.compress(dictionary)
    rest = data[8 + len(dictionary) :]
    assert warc.frames(warc.SKIPPABLE + len(packed).to_bytes(4, "little") + packed + rest)[0] == dictionary
    plain = archive(records[:2])
    assert warc.frames(plain)[0] is None and len(warc.frames(plain)[1]) == 2


@pytest.mark.parametrize("n", [3, 10, 40])
def test_damage_is_found(n):
    r = warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None)
    data = archive([r])
    with pytest.raises(ValueError):
        warc.frames(data[:-n])
    with pytest.raises(ValueError):
        warc.parse(r[:-n])
    for a, b in ((b"WARC/1.1", b"WARC/9.9"), (b"abc", b"abd"), (b"WARC-Date", b"WARC-Dote"), (b"WARC-Type: response", b"WARC-Type: resource")):
        with pytest.raises(ValueError):
            warc.parse(r.replace(a, b))
