"""Archives: what is written is read back, records meet by concurrent-to, equal payloads by digest."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import queries, warc

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (5, "http://a.org/x", "same é\r\n\r\nWARC/1.1\r\nbody"), (3, "http://b.org/y", "same é\r\n\r\nWARC/1.1\r\nbody"), (9, None, "same é\r\n\r\nWARC/1.1\r\nbody"),
    (1, "http://c.org/a b\r\nX: y", None), (2, "no url", ""), (4, "", "x" * 300_000), (None, "http://d.org", "alone"), (None, None, "same é\r\n\r\nWARC/1.1\r\nbody"),
    (7, "http://e.org", "twice"), (7, "http://e.org", "twice"), (8, "http://e.org", "twice"), (10, "http://f.org", "\r\n\r\n"), (11, "u\tv", "\n"), (12, None, None), (None, None, None),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(rows, least=0):
    """The rows of the query by their definition."""
    first = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= least:
            first.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        own = first.get(html or "", [])
        least_id = min((p for p in own if p is not None), default=None)
        again = len(own) > 0 and page != least_id
        out.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", least_id if again else None))
    return sorted(out, key=str)


def test_query_on_a_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(map(tuple, queries.op13_assemble_captures(spark, sf_dir).collect()), key=str) == plain(pages)


def test_edge_cases(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("digest", F.lit("mine")).withColumn("size", F.lit(1))
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.op13_assemble_captures(spark, str(tmp_path)).collect()), key=str) == plain(ROWS)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op13_assemble_captures(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("least", [0, 5, 1000])
def test_round_trip(spark, tmp_path, least):
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(2), f"{tmp_path}/out", least_bytes=least)
    records = warc.read_archives(spark, f"{tmp_path}/out").cache()
    assert records.count() == 3 * len(ROWS) and records.where("not intact").isEmpty()
    got = warc.page_captures(warc.captures(records)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to_page) for r in got), key=str) == plain(ROWS, least)
    for r in got:
        assert len(r.requests) == len(r.metadata) == 1
        assert r.requests[0].http.startswith("GET ") and r.requests[0].target_uri == r.target_uri
        if r.type == "response":
            assert bytes(r.payload).decode() in {x[2] or "" for x in ROWS if x[0] == r.page_id}
    records.unpersist()


def test_many_copies_of_one_page(spark, tmp_path):
    rows = [(i, f"http://h{i}.org", "hot" if i % 3 else f"own {i}") for i in range(2000)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.op13_assemble_captures(spark, str(tmp_path)).collect()), key=str) == plain(rows)


def archive(records):
    out = b""
    for kind, name, others, block in records:
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *[f"warc-concurrent-to:  <{o}>" for o in others], f"Content-Length: {len(block)}"]
        out += b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return out


def test_other_archives(spark, tmp_path):
    """Either side may name the other, a third record may connect two, members may be compressed each, and identifiers may repeat."""
    one = [("warcinfo", "info", [], b"x: y"), ("request", "q1", [], b"GET"), ("response", "r1", ["q1"], b"one"), ("metadata", "m1", ["q1"], b"about"), ("response", "r2", [], b"two"), ("request", "q2", ["r2"], b"GET"), ("metadata", "m9", [], b"alone")]
    two = [("response", "r3", [], b"three"), ("metadata", "m3", ["q3"], b""), ("metadata", "m4", ["m3", "r3"], b""), ("request", "q3", ["m4"], b"GET"), ("response", "r2", [], b"two"), ("request", "q2", ["r2"], b"GET"), ("request", "q8", ["gone"], b"GET")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc").write_bytes(archive(one))
    (tmp_path / "a" / "two.warc.gz").write_bytes(b"".join(gzip.compress(archive([r])) for r in two))
    got = warc.captures(warc.read_archives(spark, str(tmp_path / "a"))).collect()
    names = sorted((r.record_id, [x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in got)
    assert names == [("<r1>", ["<q1>"], ["<m1>"]), ("<r2>", ["<q2>"], []), ("<r2>", ["<q2>"], []), ("<r3>", ["<q3>"], ["<m3>", "<m4>"])]


@pytest.mark.parametrize("data", [b"no archive\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.1\r\nWARC-Type: response\r\n"])
def test_broken_archives_are_errors(data):
    with pytest.raises(ValueError, match="WARC record"):
        list(warc.parse(io.BufferedReader(io.BytesIO(data))))
