"""WARC archives: written from a table of pages, read back, and records joined to captures by their concurrent-to identifiers.

A page is three records: a response (or a revisit, if an equal payload is the response of a lesser id), the request, and metadata,
the latter two concurrent to the first. Spark's text writer writes them, a page a line that the writer ends with the two line ends
that end a record; so archives are committed like any output of Spark, in whatever store, and a lost executor's files are written anew.
Archives are read as whole files of bounded size, each decompressed and parsed as a stream. Then records are joined: what is
concurrent with a response or revisit, told by either side or by a third record, is nested into its row. Equal payloads meet by
their digests only, so page texts are not shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import components, cut, give_back, small

#: Uncompressed bytes of a file, about; payload bytes of a batch of records.
FILE, BATCH = 64 << 20, 8 << 20
END = "\r\n"
#: Base-32 digits.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = "file string, at bigint, type string, record_id string, concurrent_to array<string>, target_uri string, date string, refers_to string, content_type string, payload_digest string, payload_bytes bigint, intact boolean, fields map<string,string>, http string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: eight times 20 bits, each four digits."""
    digest = F.sha1(payload)
    chunk = lambda k: F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
    digit = lambda c, s: F.lit(DIGITS).substr(F.shiftright(c, s).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[digit(chunk(k), s) for k in range(8) for s in (15, 10, 5, 0)])


def _clean(text: Column) -> Column:
    """Fit for a header line: white space as in URLs."""
    for char, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.to_json(F.array(*parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column | str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its two last line ends. Headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.lit(f"WARC/1.1{END}"), F.concat_ws("", *[F.concat(F.lit(f"{k}: "), v, F.lit(END)) for k, v in lines]), F.lit(END), block)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``pages`` to compressed archives in ``folder``, which must not exist, of about ``FILE`` bytes.

    Payloads are the pages' texts in UTF-8. Of equal ones of ``least_bytes`` or more, those with the least id are responses, the others
    revisits that refer to it; null ids come last, and repeated rows are the same kind of record, with the same identifiers. Null
    texts are empty payloads, a null url or id leaves its line out. An empty table gives archives without records. Columns other than the three
    are not read."""
    own = pages.select(F.col(f"`{page_id}`").cast("string").alias("name"), F.col(f"`{page_id}`").alias("page"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    own = own.withColumns({"digest": base32_sha1(F.col("html")), "size": F.octet_length("html")})
    seen = Observation()
    met = own.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).where(F.col("size") >= least_bytes)
    rank = F.struct(F.col("page").isNull().alias("none"), "page", "name", F.coalesce("url", F.lit("")).alias("u"), "url")
    firsts = cut(met.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("digest").alias("d"), F.col("first.page").alias("f_page"), F.col("first.name").alias("f_name"), F.col("first.url").alias("f_url")))
    mean = seen.get["bytes"] // max(1, seen.get["n"]) + 1024
    full = own.join(small(firsts, 256), (F.col("digest") == F.col("d")) & (F.col("size") >= least_bytes), "left")
    again = F.col("d").isNotNull() & ~F.col("page").eqNullSafe(F.col("f_page"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    own_id = lambda kind, name="name", u="url": _uuid(F.lit(kind), F.col(name), F.col(u), F.col("digest"))
    response, target, stamp = own_id("response"), ("WARC-Target-URI", _clean(F.col("url"))), ("WARC-Date", F.lit(date))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    first = _record(
        F.when(again, "revisit").otherwise("response"), response,
        [target, stamp, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", F.when(again, own_id("response", "f_name", "f_url"))), ("WARC-Refers-To-Target-URI", F.when(again, _clean(F.col("f_url")))), ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(http, F.when(again, "").otherwise(F.col("html"))),
    )
    host = F.regexp_extract(F.coalesce(_clean(F.col("url")), F.lit("")), "://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.coalesce(_clean(F.col("url")), F.lit("/")), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END))
    request = _record("request", own_id("request"), [target, stamp, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http;msgtype=request"))], get)
    about = F.concat_ws("", F.concat(F.lit("pageId: "), _clean(F.col("name")), F.lit(END)))
    metadata = _record("metadata", own_id("metadata"), [target, stamp, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))], about)
    lines = full.select(F.concat_ws(END + END, first, request, metadata).alias("value"))
    lines.write.options(lineSep=END + END, compression="gzip", maxRecordsPerFile=max(1, FILE // mean)).text(folder)


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an archive, in order: ``headers`` (names in lower case; lists) and ``block``. What is not a record is an error."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the begin of a WARC record: {line[:80]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a WARC record ends in its headers")
            name, _, value = line.partition(b":")
            headers.setdefault(name.strip().lower().decode("latin-1"), []).append(value.strip().decode(errors="replace"))
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends in its block")
        yield {"headers": headers, "block": block}


def _row(file: str, at: int, headers: dict[str, list[str]], block: bytes) -> tuple:
    one = lambda k: headers.get(k, [None])[0]
    kind, content = one("warc-type"), one("content-type") or ""
    http, payload = None, block
    if content.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = head.decode("latin-1")
    fields = None
    if content == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in block.decode(errors="replace").splitlines()) if s]
        fields = list(dict(fields).items())
    told = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
    digest, size, intact = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), None
    if kind == "revisit":  # its payload is elsewhere
        sizes = [x.split(":", 1)[1].strip() for x in (http or "").split("\r\n") if x.lower().startswith("content-length:")]
        digest, size = told, int(sizes[0]) if sizes and sizes[0].isdigit() else None
    elif told:
        intact = told == digest
    return (file, at, kind, one("warc-record-id"), headers.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-date"), one("warc-refers-to"), content, digest, size, intact, fields, http, payload)


_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary())
_NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``RECORD`` for every record of the archives at ``path``, compressed (also record by record) or not. A file is one task's work.

    ``payload`` is the block without HTTP headers, ``payload_digest`` its SHA-1 in base 32, ``intact`` whether the record tells the same
    digest (null: it tells none); a revisit has no payload, so its digest and its size are what it tells. ``fields`` are those of blocks of
    WARC fields. No records give an empty result; a file that is no archive is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                content, name = b.column(1)[k].as_buffer(), b.column(0)[k].as_py()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content)), 1 << 20) if content.size > 1 and content[:2] == b"\x1f\x8b" else io.BufferedReader(io.BytesIO(content), 1 << 20)
                rows, held = [], 0
                for at, record in enumerate(parse(stream)):
                    rows.append(_row(name, at, record["headers"], record["block"]))
                    held += len(record["block"])
                    if held > BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)
            give_back()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)], _NAMES)


def captures(records: DataFrame) -> DataFrame:
    """One row for each response or revisit of ``records`` (as ``read_archives`` gives them, with or without ``payload``): its columns, and
    ``requests`` and ``metadata``, arrays of the records concurrent with it, each by identifier.

    Records are concurrent if one names the other, whichever does, or if a third one connects them. A record that is connected
    with several responses goes to all that it names or that name it, else to that of the least identifier; one without a response is left out.
    A record that is there twice, with one identifier and content, is nested once; a repeated response is a capture of its own.
    ``records`` is read several times, but for payloads once."""
    heads = records.where("type in ('response', 'revisit')")
    slim = ["record_id", "target_uri", "date", "content_type", "http", "fields"]
    ids = heads.select(F.col("record_id").alias("head")).distinct()
    named = records.where("record_id is not null").select("record_id", F.explode("concurrent_to").alias("other"))
    edges = named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other"))).distinct()
    direct = edges.join(ids, F.col("other") == F.col("head")).select("record_id", "head")
    direct = cut(direct.join(ids.select(F.col("head").alias("record_id")), "record_id", "left_anti"))
    rest = cut(edges.join(direct.select("record_id").distinct(), "record_id", "left_anti").join(ids.select(F.col("head").alias("record_id")), "record_id", "left_anti"))
    if not rest.isEmpty():
        group = components(edges.select(F.col("record_id").alias("a"), F.col("other").alias("b")))
        first = group.join(ids, F.col("node") == F.col("head")).groupBy("root").agg(F.min("head").alias("head"))
        far = group.join(rest.select(F.col("record_id").alias("node")).distinct(), "node").join(first, "root").select(F.col("node").alias("record_id"), "head")
        direct = direct.unionByName(far)
    # maps can't be compared, so not be in a set: entries instead
    side = records.where("type in ('request', 'metadata')").select("type", *[F.map_entries(c).alias(c) if c == "fields" else c for c in slim])
    nested = side.join(direct, "record_id").groupBy("head").agg(*[F.sort_array(F.collect_set(F.when(F.col("type") == kind, F.struct(*slim)))).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))])
    plain = [c for c in records.columns if c not in ("requests", "metadata", "head", "concurrent_to")]
    out = heads.select(*plain).join(nested, F.col("record_id") == F.col("head"), "left")
    empty = lambda c: F.coalesce(c, F.array().cast(nested.schema[c].dataType)).alias(c)
    return out.select(*plain, empty("requests"), empty("metadata"))


def page_captures(found: DataFrame, kind: str = "bigint") -> DataFrame:
    """``captures`` of archives that ``write_archives`` made, with ``page_id`` and, for revisits, ``refers_to_page``. ``found`` is read twice."""
    field = F.get(F.filter(F.get("metadata", 0)["fields"], lambda e: e["key"] == "pageId"), 0)["value"]
    own = found.withColumn("page_id", field.cast(kind))
    asked = own.where("type = 'revisit'").select(F.col("refers_to").alias("to_id")).distinct()
    pages = own.where("type = 'response'").select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to_page"))
    known = cut(pages.join(asked, "to_id", "left_semi").dropDuplicates(["to_id"]))
    return own.join(small(known, 128), F.col("refers_to") == F.col("to_id"), "left").drop("to_id")
