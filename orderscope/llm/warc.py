"""WARC archives with an index first, read back by ranges (operator 10).

Writing: pages with equal payloads form a group by SHA-1 digest and length;
the largest page_id is the response, the others become revisit records that
name it. Each task writes archives to shared storage, one gzip member per
record, and returns an index row per record: page, URL, digest, file,
offset, length. The index is a Parquet table written by Spark and is the
manifest as well: a file that no index row names does not exist for readers.

Reading: any subset of the index can be read. Its rows are dealt by file
and offset block, sorted by offset, and neighbouring byte ranges are joined
into one read when the gap between them is small; each member is then
unpacked, parsed and checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SharedFile, partitions, scratch, spill, store_of

INDEX = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
         "payload_bytes long, file string, offset long, length long")
RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
          "payload_bytes long, payload binary")
FILE_BYTES = 1 << 30      # a new archive file begins after so many bytes
BLOCK_BYTES = 64 << 20    # offsets of one file are dealt to readers in blocks of this size
GAP_BYTES = 64 << 10      # ranges at most this far apart are read together
READ_BYTES = 8 << 20      # a joined read ends when it reaches this length


def _page_uri(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(uri: str):
    value = uri.strip()[len("<urn:page:"):-1]
    return None if value == "none" else int(value)


def _header_text(url: str) -> str:
    """A URL on one header line: control characters and ``%`` percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]",
                  lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _header_url(value: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value.encode()).decode()


def _record(page_id, url, payload: bytes, refers_to, response: bool) -> tuple[bytes, str]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}",
             f"WARC-Record-ID: {_page_uri(page_id)}",
             "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if not response:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_page_uri(refers_to)}")
    body = payload if response else b""
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", digest


def _parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    url = fields.get("WARC-Target-URI")
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": None if url is None else _header_url(url),
            "record_type": fields["WARC-Type"],
            "refers_to": None if response else _page_of(fields["WARC-Refers-To"]),
            "payload_digest": digest, "payload_bytes": int(fields["WARC-Payload-Length"]),
            "payload": body if response else None}


def _writer(folder: str, schema: pa.Schema, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offset, rows = None, 0, []

        def flush():
            path = out.commit()
            for at in range(0, len(rows), 10_000):
                part = [r | {"file": path} for r in rows[at:at + 10_000]]
                yield pa.RecordBatch.from_pylist(part, schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to, response = (batch.column(c)[i].as_py() for c in (
                    "page_id", "url", "payload", "refers_to", "response"))
                if out is None:
                    out, offset, rows = SharedFile(folder, "pages", ".warc.gz"), 0, []
                record, digest = _record(page_id, url, payload, refers_to, response)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.stream.write(member)
                rows.append({"page_id": page_id, "url": url,
                             "record_type": "response" if response else "revisit",
                             "refers_to": None if response else refers_to, "payload_digest": digest,
                             "payload_bytes": len(payload), "offset": offset, "length": len(member)})
                offset += len(member)
                if offset >= FILE_BYTES:
                    yield from flush()
                    out = None
        if out is not None:
            yield from flush()
    return write


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               level: int = 1) -> DataFrame:
    """Write one record per row and return the index table.

    Payload: the HTML in UTF-8, null as empty. Among equal payloads of at
    least ``min_bytes`` bytes the largest page_id is the response and the
    others revisit it; shorter payloads are all responses. A null page_id
    counts as smaller than any other. Rows that share page_id and payload
    are equal records: if theirs is the largest page_id, each is a response.
    A null URL leaves the header out. Other columns are ignored. An empty
    table gives an empty index and no archive.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload")})
    # The election reads digests only; its partial maxima are folded before
    # the shuffle, so a payload with very many copies is one row per task.
    keys = spill(rows.select("page_id", "digest", "n_bytes"), "page-digests")
    winners = (keys.filter(F.col("n_bytes") >= min_bytes)
               .groupBy("digest", "n_bytes")
               .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
               .filter("copies > 1").drop("copies"))
    revisits = (keys.join(winners, ["digest", "n_bytes"])
                .filter(~F.col("page_id").eqNullSafe(F.col("winner")))
                .select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"),
                        F.col("winner").alias("refers_to"), F.lit(False).alias("response"))
                .distinct())
    joined = rows.join(revisits, rows.page_id.eqNullSafe(revisits.r_page)
                       & (rows.digest == revisits.r_digest), "left")
    ready = (joined.select("page_id", "url", "payload", "refers_to",
                           F.coalesce("response", F.lit(True)).alias("response")))
    schema = spark.createDataFrame([], INDEX)
    arrow = pa.schema([(f.name, pa.string() if f.dataType.simpleString() == "string" else pa.int64())
                       for f in schema.schema])
    return spill(ready.mapInArrow(_writer(f"{folder}/archive", arrow, level), INDEX), "index",
                 f"{folder}/index.parquet")


def _ranges(rows: list[tuple]) -> Iterator[tuple[str, int, int, list[tuple]]]:
    """Join sorted (file, offset, length, ...) rows into reads."""
    group: list[tuple] = []
    for row in rows:
        if group and (row[0] != group[0][0]
                      or row[1] - (group[-1][1] + group[-1][2]) > GAP_BYTES
                      or row[1] + row[2] - group[0][1] > READ_BYTES):
            yield group[0][0], group[0][1], group[-1][1] + group[-1][2] - group[0][1], group
            group = []
        group.append(row)
    if group:
        yield group[0][0], group[0][1], group[-1][1] + group[-1][2] - group[0][1], group


def _reader(schema: pa.Schema, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict[str, object] = {}
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for path, start, length, group in _ranges(rows):
                if path not in handles:
                    for f in handles.values():
                        f.close()
                    store, inner = store_of(path)
                    handles = {path: store.open_input_file(inner)}
                data = handles[path].read_at(length, start)
                out = []
                for _, offset, size in group:
                    record = _parse(zlib.decompress(data[offset - start:offset - start + size], 31))
                    if not with_payload:
                        record["payload"] = None
                    out.append(record)
                yield pa.RecordBatch.from_pylist(out, schema)
        for f in handles.values():
            f.close()
    return read


def read_warc(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the records that rows of an index name (the whole index or any
    selection of it): ``page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, payload``. A revisit has no payload of
    its own; ``refers_to`` names the page that has it. Every response's
    payload is checked against its digest."""
    spark = index.sparkSession
    fields = [tuple(x.split()) for x in RECORD.split(", ")]
    arrow = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t])
                       for n, t in fields])
    dealt = (index.select("file", "offset", "length")
             .withColumn("block", F.floor(F.col("offset") / BLOCK_BYTES))
             .repartition(partitions(spark), "file", "block")
             .sortWithinPartitions("file", "offset"))
    return dealt.mapInArrow(_reader(arrow, with_payload), RECORD)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index that :func:`write_warc` left in ``folder``."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index.parquet")
