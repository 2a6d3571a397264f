"""WARC: one gzip member per record, and a splittable reader.

The writer puts each partition's pages into one archive, a member per record.  Of pages with equal payloads of at least
``REVISIT_BYTES``, the one with the largest page_id is the response and the others are revisits that refer to it; only
digests, not pages, are grouped to find them.  The reader's tasks take byte ranges: each scans its range for the gzip
magic number, accepts a place whose member decodes to a WARC header, and reads every record that starts in its range, to
its end beyond the range if need be.

Edge cases: a null html is an empty payload; a null url leaves out the target; repeated rows with the largest page_id
are all responses; a row without page_id revisits the group's largest page_id, or is a response if no row has one; an
empty table writes no archive.  Only ``page_id``, ``url`` and ``html`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import fresh_path, join_groups, staged, storage, text_bytes

REVISIT_BYTES = 1000
RANGE_BYTES = 8 << 20
MOST_TASKS = 50_000
_READ = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_ID = "urn:page:"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    kind = "response" if payload is not None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    fields += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if payload is None:
        fields += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns page_id, url, html (null for a revisit), digest, size, refers_to."""
        part, sink, size = TaskContext.get().partitionId(), None, 0
        fs, base = storage(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:06d}.warc.gz"
        own = f"{base}/{name}.{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            sink = sink or fs.open_output_stream(own)
            ids, urls, html, digests, sizes, refers = (batch.column(i) for i in range(6))
            payloads = [None if r is not None else p for r, p in zip(refers.to_pylist(), text_bytes(html), strict=True)]
            data = b"".join(_member(_record(*row)) for row in zip(ids.to_pylist(), urls.to_pylist(), payloads, digests.to_pylist(), sizes.to_pylist(), refers.to_pylist(), strict=True))
            sink.write(data)
            size += len(data)
        if sink:
            sink.close()
            fs.move(own, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["path", "bytes"])

    return run


def _decided_batches(decisions: str):
    """Rows as ``_write_batches`` takes them: what a page refers to comes from the file of the task that numbered it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns place, page_id, url, html, digest, size."""
        fs, base = storage(decisions)
        part, refers = None, {}
        for batch in batches:
            found, pages = [], batch.column(0).to_pylist()
            for place in pages:
                if place >> _PLACE_BITS != part:
                    part, refers = place >> _PLACE_BITS, {}
                    for file in fs.get_file_info(fs_selector(f"{base}/part={part}")):
                        if file.is_file and file.base_name.endswith(".parquet"):
                            with fs.open_input_file(file.path) as source:
                                own = pq.read_table(source)
                            refers.update(zip(own.column("place").to_pylist(), own.column("refers_to").to_pylist(), strict=True))
                found.append(refers.get(place))
            html = pa.array([None if r is not None else h for r, h in zip(found, batch.column(3).to_pylist(), strict=True)], pa.string())
            columns = [batch.column(1), batch.column(2), html, batch.column(4), batch.column(5), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "html", "digest", "size", "refers_to"])

    return run


def fs_selector(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


_PAGES = "page_id long, url string, html string, digest string, size long, refers_to long"
#: ``monotonically_increasing_id`` holds the task above this bit.
_PLACE_BITS = 33


def write_archives(pages: DataFrame, broadcast_groups: int = 200_000) -> DataFrame:
    """Write all pages; returns the manifest: path, bytes of each archive.

    Only digests are grouped.  Groups that have copies are broadcast up to ``broadcast_groups``.  Beyond, pages are
    numbered and staged where they are, digests alone meet their groups by a shuffle, and what each revisit refers to is
    written to a file for every task that numbered pages, where the writing tasks find it: no page is ever shuffled.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    large = rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size")
    keepers = large.agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    keepers = staged(spark, keepers.select(F.concat_ws(":", "digest", "size").alias("key"), "keeper", "n"), "warc-copies")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to")
    key = F.concat_ws(":", "digest", "size")
    if keepers.count() <= broadcast_groups:
        met = join_groups(rows.withColumn("key", key), keepers, "key", broadcast_groups).select("page_id", "url", "html", "digest", "size", refers)
        met = met.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    else:
        numbered = staged(spark, rows.withColumn("place", F.monotonically_increasing_id()), "warc-pages")
        met = join_groups(numbered.select("place", "page_id", key.alias("key")), keepers, "key", broadcast_groups).select("place", refers)
        decisions = fresh_path(spark, "warc-refers")
        revisits = met.where("refers_to is not null").withColumn("part", F.shiftrightunsigned("place", _PLACE_BITS))
        revisits.repartition("part").write.partitionBy("part").parquet(decisions)
        met = numbered.select("place", "page_id", "url", "html", "digest", "size").mapInArrow(_decided_batches(decisions), _PAGES)
    return staged(spark, met.mapInArrow(_write_batches(fresh_path(spark, "warc")), "path string, bytes long"), "warc-manifest")


def _decoded(source, start: int) -> tuple[bytes, int] | None:
    """The member that starts at ``start`` and the place after it; None unless it decodes to a WARC record."""
    unpack, out, at = zlib.decompressobj(31), [], start
    while not unpack.eof:
        data = source.read_at(_READ, at)
        if not data:
            return None
        at += len(data)
        try:
            out.append(unpack.decompress(data))
        except zlib.error:
            return None
        if len(out) == 1 and not out[0].startswith(b"WARC/1."):
            return None
    return b"".join(out), at - len(unpack.unused_data)


def _next_magic(source, start: int, end: int) -> int | None:
    while start < end:
        data = source.read_at(_READ + len(_MAGIC) - 1, start)
        at = data.find(_MAGIC)
        if at >= 0:
            return start + at if start + at < end else None
        start += _READ
    return None


def records_in(source, start: int, end: int) -> Iterator[bytes]:
    """Records whose member starts in [start, end)."""
    while (at := _next_magic(source, start, end)) is not None:
        found = _decoded(source, at)
        if found:
            yield found[0]
        start = found[1] if found else at + 1


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased header fields, and the payload behind the block's HTTP header."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    return fields, block[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]


def _page(value: str | None) -> int | None:
    digits = (value or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits else None


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            fs, inner = storage(path)
            rows = []
            with fs.open_input_file(inner) as source:
                for record in records_in(source, start, end):
                    fields, payload = parse_record(record)
                    page, kind = _page(fields["warc-record-id"]), fields["warc-type"]
                    if kind == "response":
                        rows.append((page, len(payload), hashlib.sha1(payload).hexdigest(), kind, None))
                    else:
                        rows.append((page, int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), kind, _page(fields["warc-refers-to"])))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(manifest: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

    A task reads one range of ``range_bytes``; by default of ``RANGE_BYTES``, or as much more as leaves ``MOST_TASKS`` of them.
    """
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    range_bytes = range_bytes or max(RANGE_BYTES, -(-total // MOST_TASKS))
    size = F.lit(range_bytes).cast("long")
    starts = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, size)).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    # Their rows are too small for Spark to see what is behind them.
    count = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(count).mapInArrow(_read_batches, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
