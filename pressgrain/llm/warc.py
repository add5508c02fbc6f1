"""WARC archives: a deduplicating writer and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrain.llm.common import open_store, shared_folder, slices, table
from pressgrain.session import cut_lineage

GZIP_MAGIC = b"\x1f\x8b\x08"
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def mark_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", least: int = 1000) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, record_type and refers_to.

    Payloads of at least ``least`` bytes with equal SHA-1 are one group: the row with the largest id is the response and
    the others revisit it. Rows that repeat that id are responses as well, as is a group whose ids are all null. Groups
    are counted before anything moves; the join carries one row for each group of two or more, and a large group's pages
    are split by the skew handling of the join.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), "url", F.coalesce(F.col(html), F.lit("")).alias("html"),
                       F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    # the link between page and group is null for short payloads, which then match nothing
    keyed = own.withColumn("_group", F.when(F.col("payload_bytes") >= least, F.col("payload_digest")))
    groups = (
        keyed.filter(F.col("_group").isNotNull()).groupBy("_group").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_first").isNotNull()).drop("_n"))
    spread = keyed.withColumn("_key", F.coalesce("_group", F.concat_ws("-", "payload_digest", "page_id", "url")))
    joined = spread.join(groups.withColumnRenamed("_group", "_key"), "_key", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str, payload_bytes: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member holding one WARC record; a revisit keeps the HTTP header but not the payload."""
    block = HTTP % payload_bytes + (b"" if revisit else html.encode())
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_archives(marked: DataFrame, folder: str, roll_bytes: int = 1 << 30) -> DataFrame:
    """Write the pages of ``mark_revisits`` as archives below ``folder``; returns the table of files: path, bytes.

    Each task streams its pages, starting a new file after ``roll_bytes``. Names carry the task attempt; files of failed
    attempts are not in the returned table.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        sink, path, size = None, "", 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    path, size = f"{root}/pages-{context.partitionId():06d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz", 0
                    sink = store.open_output_stream(path, compression=None)
                page_id, url, html, payload_bytes, digest, kind, refers_to = row
                size += sink.write(record(page_id, url, html, payload_bytes, digest, refers_to, kind == "revisit"))
                if size >= roll_bytes:
                    sink.close()
                    done.append((path, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return cut_lineage(marked.mapInArrow(write, "path string, bytes long"))


class _Window:
    """A growing view of a file from ``start`` on."""

    def __init__(self, source: pa.NativeFile, start: int, size: int, step: int = 1 << 20):
        self.source, self.start, self.step = source, start, step
        self.data = source.read_at(size, start)

    def more(self) -> bool:
        got = self.source.read_at(self.step, self.start + len(self.data))
        self.data += got
        return bool(got)


def _head(raw: bytes) -> dict[str, str] | None:
    """Header fields of a record, None if ``raw`` doesn't begin with a whole WARC header."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields | {"": str(end + 4)} if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _member(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record in the gzip member at ``at`` of the window, and where the member ends; None if there is none."""
    inflate, raw, taken = zlib.decompressobj(31), b"", at
    pieces: list[bytes] = []
    known = 0
    head = None
    while not inflate.eof:
        if taken >= len(window.data) and not window.more():
            return None
        try:
            # a false candidate mostly breaks within its first bytes, before much is inflated
            chunk = window.data[taken : taken + (65536 if head else 4096)]
            got = inflate.decompress(chunk)
        except zlib.error:
            return None
        taken += len(chunk)
        pieces.append(got)
        known += len(got)
        if head is None:
            raw = b"".join(pieces)
            head = _head(raw)
            if head is None and known >= 7 and not raw.startswith(b"WARC/1."):
                return None
            pieces = [raw]
    raw = b"".join(pieces)
    if head is None:
        return None
    first, size = int(head[""]), int(head["content-length"])
    if len(raw) < first + size:
        return None
    return head, raw[first : first + size], taken - len(inflate.unused_data)


def records_in(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records whose gzip member starts in [start, end); the last one may reach beyond.

    Every occurrence of the gzip magic is a candidate; it counts if a WARC header and the stated length of content can
    be inflated from there. After a record the search goes on where its member ends.
    """
    window = _Window(source, start, end - start + len(GZIP_MAGIC) - 1)
    at = window.data.find(GZIP_MAGIC)
    while 0 <= at < end - start:
        found = _member(window, at)
        if found:
            yield found[0], found[1]
            after = found[2]
        else:
            after = at + 1
        if after >= end - start:
            return
        at = window.data.find(GZIP_MAGIC, after)


def read_archives(files: DataFrame, folder: str, split_bytes: int = 4 << 20) -> DataFrame:
    """Records of the archives that ``files`` names, by byte ranges of ``split_bytes``.

    Returns page_id, url, record_type, refers_to, payload_bytes, payload_digest (hexadecimal), html (null in a revisit).
    A response's payload is measured and checked against its digest; the length of a revisit's is that in its HTTP header.
    """
    ranges = files.select("path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split_bytes}L)")).alias("start"))
    # rows are few and small but much work: a stated number of partitions keeps AQE from merging them by their size
    spread = ranges.withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes"))).repartition(max(1, ranges.count()), "path", "start")
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("html", pa.string())])

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for path, _, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[dict] = []
                with store.open_input_file(path) as source:
                    for head, block in records_in(source, start, end):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = head["warc-type"] == "revisit"
                        stated = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        length = len(payload)
                        if revisit:
                            length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        elif hashlib.sha1(payload).hexdigest() != stated:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                        rows.append({
                            "page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"],
                            "refers_to": number(head.get("warc-refers-to")), "payload_bytes": length,
                            "payload_digest": stated,
                            "html": None if revisit else payload.decode()})
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return spread.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, html string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; repeated rows are a record each; an empty table gives no files and no rows."""
    folder = shared_folder(spark, "warc")
    files = write_archives(mark_revisits(table(spark, sf_dir, "pages")), folder)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT payload_digest AS g, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN g ON g.g = d.payload_digest AND d.payload_bytes >= 1000
"""
