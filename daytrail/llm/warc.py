"""WARC archives: written with revisits for equal payloads, read back in parallel from any byte range.

Writing. Rows with equal payloads of at least `least` bytes share the one with the largest id; the others become revisit
records without payload. Digests are shuffled to find them, and the revisits' ids and digests are joined back, so that
an id with several payloads has a record of its own for each.

Reading. A record says how long it is, but a range of a file may begin anywhere, and a payload may
hold what looks like a record. So each task emits, for every candidate start in its range, where the chain of records
from there leaves the range. These offsets are joined by pointer jumping: what a file's start reaches doubles in each round,
until nothing is new. Only ranges' true first records remain; from these each task reads its range's records, and a
magic inside a payload is stepped over.

Rules: a null payload is empty; an empty one is a response. A null url is left out of its record. Line breaks in urls
are percent-encoded. Rows with a null id are responses that nothing refers to, and so are equal rows that have the largest id.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daytrail.llm.common import stored

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)


def _body() -> Column:
    return F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(id, digest, refers): rows whose payload another row with a larger id has too."""
    keys = pages.select(F.col("page_id").cast("long").alias("id"), F.sha1(_body()).alias("digest"), F.octet_length(_body()).alias("bytes"))
    keys = stored(keys.filter(F.col("id").isNotNull() & (F.col("bytes") >= least)), "digests")
    shared = keys.groupBy("digest").agg(F.max("id").alias("refers"), F.min("id").alias("low")).filter("low < refers")
    found = keys.join(stored(shared.select("digest", "refers"), "shared"), "digest").filter("id < refers")
    return stored(found.select("id", "digest", "refers").distinct(), "revisits")


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + END


def page_record(page_id: int | None, url: str | None, html: str | None, refers: int | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    fields = [("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    fields += [("WARC-Target-URI", safe)] if safe is not None else []
    if refers is None:
        return record("response", [*fields, ("Content-Type", "application/http; msgtype=response")], http + payload)
    fields += [("WARC-Refers-To", f"<urn:page:{refers}>"),
               ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
    return record("revisit", [*fields, ("Content-Type", "application/http; msgtype=response")], http)


def write_archives(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Write a record for every page; returns (path, bytes), a row a file. Files appear under their names when whole."""
    gone = revisits(pages, least)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        part, number, stream, size, done = TaskContext.get().partitionId(), 0, None, 0, []

        def close() -> None:
            stream.close()
            name = f"part-{part:06d}-{number:04d}.warc"
            store.move(attempt, f"{base}/{name}")
            done.append({"path": f"{folder}/{name}", "bytes": size})

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers")), strict=True):
                if stream is None:
                    store.create_dir(base, recursive=True)
                    attempt, size = f"{base}/.{uuid.uuid4().hex}", 0
                    stream = store.open_output_stream(attempt)
                    size += stream.write(record("warcinfo", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n"))
                size += stream.write(page_record(*row))
                if size >= FILE_BYTES:
                    close()
                    stream, number = None, number + 1
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), F.sha1(_body()).alias("digest"))
    same = (F.col("page_id") == F.col("__id")) & (F.col("digest") == F.col("__digest"))
    named = rows.join(gone.withColumnsRenamed({"id": "__id", "digest": "__digest"}), same, "left").drop("__id", "__digest", "digest")
    return stored(named.mapInArrow(write, "path STRING, bytes LONG"), "archives")


def _header(data: bytes, at: int, head: int) -> tuple[int, int] | None:
    """(start of the block, its length) of a record at `at` whose head ends at `head`; None if that is no record's head."""
    length = _LENGTH.search(data, at, head + 2) if head >= 0 else None
    return (head + 4, int(length[1])) if length and data.startswith(MAGIC, at) else None


def _places(data: bytes, what: bytes) -> list[int]:
    found, at = [], data.find(what)
    while at >= 0:
        found.append(at)
        at = data.find(what, at + 1)
    return found


def heads(data: bytes, size: int) -> Iterator[tuple[int, tuple[int, int] | None]]:
    """(start, `_header` of it) of each candidate in the first `size` bytes.

    A head has no magic inside, as a line of a head is a field. So of the candidates before one end of a head only the last is looked at,
    and a payload full of magic costs no more than its length.
    """
    starts, ends = _places(data, MAGIC), _places(data, END)
    for i, at in enumerate(starts):
        if at >= size:
            return
        k = bisect_left(ends, at)
        own = k < len(ends) and (i + 1 == len(starts) or ends[k] < starts[i + 1])
        yield at, _header(data, at, ends[k]) if own else None


HEAD_BYTES = 1 << 16


def ranges(archives: DataFrame) -> DataFrame:
    """(path, bytes, first, end): the files cut into byte ranges, a task for about each."""
    cut = archives.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(RANGE_BYTES).cast("long"))))
    cut = stored(cut.select("path", "bytes", "first", F.least("bytes", F.col("first") + RANGE_BYTES).alias("end")), "ranges")
    return cut.repartition(min(10_000, max(1, cut.count())), "path", "first")


def candidates(cut: DataFrame) -> DataFrame:
    """(path, at, next): where the records from each candidate start leave the candidate's range; null if they break."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                size = row["end"] - row["first"]
                with store.open_input_file(path) as file:
                    file.seek(row["first"])
                    data = file.read(size + HEAD_BYTES)
                    last, searched = data.rfind(MAGIC, 0, size + len(MAGIC) - 1), 0
                    while last >= 0 and data.find(END, max(last, searched)) < 0 and data.find(MAGIC, max(last + 1, searched)) < 0:
                        more = file.read(max(HEAD_BYTES, len(data)))  # a head that is longer still
                        if not more:
                            break
                        searched = len(data) - len(MAGIC)
                        data += more
                leaves: dict[int, int | None] = {}
                for at, head in reversed(list(heads(data, size))):  # a chain only goes forward
                    to = head[0] + head[1] + len(END) if head else None
                    leaves[at] = to if to is None or to >= size else leaves.get(to)
                out = [{"path": row["path"], "at": row["first"] + at, "next": None if to is None else row["first"] + to}
                       for at, to in leaves.items()]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("at", pa.int64()), ("next", pa.int64())]))

    return cut.mapInArrow(scan, "path STRING, at LONG, next LONG")


def reachable(found: DataFrame) -> DataFrame:
    """(path, at): the candidates that a file's start leads to, by pointer jumping."""
    jumps = found
    reached = stored(found.filter("at = 0").select("path", "at"), "reached")
    while True:
        to = reached.join(jumps, ["path", "at"]).select("path", F.col("next").alias("at")).filter("at IS NOT NULL")
        new = stored(to.join(found, ["path", "at"], "left_semi").join(reached, ["path", "at"], "left_anti").distinct(), "reached-next")
        if new.isEmpty():
            return reached
        reached = stored(reached.unionByName(new), "reached")
        after = jumps.select("path", F.col("at").alias("next"), F.col("next").alias("then"))
        jumps = stored(jumps.join(after, ["path", "next"], "left").select("path", "at", F.col("then").alias("next")), "jumps")


def read_archives(archives: DataFrame) -> DataFrame:
    """Every page record: (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    The payload of a revisit is null; its size and digest are those of the payload it stands for.
    """
    cut = ranges(archives)
    entries = reachable(stored(candidates(cut), "candidates"))
    inside = entries.withColumn("first", F.floor(F.col("at") / RANGE_BYTES) * RANGE_BYTES).groupBy("path", "first").agg(F.min("at").alias("at"))
    todo = stored(cut.join(inside, ["path", "first"]), "entries")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    file.seek(row["at"])
                    data = file.read(row["end"] - row["at"])
                    at, out, held = 0, [], 0
                    while row["at"] + at < row["end"]:
                        head = _header(data, at, data.find(END, at))
                        if head is None or head[0] + head[1] + len(END) > len(data):  # goes on behind the range
                            file.seek(row["at"] + at)
                            data, row["at"], at = file.read(HEAD_BYTES), row["at"] + at, 0
                            while data.find(END) < 0 and (more := file.read(HEAD_BYTES)):
                                data += more
                            head = _header(data, 0, data.find(END))
                            if head is None:
                                raise ValueError(f"{row['path']}: no record at {row['at']}")
                            data += file.read(max(0, head[0] + head[1] + len(END) - len(data)))
                        block, size = head
                        out.append(parse(data[at:block], data[block:block + size]))
                        held += size
                        at = block + size + len(END)
                        if held > 8 << 20:
                            yield rows(out)
                            out, held = [], 0
                    yield rows(out)

    def parse(head: bytes, block: bytes) -> dict | None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        if fields["WARC-Type"] not in ("response", "revisit"):
            return None
        number = lambda text: int(text[10:-1]) if text and text[10:-1] else None
        http, _, payload = block.partition(END)
        size = int(_LENGTH.search(http + b"\r\n")[1])
        response = fields["WARC-Type"] == "response"
        return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
                "payload": payload if response else None, "payload_bytes": len(payload) if response else size,
                "payload_digest": hashlib.sha1(payload).hexdigest() if response else fields["WARC-Payload-Digest"][5:],
                "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(found: list[dict | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r for r in found if r], schema)

    spread = todo.repartition(min(10_000, max(1, todo.count())), "path", "first")
    return spread.mapInArrow(read, "page_id LONG, url STRING, payload BINARY, payload_bytes LONG, payload_digest STRING, "
                                   "record_type STRING, refers_to LONG")


def round_trip(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Write the archives, read them back, and return a row a page without the payload."""
    return read_archives(write_archives(pages, folder, least)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS top FROM p WHERE octet_length(b) >= 1000 GROUP BY digest)
SELECT p.page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN g USING (digest)
"""
