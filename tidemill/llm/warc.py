"""Dictionary-compressed WARC archives (.warc.zst): writer and reader.

An archive starts with a skippable frame that holds a Zstandard dictionary built from the archive's own records;
after it each record is a frame of its own, compressed with that dictionary. A task holds at most one archive's
records at a time.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, scratch, small_batches, stored

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The table of the archives that belong to a folder.
FILES, FILES_SCHEMA = "files", "file string, n long"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def assign(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, many: int = 100_000) -> DataFrame:
    """page_id, url, payload (binary), payload_digest, record_type, refers_to of each row of pages.

    Of rows with equal payloads of at least least_bytes, that with the largest page_id is the response, the others revisit
    it. A null payload is empty; a null url stays out of the record. Repeated rows with that largest page_id are the same record: each is a
    response. A null page_id is never the largest, unless there is no other. Digests that more rows share than `many`, or than a ten thousandth of
    all rows, are at most ten thousand; they are broadcast, so their rows are not shuffled. The others go by digest.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_bytes).select("payload_digest", "page_id")
    shared = stored(large.groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1"), "digests")
    bound = max(many, rows.count() // 10_000)
    hot = shared.where(F.col("n") > bound).select("payload_digest", F.col("kept").alias("hot_kept"), F.lit(True).alias("hot"))
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    marked = rows.join(F.broadcast(hot), "payload_digest", "left")
    found = marked.where("hot").select(*rows.columns, F.col("hot_kept").alias("kept"))
    out = found.unionByName(marked.where("hot is null").select(*rows.columns).join(shared.where(F.col("n") <= bound).select("payload_digest", "kept"), "payload_digest", "left"))
    return out.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    block = HTTP + payload if kind == "response" else HTTP
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def archive(records: list[bytes], dict_bytes: int = 64 << 10, level: int = 3) -> bytes:
    """The bytes of one archive. Records too few or too short to train on give a raw dictionary of their heads."""
    try:
        trained = zstandard.train_dictionary(dict_bytes, records, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        trained = b"".join(r[:1024] for r in records)[:dict_bytes]
    out = io.BytesIO()
    out.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
    comp = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(trained), write_checksum=True)
    for r in records:
        out.write(comp.compress(r))
    return out.getvalue()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_warc(assigned: DataFrame, path: str, *, archive_bytes: int = 16 << 20, dict_bytes: int = 64 << 10, level: int = 3) -> int:
    """Writes the archives of assign()'s rows under path, a folder that all executors reach. Returns the number of records.

    Each attempt of a task names its archives differently. A table beside them, which Spark writes for attempts that ended well only, tells which
    belong to the folder; what a lost attempt left is not among them, however rows or archives' bounds differ when the task runs again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        held, size, k = [], 0, 0
        task = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"

        def flush():
            name = f"{task}-{k:05d}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(archive(held, dict_bytes, level))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["file", "n"])

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]):
                held.append(record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size, k = [], 0, k + 1
        if held:
            yield flush()
        give_back()

    spark = assigned.sparkSession
    small_batches(spark)
    assigned.mapInArrow(write, FILES_SCHEMA).write.mode("overwrite").parquet(f"{path}/{FILES}")
    return spark.read.schema(FILES_SCHEMA).parquet(f"{path}/{FILES}").agg(F.sum("n")).first()[0] or 0


def read_archive(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != SKIPPABLE:
        raise ValueError("not a dictionary-compressed archive")
    stream = zstandard.ZstdDecompressor(dict_data=_dictionary(raw[8 : 8 + size])).stream_reader(memoryview(raw)[8 + size :], read_across_frames=True)
    lines = io.BufferedReader(stream, 1 << 20)
    while line := lines.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record starts with {line[:40]!r}")
        fields = {}
        while (line := lines.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = lines.read(int(fields["content-length"]))
        if lines.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def read_warc(spark, path: str) -> DataFrame:
    """The records of all archives that write_warc() has ended under path: page_id (long), url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Digests of responses are computed anew and must equal their headers.
    """
    number = lambda x: int(x[len("<urn:x-page:") : -1]) if x and x != "<urn:x-page:>" else None
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    raw = f.read()
                rows, size = [], 0
                for head, block in read_archive(raw):
                    kind, digest, n = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {head['warc-record-id']} differs from its digest")
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), n, digest, kind, number(head.get("warc-refers-to")), payload))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), types)], names=names)

    files = spark.read.schema(FILES_SCHEMA).parquet(f"{path}/{FILES}").select("file")
    n = files.count()
    return files.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism + n // 4))).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame, path: str | None = None, *, archive_bytes: int = 16 << 20, **options) -> DataFrame:
    """Writes pages as archives (under path, or a scratch folder) and reads them back.

    Nulls, ties and repeated rows: see assign(); each row of pages has one record. Ids must be whole numbers (ValueError). Columns of pages other than
    the three are not looked at. An empty input gives an empty result.
    """
    spark = pages.sparkSession
    id_col = options.get("id_col", "page_id")
    if pages.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be a whole number")
    path = path or scratch(spark, "warc")
    if not write_warc(assign(pages, **options), path, archive_bytes=archive_bytes):
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return read_warc(spark, path)
