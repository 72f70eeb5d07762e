"""Token ids as files: a static range asymmetric numeral system with shared frequency tables.

One frequency table, counted over all ids, serves all files of a folder. A file is a row of independent blocks. In
a block, ids go to `LANES` interleaved states in turn, so that each step encodes or decodes a whole vector. A block's head is a
checkpoint: the lanes' states, the place of its first id in the corpus, its documents and their lengths, and checksums of
ids and bytes. The index at a file's end tells where the blocks are, so any of them can be decoded alone.

    file:  MAGIC | block ... | index: (offset u64, bytes u64, first id u64, ids u32) each | index offset u64 | blocks u32 | crc32 of the index u32 | MAGIC
    block: HEAD | documents (zstd) | states u64 x lanes | words u32 ...
    table: TABLE | symbols u32 | crc32 u32 | frequencies (zstd, u32 each)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, scratch, slices, small_batches
from .tokens import encoder

MAGIC, TABLE = b"TMRANS1\n", b"TMFREQ1\n"
SCALE, LANES = 20, 4096
LOW = np.uint64(1 << 31)
#: Name of the table of the files that belong to a folder.
FILES = "files"
HEAD = struct.Struct("<4sIIIQIIII")  # mark, documents, ids, lanes, first id, bytes of documents, words, crc32 of ids, crc32 of what follows
ENTRY, FOOT = struct.Struct("<QQQI"), struct.Struct("<QII8s")


class Model:
    """Frequencies that sum up to 2 ** SCALE; each symbol that occurs has one at least."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.shift = self.freq << np.uint64(63 - SCALE)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.uint32  # the smaller, the better it is cached
            self._slots = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        return self._slots


def quantised(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum up to 2 ** SCALE, at least 1 where the count is not 0."""
    total, used = int(counts.sum()), int((counts > 0).sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    if used > 1 << SCALE:
        raise ValueError(f"{used} symbols occur; the table has room for {1 << SCALE}")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * (1 << SCALE) // total), 0).astype(np.int64)
    over = int(freq.sum()) - (1 << SCALE)
    order = np.argsort(-freq, kind="stable")
    while over:  # the most frequent symbols bear the rounding
        for s in order[: max(1, min(used, abs(over)))]:
            if not over:
                break
            step = -1 if over > 0 and freq[s] > 1 else 1 if over < 0 else 0
            if over > 0 and step:
                step = -min(over, max(1, int(freq[s]) // 8))
            freq[s] += step
            over += step
    return freq


def encode_ids(ids: np.ndarray, model: Model, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(states, words) of one block."""
    n = len(ids)
    x = np.full(lanes, LOW, np.uint64)
    f, c, top = model.freq[ids], model.cum[ids], model.shift[ids]
    words = []
    for at in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        to = min(n, at + lanes)
        y = x[: to - at]
        full = y >= top[at:to]
        words.append(y[full].astype(np.uint32))
        y = np.where(full, y >> np.uint64(32), y)
        q = y // f[at:to]
        x[: to - at] = (q << np.uint64(SCALE)) + (y - q * f[at:to]) + c[at:to]
    return x, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode_ids(n: int, states: np.ndarray, words: np.ndarray, model: Model) -> np.ndarray:
    x, lanes = states.copy(), len(states)
    slots, freq, cum = model.slots, model.freq, model.cum
    out = np.empty(n, np.uint32)
    mask, used = np.uint64((1 << SCALE) - 1), 0
    for at in range(0, n, lanes):
        to = min(n, at + lanes)
        y = x[: to - at]
        slot = y & mask
        s = slots[slot]
        out[at:to] = s
        y = freq[s] * (y >> np.uint64(SCALE)) + slot - cum[s]
        low = np.flatnonzero(y < LOW)
        y[low] = (y[low] << np.uint64(32)) | words[used : used + len(low)]
        used += len(low)
        x[: to - at] = y
    if used != len(words) or (x != LOW).any():
        raise ValueError("a block does not end where it should")
    return out


def pack_block(ids: np.ndarray, first: int, docs: bytes, n_docs: int, model: Model) -> bytes:
    """docs: as of pack_docs()."""
    states, words = encode_ids(ids, model)
    body = docs + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return HEAD.pack(b"RANS", n_docs, len(ids), LANES, first, len(docs), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def unpack_block(raw: memoryview, model: Model) -> tuple[int, list, np.ndarray, np.ndarray]:
    """(first id, doc_ids, lengths, ids)."""
    mark, n_docs, n, lanes, first, n_bytes, n_words, crc, body_crc = HEAD.unpack_from(raw)
    at = HEAD.size
    if mark != b"RANS" or zlib.crc32(raw[at : (end := at + n_bytes + 8 * lanes + 4 * n_words)]) != body_crc:
        raise ValueError("a block's bytes differ from their checksum")
    doc_ids, lengths = unpack_docs(bytes(raw[at : at + n_bytes]), n_docs)
    states = np.frombuffer(raw, "<u8", lanes, at + n_bytes)
    ids = decode_ids(n, states, np.frombuffer(raw, "<u4", n_words, end - 4 * n_words), model)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids differ from their checksum")
    return first, doc_ids, lengths, ids


def pack_docs(doc_ids: list[int | None], lengths: list[int]) -> bytes:
    null = np.array([x is None for x in doc_ids], np.uint8)
    return zstandard.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array(lengths, "<u8").tobytes() + null.tobytes(), 3)


def unpack_docs(raw: bytes, n: int) -> tuple[list[int | None], np.ndarray]:
    raw = zstandard.decompress(raw)
    null = np.frombuffer(raw, np.uint8, n, 16 * n)
    return [None if z else x for x, z in zip(np.frombuffer(raw, "<i8", n).tolist(), null.tolist())], np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)


def tokenized(docs: DataFrame, tokenizer: str, *, end_id: int = 2, block_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """Documents in ascending order of doc_id, null first, as rows (part, seq, at, n, n_docs, docs, width, ids) of whole documents each.

    Each task ends with a row of seq -1 that has no documents but the counts of its ids (symbols and counts), the least and greatest doc_id, and
    whether these came in order. in_order: the input is taken as it lies; else it is range-sorted.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[bytes] = []
        n = 0
        total = np.zeros(1, np.int64)
        low = high = None
        rising = True

        def row():
            lengths = [len(x) // 4 for x in held]
            nonlocal total
            small = np.frombuffer(b"".join(held), "<u4")
            own = np.bincount(small, minlength=len(total))
            own[: len(total)] += total
            total = own
            if len(small) and small.max() < 1 << 16:
                small = small.astype("<u2")
            return written(part, seq, at, n, len(names), pack_docs(names, lengths), small.itemsize, small.tobytes(), None, None, None, None, None)

        def written(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[x.split()[0] for x in schema.split(", ")])

        for b in slices(batches, 8 << 20):
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode([x or "" for x in b.column(1).to_pylist()])):
                rising = rising and doc is not None and (high is None or high <= doc)
                low, high = doc if low is None else low, doc
                names.append(doc)
                held.append(raw + end)
                n += len(held[-1]) // 4
                if n >= block_ids:
                    yield row()
                    names, held, seq, at, n = [], [], seq + 1, at + n, 0
        if names:
            yield row()
        ids = np.flatnonzero(total)
        yield written(part, -1, 0, 0, 0, None, None, None, ids.tolist(), total[ids].tolist(), low, high, rising)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if not in_order:
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    schema = "part int, seq int, at long, n long, n_docs int, docs binary, width int, ids binary, symbols array<int>, counts array<long>, low long, high long, rising boolean"
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
    return rows.mapInArrow(run, schema)


def _parts_in_order(parts: list) -> list | None:
    """Partitions (part, low, high, rising) in the order of their ids; null if ids don't rise within and from one to the next."""
    parts = sorted((p for p in parts if p["low"] is not None), key=lambda p: (p["low"], p["high"]))
    fit = all(p["rising"] for p in parts) and all(a["high"] <= b["low"] for a, b in zip(parts, parts[1:]))
    return [p["part"] for p in parts] if fit else None


def lies_in_order(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether ids rise within and between partitions, so that nothing need be sorted. Reads the ids only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        rising = True
        for b in batches:
            c = b.column(0)
            if not len(c):
                continue
            if c.null_count:
                rising, low, high = False, 0, 0
                break
            x = c.to_numpy()
            rising = rising and bool((x[1:] >= x[:-1]).all()) and (high is None or high <= x[0])
            low, high = int(x[0]) if low is None else low, int(x[-1])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([rising])], names=["part", "low", "high", "rising"])

    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    return _parts_in_order(ids.mapInArrow(run, "part int, low long, high long, rising boolean").collect()) is not None


def _frequencies(tokens: DataFrame) -> np.ndarray:
    """Counts of all symbols; as many rows as the vocabulary has come to the driver."""

    pairs = tokens.where("seq = -1").select(F.explode(F.arrays_zip("symbols", "counts")).alias("x"))
    rows = pairs.groupBy(F.col("x.symbols").alias("id")).agg(F.sum("x.counts").alias("n")).toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    counts[ids] = n
    return counts


def write_ids(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes all documents' ids under path, a folder that all executors reach; returns the number of ids.

    Files lie in ascending order of doc_id by name, and so do the blocks in a file: a file holds neighbouring blocks of one partition. Null is as empty: its end id alone.
    Rows that share a doc_id lie next to each other, null ids first. Ids must be whole numbers (ValueError); other columns are not looked at. A file's name comes from
    its first block and it is renamed when whole, so a task that runs again writes it anew; a table beside the files names those that belong to the folder.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be a whole number")
    small_batches(spark)
    order = None
    # documents that lie in order already are spared the shuffle; whether they did is told once more by what was read
    for in_order in (True, False) if lies_in_order(docs, id_col) else (False,):
        kept = scratch(spark, "tokens")
        tokenized(docs, tokenizer, end_id=end_id, id_col=id_col, text_col=text_col, in_order=in_order).write.option("compression", "zstd").parquet(kept)
        tokens = spark.read.parquet(kept)
        parts = tokens.where("seq = -1").select("part", "low", "high", "rising").collect()
        order = _parts_in_order(parts) if in_order else sorted(p["part"] for p in parts)
        if order is not None:
            break
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    freq = quantised(_frequencies(tokens))
    body = zstandard.compress(freq.astype("<u4").tobytes())
    with fs.open_output_stream(f"{root}/table.freq", compression=None) as f:
        f.write(TABLE + struct.pack("<II", len(freq), zlib.crc32(body)) + body)
    # one number for each partition of the range-sorted documents
    sums = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for k, p in enumerate(order):
        base[p] = k, total
        total += sums[p]
    shared = spark.sparkContext.broadcast((freq, base))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, base = shared.value
        model = Model(freq)
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        out, index, place, name, after = None, [], len(MAGIC), "", None
        attempt = TaskContext.get().taskAttemptId()

        def ended():
            out.write(pack_index(index, place))
            out.close()
            fs.move(f"{name}.{attempt}", name)
            return pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([len(index)], pa.int64())], names=["file", "blocks"])

        for b in batches:
            for part, seq, at, n, n_docs, docs, width, ids in zip(*[b.column(c).to_pylist() for c in ("part", "seq", "at", "n", "n_docs", "docs", "width", "ids")]):
                if (part, seq) != after:  # a task may get several partitions' blocks, in any order
                    if out is not None:
                        yield ended()
                    name, index, place = f"{root}/part-{base[part][0]:08d}-{seq:08d}.ids", [], len(MAGIC)
                    out = fs.open_output_stream(f"{name}.{attempt}", compression=None)
                    out.write(MAGIC)
                after = part, seq + 1
                first = base[part][1] + at
                raw = pack_block(np.frombuffer(ids, f"<u{width}").astype(np.uint32), first, docs, n_docs, model)
                index.append((place, len(raw), first, n))
                out.write(raw)
                place += len(raw)
        if out is not None:
            yield ended()

    done = tokens.where("seq >= 0").drop("symbols", "counts", "low", "high", "rising").mapInArrow(write, "file string, blocks long")
    done.write.mode("overwrite").parquet(f"{path}/{FILES}")  # only what tasks have ended with counts
    delete(spark, kept)
    return total


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    raw = bytes(spark.read.format("binaryFile").load(f"{path}/table.freq").first()["content"])
    n, crc = struct.unpack_from("<II", raw, len(TABLE))
    body = raw[len(TABLE) + 8 :]
    if raw[: len(TABLE)] != TABLE or zlib.crc32(body) != crc:
        raise ValueError("the frequency table differs from its checksum")
    return np.frombuffer(zstandard.decompress(body), "<u4", n).astype(np.int64)


def pack_index(index: list[tuple[int, int, int, int]], place: int) -> bytes:
    table = b"".join(ENTRY.pack(*x) for x in index)
    return table + FOOT.pack(place, len(index), zlib.crc32(table), MAGIC)


def index_of(f) -> list[tuple[int, int, int, int]]:
    """(offset, bytes, first id, ids) of the blocks of an open file."""
    size = f.seek(0, 2)
    f.seek(max(0, size - FOOT.size))
    at, n, crc, magic = FOOT.unpack(f.read(FOOT.size))
    f.seek(at)
    table = f.read(n * ENTRY.size)
    f.seek(0)
    if magic != MAGIC or f.read(len(MAGIC)) != MAGIC or zlib.crc32(table) != crc or at + len(table) + FOOT.size != size:
        raise ValueError("the index differs from its checksum")
    return list(ENTRY.iter_unpack(table))


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """The documents of all files under path: doc_id, start, n_tokens, ids_crc32 (long) and with_ids ids (binary, little-endian unsigned 32-bit).

    Files' indexes are read first; then blocks are dealt out one by one, so a file is decoded by as many workers as it has blocks.
    """
    shared = spark.sparkContext.broadcast(read_table(spark, path))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f:
                    at = [(x[0], x[1]) for x in index_of(f)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), *[pa.array(c, pa.int64()) for c in zip(*at)]], names=["file", "offset", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        for b in batches:
            for name, offset, size in zip(*[b.column(c).to_pylist() for c in ("file", "offset", "size")]):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(offset)
                    first, doc_ids, lengths, ids = unpack_block(memoryview(f.read(size)), model)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                parts = [raw[4 * a : 4 * z] for a, z in zip((ends - lengths).tolist(), ends.tolist())]
                cols = [pa.array(doc_ids, pa.int64()), pa.array(first + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([bytes(x) for x in parts], pa.binary())] if with_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    files = spark.read.schema("file string, blocks long").parquet(f"{path}/{FILES}")
    blocks, bytes_ = files.agg(F.sum("blocks")).first()[0] or 1, "file string, offset long, size long"
    dealt = files.mapInArrow(look, bytes_).repartition(max(1, min(blocks, 4 * spark.sparkContext.defaultParallelism + blocks // 16)))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def encoded(docs: DataFrame, tokenizer: str, path: str | None = None, *, with_ids: bool = False, **options) -> DataFrame:
    """Writes docs' ids (under path, or a scratch folder) and reads them back: see write_ids() and read_ids(). An empty input gives an empty result."""
    spark = docs.sparkSession
    path = path or scratch(spark, "ids")
    if not write_ids(docs, tokenizer, path, **options):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return read_ids(spark, path, with_ids=with_ids)
