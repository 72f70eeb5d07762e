"""Best-fit packing of token sequences into sequences of bounded length.

Bulk-synchronous best-fit: pieces are range-sorted by length, longest first, and so are the gaps of the open
sequences. In each round the pieces of the greatest length left sweep over their successors among the gaps - the
smallest gap that holds the length, then the next larger ones. Pieces that want the same gap are told apart by rank:
the r-th piece takes the r-th place. Then the gaps are updated and the next round begins.

Pieces of one length are interchangeable, and so are gaps of one size, so a round works on runs: (length, how many)
and (gap, consecutive sequence numbers). There are at most `capacity` lengths, which bounds the number of rounds
and what the driver holds, whatever the number of documents. Only the ranks are per piece, and these are
computed where the range-sorted pieces lie.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, small_batches, stored
from .tokens import encoder


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: rows (length, rank from, rank to, first sequence, per sequence, offset).

    The piece of that length and rank goes to sequence first + (rank - from) // per, at offset + length * ((rank - from) % per).
    Rounds run from the greatest length down; each is best-fit for all pieces of its length at once.
    """
    rows = []
    gaps: list[int] = []  # sizes that occur, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # size -> (first sequence, how many)
    opened = 0

    def put(size: int, first: int, many: int) -> None:
        if size:
            if size not in runs:
                insort(gaps, size)
                runs[size] = []
            runs[size].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(gaps, length)  # the successor among the gaps
            if k == len(gaps):
                per = capacity // length
                size, first, many = capacity, opened, -(-left // per)
                opened += many
            else:
                size = gaps[k]
                first, many = runs[size].pop()
                if not runs[size]:
                    del runs[size], gaps[k]
                per = size // length
            full = min(many, left // per)
            if full:
                take = full * per
                rows.append((length, rank, rank + take, first, per, capacity - size))
                put(size - per * length, first, full)
                rank, left, first, many = rank + take, left - take, first + full, many - full
            if many and left:  # fewer than a sequence's share are left
                rows.append((length, rank, rank + left, first, per, capacity - size))
                put(size - left * length, first, 1)
                first, many, left = first + 1, many - 1, 0
            if many:
                put(size, first, many)
    return rows


def best_fit(pieces: DataFrame, capacity: int, length_col: str = "length", order: tuple[str, ...] = ()) -> DataFrame:
    """pieces with sequence_id (long) and offset (long): as best-fit decreasing packs them.

    Sequences hold at most `capacity`; what is in one lies without gaps from 0. Lengths must be from 1 to capacity; null
    lengths and others fail. Pieces of equal length, and repeated rows, each get a place of their own; which of them
    gets which is open. Other columns pass through; columns named sequence_id and offset are replaced. An empty
    input gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = stored(pieces.drop("sequence_id", "offset"), "cut")  # range sampling reads its input once more
    length = F.col(f"`{length_col}`")
    part_, row_ = fresh(pieces.columns, "_part", "_row")
    keys = [F.desc(length_col), *[F.col(f"`{c}`") for c in order]]
    # the salt spreads a length that many pieces have over several ranges, even where `order` doesn't tell them apart
    ranged = pieces.repartitionByRange(*keys, F.rand(7)).sortWithinPartitions(F.desc(length_col))
    ranged = stored(ranged.withColumn(part_, F.spark_partition_id()).withColumn(row_, F.monotonically_increasing_id()), "pieces")
    # ranges overlap in one length at most, so there are no more rows than ranges and lengths together
    told = ranged.groupBy(F.col(part_).alias("part"), length.cast("long").alias("length")).agg(F.count("*").alias("n"), F.min(row_).alias("first")).collect()
    counts: dict[int, int] = {}
    bases = []
    for r in sorted(told, key=lambda r: (r["part"], r["length"] or 0)):
        if r["length"] is None or not 0 < r["length"] <= capacity:
            raise ValueError(f"a piece of length {r['length']}; lengths must be from 1 to {capacity}")
        bases.append((r["part"], r["length"], counts.get(r["length"], 0) - r["first"]))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    shared = spark.sparkContext.broadcast((np.array(plan(counts, capacity), np.int64).reshape(-1, 6), np.array(bases, np.int64).reshape(-1, 3)))
    names = [c for c in ranged.columns if c not in (part_, row_)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, base = shared.value
        row_key = rows[:, 0] << 40 | rows[:, 1]
        order_ = np.argsort(row_key)
        rows, row_key = rows[order_], row_key[order_]
        base_key = base[:, 0] << 24 | base[:, 1]
        base_order = np.argsort(base_key)
        base, base_key = base[base_order], base_key[base_order]
        for b in batches:
            n = b.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(row_).to_numpy() + base[np.searchsorted(base_key, b.column(part_).to_numpy().astype(np.int64) << 24 | n), 2]
            own = rows[np.searchsorted(row_key, n << 40 | rank, "right") - 1]
            at = rank - own[:, 1]
            more = [pa.array(own[:, 3] + at // own[:, 4]), pa.array(own[:, 5] + n * (at % own[:, 4]))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *more], names=[*names, "sequence_id", "offset"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema if f.name in names], "sequence_id long, offset long"])
    return ranged.mapInArrow(place, schema)


def pieces_of(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids, and end_id after them, in pieces of at most capacity ids; only longer documents are cut.

    tokenizer: path of a tokenizers file, read on the driver. Null is as empty: the end id alone. Columns: doc_id, piece
    (int), start, length (long), ids_crc32 (long), and with_ids ids (binary, unsigned little-endian 32-bit).
    """
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in slices(batches, 8 << 20):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, raw in enumerate(enc.encode(texts)):
                raw += end
                for i, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append(k)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Whole documents, tokenized and packed best-fit into sequences of at most capacity ids: one row per piece.

    Columns: those of pieces_of(), sequence_id and offset. Null and empty texts are packed as their end id alone;
    repeated documents are packed as often as they occur.
    """
    return best_fit(pieces_of(docs, tokenizer, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids), capacity, order=("doc_id", "piece"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), pieces (array of doc_id and length, in place order). Needs with_ids."""
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return got.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["length"].alias("length"))).alias("pieces"))


