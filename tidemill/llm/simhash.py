"""SimHash near-duplicates through an inverted index of byte positions, with count filtering.

Fingerprints are 8 positional bytes. At most 3 differing bits touch at most 3 bytes, so two fingerprints to be linked share
at least 5 positional bytes. The index's keys are small sets of positional bytes chosen such that any 5 positions
contain one of them: pairs that reach the minimum meet in at least one posting list. In a list, the shared positional
bytes of each pair are tallied, pairs that share fewer than 5 are passed over, the rest verified bit by bit.

Only distinct fingerprints are indexed. A list gives no more links than a spanning forest needs. Lists longer than
`long_list` are dealt out once more by ten-bit blocks of the other bits, of which one at least must be equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, fresh, slices, small_batches, stored
from .components import components

#: Bit j of a byte becomes 1 in the j-th byte of a word, so that adding words counts bits in eight lanes.
_LANES = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)


def shingles(text: bytes, k: int) -> list[bytes]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def fingerprints_of(texts: list[bytes], k: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text as uint64."""
    hashes: list[int] = []
    sizes = []
    for t in texts:
        own = shingles(t, k)
        sizes.append(len(own))
        hashes += map(xxhash.xxh64_intdigest, own, repeat(seed))
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    h = np.array(hashes, np.uint64)
    n = np.array(sizes, np.int64)
    first = np.cumsum(n) - n
    has = np.flatnonzero(n)
    # lanes hold up to 255, so each text is counted in parts of 255 shingles at most
    parts = -(-n[has] // 255)
    owner = np.repeat(np.arange(len(has)), parts)
    at = first[has][owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    raw = h.view(np.uint8).reshape(-1, 8)
    for b in range(8):
        lanes = np.add.reduceat(_LANES[raw[:, b]], at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), np.cumsum(parts) - parts, axis=0)
        bits = (2 * ones > n[has][:, None]).astype(np.uint64)
        out[has] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * b))).sum(axis=1, dtype=np.uint64)
    return out


@cache
def key_positions(size: int) -> tuple[tuple[int, ...], ...]:
    """Sets of `size` byte positions such that any 5 of the 8 positions contain one."""
    if size == 3:  # of 5 positions, 3 at least are in one half
        return tuple([*combinations(range(4), 3), *combinations(range(4, 8), 3)])
    left, out = {frozenset(c) for c in combinations(range(8), 5)}, []
    while left:
        best = max(combinations(range(8), size), key=lambda c: sum(set(c) <= x for x in left))
        out.append(best)
        left = {x for x in left if not set(best) <= x}
    return tuple(out)


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def linked_pairs(fps: DataFrame, *, max_bits: int = 3, long_list: int = 20_000) -> DataFrame:
    """fps (fp long, distinct) -> links (u, v) that join all fingerprints within max_bits of each other, directly or through others."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index is complete for at most 3 differing bits")
    size = 3 if fps.count() < 1 << 30 else 4
    masks = [_mask(p) for p in key_positions(size)]
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)]))
    index = fps.select("fp", entry.alias("e")).select("fp", "e.i", "e.bytes")
    hot = index.groupBy("i", "bytes").count().where(F.col("count") > long_list).select("i", "bytes", F.lit(True).alias("hot"))
    index = index.join(hot, ["i", "bytes"], "left")
    rest = [[8 * p + j for p in range(8) if p not in c for j in range(8)] for c in key_positions(size)]
    # max_bits + 1 blocks: one of them at least is equal
    blocks = [[_bits([b for k, b in enumerate(own) if k % (max_bits + 1) == j]) for j in range(max_bits + 1)] for own in rest]
    block = F.element_at(F.array(*[F.array(*[F.lit(m) for m in own]) for own in blocks]), F.col("i") + 1)
    fine = F.when(F.col("hot"), F.transform(block, lambda m, j: F.xxhash64("i", "bytes", j, F.col("fp").bitwiseAND(m)))).otherwise(F.array(F.xxhash64("i", "bytes")))
    keyed = index.select("fp", F.explode(fine).alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linker(max_bits), "u long, v long").distinct()


def _bits(places: list[int]) -> int:
    m = sum(1 << p for p in places)
    return m - (1 << 64) if m >> 63 else m


def _linker(max_bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            k = np.concatenate([held_k, b.column("key").to_numpy()])
            f = np.concatenate([held_f, b.column("fp").to_numpy()])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last list may go on
            yield from _links(k[:cut], f[:cut], max_bits)
            held_k, held_f = k[cut:], f[cut:]
        yield from _links(held_k, held_f, max_bits)

    return link


def near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Places where two arrays' fingerprints are to be linked: the tally of shared positional bytes, then the bits."""
    x = a ^ b
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    at = np.flatnonzero(tally >= 8 - max_bits)
    return at[np.bitwise_count(x[at]) <= max_bits]


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    """Keys ascending. Short lists: all pairs at distance 1, 2, ... at once. Long ones: split by further bits, spanning links only."""
    if len(key) < 2:
        return
    f = fp.view(np.uint64)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    short = (sizes > 1) & (sizes <= 64)
    inside = np.zeros(len(key), bool)
    inside[np.flatnonzero(np.repeat(short, sizes))] = True
    us, vs = [], []
    at = np.flatnonzero(inside)
    for d in range(1, 64):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        hit = at[near(f[at], f[at + d], max_bits)]
        us.append(fp[hit])
        vs.append(fp[hit + d])
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        own = f[s : s + n]
        parent = np.arange(n)
        for i, j in _near_pairs(own, np.arange(n), max_bits):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[b] = a
                us.append(fp[s + i : s + i + 1])
                vs.append(fp[s + j : s + j + 1])
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _near_pairs(f: np.ndarray, at: np.ndarray, max_bits: int, most: int = 64) -> Iterator[tuple[int, int]]:
    """Pairs of places among `at` to be linked, each once or more often.

    Of the bits in which any of them differ, max_bits + 1 blocks are made; a pair within max_bits is equal in one at least. So the
    list is split by each block in turn, and again by the bits that are left, until parts are short. There are at most 2 ** bits distinct fingerprints in a part.
    """
    own = f[at]
    if len(at) <= most:
        i, j = np.triu_indices(len(at), 1)
        hit = near(own[i], own[j], max_bits)
        yield from zip(at[i[hit]].tolist(), at[j[hit]].tolist())
        return
    differ = int(np.bitwise_or.reduce(own ^ own[0]))
    bits = [b for b in range(64) if differ >> b & 1]
    if len(bits) <= max_bits:  # all of them are near
        yield from zip(at[:-1].tolist(), at[1:].tolist())
        return
    for k in range(max_bits + 1):
        key = own & np.uint64(sum(1 << b for b in bits[k :: max_bits + 1]))
        by = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.append(True, key[by[1:]] != key[by[:-1]]))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(by)]):
            if z - a > 1:
                yield from _near_pairs(f, at[by[a:z]], max_bits, most)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = int(parent[i])
    return i


def _rooted(docs: DataFrame, k: int, max_bits: int, id_col: str, text_col: str, long_list: int, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp) of each row, and of each fingerprint (fp, least, root): its least row (missing, doc_id, text_hash), and
    the least fingerprint of its class. Unless hashed, text_hash is 0."""
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprints_of(binary(b.column(2)), k).view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.xxhash64(text) if hashed else F.lit(0).cast("long")).alias("text_hash"), text.alias("text"))
    got = stored(rows.mapInArrow(scan, f"doc_id {kind}, text_hash long, fp long"), "fingerprints")
    fps = stored(got.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("missing"), "doc_id", "text_hash")).alias("least")), "distinct")
    roots = components(linked_pairs(fps.select("fp"), max_bits=max_bits, long_list=long_list)).select(F.col("node").alias("fp"), "root")
    return got, fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, k: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text", long_list: int = 20_000) -> DataFrame:
    """Each row of docs with its fingerprint and class.

    Columns: doc_id, fp (long, the fingerprint's bits), component_id (the least doc_id among the documents reachable over
    links, itself included). Null and empty texts have fingerprint 0 and are linked like any other. Equal texts, and
    repeated rows, have one fingerprint and so one class. A null doc_id keeps its row; it is no class's id unless the
    class has no other. Empty input: empty result.
    """
    got, fps = _rooted(docs, k, max_bits, id_col, text_col, long_list)
    least = fps.groupBy("root").agg(F.min("least").alias("least"))
    classes = stored(fps.select("fp", "root").join(least, "root").select("fp", F.col("least.doc_id").alias("component_id")), "classes")
    return got.join(classes, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, k: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text", long_list: int = 20_000) -> DataFrame:
    """docs without all but one document of each class (as in near_duplicates): that with the least doc_id stays.

    The text stays where it is; only ids and texts' hashes are compared. Where rows of a class share that doc_id, the first of them in
    the order of their text's hash stays. Classes that share an id keep a row each. A null id comes after all others.
    """
    _, fps = _rooted(docs, k, max_bits, id_col, text_col, long_list, hashed=True)
    least = fps.groupBy("root").agg(F.min("least").alias("least"))
    own, hash_, row = fresh(docs.columns, "_kept", "_hash", "_row")
    kept = stored(least.select(F.col("least.doc_id").alias(own), F.col("least.text_hash").alias(hash_)), "kept")
    out = docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(hash_))).drop(own)
    if out.count() > kept.count():  # rows repeat with id and text
        rest = [c for c in docs.columns if c != id_col]
        out = out.groupBy(F.col(f"`{id_col}`"), hash_).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias(row)).select(F.col(f"`{id_col}`"), *[F.col(f"{row}.`{c}`") for c in rest])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
