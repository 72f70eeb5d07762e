"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words are 64-bit hashes. A first pass counts them. A second one counts each task's own n-grams, a bounded number at a time, and
sends them, dictionary-coded, to the shard of their last but one word. There all that the model needs of them is at hand: of
an n-gram and its context their counts, and, as lower orders count in how many longer ones they stand, the same of all shorter endings.
Words so frequent that their n-grams would outgrow a shard are hot: n-grams with a hot last but one word are dealt by the hash of the whole n-gram,
and what they add to contexts and to shorter endings is summed there and summed again in the shards of these.

A shard's arrays hold hashes in ascending order: the upper bits by a table of bucket offsets, the next 32 bits as they are.
Counts take a byte, larger ones stand in a list of exceptions. The files lie in the folder that all executors share;
workers map them into memory and touch only the pages that a batch needs. The number of shards grows with the text.
"""

from __future__ import annotations

import json
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, delete, give_back, scratch, slices, small_batches, write

BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"begin", 1))
END = np.uint64(xxhash.xxh3_64_intdigest(b"end", 1))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of a packed table that stand in the order of their first use.
HEAD = 4096
#: What a row of an intermediate table is.
GRAMS, CONTEXTS, WORDS, TIMES = range(4)
ROWS = "level int, shard int, kind int, data binary"
TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]


class WordNumbers(dict):
    """word -> number from 2 on, in the order of their first use; 0 is a text's beginning, 1 its end. Starts anew when large."""

    def __init__(self, most: int = 500_000):
        self.most = most
        self._fresh()

    def _fresh(self) -> None:
        self.clear()
        self.hashes, self.known = [int(BEGIN), int(END)], np.array([BEGIN, END], np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n

    @property
    def full(self) -> bool:
        return len(self.hashes) > self.most

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, how many each text has)."""
        # Arrow cuts the words and finds the distinct ones, and only these are looked up; its white space is that of bytes
        cut = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.binary()).view(pa.string()))
        words, sizes = cut.flatten(), cut.value_lengths().to_numpy().astype(np.int64)
        full = pc.greater(pc.binary_length(words), 0)
        if pc.any(pc.invert(full)).as_py():  # beside white space at an end
            ends = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
            after = np.cumsum(sizes)
            words, sizes = words.filter(full), ends[after] - ends[after - sizes]
        words = words.dictionary_encode()
        own = words.dictionary.view(pa.binary()).to_pylist()
        out = np.fromiter(map(self.__getitem__, own), np.int32, len(own))[words.indices.to_numpy()]
        if len(self.known) < len(self.hashes):
            self.known = np.append(self.known, np.array(self.hashes[len(self.known) :], np.uint64))
        return out, sizes


def grams_of(words: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """The order columns of all texts' n-grams, one for each word and each text's end; before a text stand order - 1 beginnings."""
    pad = order - 1
    first = np.cumsum(sizes + order) - (sizes + order) + pad
    a = np.zeros(len(words) + len(sizes) * order, np.int32)
    a[np.arange(len(words)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)] = words
    a[first + sizes] = 1
    at = np.arange(len(words) + len(sizes)) + np.repeat(pad * np.arange(1, len(sizes) + 1), sizes + 1)
    return [a[at - pad + j] for j in range(order)]


def _joined(columns: list[np.ndarray]) -> tuple[np.ndarray, int] | None:
    """(columns of numbers from 0 on side by side in one number, the first in the upper bits; bits of each); null if they don't fit into 63 bits."""
    bits = max([1, *[int(c.max(initial=0)).bit_length() for c in columns]])
    if bits * len(columns) > 63:
        return None
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = key << bits | c
    return key, bits


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Of n-grams, given their words' hashes; equal for equal n-grams only, up to 64 bits."""
    x = columns[0]
    for c in columns[1:]:
        x = x * _STEP + c
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By the upper 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of equal length: each in the least width that holds it, bytes of equal weight together."""
    out = [struct.pack("<IB", len(columns[0]), len(columns))]
    for c in columns:
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        planes = np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        out += [bytes([width]), np.ascontiguousarray(planes.T).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    n, k = struct.unpack_from("<IB", raw)
    at, out = 5, []
    for _ in range(k):
        width = raw[at]
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(c.view("<u8").ravel())
        at += 1 + n * width
    return out


def _gapped(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [np.diff(columns[0], prepend=np.uint64(0)), *columns[1:]]


def pack_grams(columns: list[np.ndarray], c: np.ndarray, hashes: np.ndarray) -> bytes:
    """n-grams of word numbers: the hashes of the words that occur, then the n-grams by their last but one word."""
    if len(hashes) > 8 * len(c) * len(columns):
        used, inverse = np.unique(np.concatenate(columns), return_inverse=True)
        columns = np.split(inverse, len(columns))
    else:
        place = np.zeros(len(hashes), np.int32)
        for x in columns:
            place[x] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used), dtype=np.int32)
        columns = [place[x] for x in columns]
    # the head's words stand in the order of their first use, frequent ones first for the most part; the others by hash, as gaps
    head = min(len(used), HEAD)
    hashes = hashes[used]
    tail = np.argsort(hashes[head:])
    move = np.arange(len(used))
    move[head + tail] = np.arange(head, len(used))
    hashes = np.append(hashes[:head], np.diff(hashes[head:][tail], prepend=np.uint64(0)))
    columns = [move[x] for x in columns]
    second = 0 if len(columns) > 2 else -1
    rest = [x for k, x in enumerate(columns) if k not in (second % len(columns), len(columns) - 2)]
    key = _joined([columns[-2], *[columns[second]] * (len(columns) > 1), *rest])
    by = np.argsort(key[0]) if key else np.lexsort([*rest, columns[second], columns[-2]])
    columns = [x[by] for x in columns]
    x, y = columns[-2], columns[second]
    columns[-2] = np.diff(x, prepend=0)
    columns[second] = np.where(columns[-2] == 0, np.diff(y, prepend=0), y)  # ascends where the last but one word stays
    told, body = pack(hashes), pack(*columns, c[by])
    return struct.pack("<I", len(told)) + told + body


def unpack_grams(raw: bytes) -> list[np.ndarray]:
    """Columns of word hashes, and the counts."""
    (n,) = struct.unpack_from("<I", raw)
    (hashes,) = unpack(raw[4 : 4 + n])
    hashes[HEAD:] = np.cumsum(hashes[HEAD:], dtype=np.uint64)
    *columns, c = unpack(raw[4 + n :])
    columns = [x.astype(np.int64) for x in columns]
    second = 0 if len(columns) > 2 else -1
    new = np.flatnonzero(columns[-2])
    new = np.append(0, new[new > 0])
    y = np.cumsum(columns[second])
    columns[second] = y - np.repeat(y[new] - columns[second][new], np.diff(np.append(new, len(y))))
    columns[-2] = np.cumsum(columns[-2])
    return [*[hashes[x] for x in columns], c.astype(np.int64)]


def summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, with each value column's sums."""
    if not len(key):
        return [key, *values]
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return [key[at], *[np.add.reduceat(v[order], at) for v in values]]


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, places that have it)."""
    if len(to) and to.min() >= -(1 << 15) and to.max() < 1 << 15:
        to = to.astype(np.int16)  # sorted by radix
    by = np.argsort(to, kind="stable")
    to = to[by]
    cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, int)
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(to)]):
        yield int(to[a]), by[a:z]


# Files of arrays -----------------------------------------------------------------------------------------------------------


def _small(name: str, v: np.ndarray) -> dict[str, np.ndarray]:
    """A column of counts: a byte each; those from 255 on are exceptions."""
    large = np.flatnonzero(v >= 255)
    return {name: np.minimum(v, 255).astype("<u1"), f"{name}.at": large.astype("<u8"), f"{name}.is": v[large].astype("<u8")}


def _counts(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    v = arrays[name][at].astype(np.int64)
    large = np.flatnonzero(v == 255)
    if len(large):
        v[large] = arrays[f"{name}.is"][np.searchsorted(arrays[f"{name}.at"], at[large])]
    return v


def _hashed(prefix: str, key: np.ndarray, *values: tuple[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A table by ascending hashes: bucket offsets for the upper bits, about 16 hashes a bucket, and the 32 bits below."""
    bits = max(0, (len(key) >> 4).bit_length() - 1)
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    out = {f"{prefix}.first": np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype("<u4"), f"{prefix}.low": ((key >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")}
    for name, v in values:
        out |= _small(f"{prefix}.{name}", v)
    return out


def _find(arrays: dict[str, np.ndarray], prefix: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places among key, places in the table) of the keys that the table has."""
    first, low = arrays[f"{prefix}.first"], arrays[f"{prefix}.low"]
    by = np.argsort(key)  # so that the table is read from its beginning to its end
    key = key[by]
    bits = (len(first) - 1).bit_length() - 1
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    want = ((key >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lo, end = first[bucket].astype(np.int64), first[bucket + 1].astype(np.int64)
    for k in range(int((end - lo).max(initial=0)).bit_length() - 1, -1, -1):
        mid = lo + ((1 << k) - 1)
        less = low.take(mid, mode="clip") < want
        less &= mid < end
        lo += less.astype(np.int64) << k
    at = np.flatnonzero(lo < end)
    at = at[low[lo[at]] == want[at]]
    return by[at], lo[at]


def _save(path: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes the arrays one after another behind a list of them, then renames the file."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    temporary = f"{root}/{name}.{TaskContext.get().taskAttemptId()}"
    told = json.dumps([[k, v.dtype.str, len(v)] for k, v in arrays.items()]).encode()
    with fs.open_output_stream(temporary, compression=None) as f:
        f.write(struct.pack("<Q", len(told)) + told + b" " * (-len(told) % 8))
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).data)
            f.write(b"\0" * (-v.nbytes % 8))
    fs.move(temporary, f"{root}/{name}")


@lru_cache(maxsize=20_000)  # a process may hold some 65,000 maps
def _mapped(path: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory. One that no local path reaches is first fetched into an unnamed file. A missing one is an error."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        f = open(f"{root}/{name}", "rb")
    else:
        f = tempfile.TemporaryFile()
        with fs.open_input_stream(f"{root}/{name}", compression=None) as there:
            while part := there.read(1 << 24):
                f.write(part)
        f.flush()
    whole = np.memmap(f, np.uint8, "r").view(np.ndarray)  # which need not tell every part of it where it is mapped
    f.close()
    (n,) = struct.unpack("<Q", whole[:8].tobytes())
    at, out = 8 + n + -n % 8, {}
    for k, kind, size in json.loads(whole[8 : 8 + n].tobytes()):
        bytes_ = size * np.dtype(kind).itemsize
        out[k] = whole[at : at + bytes_].view(kind)
        at += bytes_ + -bytes_ % 8
    return out


# Counting ------------------------------------------------------------------------------------------------------------------


def _batch(rows: list[tuple], schema: str = ROWS, types: list = TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])


def _count_words(shards: int):
    """Texts -> rows (shard, data) of their words and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, n = WordNumbers(), np.zeros(2, np.int64)

        def flush():
            key, c = summed(numbers.known[: len(n)], n)
            key, c = key[c > 0], c[c > 0]
            to = shard_of(key, shards)
            yield _batch([(0, s, WORDS, pack(*_gapped([key[at], c[at]]))) for s, at in _dealt(to)])

        for b in slices(batches):
            words, sizes = numbers.of(binary(b.column(0)))
            own = np.bincount(words, minlength=len(numbers.known))
            own[1] += len(sizes)
            own[: len(n)] += n
            n = own
            if numbers.full:
                yield from flush()
                numbers._fresh()
                n = np.zeros(2, np.int64)
        if n.any():
            yield from flush()

    return run


def _by_shard(df: DataFrame, n: int, f, schema: str, key: tuple[str, ...] = ("level", "shard")) -> DataFrame:
    """f(key, rows) of each shard's rows; shards are dealt to n tasks in turn, so that none gets many by chance."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in key]))
            at = 0
            while at < len(keys):
                to = at + 1
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at] != now:
                    if held:
                        yield from f(now, pa.Table.from_batches(held)).select(names).to_batches()
                    now, held = keys[at], []
                held.append(b.slice(at, to - at))
                at = to
        if held:
            yield from f(now, pa.Table.from_batches(held)).select(names).to_batches()

    return df.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions(*key).mapInArrow(run, schema)


def _sum_words(most: int):
    """One shard's words -> one row of them, which of them are hot, and their numbers."""

    def run(key, rows):
        parts = [unpack(x.as_py()) for x in rows.column("data")]
        w, c = summed(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        return pa.table([pa.array([x], t) for x, t in ((key[1], pa.int32()), (pack(*_gapped([w, c])), pa.binary()), (w[c > most].view(np.int64).tolist(), pa.list_(pa.int64())), (int(c.sum()), pa.int64()), (len(w), pa.int64()))], names=["shard", "data", "hot", "n", "v"])

    return run


def _is_hot(word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(word), bool)
    return hot[np.minimum(np.searchsorted(hot, word), len(hot) - 1)] == word


def _to_shard(columns: list[np.ndarray], hot: np.ndarray, shards: int) -> np.ndarray:
    """Below `shards`: that of the last but one word; from there on, if this is hot, that of the n-gram."""
    to, warm = shard_of(columns[-2], shards), np.flatnonzero(_is_hot(columns[-2], hot))
    to[warm] = shards + shard_of(gram_hash([x[warm] for x in columns]), shards)
    return to


def _count_grams(order: int, shards: int, shared, most: int = 2_000_000):
    """Texts -> rows (level, shard, kind, data) of their n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, n = WordNumbers(), [], 0
        hot = shared.value

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            hashes = numbers.known
            if joined := _joined(columns):  # sorted by numbers: nothing is hashed or moved for each occurrence
                key, bits = joined
                key.sort()
                at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                c, key = np.diff(np.append(at, len(key))), key[at]
                columns = [(key >> bits * k & (1 << bits) - 1).astype(np.int32) for k in range(order - 1, -1, -1)]
            else:
                g = gram_hash([hashes[x] for x in columns])
                by = np.argsort(g)
                g = g[by]
                at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                c = np.diff(np.append(at, len(g)))
                columns = [x[by[at]] for x in columns]
            for s, own in _dealt(_to_shard([hashes[x] for x in columns], hot, shards)):
                yield _batch([(order, s, GRAMS, pack_grams([x[own] for x in columns], c[own], hashes))])

        for b in slices(batches):
            words, sizes = numbers.of(binary(b.column(0)))
            held.append(grams_of(words, sizes, order))
            n += len(held[-1][0])
            if n >= most or numbers.full:
                yield from flush()
                held, n = [], 0
                if numbers.full:
                    numbers._fresh()
        if held:
            yield from flush()

    return run


def _merge(path: str, shards: int):
    """One shard's n-grams of one level -> its file, and rows of what they add elsewhere.

    A shard of a word's own has all levels down to pairs. One of hot words has its level; contexts and shorter endings go on.
    """

    def run(key, rows):
        level, shard = key
        parts = [unpack_grams(x.as_py()) for x in rows.column("data")]
        *columns, c = (np.concatenate(x) for x in zip(*parts))
        del parts
        arrays, out = {}, []
        own = shard < shards
        for k in range(level, 1, -1):
            g = gram_hash(columns)
            by = np.argsort(g)
            g = g[by]
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            g, c = g[at], np.add.reduceat(c[by], at)
            columns = [x[by[at]] for x in columns]
            arrays |= _hashed(f"grams{k}", g, ("n", c))
            one = lambda m: (c == m).astype(np.int64)
            contexts = summed(gram_hash(columns[:-1]), c, one(1), one(2), (c > 2).astype(np.int64))
            if own:
                arrays |= _hashed(f"contexts{k}", contexts[0], *zip(STATS, contexts[1:]))
            else:
                for s, at in _dealt(shard_of(contexts[0], shards)):
                    out.append((k, s, CONTEXTS, pack(*_gapped([x[at] for x in contexts]))))
            out.append((k, shard, TIMES, pack(np.array([(c == m).sum() for m in (1, 2, 3, 4)]))))
            columns, c = columns[1:], np.ones(len(c), np.int64)
            if not own:
                break
        if len(columns) > 1:
            hashes, inverse = np.unique(np.concatenate(columns), return_inverse=True)
            g, numbers = gram_hash(columns), np.split(inverse, len(columns))
            first = np.unique(g, return_index=True)[1]  # sum before sending
            g, n, numbers = g[first], summed(g, c)[1], [x[first] for x in numbers]
            for s, at in _dealt(shards + shard_of(g, shards)):
                out.append((level - 1, s, GRAMS, pack_grams([x[at] for x in numbers], n[at], hashes)))
        else:
            words = summed(columns[0], c)
            for s, at in _dealt(shard_of(words[0], _word_shards(shards))):
                out.append((1, s, WORDS, pack(*_gapped([x[at] for x in words]))))
        _save(path, _name(level, shard, shards), arrays)
        give_back()
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), TYPES)], names=["level", "shard", "kind", "data"])

    return run


STATS = ("total", "once", "twice", "more")


def _word_shards(shards: int) -> int:
    return -(-shards // 8)


def _name(level: int, shard: int, shards: int) -> str:
    return f"own-{shard:08d}" if shard < shards else f"hot{level}-{shard - shards:08d}"


def _sum_contexts(path: str):
    """One shard's rows of hot contexts of one level -> its file."""

    def run(key, rows):
        level, shard = key
        parts = [unpack(x.as_py()) for x in rows.column("data")]
        values = [np.concatenate(x).astype(np.int64) for x in list(zip(*parts))[1:]]
        got = summed(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), *values)
        _save(path, f"contexts{level}-{shard:08d}", _hashed(f"contexts{level}", got[0], *zip(STATS, got[1:])))
        return pa.table([pa.array([level], pa.int32()), pa.array([shard], pa.int32())], names=["level", "shard"])

    return run


def _save_words(path: str):
    """One shard's words: counts (level 0) and in how many pairs they are second (level 1) -> its file, and sums."""

    def run(key, rows):
        keys, values = [], []
        for level, raw in zip(rows.column("level").to_pylist(), rows.column("data")):
            w, c = unpack(raw.as_py())
            v = np.zeros((2, len(w)), np.int64)
            v[level] = c
            keys.append(np.cumsum(w, dtype=np.uint64))
            values.append(v)
        w, c, a = summed(np.concatenate(keys), *np.concatenate(values, axis=1))
        _save(path, f"words-{key[0]:08d}", {"key": w.astype("<u8")} | _small("count", c) | _small("continued", a))
        sums = [key[0], int(a.sum()), int((a > 0).sum()), *[int((a == k).sum()) for k in (1, 2, 3, 4)]]
        return pa.table([pa.array([x], pa.int64()) for x in sums], names=["shard", "pairs", "seconds", "t1", "t2", "t3", "t4"])

    return run


# The model -----------------------------------------------------------------------------------------------------------------


def discounts(t1: int, t2: int, t3: int, t4: int) -> tuple[float, float, float]:
    """What counts of 1, 2 and more are lowered by: from the numbers of items seen once to four times; too few items: halves."""
    if not (t1 and t2 and t3):
        return 0.5, 0.5, 0.5
    y = t1 / (t1 + 2 * t2)
    found = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3)
    return tuple(min(max(d, 0.0), k) for k, d in zip((0.9, 1.8, 2.7), found))  # never all of a count: it stays above 0


def _lowered(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c > 0, c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


class Model:
    """A trained model's folder, shards and sums; what is sent along with a task grows with the shards, a few bytes each.

    times: of each level the numbers of n-grams counted once to four times. there: which files there are; only those are looked for.
    """

    def __init__(self, path: str, order: int, shards: int, hot: np.ndarray, n_tokens: int, n_words: int, pairs: int, seconds: int, times: dict[int, list[int]], there: dict[str, np.ndarray]):
        self.path, self.order, self.shards, self.hot, self.there = path, order, shards, hot, there
        self.n_tokens, self.n_words, self.pairs = n_tokens, n_words, pairs
        self.discounts = {k: discounts(*times.get(k, [0] * 4)) for k in range(1, order + 1)}
        n1, n2 = times.get(1, [0] * 4)[:2]
        d = self.discounts[1]
        #: What the discounts leave for the uniform distribution over the words and the unknown one.
        self.rest = (d[0] * n1 + d[1] * n2 + d[2] * (seconds - n1 - n2)) / pairs if pairs else 1.0

    def _file(self, kind: str, shard: int) -> dict[str, np.ndarray] | None:
        flags = self.there.get(kind)
        if flags is None or not flags[shard >> 3] >> (7 - (shard & 7)) & 1:
            return None
        return _mapped(self.path, f"{kind}-{shard:08d}")

    def words(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, continuation counts) of words."""
        count, continued = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for s, at in _dealt(shard_of(w, _word_shards(self.shards))):
            f = self._file("words", s)
            if f is None:
                continue
            place = np.minimum(np.searchsorted(f["key"], w[at]), len(f["key"]) - 1)
            hit = f["key"][place] == w[at]
            count[at[hit]], continued[at[hit]] = _counts(f, "count", place[hit]), _counts(f, "continued", place[hit])
        return count, continued

    def _grams(self, f, k: int, key: np.ndarray, at: np.ndarray, c: np.ndarray) -> None:
        hit, place = _find(f, f"grams{k}", key)
        c[at[hit]] = _counts(f, f"grams{k}.n", place)

    def _contexts(self, f, k: int, key: np.ndarray, at: np.ndarray, stats: np.ndarray) -> None:
        hit, place = _find(f, f"contexts{k}", key)
        for row, name in zip(stats, STATS):
            row[at[hit]] = _counts(f, f"contexts{k}.{name}", place)

    def _left(self, k: int, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences of contexts, what the discounts leave for shorter endings)."""
        d = self.discounts[k]
        return stats[0], np.where(stats[0] > 0, (d[0] * stats[1] + d[1] * stats[2] + d[2] * stats[3]) / np.maximum(stats[0], 1), 1.0)

    def after_word(self, w: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_left() of words as contexts. shard: -1 of hot ones."""
        u, stats = gram_hash([w]), np.zeros((4, len(w)), np.int64)
        for s, at in _dealt(shard):
            if s >= 0 and (f := self._file("own", s)) is not None:
                self._contexts(f, 2, u[at], at, stats)
        warm = np.flatnonzero(shard < 0)
        for s, at in _dealt(shard_of(u[warm], self.shards)):
            if (f := self._file("contexts2", s)) is not None:
                self._contexts(f, 2, u[warm[at]], warm[at], stats)
        return self._left(2, stats)

    def probabilities(self, columns: list[np.ndarray], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of n-grams of word numbers: (counts of the last words, their log10 base probabilities, probabilities after the words before)."""
        hashes, last = known.hashes, columns[-1]
        count, base, p = known.count[last], known.base[last], known.alone[last]
        if not len(last):
            return count, base, p
        cols = [hashes[x] for x in columns]
        own = known.shard[columns[-2]]
        places = [(s, at) for s, at in _dealt(own) if s >= 0]
        warm = np.flatnonzero(own < 0)
        for k in range(2, self.order + 1):
            g, u = gram_hash(cols[-k:]), gram_hash(cols[-k:-1])
            c, stats = np.zeros(len(g), np.int64), np.zeros((4, len(g)), np.int64)
            for s, at in places:
                if (f := self._file("own", s)) is not None:
                    self._grams(f, k, g[at], at, c)
                    if k > 2:
                        self._contexts(f, k, u[at], at, stats)
            for kind, key, look, into in ((f"hot{k}", g, self._grams, c), *[(f"contexts{k}", u, self._contexts, stats)] * (k > 2)):
                for s, at in _dealt(shard_of(key[warm], self.shards)):
                    if (f := self._file(kind, s)) is not None:
                        look(f, k, key[warm[at]], warm[at], into)
            if k > 2:
                total, left = self._left(k, stats)
            else:  # the context is a word
                total, left = known.total[columns[-2]], known.left[columns[-2]]
            p = np.where(total > 0, _lowered(c, self.discounts[k]) / np.maximum(total, 1), 0.0) + left * p
        return count, base, p

    def score(self, texts: list[bytes], known: Known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: (tokens, known tokens, base scores, scores)."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        words, sizes = known.of(texts)
        count, base, p = self.probabilities(grams_of(words, sizes, self.order), known)
        first = np.cumsum(sizes + 1) - (sizes + 1)
        return sizes + 1, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)


class Known:
    """Numbered words of a worker, with what a model has of each: count, log10 base probability, probability without context, shard (-1: hot), and as a context its occurrences and what they leave."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.numbers = model, WordNumbers(most)
        self._fresh()

    def _fresh(self) -> None:
        self.numbers._fresh()
        self.hashes = self.count = self.shard = self.total = np.zeros(0, np.int64)
        self.base = self.alone = self.left = np.zeros(0)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.numbers.full:
            self._fresh()
        out = self.numbers.of(texts)
        m, new = self.model, self.numbers.known[len(self.count) :]
        self.hashes = self.numbers.known
        if len(new):
            count, continued = m.words(new)
            self.count = np.append(self.count, count)
            self.base = np.append(self.base, np.log10((count + 0.5) / (m.n_tokens + 0.5 * (m.n_words + 1))))
            self.alone = np.append(self.alone, _lowered(continued, m.discounts[1]) / max(1, m.pairs) + m.rest / (m.n_words + 1))
            shard = np.where(_is_hot(new, m.hot), -1, shard_of(new, m.shards))
            total, left = m.after_word(new, shard)
            self.shard, self.total, self.left = np.append(self.shard, shard), np.append(self.total, total), np.append(self.left, left)
        return out


def _flags(shards: np.ndarray) -> np.ndarray:
    out = np.zeros(int(shards.max(initial=0)) + 1, bool)
    out[shards] = True
    return np.packbits(out)


def train(docs: DataFrame, path: str, *, order: int = 3, text_col: str = "text", shard_bytes: int = 16 << 20) -> Model:
    """Counts all of docs' texts and writes the model under path, a folder that all executors reach. Null is as empty: its end alone.

    order: the n of the n-grams, 2 or more. The number of shards is the texts' size over shard_bytes; a word that occurs more than shard_bytes / 8 times is hot,
    of which there are fewer than twice the shards. An empty docs gives a model that knows no words.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    size, n_texts = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards, most = max(1, -(-(size or 0) // shard_bytes)), shard_bytes // 8
    few = _word_shards(shards)

    def kept(df: DataFrame, name: str) -> DataFrame:
        write(df, f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    words = kept(_by_shard(texts.mapInArrow(_count_words(few), ROWS), few, _sum_words(most), "shard int, data binary, hot array<long>, n long, v long"), "words")
    n_tokens, n_words = (x or 0 for x in words.agg(F.sum("n"), F.sum("v")).first())
    hot = words.select(F.explode("hot").alias("w")).toArrow().column("w").to_numpy().astype(np.int64).view(np.uint64)
    hot = np.sort(np.append(hot, BEGIN) if n_texts > most else hot)
    rows, made = texts.mapInArrow(_count_grams(order, shards, spark.sparkContext.broadcast(hot)), ROWS), []
    for k in range(order, 1, -1):
        merged = _by_shard(rows, 2 * shards if len(hot) else shards, _merge(path, shards), ROWS)
        made.append(kept(merged, f"rows{k}"))
        rows = made[-1].where(F.col("kind") == GRAMS)
        if not len(hot):
            break
    every = made[0]
    for x in made[1:]:
        every = every.union(x)
    times = {r["level"]: list(r)[1:] for r in every.where(F.col("kind") == TIMES).mapInArrow(_times, "level int, a long, b long, c long, d long").groupBy("level").agg(*[F.sum(c) for c in "abcd"]).collect()}
    files = every.where(F.col("kind") == TIMES).select("level", "shard").distinct().toArrow()
    level, shard = (files.column(c).to_numpy() for c in ("level", "shard"))
    there = {"own": _flags(shard[shard < shards])} | {f"hot{k}": _flags(shard[(shard >= shards) & (level == k)] - shards) for k in range(2, order + 1)}
    warm = _by_shard(every.where(F.col("kind") == CONTEXTS), shards, _sum_contexts(path), "level int, shard int").toArrow()
    level, shard = (warm.column(c).to_numpy() for c in ("level", "shard"))
    there |= {f"contexts{k}": _flags(shard[level == k]) for k in range(2, order + 1)}
    both = words.select(F.lit(0).alias("level"), "shard", "data").union(every.where(F.col("kind") == WORDS).select("level", "shard", "data"))
    schema = "shard long, pairs long, seconds long, t1 long, t2 long, t3 long, t4 long"
    sums = _by_shard(both, few, _save_words(path), schema, ("shard",)).toArrow()
    there["words"] = _flags(sums.column("shard").to_numpy())
    total = {c: int(sums.column(c).to_numpy().sum()) for c in sums.column_names[1:]}
    times[1] = [total[f"t{k}"] for k in (1, 2, 3, 4)]
    for name in ["words", *[f"rows{k}" for k in range(2, order + 1)]]:
        delete(spark, f"{path}/{name}")
    return Model(path, order, shards, hot, n_tokens, n_words, total["pairs"], total["seconds"], times, there)


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            found = [unpack(x.as_py())[0].astype(np.int64) for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("level"), *[pa.array(x) for x in zip(*[f.tolist() for f in found])]], names=["level", "a", "b", "c", "d"])


def held_out_by(id_col: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score_texts(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per row of docs: the columns of keep, n_tokens, n_known, train_tokens (long), base_score, score (double), perplexity (double).

    n_tokens counts the words and one end; score is the model's log10 probability, perplexity 10 ** (-score / n_tokens). Null and empty texts have their end alone.
    Columns of docs that are not named are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        known = Known(m)
        for b in slices(batches):
            sizes, found, base, score = m.score(binary(b.column(b.num_columns - 1)), known)
            more = [pa.array(sizes), pa.array(found), pa.array(np.full(len(sizes), m.n_tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / sizes))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, order: int = 3, path: str | None = None, shard_bytes: int = 16 << 20) -> DataFrame:
    """Scores all of docs with a model of those that are not held out (crc32 of the id as text, modulo folds, is not fold; a null id is as empty).

    Columns: doc_id, held_out, and those of score_texts(); docs' other columns are not looked at. Repeated rows are counted and scored each. An empty input gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out_by(id_col, folds, fold).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    model = train(rows.where(~F.col("held_out")), path or scratch(docs.sparkSession, "ngrams"), order=order, shard_bytes=shard_bytes)
    return score_texts(rows, model, keep=("doc_id", "held_out"))
