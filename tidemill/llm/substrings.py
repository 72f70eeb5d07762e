"""Exact substring deduplication: every byte that a string of `length` bytes covers goes, if that string also starts earlier.

Finding candidates. Over each text the k-byte strings are hashed, and of each `length - k + 1` neighbouring ones the least hash is an
anchor. Which string of a repeated passage is its anchor depends on the passage alone, so all places of a repeated string have the same
anchor at the same distance. An anchor's context is all that a string around it can reach: `length - k` bytes on either side.
  1. Anchors are dealt to shards by their hash. Places with equal context but the first are covered over all of it.
     A task sends on one place of each context only, so no context has more places than there are tasks.
  2. Where one anchor has several contexts, these are cut out of the texts and dealt to shards by the region of the first text that has the anchor,
     so that what one text shares with another is cut out in few pieces. Contexts that were dealt alike are one text, whose suffix array is built by induced
     sorting; permuted common prefixes tell runs of suffixes that share `length` bytes. All places in a run but the first are covered.
     A region has few anchors, and an anchor here at most `many` contexts, so what one array must hold is bounded.
  3. Anchors with more contexts are those of short lines that very many texts share. The strings of `length` bytes around these are dealt by
     their own hashes instead, the first of each task's; where a hash recurs the strings are cut out and compared.
  4. Covered spans are merged by text.
All steps send hashes, places and contexts; the texts themselves stay in files of the shared folder, one for each task of the first step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, give_back, scratch, slices, small_batches, stored
from .kneser_ney import pack, unpack
from .suffix_array import common_prefixes, suffix_array

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
K = 32
ROWS = "to int, kind int, part int, data binary"
TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
ANCHORS, COVERED, WANTED, SPANS, FILE, OFTEN, STRINGS, FREQUENT = range(8)
#: Bytes of a leading text whose anchors' contexts are dealt together.
REGION = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors_of(t: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of the texts at [starts, ends) of t."""
    n = len(t) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, size = _BYTE[t], 1
    while size < k:  # the hash of 2m bytes from those of m
        h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    h = _mixed(h)
    for e in ends[:-1].tolist():  # strings that reach into the next text
        h[max(0, e - k + 1) : e] = NEVER
    w = length - k + 1
    low = _sliding(np.minimum, h, w)
    # a place is an anchor if it is the least of any of the windows that hold it
    high = _sliding(np.maximum, np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w) if len(low) else np.zeros(len(h), np.uint64)
    at = np.flatnonzero((high[: len(h)] == h) & (h != NEVER))
    return at, h[at]


def _sliding(f, x: np.ndarray, w: int) -> np.ndarray:
    if len(x) < w:
        return x[:0]
    size = 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((_mixed(h) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _dealt(to: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(to, kind="stable")
    to = to[order]
    cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, int)
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(to)]):
        yield int(to[a]), [c[order[a:z]] for c in columns]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=["to", "kind", "part", "data"])


def _firsts(value: np.ndarray, ctx: np.ndarray, ord_: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a place in that order is the first of its anchor and context)."""
    order = np.lexsort((pos, ord_, ctx, value))
    v, c = value[order], ctx[order]
    return order, np.append(True, (v[1:] != v[:-1]) | (c[1:] != c[:-1]))[: len(order)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) ^ np.int64(-1 << 63)


def _unsigned(x: np.ndarray) -> np.ndarray:
    """int64 in the order of unsigned numbers, as pack() takes them."""
    return (x ^ np.int64(-1 << 63)).view(np.uint64)


def _scan(path: str, shards: int, length: int, many: int, most: int = 2_000_000) -> Callable:
    """Texts (_ord first, _text last) -> anchors for shards, what a task finds covered by itself, and the task's file.

    An anchor with more than `many` contexts here is frequent: its places stay, and its shard is told only that it is, so that none gets all places of one anchor.
    """
    reach = length - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name, temporary = f"{root}/{part:06d}.parquet", f"{root}/{part:06d}.{TaskContext.get().taskAttemptId()}"
        writer, out, held, n = None, None, [], 0

        def flush():
            v, c, o, p = (np.concatenate(x) for x in zip(*held))
            order, first = _firsts(v, c, o, p)
            rows = []
            if not first.all():
                again = order[~first]
                rows.append((part % shards, COVERED, part, pack(_unsigned(o[again]), p[again])))
            keep = np.sort(order[first])
            v, c, o, p = v[keep], c[keep], o[keep], p[keep]
            order = np.argsort(v, kind="stable")
            cut = np.flatnonzero(np.append(True, v[order[1:]] != v[order[:-1]]))
            n = np.diff(np.append(cut, len(v)))
            frequent = np.zeros(len(v), bool)
            frequent[order] = np.repeat(n > many, n)
            if frequent.any():
                rows.append((part % shards, OFTEN, part, pack(_unsigned(o[frequent]), p[frequent], np.zeros(frequent.sum(), np.uint64))))
                for to, (cols,) in _dealt(_shard(names := v[order[cut[n > many]]], shards), [names]):
                    rows.append((to, FREQUENT, part, pack(cols)))
            v, c, o, p = v[~frequent], c[~frequent], o[~frequent], p[~frequent]
            for to, cols in _dealt(_shard(v, shards), [v, c, _unsigned(o), p]):
                rows.append((to, ANCHORS, part, pack(*cols)))
            yield _batch(rows)

        for b in slices(batches, 1 << 20):
            if writer is None:
                out = fs.open_output_stream(temporary, compression=None)
                writer = pyarrow.parquet.ParquetWriter(out, b.schema, compression="zstd", use_dictionary=False)
            writer.write_batch(b)
            texts = binary(b.column(b.num_columns - 1))
            ords = b.column(0).to_numpy()
            for lo, hi in _portions(texts):
                rows_ = [i for i in range(lo, hi) if len(texts[i]) >= length]
                if not rows_:
                    continue
                joined = b"".join([texts[i] for i in rows_])
                ends = np.cumsum([len(texts[i]) for i in rows_])
                starts = np.append(0, ends[:-1])
                at, value = anchors_of(np.frombuffer(joined, np.uint8), starts, ends, length)
                if not len(at):
                    continue
                row = np.searchsorted(ends, at, "right")
                a, z = np.maximum(starts[row], at - reach), np.minimum(ends[row], at + length)
                digest = xxhash.xxh3_64_intdigest
                # the anchor's place in its context counts: near a text's ends two anchors may have one context, which then is no repeat
                ctx = np.array([digest(joined[x:y], d) for x, y, d in zip(a.tolist(), z.tolist(), (at - a).tolist())], np.uint64)
                held.append((value, ctx, ords[rows_][row], at - starts[row]))
                n += len(at)
            if n >= most:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temporary, name)
            yield _batch([(part % shards, FILE, part, b"")])

    return run


def _portions(texts: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows (kind, part, data) of each value of the key, by which they are sorted."""
    now, rows = None, []
    for b in batches:
        for k, kind, part, data in zip(b.column(key).to_pylist(), b.column("kind").to_pylist(), b.column("part").to_pylist(), b.column("data").to_pylist()):
            if k != now:
                if rows:
                    yield now, rows
                now, rows = k, []
            rows.append((kind, part, data))
    if rows:
        yield now, rows
    give_back()


def _match(many: int) -> Callable:
    """A shard's anchors -> places covered over all of their context, and places whose contexts are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in _grouped(batches, "to"):
            out, cols, frequent = [], [], [np.zeros(0, np.uint64)]
            for kind, part, data in rows:
                if kind == FREQUENT:
                    frequent += unpack(data)
                elif kind == ANCHORS:
                    v, c, o, p = unpack(data)
                    cols.append((v, c, _signed(o), p.astype(np.int64), np.full(len(v), part)))
                else:
                    out.append((to, kind, part, data))
            if cols:
                v, c, o, p, part = (np.concatenate(x) for x in zip(*cols))
                del cols
                order = np.argsort(v)
                s, frequent = v[order], np.unique(np.concatenate(frequent))
                same = s[1:] == s[:-1]
                shared = order[np.append(same, False) | np.append(False, same) | np.isin(s, frequent)] if len(s) else order
                v, c, o, p, part = v[shared], c[shared], o[shared], p[shared], part[shared]
                order, first = _firsts(v, c, o, p)
                again = order[~first]
                for q, (a, b) in _dealt(part[again], [_unsigned(o[again]), p[again]]):
                    out.append((to, COVERED, q, pack(a, b)))
                reps = order[first]
                v, o, p, part = v[reps], o[reps], p[reps], part[reps]
                cut = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
                sizes = np.repeat(np.diff(np.append(cut, len(v))), np.diff(np.append(cut, len(v)))) if len(v) else np.zeros(0, int)
                first = np.lexsort((p, o, v))[cut]  # the least place of each anchor
                leader = np.repeat(_mixed(_mixed(o[first].view(np.uint64)) + (p[first] // REGION).astype(np.uint64)), np.diff(np.append(cut, len(v)))) if len(v) else v
                often = (sizes > many) | np.isin(v, frequent)
                for kind, own in ((WANTED, (sizes > 1) & ~often), (OFTEN, often)):
                    own = np.flatnonzero(own)
                    for q, cols in _dealt(part[own], [_unsigned(o[own]), p[own], leader[own]]):
                        out.append((to, kind, q, pack(*cols)))
            if out:
                yield _batch(out)

    return run


def _texts(path: str, part: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{root}/{part:06d}.parquet") as f:
        yield from pyarrow.parquet.ParquetFile(f).iter_batches(batch_size=1024, columns=columns)


def _looked_up(ords: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ords, the range of its places in sorted_."""
    return np.searchsorted(sorted_, ords, "left"), np.searchsorted(sorted_, ords, "right")


def _places(path: str, part: int, rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(ord, text, places, keys) of a part's texts that have places among the packed rows of them."""
    o, p, key = (np.concatenate(x) for x in zip(*[unpack(data) for _, _, data in rows]))
    o, p = _signed(o), p.astype(np.int64)
    order = np.lexsort((p, o))
    o, p, key = o[order], p[order], key[order]
    for b in _texts(path, part, ["_ord", "_text"]):
        lo, hi = _looked_up(b.column(0).to_numpy(), o)
        for i in np.flatnonzero(hi > lo).tolist():
            yield int(o[lo[i]]), (b.column(1)[i].as_py() or "").encode(), p[lo[i] : hi[i]], key[lo[i] : hi[i]]


def _sent(held: list[tuple[int, int, int, bytes]], shards: int, kind: int, part: int) -> pa.RecordBatch:
    """Pieces of text (key, ord, start, bytes), dealt by key."""
    key, ords, starts, texts = zip(*held)
    key, sizes = np.array(key, np.uint64), np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for s, (i,) in _dealt(_shard(key, shards), [np.arange(len(key))]):
        own = np.concatenate([joined[ends[j] - sizes[j] : ends[j]] for j in i])
        head = pack(key[i], _unsigned(np.array(ords)[i]), np.array(starts)[i], sizes[i])
        out.append((s, kind, part, len(head).to_bytes(4, "little") + head + own.tobytes()))
    return _batch(out)


def _received(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(keys, ords, starts, sizes, parts, all bytes) of rows of _sent()."""
    texts, cols = [], []
    for _, q, data in rows:
        size = int.from_bytes(data[:4], "little")
        key, a, b, c = unpack(data[4 : 4 + size])
        cols.append((key, _signed(a), b.astype(np.int64), c.astype(np.int64), np.full(len(a), q)))
        texts.append(np.frombuffer(data, np.uint8, offset=4 + size))
    return *[np.concatenate(x) for x in zip(*cols)], np.concatenate(texts)


def _cut(path: str, shards: int, length: int) -> Callable:
    """A part's wanted places -> their contexts, dealt by the region of the text that leads them."""
    reach = length - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches, "part"):
            held, n = [], 0
            for o, text, places, keys in _places(path, part, rows):
                spans: dict[int, list[list[int]]] = {}
                for at, key in zip(places.tolist(), keys.tolist()):
                    a, z = max(0, at - reach), min(len(text), at + length)
                    if z - a < length:
                        continue
                    if (own := spans.setdefault(key, [])) and a <= own[-1][1]:
                        own[-1][1] = z
                    else:
                        own.append([a, z])
                for key, own in spans.items():
                    for a, z in own:
                        held.append((key, o, a, text[a:z]))
                        n += z - a
                if n >= 16 << 20:
                    yield _sent(held, shards, WANTED, part)
                    held, n = [], 0
            if held:
                yield _sent(held, shards, WANTED, part)

    return run


def _cut_often(path: str, shards: int, length: int, most: int = 1 << 20) -> Callable:
    """A part's places of frequent anchors -> the hashes of all strings of `length` bytes around them, dealt by hash.

    Of equal strings among `most` bytes the first is sent; the others, compared byte by byte, are covered.
    """
    reach = length - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches, "part"):
            held, n = [], 0

            def flush():
                ords, starts, texts = zip(*held)
                sizes = np.array([len(x) for x in texts])
                ends = np.cumsum(sizes)
                joined = np.frombuffer(b"".join(texts), np.uint8)
                h = _hashes(joined, length)
                fits = np.ones(len(h), bool)
                for e in ends[:-1].tolist():  # strings that reach into the next piece
                    fits[max(0, e - length + 1) : e] = False
                at = np.flatnonzero(fits)
                row = np.searchsorted(ends, at, "right")
                h, o, p = h[at], np.array(ords)[row], np.array(starts)[row] + at - (ends - sizes)[row]
                by = np.lexsort((p, o, h))
                h, o, p, at = h[by], o[by], p[by], at[by]
                head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                first = np.repeat(head, np.diff(np.append(head, len(h))))
                later = np.flatnonzero(first != np.arange(len(h)))
                equal = _equal(joined, at[later], at[first[later]], length)
                out, gone = [], later[equal]
                if len(gone):
                    out.append((part % shards, SPANS, part, pack(*_spans(o[gone], p[gone], length))))
                keep = np.ones(len(h), bool)
                keep[gone] = False
                for s, (x, y, z) in _dealt(_shard(h[keep], shards), [h[keep], _unsigned(o[keep]), p[keep]]):
                    out.append((s, OFTEN, part, pack(np.diff(x, prepend=np.uint64(0)), y, z)))
                return _batch(out)

            for o, text, places, _ in _places(path, part, rows):
                spans: list[list[int]] = []
                for at in places.tolist():
                    a, z = max(0, at - reach), min(len(text), at + length)
                    if z - a < length:
                        continue
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = z
                    else:
                        spans.append([a, z])
                held += [(o, a, text[a:z]) for a, z in spans]
                n += sum(z - a for a, z in spans)
                if n >= most:
                    yield flush()
                    held, n = [], 0
            if held:
                yield flush()

    return run


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings at a and b are equal."""
    out, step = np.zeros(len(a), bool), np.arange(length)
    for i in range(0, len(a), 1 << 14):
        out[i : i + (1 << 14)] = (text[a[i : i + (1 << 14), None] + step] == text[b[i : i + (1 << 14), None] + step]).all(axis=1)
    return out


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's hashes of strings -> the places of those that it has twice or more."""
    for to, rows in _grouped(batches, "to"):
        cols = []
        for _, part, data in rows:
            h, o, p = unpack(data)
            cols.append((np.cumsum(h, dtype=np.uint64), o, p, np.full(len(h), part)))
        h, o, p, part = (np.concatenate(x) for x in zip(*cols))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = order[np.append(same, False) | np.append(False, same)]
        if len(again):
            yield _batch([(to, STRINGS, q, pack(*own)) for q, own in _dealt(part[again], [o[again], p[again], h[again]])])


def _cut_strings(path: str, shards: int, length: int) -> Callable:
    """A part's places of strings whose hash recurs -> the strings, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches, "part"):
            held = []
            for o, text, places, keys in _places(path, part, rows):
                held += [(key, o, at, text[at : at + length]) for at, key in zip(places.tolist(), keys.tolist())]
                if len(held) * length >= 16 << 20:
                    yield _sent(held, shards, STRINGS, part)
                    held = []
            if held:
                yield _sent(held, shards, STRINGS, part)

    return run


def _same_strings(length: int) -> Callable:
    """A shard's strings -> all of equal ones but the first, as covered spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in _grouped(batches, "to"):
            _, o, p, _, part, text = _received(rows)
            kind = np.unique(text.reshape(-1, length).view(f"V{length}").ravel(), return_inverse=True)[1]
            by = np.lexsort((p, o, kind))
            later = by[np.append(False, kind[by[1:]] == kind[by[:-1]])]
            if len(later):
                yield _batch([(to, SPANS, q, pack(*_spans(a, b, length))) for q, (a, b) in _dealt(part[later], [o[later], p[later]])])

    return run


def _spans(o: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ord, start, bytes) for pack(): the strings at these places, those that meet or overlap joined."""
    by = np.lexsort((p, o))
    o, p = o[by], p[by]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (p[1:] > p[:-1] + length))[: len(o)])
    last = np.append(first[1:] - 1, len(o) - 1)
    return _unsigned(o[first]), p[first], p[last] + length - p[first]


def _hashes(t: np.ndarray, length: int) -> np.ndarray:
    """Of all strings of that length."""
    h, size, out, done = _BYTE[t], 1, None, 0
    while size <= length:
        if length & size:
            part = h[done : len(t) - length + done + 1]
            out = part if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + part
            done += size
        if 2 * size <= length:
            h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return _mixed(out)


def _candidates(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, ord_: np.ndarray, pos: np.ndarray, length: int):
    """The same without what can't repeat: bytes in no string whose hash occurs twice. What is left of a context is one or more contexts."""
    n = len(texts)
    if n < length:
        return None
    h = _hashes(texts, length)
    fits = np.ones(n, bool)
    fits[len(h) :] = False
    for back in range(1, length):  # strings that reach into the next context
        fits[np.maximum(ends - back, starts)] = False
    at = np.flatnonzero(fits)
    order = at[np.argsort(h[at])]
    same = h[order[1:]] == h[order[:-1]]
    again = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    if not len(again):
        return None
    step = np.zeros(n + 1, np.int32)
    step[again] += 1
    np.subtract.at(step, again + length, 1)
    keep = np.cumsum(step[:n]) > 0
    new = keep.copy()
    new[1:] &= ~keep[:-1]
    edge = starts[keep[starts]]
    new[edge] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(ends, first, "right")
    place = np.cumsum(keep)
    s = place[first] - 1
    return texts[keep], s, np.append(s[1:], place[-1]), ord_[row], pos[row] + first - starts[row]


def repeated(texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, ord_: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ord, start) of each string of `length` bytes in the contexts [starts, ends) of texts that has an earlier place; pos: where contexts start in their texts."""
    sa = suffix_array(texts)
    plcp = common_prefixes(texts, sa, length)
    run = np.cumsum(plcp[sa] < length)  # suffixes that share `length` bytes
    row = np.searchsorted(ends, sa, "right")
    inside = sa + length <= ends[np.minimum(row, len(ends) - 1)]
    sa, run, row = sa[inside], run[inside], row[inside]
    o, at = ord_[row], pos[row] + sa - starts[row]
    order = np.lexsort((at, o, run))
    o, at, run = o[order], at[order], run[order]
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1])[: len(run)])
    first = np.repeat(head, np.diff(np.append(head, len(run))))
    later = (o != o[first]) | (at != at[first])
    return o[later], at[later]


def _resolve(length: int, most: int = 2 << 20) -> Callable:
    """A shard's contexts -> covered spans. Contexts of one key are in one suffix array; an array has about `most` bytes, or one key's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, rows in _grouped(batches, "to"):
            key, o, p, n, part, text = _received(rows)
            ends = np.cumsum(n)
            order = np.argsort(key, kind="stable")
            key, o, p, n, part, starts = key[order], o[order], p[order], n[order], part[order], (ends - n)[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sums = np.cumsum(np.add.reduceat(n, new))
            for lo, hi in _runs(new, sums, len(key), most):
                own = np.concatenate([text[starts[j] : starts[j] + n[j]] for j in range(lo, hi)])
                e = np.cumsum(n[lo:hi])
                left = _candidates(own, e - n[lo:hi], e, o[lo:hi], p[lo:hi], length)
                if left is None:
                    continue
                so, sp = repeated(*left, length)
                if not len(so):
                    continue
                where = np.argsort(o[lo:hi], kind="stable")
                home = part[lo:hi][where[np.searchsorted(o[lo:hi][where], so)]]
                out = [(to, SPANS, q, pack(*_spans(a, b, length))) for q, (a, b) in _dealt(home, [so, sp])]
                yield _batch(out)

    return run


def _runs(new: np.ndarray, sums: np.ndarray, n: int, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of contexts, whole keys each, of about `most` bytes."""
    bounds = np.append(new[1:], n)
    at = done = 0
    while at < len(new):
        to = max(at + 1, int(np.searchsorted(sums, done + most, "right")))
        yield int(new[at]), int(bounds[to - 1])
        done, at = int(sums[to - 1]), to


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with _ord first and _text last: numbers in the order of the ids, all different.

    Ids that are whole numbers and all different are the order themselves. Otherwise rows are range-sorted by id (null
    first), then by the hash of their text, and numbered.
    """
    col = F.col(f"`{id_col}`")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.col(f"`{text_col}`").alias("_text")
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        n, ids = docs.agg(F.count("*"), F.count(col)).first()
        if n == ids and docs.groupBy(col).count().where("count > 1").isEmpty():
            return docs.select(col.cast("long").alias("_ord"), *rest, text)
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    ranged = docs.withColumn("_key", key).repartitionByRange(col.asc_nulls_first(), "_key", F.rand(3)).sortWithinPartitions(col.asc_nulls_first(), "_key")
    return stored(ranged.select(F.monotonically_increasing_id().alias("_ord"), *rest, text), "numbered")


def covered_spans(docs: DataFrame, path: str, *, id_col: str, text_col: str, length: int, many: int = 256) -> DataFrame:
    """Rows (part, kind, data) that tell each part's covered spans, and one FILE row for each part."""
    if length < 2 * K:
        raise ValueError(f"length must be {2 * K} or more")
    rows = _numbered(docs, id_col, text_col)
    n = max(1, rows.rdd.getNumPartitions())
    shards = 2 * n
    found = rows.mapInArrow(_scan(path, shards, length, many), ROWS)
    # shards and parts are numbered, so each is a partition of its own
    shuffled = lambda df, k, key, f: df.repartitionById(k, F.pmod(F.col(key), F.lit(k))).sortWithinPartitions(key).mapInArrow(f, ROWS)
    found = stored(shuffled(found, shards, "to", _match(many)), "matched")
    contexts = shuffled(found.where(F.col("kind") == WANTED), n, "part", _cut(path, shards, length))
    spans = shuffled(contexts, shards, "to", _resolve(length))
    often = stored(shuffled(found.where(F.col("kind") == OFTEN), n, "part", _cut_often(path, shards, length)), "often")
    again = shuffled(often.where(F.col("kind") == OFTEN), shards, "to", _recurring)
    strings = shuffled(shuffled(again, n, "part", _cut_strings(path, shards, length)), shards, "to", _same_strings(length))
    return found.where(F.col("kind").isin(COVERED, FILE)).union(spans).union(often.where(F.col("kind") == SPANS)).union(strings)


def _merge(spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (ord, start, end) in order, those that meet or overlap made one."""
    o, a, z = (np.concatenate(x) for x in zip(*spans))
    order = np.lexsort((a, o))
    o, a, z = o[order], a[order], z[order]
    new_ord = np.append(True, o[1:] != o[:-1])
    # the farthest end so far in each text: texts are set apart by more than any end
    gap = np.int64(int(z.max()) + 1)
    lift = (np.cumsum(new_ord) - 1) * gap
    far = np.maximum.accumulate(z + lift)
    new = np.append(True, (a + lift)[1:] > far[:-1]) | new_ord
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(o) - 1)
    return o[first], a[first], far[last] - lift[last]


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, path: str | None = None) -> DataFrame:
    """docs, one row per row, without the bytes that repeat an earlier place.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a text of smaller id, or earlier in
    the same text; strings are judged on the input, and matches never cross texts. Columns: doc_id, text (what is left;
    parts of characters at a cut go too), kept (its bytes as binary), n_bytes, n_removed, n_spans (long: maximal removed runs), spans (array of start and
    end), and all other columns of docs but those that have these names.

    Null and empty texts have nothing to remove; a null text stays null. Null ids come before all others. Rows that share an id are
    different texts, in the order of their text's hash, so of equal rows all but one are removed as far as they are long enough. An empty input gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or scratch(spark, "texts")
    own = ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans", "spans"]
    others = [c for c in docs.columns if c not in (id_col, text_col, *own)]
    # under names of their own, so that none clashes with those in use here
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`").alias(f"_other_{i}") for i, c in enumerate(others)], F.col(f"`{text_col}`").alias("text"))
    found = covered_spans(docs, path, id_col="doc_id", text_col="text", length=length)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    reach = length - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches, "part"):
            spans = []
            for kind, _, data in rows:
                if kind == COVERED:  # up to the text's end, as long as the context is
                    o, p = unpack(data)
                    p = p.astype(np.int64)
                    spans.append((_signed(o), np.maximum(0, p - reach), p + length))
                elif kind == SPANS:
                    o, a, n = unpack(data)
                    spans.append((_signed(o), a.astype(np.int64), (a + n).astype(np.int64)))
            so, sa, sz = _merge(spans) if spans else (np.zeros(0, np.int64),) * 3
            for b in _texts(path, part, None):
                raw = [None if x is None else x.encode() for x in b.column(b.num_columns - 1).to_pylist()]
                lo, hi = _looked_up(b.column(0).to_numpy(), so)
                kept, told = list(raw), [[] for _ in raw]
                for i in np.flatnonzero(hi > lo).tolist():
                    t, at, left = raw[i], 0, []
                    for x, y in zip(sa[lo[i] : hi[i]].tolist(), sz[lo[i] : hi[i]].tolist()):
                        y = min(y, len(t))
                        left.append(t[at:x])
                        told[i].append({"start": x, "end": y})
                        at = y
                    left.append(t[at:])
                    kept[i] = b"".join(left)
                size = lambda x: np.array([len(y or b"") for y in x], np.int64)
                text = [None if x is None else x.decode(errors="ignore") for x in kept]
                more = [pa.array(text, pa.string()), pa.array([x or b"" for x in kept], pa.binary()), pa.array(size(raw)), pa.array(size(raw) - size(kept)), pa.array([len(x) for x in told], pa.int64()), pa.array(told, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*b.columns[1:-1], *more], names=[*b.schema.names[1:-1], *own[1:]])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest]) + ", text string, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>"
    n = max(1, docs.rdd.getNumPartitions())
    return found.repartitionById(n, F.pmod("part", F.lit(n))).sortWithinPartitions("part").mapInArrow(run, schema).toDF("doc_id", *others, *own[1:])
