"""Benchmark decontamination with a generalised suffix automaton of the normalised items.

Normalisation: A-Z become a-z; words are maximal runs of digits, letters a-z and characters beyond ASCII.
The items' word sequences make up one automaton, with numbered words as its alphabet. A document's words are
streamed through it; the automaton's state tells the longest suffix read so far that occurs in any item. Where that
length reaches the window, the window's words are hit.

A word that no item has, or a pair of neighbours that stands in no item, ends every match, so the stream is cut
there beforehand, in whole batches, and only runs long enough for a window enter the automaton.

Benchmarks are read in blocks of bounded size (`block_bytes`), one automaton each, built and broadcast one after the other; each
adds its hits to the documents' rows, so no shuffle is needed whatever the number of blocks. A worker holds the automata of 16 blocks at most.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, binary, slices, small_batches, stored

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPANS = "array<struct<first:int,last:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class _Growing:
    """The automaton while it is built: a dictionary of transitions for each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, seq: list[int]) -> None:
        last = 0
        for c in seq:
            last = self._extend(last, c)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy


class SuffixAutomaton:
    """The generalised suffix automaton of some word sequences, and which items hold each of its windows.

    It is kept in flat arrays: a state's transitions, by word number, stand in a row, and so do the items of a window.
    Items without an id have windows like any other, but are not named.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        seqs = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for item, words in items if words]
        grown = _Growing()
        for _, seq in seqs:
            grown.add(seq)
        self.link, self.length, self.first = array("i", grown.link), array("i", grown.length), array("i", [0])
        self.word, self.to = array("i"), array("i")
        for k, own in enumerate(grown.next):
            for c in sorted(own):
                self.word.append(c)
                self.to.append(own[c])
            self.first.append(len(self.word))
            grown.next[k] = {}  # not needed any more
        del grown
        self.names: list[str] = sorted({item for item, _ in seqs if item is not None})
        number = {item: k for k, item in enumerate(self.names)}
        held: set[tuple[int, int, int]] = set()
        for item, seq in seqs:
            n = min(window, len(seq))
            held.update((self.shortened(state, n), n, number.get(item, -1)) for _, state, length in self.lengths(seq) if length >= n)
        rows = np.array(sorted(held), np.int64).reshape(-1, 3)
        del held
        #: windows as state * (window + 1) + length, ascending; where each one's items start; items
        self.windows, starts = np.unique(rows[:, 0] * (window + 1) + rows[:, 1], return_index=True)
        self.starts, self.items, self.window = np.append(starts, len(rows)).astype(np.int32), rows[:, 2].astype(np.int32), window
        self.sizes = sorted(set(rows[:, 1].tolist()))
        v = max(1, len(self.vocab))
        self.pairs = np.array(sorted({a * v + b for _, seq in seqs for a, b in zip(seq, seq[1:])}), np.int64)

    def lengths(self, seq: list[int]) -> Iterator[tuple[int, int, int]]:
        """For each place: the place, the state, and the length of the longest match that ends there."""
        first, word, to, link, length = self.first, self.word, self.to, self.link, self.length
        state = n = 0
        for i, c in enumerate(seq):
            while True:
                end = first[state + 1]
                at = bisect_left(word, c, first[state], end)
                if at < end and word[at] == c:
                    state = to[at]
                    n += 1
                    break
                if not state:
                    break
                state = link[state]
                n = length[state]
            yield i, state, n

    def shortened(self, state: int, n: int) -> int:
        """The state of the last n words of a match that is at least as long."""
        link, length = self.link, self.length
        while link[state] >= 0 and length[link[state]] >= n:
            state = link[state]
        return state

    def hits(self, seq: list[int]) -> Iterator[tuple[int, int, list[str]]]:
        """(first, last, named items) of each window that occurs in seq."""
        for i, state, n in self.lengths(seq):
            for size in self.sizes:
                if n < size:
                    break
                key = self.shortened(state, size) * (self.window + 1) + size
                at = int(np.searchsorted(self.windows, key))
                if at < len(self.windows) and self.windows[at] == key:
                    yield i - size + 1, i, [self.names[k] for k in self.items[self.starts[at] : self.starts[at + 1]].tolist() if k >= 0]

    def runs(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """[from, to) of the runs in which each neighbouring pair occurs in an item and a window fits. starts: each document's first place."""
        if not len(ids) or not self.sizes:
            return
        v = len(self.vocab)
        joined = np.zeros(len(ids), bool)  # with the place before
        joined[1:] = (ids[1:] >= 0) & (ids[:-1] >= 0)
        joined[starts[starts < len(ids)]] = False
        at = np.flatnonzero(joined)
        key = ids[at - 1] * v + ids[at]
        if len(self.pairs):
            joined[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        else:
            joined[at] = False
        first = np.flatnonzero((ids >= 0) & ~joined)
        stop = np.append(joined, False)
        ends = np.flatnonzero(((ids >= 0) & ~stop[1:])) + 1
        keep = ends - first >= self.sizes[0]
        yield from zip(first[keep].tolist(), ends[keep].tolist())


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[SuffixAutomaton]:
    """One automaton after the other, each for about block_bytes of item text. Only one block's text and automaton are held at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield SuffixAutomaton([(r[0], words_of((r[1] or "").encode())) for r in items.where(part == k).toLocalIterator()], window)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 10, block_bytes: int = 2 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Where benchmark windows occur in documents: one row per row of docs.

    Columns: doc_id, text, n_words (long), n_hit (long: words inside any occurrence of a window), spans (maximal
    runs of hit words: first and last, from 0), items (ids of the items whose windows occur, as strings, sorted),
    and the columns of docs named in keep.

    Null and empty texts have no words and no hits. Items without words are ignored; an item shorter than the window
    is a window as a whole. The windows of items without an id (null) are hit like any other, but items does not name them. Equal items are all named. Repeated documents give repeated rows. An empty benchmark
    gives no hits, an empty docs an empty result. Columns that aren't named are not looked at.
    """
    out = _marked(docs, benchmark, id_col, text_col, window, block_bytes, keep)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return out.select(*[F.col(f"`{c}`") for c in keep], "doc_id", "text", "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _marked(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int, keep: tuple[str, ...], then=None, schema: str | None = None, together: int = 16) -> DataFrame:
    """keep, doc_id, n_words, spans, items and text of each row; or, of that schema, what `then` makes of such batches in the same worker.

    A worker goes through the automata of `together` blocks at once; between these the rows are stored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{id_col}`").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(_SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.col(f"`{text_col}`").alias("text"))
    shared, blocks = [], _blocks(benchmark, window, block_bytes)
    automaton = next(blocks)
    while automaton is not None:
        shared.append(spark.sparkContext.broadcast(automaton))
        automaton = next(blocks, None)  # the one before lives on in its broadcast only
        find = _finder(shared)
        if automaton is None:
            return out.mapInArrow((lambda batches: map(then, find(batches))) if then else find, schema or out.schema)
        if len(shared) == together:
            out, shared = stored(out.mapInArrow(find, out.schema), "leaks"), []


def _finder(shared: list):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: list[SuffixAutomaton] = [x.value for x in shared]
        for batch in slices(batches):
            texts = binary(batch.column("text"))
            words: list[bytes] = []
            starts = []
            for t in texts:
                starts.append(len(words))
                words += t.translate(ALNUM).split()
            bounds = np.array(starts + [len(words)], np.int64)
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            found: dict[int, tuple[set[tuple[int, int]], set[str]]] = {}
            for a in automata:
                ids = np.fromiter(map(a.vocab.get, words, repeat(-1)), np.int64, len(words))
                for lo, hi in a.runs(ids, bounds):
                    row = None
                    for first, last, of in a.hits(ids[lo:hi].tolist()):
                        if row is None:
                            row = int(np.searchsorted(bounds, lo, "right")) - 1
                            own = found.setdefault(row, (set(), set()))
                        own[0].add((lo + first - starts[row], lo + last - starts[row]))
                        own[1].update(of)
            for row, (more, of) in found.items():
                more |= {(s["first"], s["last"]) for s in spans[row] or ()}
                spans[row] = [{"first": x, "last": y} for x, y in merged(more)]
                items[row] = sorted(of.union(items[row] or ()))
            cols = [*batch.columns[:-4], pa.array(np.diff(bounds)), pa.array(spans, batch.column("spans").type), pa.array(items, batch.column("items").type), batch.column("text")]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return find


def merged(spans: set[tuple[int, int]]) -> list[list[int]]:
    """Closed spans, those that meet or overlap made one."""
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1] + 1:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 10, max_coverage: float = 0.5, block_bytes: int = 2 << 20) -> DataFrame:
    """docs without the spans that occur in the benchmark.

    A span of hit words goes, with what stands between its words; what stands around it stays, with a line's end in
    its place. A document more than `max_coverage` of whose words are hit goes as a whole. Columns: those of docs, then n_words, n_hit and
    removed (what was cut out, joined by line ends; null where nothing was); docs' own columns of these names are dropped. Nulls, ties, repeated rows and empty inputs: see find_leaks.
    """
    own = ("n_words", "n_hit", "removed", "spans", "items")
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col, *own))
    order = [F.col(f"`{c}`") if c in rest else F.col("doc_id" if c == id_col else "text").alias(c) for c in docs.columns if c not in own]
    # names that find_leaks gives are free, as id_col and text_col are set apart
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_kept_{i}") for i, c in enumerate(rest)])
    kept = tuple(f"_kept_{i}" for i in range(len(rest)))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, spans = batch.column("n_words").to_pylist(), [x or [] for x in batch.column("spans").to_pylist()]
        hit = [sum(x["last"] - x["first"] + 1 for x in own) for own in spans]
        rows = [i for i in range(len(n)) if hit[i] <= max_coverage * max(n[i], 1)]
        batch = batch.take(pa.array(rows, pa.int64()))
        texts, removed = batch.column("text").to_pylist(), [None] * len(rows)
        for k, i in enumerate(rows):
            if spans[i]:
                texts[k], removed[k] = without(texts[k].encode(), [(x["first"], x["last"]) for x in spans[i]])
        new = {"text": pa.array(texts, pa.string()), "spans": pa.array([hit[i] for i in rows], pa.int64()), "items": pa.array(removed, pa.string())}
        return pa.RecordBatch.from_arrays([new.get(c, x) for c, x in zip(batch.schema.names, batch.columns)], names=[{"spans": "n_hit", "items": "removed"}.get(c, c) for c in batch.schema.names])

    kind = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = ", ".join([*[f"{c} {kind[c]}" for c in kept], f"doc_id {kind['_id']}, n_words long, n_hit long, removed string, text string"])
    out = _marked(plain, benchmark, "_id", "_text", window, block_bytes, kept, cut, schema)
    for i, c in enumerate(rest):
        out = out.withColumnRenamed(f"_kept_{i}", c)
    return out.select(*order, "n_words", "n_hit", "removed")


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[str, str]:
    """The text without the words of the closed spans, and those."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, gone, at = [], [], 0
    for first, last in spans:
        a, b = places[first][0], places[last][1]
        kept.append(text[at:a])
        gone.append(text[a:b])
        at = b
    kept.append(text[at:])
    return b"\n".join(kept).decode(), b"\n".join(gone).decode()


def leak_digest(leaks: DataFrame) -> DataFrame:
    """The contract's columns of find_leaks()."""
    return leaks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
