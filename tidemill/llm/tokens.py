"""Encoding whole texts with the tokenizers library, each distinct piece once per worker."""

from __future__ import annotations

import gc
import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: The byte alphabet of byte-level tokenizers: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)}
_POINTS = np.array([ord(_BYTES[b]) for b in range(256)], "<u4")

#: What is known of a byte: a letter, digit or sign (the apostrophe begins contractions and is none), a space, a line's end, or of an added token.
_OTHER, _LETTER, _DIGIT, _SIGN, _SPACE, _LINE, _ADDED = range(7)
_KINDS = np.array([_SPACE if b == 32 else _LINE if b == 10 else _OTHER if not 32 < b < 127 or b == 39 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN for b in range(256)], np.uint8)
#: Kinds of a byte and the next, as 8 * a + b, between which every pattern cuts.
_PARTED = np.array([0 < a <= _SIGN and 0 < b <= _SIGN and a != b for a in range(8) for b in range(8)])
#: First bytes of characters that are no white space; after the others the next bytes tell, three of which are one number here.
_SOLID = np.array([b > 32 and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
_BLANK = np.array([int.from_bytes(chr(x).encode()) for x in (0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])
_BLANKS = np.array([int.from_bytes(chr(x).encode()) for x in (0x85, 0xA0)])

#: The one tokenizer with a normalizer whose words are known to be pretokens once they are in lower case.
_LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}

#: Longer pieces are not kept, in bytes.
_LONG = 64


def _kind(told: dict) -> str:
    """How a tokenizer's texts can be cut: led, dropped, or whole (not at all)."""
    pre, norm, model = (told.get(k) or {} for k in ("pre_tokenizer", "normalizer", "model"))
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or told.get("truncation") or told.get("padding") or any(t.get(k) for t in told.get("added_tokens") or [] for k in ("normalized", "single_word", "lstrip", "rstrip")):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "led"
    if pre.get("type") == "Sequence" and norm.get("type") == "Sequence" and norm["normalizers"] == _LOWERED:
        first, *rest = pre["pretokenizers"]
        if first == _WORDS and len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not rest[0].get("use_regex") and not rest[0].get("add_prefix_space"):
            return "dropped"
    return "whole"


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 text; letters are those of ASCII and Latin-1, which compose with nothing before them."""
    kinds = _KINDS[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kinds[at] = kinds[at + 1] = _LETTER
    return kinds


def _gathered(ids: np.ndarray, from_: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ids[f : f + n] for each f and n, one after the other."""
    out = [ids[:0]]
    for k in range(0, len(sizes), 1 << 18):  # places take more memory than ids
        f, n = from_[k : k + (1 << 18)], sizes[k : k + (1 << 18)]
        ends = np.cumsum(n)
        at = np.repeat(f - (ends - n), n)
        at += np.arange(len(at))
        out.append(ids[at])
    return np.concatenate(out)


class ChunkEncoder:
    """Ids of whole texts, equal to those that the library gives for the text at once.

    A text is cut where the tokenizer's own pattern is sure to cut it too:
      * between letters, digits and signs (other than the apostrophe) of ASCII and Latin-1;
      * before a space that is followed by no white space, as patterns take a space along with the characters after it, or drop it;
      * before a line's end after one of these characters, and after it if such a character follows.
    Nothing is cut in and next to added tokens, nor before a space that such a one follows. The pieces of a batch are told apart by Arrow, with the
    pieces met before in front, and the library encodes those that are new. Any other kind of tokenizer encodes whole texts. `keep` bounds how many pieces
    are kept; it does not bear upon results.
    """

    def __init__(self, spec: str, keep: int = 600_000, dtype: str = "<u4"):
        self.lib, self.keep, self.dtype = Tokenizer.from_str(spec), keep, dtype
        told = json.loads(spec)
        self.kind = _kind(told)
        self.added = [t["content"].encode() for t in told.get("added_tokens") or [] if t["content"]]
        #: Pieces, where in `ids` theirs are, and in how many batches they were met.
        self.words = pa.array([], pa.binary())
        self.from_, self.sizes, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, dtype)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the pieces of texts begin; the texts lie one after the other, between bounds."""
        kinds = _kinds(data)
        text = data.tobytes() if self.added else b""
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                kinds[at : at + len(token)] = _ADDED
                at = text.find(token, at + 1)
        known = (kinds > 0) & (kinds <= _SIGN)
        cut = np.zeros(len(data) + 2, bool)
        cut[1 : len(data)] = _PARTED[kinds[:-1] << 3 | kinds[1:]]
        line = np.flatnonzero(kinds == _LINE)
        line = line[known[line - 1]]  # the first byte's neighbour does not matter: what follows a single line's end is cut from it
        cut[line] = True
        cut[line + 1] |= known[np.minimum(line + 1, len(data) - 1)]
        space = np.flatnonzero(kinds == _SPACE)
        last = np.zeros(len(data) + 1, bool)
        last[bounds] = True
        space = space[~last[space + 1]]
        after = data[space + 1]
        solid = _SOLID[after]
        rest = np.flatnonzero((after > 0x80) & ~solid)
        code = after[rest].astype(np.int64) << 16 | data[space[rest] + 2].astype(np.int64) << 8 | data[np.minimum(space[rest] + 3, len(data) - 1)]
        solid[rest] = ~np.isin(code, _BLANK) & ~np.isin(code >> 8, _BLANKS)
        cut[space[solid & (kinds[space + 1] != _ADDED)]] = True
        cut[bounds] = True
        return np.flatnonzero(cut[: len(data)])

    def _learn(self, new: pa.BinaryArray) -> None:
        """Appends ids of new pieces."""
        offsets = np.frombuffer(new.buffers()[1], np.int32, len(new) + 1, 4 * new.offset)
        data = np.frombuffer(new.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        letters = np.add.reduceat(_kinds(data) == _LETTER, starts, dtype=np.int64)
        alone = (letters > 0) & (letters == np.diff(offsets) - (data[starts] == 32))
        ids, sizes = [self.ids], np.zeros(len(new), np.int64)
        words = new.filter(pa.array(alone)).to_pylist()
        own: list[int] = []
        for k in range(0, len(words), 10_000):  # one pretoken each: straight to the library's model, in the byte alphabet
            text = b"\n".join(words[k : k + 10_000])
            if self.kind == "dropped":
                text = text.replace(b" ", b"").decode().lower().encode()
            told = list(map(self.lib.model.tokenize, _POINTS[np.frombuffer(text, np.uint8)].tobytes().decode("utf-32-le").split(_BYTES[10])))
            own += map(len, told)
            ids.append(np.array([t.id for x in told for t in x], self.dtype))
        sizes[alone] = own
        others = self._whole([x.decode() for x in new.filter(pa.array(~alone)).to_pylist()])
        sizes[~alone] = [len(x) // ids[0].itemsize for x in others]
        ids.append(np.frombuffer(b"".join(others), self.dtype))
        order = np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])
        from_ = np.empty(len(new), np.int64)
        from_[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        self.from_, self.sizes = np.append(self.from_, from_), np.append(self.sizes, sizes)
        self.ids, self.met = np.concatenate(ids), np.append(self.met, np.zeros(len(new), np.int64))

    def _trim(self) -> None:
        """Drops long pieces and, if there are too many, those that the fewest batches had."""
        lengths = np.diff(np.frombuffer(self.words.buffers()[1], np.int32, len(self.words) + 1, 4 * self.words.offset))
        left = np.flatnonzero(lengths <= _LONG)
        if len(left) > self.keep:
            left = np.sort(left[np.argsort(self.met[left], kind="stable")[-(self.keep // 2) :]])
            self.met //= 2
        if len(left) < len(self.words):
            self.ids = _gathered(self.ids, self.from_[left], self.sizes[left])
            self.words, self.sizes, self.met = self.words.take(pa.array(left)), self.sizes[left], self.met[left]
            self.from_ = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Each text's ids, little-endian, in self.dtype."""
        texts = list(texts)
        if self.kind == "whole":
            return self._whole(texts)
        gc.disable()  # pieces make no cycles, and there are many to look through
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = pa.array(texts, pa.string())
        bounds = np.frombuffer(whole.buffers()[1], np.int32, len(texts) + 1)
        if not len(texts) or not bounds[-1]:
            return [b""] * len(texts)
        starts = self._cuts(np.frombuffer(whole.buffers()[2], np.uint8, bounds[-1]), bounds)
        offsets = np.append(starts, bounds[-1]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), whole.buffers()[2]])
        # what was met before comes first, so its places in the dictionary are those it had
        told = pa.chunked_array([self.words, pieces]).dictionary_encode().chunks[-1]
        words, at = told.dictionary, told.indices.to_numpy()
        if len(words) > len(self.words):
            self._learn(words[len(self.words) :])
            self.words = words
        self.met += np.bincount(at, minlength=len(words)) > 0
        sizes = self.sizes[at]
        ids = memoryview(_gathered(self.ids, self.from_[at], sizes).view(np.uint8))
        ends = (np.append(0, np.cumsum(sizes))[np.searchsorted(starts, bounds)] * self.ids.itemsize).tolist()
        self._trim()
        return [bytes(ids[a:z]) for a, z in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def encoder(spec: str) -> ChunkEncoder:
    """One encoder for all tasks that a worker runs, so that each starts with the pieces of those before."""
    return ChunkEncoder(spec)
