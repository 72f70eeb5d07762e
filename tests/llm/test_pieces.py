"""Small parts, without Spark."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import kneser_ney, quality, rans, simhash, warc
from tidemill.llm.decontam import SuffixAutomaton, words_of
from tidemill.llm.packing import plan
from tidemill.llm.simhash import key_positions
from tidemill.llm.suffix_array import _small, common_prefixes, suffix_array
from tidemill.llm.tokens import ChunkEncoder

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", " ", "　", "'s", "12", "é", "ß", "İ", "Σ", "é", "́", "!", "<|endoftext|>", "\0", "日本", "the", ".", "Fo.", "x\ny", "$$$"]


def test_pieces_are_looked_up_once():
    """A batch's texts give each distinct piece to the dictionary once, however often it occurs."""
    asked = []

    class Told(dict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)

    enc = ChunkEncoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
    enc.seen = Told()
    words = ["alpha", "bêta", "gamma,", "delta.\nEta", "42", "x"]
    texts = [" ".join(words * 500), "", "  a  b", " ".join(words), "one"]
    assert enc.encode(texts) == [np.array(enc.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(asked) < 50


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_encoded_once_whatever_signs_are_by_them(name):
    """The library gets letters, digits and signs apart, each once, also in later batches; texts that must not be cut so have its ids all the same."""
    asked = []

    class Model:
        def tokenize(self, text):
            asked.append(text)
            return lib.model.tokenize(text)

    class Lib:
        model = Model()

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return lib.encode_batch_fast(texts, **options)

    enc = ChunkEncoder(open(public_tokenizers.path(name)).read())
    lib, enc.lib = enc.lib, Lib()
    words = ["alpha", "bêta", "Gamma", "delta", "éta", "Iota", "kappa", "x", "Ÿy", "Zürich"]
    texts = [f"one {a}-{b}.\n{c}!" for a in words for b in words for c in ("7", *words)]
    odd = ["a \n <|endoftext|> b", "a  <|endoftext|>b <|endoftext|", "a \u3000b \xa0c \u2014 d", "x \n\ny\n z", "it's,'s!'ll 'tis", "e\u0301,\u0301 =\u0338", "1²3½ \x85a \x1cb", " \n", " ", "\n", ""]
    want = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts + odd]
    assert enc.encode(texts) == want[: len(texts)]
    assert len(asked) < 60
    assert enc.encode(texts[::2]) == want[: len(texts) : 2]
    assert len(asked) < 60
    assert enc.encode(odd) == want[len(texts) :]


@pytest.mark.parametrize("change", [{"normalizer": None}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"id": 49407, "content": "abc", "single_word": False, "lstrip": False, "rstrip": False, "normalized": True, "special": False}]}])
def test_other_tokenizers_are_not_cut(change):
    """A tokenizer that is not just the one whose words are known gives the library's ids."""
    enc = ChunkEncoder(json.dumps(json.load(open(public_tokenizers.path("word_bpe_49k.json"))) | change))
    texts = ["Foo BAR foo", "Às, ÀB", "abc ABC xabcx. Abc"]
    assert enc.encode(texts) == [np.array(enc.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    enc = ChunkEncoder(open(public_tokenizers.path(name)).read(), keep=50)
    rng = random.Random(1)
    for _ in range(40):
        texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(100)]
        assert enc.encode(texts) == enc._whole(texts)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=60).map(str.encode), st.text("abc", min_size=1, max_size=4).map(lambda x: x.encode() * 12)))
def test_suffix_array(b):
    t = np.frombuffer(b, np.uint8)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    assert suffix_array(t).tolist() == want == _small(list(b), 256)
    p = common_prefixes(t, np.array(want, np.int64), 20)
    for x, y in zip(want[1:], want):
        k = 0
        while k < 20 and max(x, y) + k < len(b) and b[x + k] == b[y + k]:
            k += 1
        assert p[x] == k


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc ", max_size=12), max_size=6), st.text("abc ", max_size=40), st.integers(1, 4))
def test_automaton(items, doc, window):
    items = [(str(i), words_of(" ".join(x).encode())) for i, x in enumerate(items)]
    doc = words_of(" ".join(doc).encode())
    want = set()
    for name, ws in items:
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == ws[i : i + n]:
                    want.add((j, j + n - 1, name))
    a = SuffixAutomaton(items, window)
    ids = np.array([a.vocab.get(w, -1) for w in doc], np.int64)
    got = {(lo + x, lo + y, name) for lo, hi in a.runs(ids, np.array([0, len(doc)])) for x, y, of in a.hits(ids[lo:hi].tolist()) for name in of}
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_plan_is_best_fit_decreasing(counts):
    bins: list[int] = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        fit = [i for i, gap in enumerate(bins) if gap >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(50 - n)
    used: dict[int, list[tuple[int, int]]] = {}
    ranks: dict[int, int] = {}
    for n, lo, hi, first, per, offset in plan(counts, 50):
        assert lo == ranks.get(n, 0)
        ranks[n] = hi
        for r in range(lo, hi):
            used.setdefault(first + (r - lo) // per, []).append((offset + n * ((r - lo) % per), n))
    assert ranks == counts and sorted(used) == list(range(len(bins)))
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 50


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(1, 40))
def test_rans_round_trip(ids, lanes):
    ids = np.array(ids, np.uint32)
    model = rans.Model(rans.quantised(np.bincount(ids, minlength=1)))
    states, words = rans.encode_ids(ids, model, lanes)
    assert rans.decode_ids(len(ids), states, words, model).tolist() == ids.tolist()


def test_rans_detects_damage():
    ids = np.arange(5000, dtype=np.uint32) % 7
    model = rans.Model(rans.quantised(np.bincount(ids)))
    raw = bytearray(rans.pack_block(ids, 9, rans.pack_docs([3, None], [2000, 3000]), 2, model))
    first, docs, lengths, got = rans.unpack_block(memoryview(bytes(raw)), model)
    assert (first, docs, lengths.tolist(), got.tolist()) == (9, [3, None], [2000, 3000], ids.tolist())
    raw[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.unpack_block(memoryview(bytes(raw)), model)


def test_quantised_keeps_rare_symbols():
    counts = np.array([10**12, 1, 0, 5, 10**9])
    f = rans.quantised(counts)
    assert f.sum() == 1 << rans.SCALE and (f[counts > 0] > 0).all() and f[2] == 0


@pytest.mark.parametrize("size", [3, 4])
def test_keys_cover_all_pairs(size):
    from itertools import combinations

    assert all(any(set(k) <= set(c) for k in key_positions(size)) for c in combinations(range(8), 5))


def test_fingerprints():
    import xxhash

    texts = [b"", b" ", b"One", b"a b c d e", b"x y z " * 400]
    for t, got in zip(texts, simhash.fingerprints_of(texts)):
        w = t.lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert got == sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("words", [40, 100_000])
def test_gram_packing(words):
    """Dictionaries by marks and by sorting."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, words, np.uint64)
    columns, c = [rng.integers(0, words, 500) for _ in range(3)], rng.integers(1, 300, 500)
    got = kneser_ney.unpack_grams(kneser_ney.pack_grams(columns, c, hashes))
    assert sorted(zip(*map(list, got))) == sorted(zip(*[hashes[x] for x in columns], c))


def test_gram_tables():
    """Hashes are found, others are not; counts beyond a byte are whole."""
    rng = np.random.default_rng(2)
    for n in (0, 1, 15, 16, 40, 5000):
        key = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        count = rng.integers(0, 600, len(key))
        table = kneser_ney._hashed("x", key, ("n", count))
        asked = np.concatenate([key[::3], rng.integers(0, 1 << 63, 50, np.uint64)])
        at, place = kneser_ney._find(table, "x", asked)
        assert at.tolist() == list(range(len(key[::3]))) and (kneser_ney._counts(table, "x.n", place) == count[::3]).all()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.one_of(st.none(), st.text(max_size=9)), st.binary(max_size=50), st.booleans()), max_size=12))
def test_warc_round_trip(rows):
    import hashlib

    records = [warc.record(i, u, p, hashlib.sha1(p).hexdigest(), "revisit" if r else "response", 7 if r else None) for i, u, p, r in rows]
    raw = warc.archive(records)
    assert int.from_bytes(raw[:4], "little") == warc.SKIPPABLE
    for (i, _, p, r), (head, block) in zip(rows, list(warc.read_archive(raw)), strict=True):
        assert head["warc-type"] == ("revisit" if r else "response") and head["warc-record-id"] == f"<urn:x-page:{i}>"
        assert head["x-payload-length"] == str(len(p)) and block == warc.HTTP + (b"" if r else p)


def test_estimates():
    share, tables = quality.estimate([((1, 1, 1), 900), ((-1, -1, 1), 80), ((1, 1, -1), 20)])
    assert share == quality.BALANCE and tables[0][-1][1] > tables[0][-1][0]
    assert quality.estimate([])[1] == []
