"""The operators against brute force, on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import textwrap
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import components, decontam, kneser_ney, licenses, packing, quality, queries, rans, simhash, substrings, toxicity, warc

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(300)]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = sentence(70)
BASE = sentence(200)
TEXTS = [
    None, "", "   \n", "one", BASE, BASE, BASE.replace("a", "b", 1), sentence(50) + "\n" + PASSAGE + "\n" + sentence(40), PASSAGE.upper() + " " + sentence(9), sentence(3000), "é" * 150 + " 日本語 " * 40,
    "x" * 400, "ab " * 200, sentence(30) + "\nReleased under the MIT License.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0", "a\0b <|endoftext|> c", "### $$$ %%%", PASSAGE, "one",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names operators use for themselves
    return spark.createDataFrame([(i, t, "x", 1, "y", 2.0) for i, t in ROWS], "doc_id bigint, text string, spans string, n_words int, kept string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_decontamination(spark, docs, none):
    items = [(1, PASSAGE[: len(PASSAGE) // 2]), (2, "ONE"), (3, None), (4, ""), (5, PASSAGE), (5, "mit license"), (None, "x"), (None, "日本語 日本語")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for i, t in ROWS:
        w, hit, names = decontam.words_of((t or "").encode()), set(), set()
        for item, x in items:
            own = decontam.words_of((x or "").encode())
            n = min(10, len(own))
            for a in range(len(own) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == own[a : a + n]:
                        hit.update(range(b, b + n))
                        names.update([str(item)] if item is not None else [])
        want[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    for size in (8 << 20, 60):  # one block, and many
        got = decontam.leak_digest(decontam.find_leaks(docs, bench, block_bytes=size))
        assert {i: tuple(r)[1:] for i, r in by_id(got).items()} == want
    clean = by_id(decontam.decontaminate(docs, bench, block_bytes=100))
    assert set(want) - set(clean) == {i for i, x in want.items() if x[1] > 0.5 * x[0]}
    assert PASSAGE not in clean[7]["text"] and clean[7]["kept"] == "y" and clean[4]["text"] == BASE
    assert decontam.find_leaks(none, bench).count() == 0 == decontam.leak_digest(decontam.find_leaks(docs, bench.limit(0))).where("contaminated").count()


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs.union(docs.where("doc_id = 4")), path, capacity=64, with_ids=True).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in ROWS:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        cut = [(k, a, len(p := ids[a : a + 64]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p))) for k, a in enumerate(range(0, len(ids), 64))]
        assert sorted(pieces[i]) == sorted(cut * (2 if i == 4 else 1))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    # as many sequences as plain best-fit decreasing needs
    gaps: list[int] = []
    for n in sorted((n for own in bins.values() for _, n in own), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((64 if fit is None else fit) - n)
    assert len(bins) == len(gaps) and packing.pack_documents(none, path).count() == 0


def test_packing_builds_sequences(docs):
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    got = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) // 4 for r in got) == packed.agg(F.sum("length")).first()[0] == sum(p["length"] for r in got for p in r["pieces"])


def test_packing_refuses_lengths(spark):
    with pytest.raises(ValueError, match="length"):
        packing.best_fit(spark.createDataFrame([(1, 0)], "doc_id int, length int"), 10)


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), sum(g and not (a and gone[a - 1]) for a, g in enumerate(gone)), kept))
    return out


@pytest.mark.parametrize("length", [64, 100])
def test_substrings(docs, none, length):
    got = substrings.remove_repeated(docs, length=length)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == brute_repeats(ROWS, length)
    assert substrings.remove_repeated(none).count() == 0


def test_substrings_in_order_of_ids(spark):
    rng = random.Random(4)
    parts = [sentence(25, rng) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for i in rng.sample(range(-500, 500), 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeated(df).collect()) == brute_repeats(sorted(rows), 100)


def test_substrings_of_frequent_anchors(spark):
    """More contexts than `many` for one anchor, so that halves decide."""
    rng = random.Random(6)
    mid = sentence(9, rng)[:45]
    rows = [(i, sentence(20, rng) + rng.choice(["  left side, it is the same  ", "other "]) * 2 + mid + rng.choice(["right side, as long as that, too", "z"]) * 2 + sentence(20, rng)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    from unittest.mock import patch

    with patch.object(substrings.covered_spans, "__kwdefaults__", substrings.covered_spans.__kwdefaults__ | {"many": 3}):
        got = substrings.remove_repeated(df).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == brute_repeats(rows, 100)


def test_substrings_of_a_line_that_all_documents_share(spark):
    """One line in all documents, shorter than the length alone and longer with what some have around it; no key holds what grows with the documents."""
    rng = random.Random(16)
    line, near_by = sentence(30, rng)[:90], [sentence(4, rng) for _ in range(3)]
    rows = [(i, f"{sentence(30, rng)} {rng.choice([*near_by, sentence(4, rng)])}\n{line}\n{rng.choice([*near_by, sentence(5, rng)])} {sentence(20, rng)}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeated(df).collect()) == brute_repeats(rows, 100)
    most = []
    for n in (300, 1200):
        from tidemill.llm.common import scratch

        docs_ = spark.createDataFrame(rows[:n], "doc_id bigint, text string").repartition(3)
        path = scratch(spark, "texts")
        found = substrings._numbered(docs_, "doc_id", "text").mapInArrow(substrings._scan(path, 6, 100, 64), substrings.ROWS)
        got = found.where(F.col("kind") == substrings.ANCHORS).collect()
        counts = {}
        for r in got:
            for v in substrings.unpack(bytes(r["data"]))[0].tolist():
                counts[v] = counts.get(v, 0) + 1
        most.append(max(counts.values()))
    assert max(most) <= 3 * 64


def test_substrings_of_short_periodic_texts(spark):
    rows = [(i, ("ab" * 200)[: 95 + i]) for i in range(12)] + [(100 + i, "x" * (99 + 9 * i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeated(df).collect())
    assert got == brute_repeats(rows, 100)


def test_substrings_with_shared_ids(spark):
    df = spark.createDataFrame([(None, BASE), (1, BASE), (1, BASE), (2, None), (2, "x" * 120)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in substrings.remove_repeated(df).collect()))
    n = len(BASE.encode())
    assert got == [(0, 0), (1, n), (1, n), (2, 0), (2, 119)]  # of equal characters all but the first repeat


def test_licenses(docs, none):
    got = by_id(licenses.scan_licenses(docs))
    assert (got[13]["n_base"], got[13]["first_word"], got[13]["base_labels"], got[13]["score"]) == (2, 33, "mit", 1.0)
    assert got[13]["last_word"] == 38 and "mit" in got[13]["labels"].split(",")
    assert got[14]["base_labels"] == "apache-2" and got[0]["first_word"] is None and got[0]["labels"] == "" and got[1]["n_words"] == 0
    assert licenses.scan_licenses(none).count() == 0


def test_license_query_counts_the_contract_phrases(spark, tmp_path):
    """op4's exact columns, against a plain reading of the contract."""
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = [
        None, "", "Released under the MIT License.", "the mit license, MIT LICENSE, MIT licence", "UNDER\nTHE * MIT-License under the mit license under the mit", "under the mit licenses; under the é mit license", "cc by nc cc by-NC cc BY nc-sa 4.0",
        "Apache License, Version 2.0; apache license version 20; Apache\0License\tVersion\u00a02 apache_license_version_2", "x under the mit license apache license version 2 cc by nc", "under the MIT license " * 3000, *[t for t in TEXTS if t],
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op4_license_scan(spark, str(tmp_path)))
    for i, t in enumerate(texts):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in phrases.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
        places, labels = [k for k, _ in at], ",".join(sorted({x for _, x in at}))
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(own), len(at), min(places, default=None), max(places, default=None), labels), (i, t)
        assert {x for _, x in at} <= set(r["labels"].split(","))


def test_license_join_is_exact(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    templates = [(f"t{k}", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 7)))) for k in range(8)]
    rows = [(i, "\n".join(" ".join(rng.choice([*vocab, "other"]) for _ in range(rng.randint(0, 9))) for _ in range(3))) for i in range(60)]
    for across in (True, False):
        got = by_id(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=templates, phrases={}, threshold=0.7, across_lines=across))
        for i, t in rows:
            want = {}
            for line in [t] if across else t.split("\n"):
                own = line.split()
                for label, x in templates:
                    b, span = set(x.split()), math.ceil(1.25 * len(x.split()))
                    for at in range(max(1, len(own) - span + 1)):
                        n = len(set(own[at : at + span]) & b)
                        if n >= 0.7 * len(b) - 1e-9:
                            want[label] = max(want.get(label, 0), n / len(b))
            found = {}
            for m in got[i]["matches"]:
                found[m["label"]] = max(found.get(m["label"], 0), m["containment"])
            assert found == want and got[i]["score"] == max([0.0, *want.values()]) and got[i]["labels"] == ",".join(sorted(want))


def test_licenses_recall_and_precision(spark):
    """Notices as they stand in files: wrapped, behind comment marks, in capitals, with a few words lost; and texts that only look alike."""
    rng = random.Random(12)
    rows = []
    for label, text, *_ in licenses.TEMPLATES:
        for width, mark in ((72, " * "), (60, "# "), (78, "// "), (200, "")):
            own = text.upper() if mark == "# " else text
            if len(text.split()) > 40:
                words = own.split()
                for k in rng.sample(range(len(words)), len(words) // 20):
                    words[k] = rng.choice(WORDS)
                own = " ".join(words)
            body = "\n".join(mark + x for x in textwrap.wrap(own, width))
            rows.append((label, f"{sentence(40, rng)}\n{body}\n{sentence(60, rng)}"))
    planted = len(rows)
    vocabulary = sorted({w for _, x, *_ in licenses.TEMPLATES for w in x.split()})
    rows += [("", " ".join(rng.choice(vocabulary + WORDS * 2) for _ in range(400))) for _ in range(60)]
    rows += [("", t) for t in (
        "licensed grapes by the cc, under 4 roofs, scored 0 points", "All " + sentence(400, rng) + " rights " + sentence(400, rng) + " reserved " + sentence(400, rng), "The above conditions are met with the permission of all persons to whom the software is furnished",
        "You can redistribute the apples and modify the public terms of the foundation under either version of the general license", "Use of this name in commercial products without prior written permission is at your own risk",
    )]
    got = by_id(licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string"), phrases={}))
    found = [set(got[i]["labels"].split(",")) - {""} for i in range(len(rows))]
    hit = sum(label in f for (label, _), f in zip(rows[:planted], found))
    given = sum(map(len, found))
    print("recall", hit / planted, "precision", hit / given, [(r[0], f) for r, f in zip(rows, found) if f - {r[0]}][:9], [r[0] for r, f in zip(rows[:planted], found) if r[0] not in f])
    assert hit / planted >= 0.95 and hit / given >= 0.95


def test_licenses_across_lines(spark):
    """Notices as they are wrapped in source files."""
    texts = [
        "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n */",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
        "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted",
        "Licensed\n\nunder\nthe\nMIT\nLicense",
        "Licensed\n" + sentence(30) + "\nunder the\n" + sentence(30) + "\nMIT License",
    ]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(licenses.scan_licenses(df, phrases={}))
    for i, label in enumerate(["mit", "bsd", "gpl-3", "isc", "mit"]):
        assert label in got[i]["labels"].split(","), (i, got[i]["labels"])
    assert all(got[i]["score"] >= 0.8 for i in range(5)) and got[0]["matches"][0]["block"] == 1
    assert got[5]["labels"] == ""  # too far apart
    by_lines = by_id(licenses.scan_licenses(df, phrases={}, across_lines=False))
    assert all(not by_lines[i]["labels"] for i in (0, 1, 4))


def test_licenses_own_label_only(spark):
    """Licences with nearly the same notice: each text yields its own label, and that of others none."""
    foundation = licenses._FOUNDATION
    rows = [
        ("apache-2", "Licensed under the Apache License, Version 2.0."), ("gpl-3", "This work is licensed under the GNU General Public License, version 3."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
        ("mit", "Released under the MIT License."), ("proprietary", "All rights reserved."), ("", "Licensed under the Foo License"), ("", "Licensed under the Apache License, Version 1.1"), ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
        ("gpl-2,gpl-3", "This work is licensed under the GNU General Public License, version 2 or version 3"), ("gpl-3", "This work is licensed under version 3 of the GNU General Public License"), ("gpl-3", "This work is licensed under the GNU General Public License v3"),
        ("", "This work is licensed under the GNU Lesser General Public License, version 2.1"), ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3"), ("agpl-3", "Licensed under the GNU Affero General Public License, version 3"),
        ("cc-by", "Licensed under CC BY 4.0"), ("cc-by", "Licensed under CC BY 3.0"), ("cc-by-sa", "Licensed under CC BY-SA 4.0"), ("cc-by-nc", "Licensed under CC BY-NC-SA 4.0"), ("cc-by,cc-by-nc", "Licensed under CC BY 4.0 or CC BY-NC 4.0"), ("cc-by-nc", "Use 4.0 licensed under CC BY-\nNC 4.0"),
        ("gpl-2", foundation.format("", 2)), ("gpl-3", foundation.format("", 3)), ("lgpl-3", foundation.format("Lesser ", 3)), ("agpl-3", foundation.format("Affero ", 3)), ("lgpl-3", foundation.format("Lesser\n * ", 3).replace("License as", "License\n * as")),
        ("", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
        ("", "This is free software released into the public domain"), ("", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ]
    rows += [(label, text) for label, text, *_ in licenses.TEMPLATES] + [(label, text.replace(" ", "\n")) for label, text, *_ in licenses.TEMPLATES]
    got = by_id(licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")))
    assert [(r[1], got[i]["labels"]) for i, r in enumerate(rows)] == [(t, label) for label, t in rows]


def test_token_files(spark, docs, none, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = by_id(rans.encoded(docs, path, f"file://{tmp_path}/ids", with_ids=True))
    at = 0
    for i, t in ROWS:
        ids = b"".join(x.to_bytes(4, "little") for x in [*lib.encode(t or "", add_special_tokens=False).ids, 2])
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], bytes(got[i]["ids"])) == (at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4
    assert rans.encoded(none, path).count() == 0
    twice = rans.encoded(docs.where("doc_id = 3").union(docs.where("doc_id = 3")), path).orderBy("start").collect()
    assert [r["start"] for r in twice] == [0, twice[0]["n_tokens"]]


@pytest.mark.parametrize("in_order", [True, False])
def test_token_files_lie_in_order(spark, tmp_path, in_order):
    """Many small partitions of unlike sizes, so that one task writes several: ids ascend over all files by name, and in each."""
    path, n = public_tokenizers.path("byte_bpe_50k.json"), 600
    rows = [(i, f"text {i} " * (1 + (i * 7919) % 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id") if in_order else df.repartition(12)
    total = rans.write_ids(df, path, f"file://{tmp_path}/ids")
    at = 0
    files = sorted((tmp_path / "ids").glob("*.ids"))
    assert len(files) > 1 or not in_order
    model = rans.Model(rans.read_table(spark, f"file://{tmp_path}/ids"))
    seen = []
    for name in files:
        raw = name.read_bytes()
        with open(name, "rb") as f:
            for offset, size, first, ids in rans.index_of(f):
                assert first == at
                at += ids
                seen += list(rans.unpack_block(memoryview(raw)[offset : offset + size], model)[1])
    assert at == total and [int(x) for x in seen] == list(range(n))
    got = rans.read_ids(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == list(range(n))
    with pytest.raises(ValueError, match="whole number"):
        rans.encoded(spark.createDataFrame([("a", "b")], "doc_id string, text string"), path)


def test_order_is_seen(spark):
    make = lambda ids, n: spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string").coalesce(1).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    assert rans.lies_in_order(make(range(20), 3)) and rans.lies_in_order(make([1, 1, 2, 2, 2], 2)) and rans.lies_in_order(make([], 2))
    assert not rans.lies_in_order(make([None, 1, 2], 2)) and not rans.lies_in_order(make(range(20), 1).orderBy(F.desc("doc_id")))
    mixed = make(range(20), 1).where("doc_id > 9").union(make(range(20), 1).where("doc_id <= 10"))  # 10 is in both, partitions come the other way round
    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (make(range(50), 3), mixed, make(range(20), 1).union(make(range(5, 15), 1))):
        got = rans.encoded(df, path).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in df.collect())
        assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_toxicity(spark, docs, none):
    rng = random.Random(3)
    rows = [(i, sentence(rng.randint(20, 80), rng), 0) for i in range(300)]
    bad = ["zzyzx", "qwrtk", "xxvvq"]
    rows += [(1000 + i, " ".join(w if rng.random() > 0.1 else rng.choice(bad) for w in sentence(rng.randint(20, 80), rng).split()), 1) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = toxicity.score_toxicity(d.drop("toxic"), d.select("doc_id", "toxic")).join(d, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right / len(got) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    odd = toxicity.score_toxicity(docs, d.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id bigint, toxic int"))).collect()
    assert len(odd) == len(ROWS) and len({r["score"] for r in odd if r["doc_id"] in (0, 1, 2)}) == 1
    lone = toxicity.score_toxicity(docs, d.where("toxic = 0").select("doc_id", "toxic")).collect()
    assert {r["predicted"] for r in lone} == {0} and toxicity.score_toxicity(none, d.select("doc_id", "toxic")).count() == 0
    assert toxicity.score_toxicity(docs, d.limit(0).select("doc_id", "toxic")).count() == len(ROWS)
    kept = toxicity.without_toxic(d, d.select("doc_id", "toxic"))
    assert kept.columns == d.columns and kept.where("toxic = 0").count() > 280 and kept.where("toxic = 1").count() < 20


def test_quality(docs, none):
    got = by_id(quality.judge_quality(docs))
    for i, t in ROWS:
        w = (t or "").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        seen = {}
        for a in range(len(w) - 7):
            seen.setdefault(tuple(w[a : a + 8]), []).append(a)
        rep = {x for v in seen.values() if len(v) > 1 for a in v for x in range(a, a + 8)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and 0 <= r["quality"] <= 1 and not (r["base_failed"] and r["kept"])
    assert got[4]["kept"] and got[9]["kept"] and quality.judge_quality(none).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1500
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", "<b>"), (5, "u5", "<b>"), (6, "u6", None), (7, "u\r\n7", "é" * 600), (3, None, big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.archived(pages, f"file://{tmp_path}/w", archive_bytes=2000).collect())
    want = sorted((i, "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None, len(h), hashlib.sha1(h).hexdigest()) for i, h in ((i, (h or "").encode()) for i, _, h in rows))
    assert got == want and warc.archived(pages.limit(0)).count() == 0


def test_language_model(spark, docs, none):
    got = by_id(kneser_ney.lm_scores(docs))
    train = [i for i, _ in ROWS if zlib.crc32(str(i).encode()) % 5 != 1]
    from collections import Counter

    toks = {i: [*(t or "").lower().encode().split(), b"\n"] for i, t in ROWS}
    c = Counter(w for i in train for w in toks[i])
    import math

    n, v = sum(c.values()), len(c)
    for i, _ in ROWS:
        r = got[i]
        assert r["held_out"] == (i not in train) and r["n_tokens"] == len(toks[i]) and r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in toks[i])
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks[i]), rel_tol=1e-9) and r["score"] < 0
    assert kneser_ney.lm_scores(none).count() == 0
    held = docs.where("doc_id = 1")  # nothing to learn from
    assert [r["train_tokens"] for r in kneser_ney.lm_scores(held, folds=1, fold=0).collect()] == [0]


def test_warc_of_hot_payloads(spark):
    """Payloads above the bound and below it are dealt differently, with equal results."""
    rows = [(i, f"u{i}", ("<p>" + "abc"[i % 3] * 1200) if i % 4 else f"<p>{i}") for i in range(90)] + [(None, None, "<p>" + "b" * 1200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or -1) for r in warc.assign(pages, many=m).collect()) for m in (5, 22, 100_000)]
    assert got[0] == got[1] == got[2] and sum(x[1] == "revisit" for x in got[0]) == len(rows) - 23 - 3


def test_very_long_texts(spark, tmp_path):
    """A text beyond the slices and batches in which workers take texts, and a page beyond an archive's size."""
    rng = random.Random(21)
    parts = [sentence(2000, rng) for _ in range(9)]
    long = " ".join(rng.choice(parts) for _ in range(1100))
    assert len(long) > 8 << 20
    rows = [(1, long), (2, parts[0]), (3, long[: 1 << 20])]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for path, make in ((public_tokenizers.path("byte_bpe_50k.json"), lambda p: rans.encoded(d, p, with_ids=True)),):
        lib = Tokenizer.from_file(path)
        got = by_id(make(path))
        for i, t in rows:
            want = b"".join(x.to_bytes(4, "little") for x in [*lib.encode(t, add_special_tokens=False).ids, 2])
            assert bytes(got[i]["ids"]) == want
    packed = packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json"))
    per = by_id(packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most"), F.count("*").alias("pieces")))
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(per[i]["n"] == len(lib.encode(t, add_special_tokens=False).ids) + 1 and per[i]["most"] <= 2048 for i, t in rows)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeated(d.where("doc_id > 1")).collect()} == {i: n for i, _, n, _, _ in brute_repeats(rows[1:], 100)}
    whole = by_id(substrings.remove_repeated(d))
    assert whole[3]["n_removed"] == 1 << 20 and whole[1]["n_bytes"] == len(long)
    leaks = by_id(decontam.find_leaks(d, spark.createDataFrame([(7, parts[0])], "item_id bigint, text string")))
    assert leaks[2]["n_hit"] == 2000 == leaks[2]["n_words"] and leaks[1]["n_hit"] % 2000 == 0 < leaks[1]["n_hit"]
    assert by_id(simhash.near_duplicates(d).select("doc_id", simhash.fingerprint_hex().alias("f")))[1]["f"] == f"{int(simhash.fingerprints_of([long.encode()])[0]):016x}"
    assert by_id(kneser_ney.lm_scores(d, folds=7, fold=9))[1]["n_tokens"] == len(long.split()) + 1
    assert by_id(licenses.scan_licenses(d))[1]["n_words"] == len(long.split()) == by_id(quality.judge_quality(d))[1]["n_words"]
    assert len(toxicity.score_toxicity(d, spark.createDataFrame([(2, 1), (3, 0)], "doc_id bigint, toxic int")).collect()) == 3
    page = spark.createDataFrame([(1, "u", long * 2), (2, "v", long * 2), (3, "w", "x")], "page_id bigint, url string, html string")
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in warc.archived(page).collect()) == [(1, "revisit", 2 * len(long)), (2, "response", 2 * len(long)), (3, "response", 1)]


def test_warc_reads_what_was_ended(spark, tmp_path):
    """Archives that a lost attempt left behind are not read."""
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}" * 300) for i in range(40)], "page_id bigint, url string, html string")
    warc.write_warc(warc.assign(pages), f"file://{tmp_path}/w", archive_bytes=5000)
    names = sorted((tmp_path / "w").glob("*.warc.zst"))
    (tmp_path / "w" / "part-000000-999-00000.warc.zst").write_bytes(names[0].read_bytes())
    assert sorted(r["page_id"] for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()) == list(range(40)) and len(names) > 4
    with pytest.raises(ValueError, match="whole number"):
        warc.archived(pages.withColumn("page_id", F.col("url")))


def brute_kneser_ney(train, order):
    """token, words before it -> probability; plainly, from lists of n-grams."""
    from collections import Counter, defaultdict

    full = [tuple(["<s>"] * (order - 1) + w) for w in train]
    counts = {order: Counter(t[i - order + 1 : i + 1] for t in full for i in range(order - 1, len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    vocab = {w for t in train for w in t}
    cut, after = {}, {}
    for k, c in counts.items():
        t = [sum(v == m for v in c.values()) for m in (1, 2, 3, 4)]
        cut[k] = kneser_ney.discounts(*t)
        after[k] = defaultdict(Counter)
        for g, n in c.items():
            after[k][g[:-1]][g[-1]] = n

    def p(word, before, k=order):
        if k == 0:
            return 1 / (len(vocab) + 1)
        own = after[k].get(tuple(before[-k + 1 :] if k > 1 else ()))
        if not own:
            return p(word, before, k - 1)
        d = lambda n: cut[k][min(n, 3) - 1] if n else 0.0
        return ((own[word] - d(own[word])) + sum(map(d, own.values())) * p(word, before, k - 1)) / sum(own.values())

    return p


@pytest.mark.parametrize(("order", "shard_bytes"), [(3, 16 << 20), (3, 400), (2, 400), (4, 600)])
def test_language_model_against_plain_kneser_ney(spark, order, shard_bytes):
    """One shard and many; with many, frequent words and the beginning are hot."""
    import math

    rng = random.Random(order)
    text = lambda: " ".join(rng.choice(WORDS[: rng.choice([3, 12, 60])]) for _ in range(rng.randint(0, 30)))
    rows = [(i, text()) for i in range(120)] + [(500, None), (501, "Ab AB ab " * 400), (502, text() + " unseen words")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = by_id(kneser_ney.lm_scores(d, order=order, shard_bytes=shard_bytes))
    toks = {i: [*(t or "").lower().split(), "</s>"] for i, t in rows}
    p = brute_kneser_ney([w for i, w in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1], order)
    for i, w in toks.items():
        padded = ["<s>"] * (order - 1) + w
        want = sum(math.log10(p(padded[j], padded[:j])) for j in range(order - 1, len(padded)))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9), (i, got[i]["score"], want)


def test_language_model_sums_to_one(spark):
    rows = [(i, sentence(30)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    import numpy as np

    from tidemill.llm.common import scratch

    m = kneser_ney.train(d, scratch(spark, "ngrams"), shard_bytes=500)
    words = sorted({w for _, t in rows for w in t.split()})
    known = kneser_ney.Known(m)
    n, _ = known.of([" ".join([*words, "unseen", "another"]).encode()])
    every = np.append(n[:-1], 1)  # all known words, an unknown one, and the end
    for before in ((0, 0), (0, n[0]), (n[0], n[7]), (n[-1], n[3]), (n[3], n[-1])):
        count, base, p = m.probabilities([np.full(len(every), x) for x in before] + [every], known)
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all() and count.sum() == m.n_tokens and (count == 0).sum() == 1
        assert abs((10**base).sum() - 1) < 1e-9


def test_language_model_looks_up_words_once(spark, monkeypatch):
    """What a word is as a context is looked up once, not at each of its places; what is sent is sorted as one number."""
    import numpy as np

    from tidemill.llm.common import scratch

    d = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=60))) for i in range(20)], "doc_id long, text string")
    m, asked, find = kneser_ney.train(d, scratch(spark, "ngrams")), [], kneser_ney._find
    monkeypatch.setattr(kneser_ney, "_find", lambda arrays, prefix, key: asked.append((prefix, len(key))) or find(arrays, prefix, key))
    texts = [r["text"].encode() for r in d.collect()]
    n, *_ = m.score(texts, kneser_ney.Known(m))
    assert sum(k for x, k in asked if x == "contexts2") <= len(WORDS) + 2
    assert sum(k for _, k in asked) <= 3 * n.sum() + len(WORDS) + 2
    columns = [np.array([5, 0, 5]), np.array([1, 2, 0]), np.array([3, 3, 3])]
    key, bits = kneser_ney._joined(columns)
    assert np.argsort(key).tolist() == [1, 2, 0] and bits == 3 and kneser_ney._joined([columns[0] << 30] * 2) is None
    own = kneser_ney.WordNumbers()
    words, sizes = own.of([b" A b\x1c\n\x0bb ", b"", b"\t", "Ä a\u00a0 a ".encode()])
    assert words.tolist() == [2, 3, 4, 5, 6, 2] and sizes.tolist() == [3, 0, 0, 3]


def test_language_model_misses_no_shard(spark, tmp_path):
    """A file that is gone is an error, not a count of zero; large counts are kept whole."""
    import numpy as np

    d = spark.createDataFrame([(i, sentence(30)) for i in range(40)], "doc_id bigint, text string")
    m = kneser_ney.train(d, f"file://{tmp_path}/m", shard_bytes=500)
    next((tmp_path / "m").glob("own-*")).unlink()
    with pytest.raises(FileNotFoundError):
        m.score([" ".join(WORDS).encode()] * 2, kneser_ney.Known(m))
    with pytest.raises(ValueError):
        kneser_ney.train(d, "unused", order=1)
    v = np.array([3, 254, 255, 1 << 40, 0, 1 << 33])
    assert (kneser_ney._counts(kneser_ney._small("n", v), "n", np.array([5, 3, 2, 1, 0])) == v[[5, 3, 2, 1, 0]]).all()


def test_scratch_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from tidemill.llm import common

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(fake)


def brute_classes(rows, max_bits=3):
    fps = {i: int(simhash.fingerprints_of([(t or "").encode()])[0]) for i, t in rows}
    ids, root = sorted(fps), {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id")
    assert {r["doc_id"]: (r["f"], r["component_id"]) for r in got.collect()} == brute_classes(ROWS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute_classes(ROWS).values()})
    assert simhash.keep_one(docs.union(docs)).count() == kept.count() and simhash.near_duplicates(none).count() == 0


def test_keep_one_of_each_class(spark):
    """Ids that are null or shared by different texts: no class goes without a document."""
    a, b, c, d, e = (sentence(200) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (2, c), (2, d), (None, d), (3, e), (3, a[:400]), (3, "")]
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.keep_one(make(rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, make([(None, a), (None, b), (1, c), (2, d), (3, e), (3, a[:400]), (3, "")]).collect()))


def test_thresholds_see_all_ordinary_windows(monkeypatch):
    rng, seen, quantile = random.Random(5), [], toxicity.np.quantile
    texts = [sentence(400, rng).encode() for _ in range(4000)] + [(sentence(30, rng) + " vile scum " * 3).encode() for _ in range(60)]
    toxic = [i >= 4000 for i in range(len(texts))]
    monkeypatch.setattr(toxicity.np, "quantile", lambda x, q: seen.append(sorted(x)) or quantile(x, q))
    model = toxicity.fit(texts, toxic)
    gains = model.gains([w for t, bad in zip(texts, toxic) if not bad for w in toxicity.windows(t, model.size)])
    assert len(gains) > 50_000 and seen == [sorted(gains)]


@pytest.mark.parametrize("long_list", [20_000, 5])
def test_simhash_finds_all_links(spark, long_list):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(12):
            g = f
            for _ in range(rng.randint(1, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), long_list=long_list)
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    want = {f: f for f in signed}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                want[y] = x
    assert {f: root.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_simhash_of_long_lists():
    """Lists far above what is compared pair by pair: same classes as brute force, and no quadratic number of comparisons."""
    import numpy as np

    rng = random.Random(9)
    fps = {rng.getrandbits(14) << 20 | rng.getrandbits(3) for _ in range(900)} | {rng.getrandbits(40) for _ in range(300)}
    f = np.array(sorted(fps), np.uint64)
    links = pa_rows(simhash._links(np.zeros(len(f), np.int64), f.view(np.int64), 3))

    def classes(pairs):
        root = list(range(len(f)))
        for a, b in pairs:
            simhash_a, simhash_b = simhash._root(root, a), simhash._root(root, b)
            root[max(simhash_a, simhash_b)] = min(simhash_a, simhash_b)
        return [simhash._root(root, i) for i in range(len(f))]

    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    brute = [(i, j) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 3) + i + 1]
    assert classes([(at[u], at[v]) for u, v in links]) == classes(brute) and len(links) < len(f)


def pa_rows(batches):
    return [pair for b in batches for pair in zip(*[c.to_pylist() for c in b.columns])]


RESERVED = ["_ord", "_text", "_key", "_kept", "_hash", "_row", "_part", "_id", "_label", "fp", "salt", "kept_", "part"]


def test_names_in_use_are_no_trouble(spark):
    """Columns that have the names which operators use inside pass through, also where ids repeat."""
    rows = [(1, BASE, *RESERVED), (1, BASE, *RESERVED), (2, PASSAGE, *RESERVED), (None, None, *RESERVED)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in RESERVED))
    for out in (substrings.remove_repeated(df), simhash.keep_one(df), decontam.decontaminate(df, spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")), packing.best_fit(df.selectExpr("*", "7 AS length"), 20), toxicity.without_toxic(df, spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int"))):
        got = out.collect()
        assert got and all(r[c] == c for r in got for c in RESERVED)
    assert len(simhash.keep_one(df).collect()) == 3


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (300, 300)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == dict.fromkeys(range(101), 0) | {200: 200, 201: 200}
