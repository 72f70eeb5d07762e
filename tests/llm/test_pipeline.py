"""The pipeline against a plain version of each of its stages, and its queries' contracts."""

import duckdb
import public_tokenizers
import pytest
from test_operators import brute_classes, brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline as P
from tidemill.llm import decontam, queries, toxicity
from tidemill.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, sf):
    from tidemill.llm.common import stored

    docs, out = table(spark, sf, "documents"), {}
    out["input"] = docs
    for name, f in P.STAGES:
        docs = out[name] = stored(f(spark, docs, sf), name)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_columns(stages, spark, sf):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == P.COLUMNS == stages["input"].columns
    assert sorted(map(tuple, P.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, stages["packing"].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_toxicity_stage(spark, sf, stages):
    scores = toxicity.score_toxicity(stages["input"], table(spark, sf, "labels")).where("predicted = 0")
    assert [i for i, _ in texts(stages["toxicity"])] == sorted(r["doc_id"] for r in scores.collect())


def test_near_duplicate_stage(stages):
    before, after = texts(stages["toxicity"]), texts(stages["simhash"])
    kept = {c for _, c in brute_classes(before).values()}
    assert after == [(i, t) for i, t in before if i in kept]


def test_substring_stage(stages):
    want = [(i, kept.decode(errors="ignore")) for i, n, gone, _, kept in brute_repeats(texts(stages["simhash"]), 100) if not gone or gone < n]
    assert texts(stages["substrings"]) == want


def test_decontamination_stage(spark, sf, stages):
    bench = [decontam.words_of((r["text"] or "").encode()) for r in table(spark, sf, "benchmark").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in bench if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    want = []
    for i, t in texts(stages["substrings"]):
        w, hit = decontam.words_of(t.encode()), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
        if len(hit) <= 0.5 * max(1, len(w)):
            spans = decontam.merged({(x, x) for x in hit})
            want.append((i, decontam.without(t.encode(), [tuple(s) for s in spans])[0] if spans else t))
    assert texts(stages["decontamination"]) == want


def test_benchmark_passages_without_an_id_go(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(12))
    spark.createDataFrame([(None, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, passage, "en", "web", 0), (2, "another text", "en", "web", 12)]
    got = P.cut_benchmarks(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), str(tmp_path))
    assert texts(got) == [(2, "another text")]


def test_packing_stage(stages):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in stages["packing"].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts(stages["decontamination"])}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    q = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(map(str, q.fetchall())) == sorted(str(tuple(r)) for r in queries.queries()[name](spark, sf).select(*names).collect())


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_registered_queries(spark, sf, name):
    """The contracts' columns, and a row for each row of the table (for packing, for each piece)."""
    columns = {
        "op1": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2": "doc_id piece start length ids_crc32 sequence_id offset", "op3": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op4": "doc_id n_words n_base first_word last_word base_labels labels score", "op5": "doc_id start n_tokens ids_crc32", "op6": "doc_id held_out score predicted",
        "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8": "page_id payload_bytes payload_digest record_type refers_to",
        "op9": "doc_id held_out n_tokens n_known train_tokens base_score score", "op10": "doc_id fingerprint component_id",
    }
    op = name.split("_")[0]
    df = queries.queries()[name](spark, sf)
    assert set(columns[op].split()) <= set(df.columns)
    n = table(spark, sf, "pages" if op == "op8" else "documents").count()
    assert df.count() >= n if op == "op2" else df.count() == n


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in all columns, empty texts, repeated rows, extra columns; and tables without rows."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _kept string, spans string"
    words = [f"w{i}x" for i in range(400)]
    prose = [" ".join(words[(i * 37 + k * k) % 400] for k in range(150)) for i in range(6)]
    rows = [(i, t, "en", "s", len(t), "a", "b") for i, t in enumerate(prose)] + [(1, prose[1], "en", "s", len(prose[1]), "a", "b"), (None, None, None, None, None, None, None), (7, "", None, None, 0, None, None), (8, None, "en", None, None, None, None), (None, prose[0] + " more of it", None, None, None, None, None)]
    for name, docs in (("full", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, None, 1), (1, 0, 0), (2, None, None)] if docs else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, " ".join(prose[3].split()[20:60])), (1, None), (2, "")] if docs else [], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = P.run(spark, folder).collect()
        assert bool(got) == bool(docs)
        if docs:
            # the row without an id comes first, so the text of 0, which it holds, is a repeat
            assert {r["doc_id"] for r in got} >= {1, 2, 3, 4, 5} and 0 not in {r["doc_id"] for r in got} and sum(r["doc_id"] == 1 for r in got) == 1
            assert all(r["offset"] + r["length"] <= 2048 for r in got)
    stage = spark.read.parquet(f"{tmp_path}/none/documents.parquet")
    for _, f in P.STAGES[:-1]:
        stage = f(spark, stage, f"{tmp_path}/none")
        assert stage.columns == P.COLUMNS and stage.isEmpty()
