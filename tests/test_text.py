from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import chunks as C
from tidemill.functions import entities as E
from tidemill.functions import text as T
from tidemill.functions import urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_entities(spark):
    get = lambda t, types=None: one(spark, t, lambda c: E.entity_map(c, types))
    assert get("a@b.com and c.d@e.org")["email"] == ["a@b.com", "c.d@e.org"]
    assert len(get("see https://a.com/x, http://b.org/y.")["url"]) == 2
    assert get("on 2024-03-01 and 2024-03-02, 2024-03-01")["date_iso"] == ["2024-03-01", "2024-03-02"]
    assert len(get("(555) 123-4567, 555-123-4567, 555.123.4567")["phone_us"]) >= 2
    assert get("#one #Two @me")["hashtag"] == ["#Two", "#one"]
    assert get("$5, €1,000.50 and 20 USD")["currency"] == ["$5", "20 USD", "€1,000.50"]
    pii = "123-45-6789 and 4111111111111111"
    assert "ssn" not in get(pii) and "credit_card" not in get(pii)
    assert set(get(pii, ["ssn", "credit_card"])) == {"ssn", "credit_card"}
    assert get(None) == {} and get("") == {}


def chunked(spark, n, c, exact=False):
    df = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(n)))], "id int, text string")
    return C.chunks(df, ["id"], config=c, exact=exact).orderBy("chunk_index").collect()


def test_chunks(spark):
    assert [r["content"] for r in chunked(spark, 3, C.ChunkConfig(10, 2, 3))] == ["word0 word1 word2"]
    assert len(chunked(spark, 10, C.ChunkConfig(10, 2, 3))) == 1
    assert [r["start_index"] for r in chunked(spark, 12, C.ChunkConfig(5, 1, 2))] == [0, 4, 8]
    assert [(r["start_index"], r["end_index"]) for r in chunked(spark, 13, C.ChunkConfig(10, 2, 5), True)] == [(0, 10), (8, 13)]
    merged = chunked(spark, 12, C.ChunkConfig(10, 2, 5))
    assert [(r["start_index"], r["end_index"], r["word_count"]) for r in merged] == [(0, 12, 14)]
    empty = C.chunks(spark.createDataFrame([(1, ""), (2, None), (3, "  ")], "id int, text string"), ["id"]).collect()
    assert [r["word_count"] for r in empty] == [0, 0, 0]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 60), st.integers(1, 12), st.integers(0, 14), st.integers(0, 6))
def test_chunks_like_a_loop(spark, n, window, overlap, least):
    words = [f"word{i}" for i in range(n)]
    want = []
    if n <= window:
        want = [(0, n, n, " ".join(words))]
    else:
        start = 0
        while True:
            end = min(start + window, n)
            if end >= n and end - start < least and want:
                s, _, k, t = want[-1]
                want[-1] = (s, n, k + end - start, t + " " + " ".join(words[start:end]))
                break
            want.append((start, end, end - start, " ".join(words[start:end])))
            if end >= n:
                break
            start += max(1, window - overlap)
    got = [(r["start_index"], r["end_index"], r["word_count"], r["content"]) for r in chunked(spark, n, C.ChunkConfig(window, overlap, least))]
    assert got == want


def test_words(spark):
    assert one(spark, "Hello, wor-ld! it's 3.14 世界", T.words_uax29) == ["Hello", "wor", "ld", "it's", "3.14", "世", "界"]
    assert one(spark, "a b c", T.word_count) == 3


def test_normalized_and_shingles(spark):
    assert one(spark, "Hello,  World! How are   you?", T.normalized) == "hello world how are you"
    assert sorted(one(spark, "hello", T.shingles)) == ["ell", "hel", "llo"]
    assert one(spark, "hi", T.shingles) == ["hi"] and one(spark, "!", T.shingles) == []


def test_sentiment_and_embedding(spark):
    assert one(spark, "a great and happy day", T.sentiment) == 1.0
    assert one(spark, "a terrible day", T.sentiment) == -1.0
    assert one(spark, "good but bad", T.sentiment) == 0.0 and one(spark, "a day", T.sentiment) == 0.0
    assert one(spark, "", T.sentiment) is None and one(spark, "", T.embedding) is None
    v = one(spark, "text", T.embedding)
    assert len(v) == 768 and abs(sum(x * x for x in v) - 1) < 1e-4 and v == one(spark, "text", T.embedding) != one(spark, "other", T.embedding)


def test_boilerplate(spark):
    for t, want in [("We use Cookies", True), ("home", True), ("A home that is long enough", False), ("© 2024", True), ("An ordinary line", False)]:
        assert one(spark, t, T.is_boilerplate) is want


def test_clamped(spark):
    df = spark.createDataFrame([(2.0,), (-2.0,), (0.5,), (None,)], "x double")
    assert [r[0] for r in df.select(T.clamped(F.col("x"), -1.0, 1.0)).collect()] == [1.0, -1.0, 0.5, None]


def test_url_normalization(spark):
    n = urls.normalize
    assert n("page", "https://example.com") == "https://example.com/page" == n("page#section1", "https://example.com")
    assert n("/page", "https://EXAMPLE.com") == "https://example.com/page"
    got = n("/product?id=123&utm_source=google&ref=landing&gclid=xyz&sort=asc", "https://example.com")
    assert got == "https://example.com/product?id=123&sort=asc"
    assert n("/search?b=2&a=1&c=3", "https://example.com").endswith("?a=1&b=2&c=3")
    assert n("page", "not_a_url") is None and n(None, "https://a.com") is None
    assert n("/s?a=1&a=2", "https://example.com").endswith("/s?a=2") and n("/s?UTM_Source=x", "https://example.com") == "https://example.com/s"
    for u in ["https://Example.com/a?b=1&a=2#x", "http://x.org", "https://x.org/s?ref=1", "https://x.org/s?a=1&a=2&utm_term=3"]:
        assert one(spark, u, urls.normalize_absolute) == n(u, u) == n(n(u, u), u)
    assert one(spark, "page", urls.normalize_absolute) is None


def test_uax29_words_of_a_batch_take_little_memory(spark):
    """The words are what they were, and a batch's words are no objects of their own in Python."""
    import tracemalloc

    import pandas as pd
    import regex

    odd = [None, "", "\n", "a\nb\r\nc\u2028d\x0be", "\n\u0345x", "\0\u0345 x\n\u0903", "can't 3.14 a_b \U0001d4d0 \u0e01\u0e32", " \u00e9\u0301l ", "x\u200dy\u200d\nz", "日本語 カタカナ"]
    want = [[w for w in regex.split(r"(?w)\b", t or "") if regex.search(r"[\p{Alphabetic}\p{N}]", w)] for t in odd]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, t string").select("i", T.words_uax29(F.col("t")).alias("w"))
    assert [r["w"] for r in df.orderBy("i").collect()] == want
    texts = pd.Series(["some words of a text " * 1000] * 100)
    T._cut_uax29(texts[:1])
    tracemalloc.start()
    got = T._cut_uax29(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 100 and peak < 3 * texts.str.len().sum()
