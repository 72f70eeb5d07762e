"""Queries over pages that are built, one from each document's id, so that SQL can tell what must be read from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import urls
from .operators import events, metrics, pages, records
from .plans import refinery
from .sources.io import exposition_text, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


ID = "CAST(doc_id AS STRING)"

# --- content: an area of one of five kinds, or none; headings, paragraphs, items, quotes and code, some too short, some boilerplate

PIECES = {
    "nav": f"'Navigation entry outside of the area ' || {ID}", "h": f"'Heading ' || {ID}", "h2": "'Subscribe to us'", "p1": f"'Paragraph ' || {ID} || repeat(' lorem ipsum', CAST(doc_id % 60 AS INT))",
    "p2": "'short'", "p3": "'Read more about this long paragraph here'", "p4": f"'Write to a' || {ID} || '@x.org for more'", "p5": f"'Yet another paragraph of ' || {ID}",
    "li1": f"'A list item that is long enough ' || {ID}", "li2": "'tiny'", "q": f"'Quoted ' || {ID}", "c1": f"'code ' || {ID}", "c2": "'x'", "c3": f"'a longer piece of code ' || {ID}",
}
OPEN = ["<article>", "<main>", '<div role="main">', '<div class="x post-content y">', '<div id="the-article">', "<div>"]
CLOSE = ["</article>", "</main>", "</div>", "</div>", "</div>", "</div>"]
_pick = lambda names, by: "CASE " + " ".join(f"WHEN {by} = {k} THEN '{x}'" for k, x in enumerate(names)) + " END"
MORE = "CASE WHEN doc_id % 3 = 0 THEN '<p>' || p4 || '</p><P>' || p5 || '</P>' ELSE '' END"
INNER = f"'<h1> ' || h || '</h1><h2>' || h2 || '</h2><p>' || p1 || '<p>' || p2 || '</p><p>' || p3 || '</p>' || {MORE} || '<ul><li>' || li1 || '<li>' || li2 || '</ul><blockquote>' || q || '</blockquote><pre>' || c1 || '</pre><code>' || c2 || '</code><code>' || c3 || '</code>'"
TABLE = f"'<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>' || {ID} || '</td></tr></tbody></table>'"
CONTENT = f"'<!DOCTYPE html><html><head><title>t</title><script>var x = \"<p>no</p>\";</script></head><body><nav><ul><li>' || nav || '</li></ul></nav>' || {_pick(OPEN, 'doc_id % 6')} || {INNER} || {_pick(CLOSE, 'doc_id % 6')} || {TABLE} || '</body></html>'"


def content_pages(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", *[F.expr(x).alias(k) for k, x in PIECES.items()])
    return docs.select("doc_id", F.expr(CONTENT).alias("html"))


WORDS = lambda t: f"len([x FOR x IN string_split_regex({t}, '\\s+') IF x <> ''])"
CONTENT_SQL = f"""
WITH p AS (SELECT doc_id, {", ".join(f"{x} AS {k}" for k, x in PIECES.items())} FROM documents),
a AS (SELECT *, ' ' || h || h2 || p1 || p2 || p3 || CASE WHEN doc_id % 3 = 0 THEN p4 || p5 ELSE '' END || li1 || li2 || q || c1 || c2 || c3 AS area FROM p),
m AS (SELECT *, doc_id % 6 < 5 AND {WORDS("area")} >= 25 AS found FROM a),
k AS (SELECT *, [x FOR x IN [CASE WHEN strlen(p1) >= 20 THEN p1 END, CASE WHEN doc_id % 3 = 0 AND strlen(p4) >= 20 THEN p4 END, CASE WHEN doc_id % 3 = 0 AND strlen(p5) >= 20 THEN p5 END] IF x IS NOT NULL] AS ps FROM m),
t AS (SELECT *, array_to_string([h] || ps || CASE WHEN found THEN [] ELSE ['• ' || nav] END || ['• ' || li1], chr(10) || chr(10)) AS text FROM k),
w AS (SELECT *, {WORDS("text")} AS words FROM t)
SELECT doc_id, md5(text) AS text_md5, '1:' || h AS headings, array_to_string(ps, '|') AS paragraphs, c1 || '|' || c3 AS code_blocks, q AS quotes, CAST(words AS BIGINT) AS word_count, found AS found_main_content,
       round(CASE WHEN found THEN 0.3 ELSE 0 END + 0.2 + CASE WHEN len(ps) >= 3 THEN 0.2 ELSE 0 END + CASE WHEN words >= 200 THEN 0.2 WHEN words >= 100 THEN 0.1 ELSE 0 END + 0.1, 4)::DOUBLE AS quality_score FROM w
"""


@query(CONTENT_SQL)
def page_content_built(s, d):
    headings = F.array_join(F.transform("headings", lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["text"])), "|")
    join = lambda c: F.array_join(c, "|").alias(c)
    return pages.content(content_pages(s, d), ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"), headings.alias("headings"), join("paragraphs"), join("code_blocks"), join("quotes"), "word_count", "found_main_content", "quality_score")


@query(f"SELECT doc_id, CAST(word_count AS BIGINT) AS word_count, CAST(CASE WHEN paragraphs = '' THEN 0 ELSE len(string_split(paragraphs, '|')) END AS BIGINT) AS paragraph_count, CAST(1 AS BIGINT) AS table_count, CAST(CASE WHEN doc_id % 3 = 0 AND contains(paragraphs, '@') THEN 2 ELSE 0 END AS BIGINT) AS entity_count, CAST(1 AS BIGINT) AS chunk_count, quality_score, found_main_content AS has_main_content FROM ({CONTENT_SQL})")
def refined_built(s, d):
    """The whole refinery: an address is an entity of its own and a mention."""
    return refinery.refine(content_pages(s, d), ["doc_id"]).select("doc_id", "stats.*")


@query(f"SELECT doc_id, {WORDS('x')} >= 25 AS valid FROM (SELECT doc_id, nav || ' ' || h || h2 || p1 || p2 || p3 || CASE WHEN doc_id % 3 = 0 THEN p4 || p5 ELSE '' END || li1 || li2 || q || c1 || c2 || c3 || 'AB1' || {ID} AS x FROM (SELECT doc_id, {', '.join(f'{x} AS {k}' for k, x in PIECES.items())} FROM documents))")
def valid_areas(s, d):
    return pages.valid_area(content_pages(s, d), ["doc_id"])


# --- metadata: JSON-LD, Open Graph, meta tags and what the page shows, each present in some pages only

LD = f"""'<script type="application/ld+json">{{"@type":"NewsArticle","headline":"LD ' || {ID} || '","datePublished":"2024-01-02","author":[{{"name":"A ' || {ID} || '"}},{{"name":"B"}}],"publisher":{{"name":"Pub"}},"image":["http://i/' || {ID} || '.png"],"wordCount":' || {ID} || ',"articleSection":"Sec","inLanguage":"de","mainEntityOfPage":{{"@id":"http://c/' || {ID} || '"}}}}</script>'"""
_og = lambda name, value: f"<meta property=\"{name}\" content=\"{value}' || {ID} || '\">"
OG_NAMES = [("og:title", "OT"), ("og:description", "OD"), ("article:published_time", "2023-01-"), ("article:modified_time", "2023-02-"), ("og:site_name", "Site"), ("og:url", "http://o/"), ("og:image", "http://oi/"), ("og:type", "one"), ("og:type", "two"), ("article:section", "OS"), ("article:author", "OA")]
OG = "'" + "".join(_og(*x) for x in OG_NAMES) + "'"
META = f"""'<meta name="Author" content="MA' || {ID} || '"><meta name="description" content="MD' || {ID} || '"><meta name="pubdate" content="2022-01-' || {ID} || '"><meta name="revised" content="2022-02-' || {ID} || '"><meta name="keywords" content="a' || {ID} || ', b , ,c"><meta name="content-language" content="fr">'"""
HEADS = f"""'<html lang="es"><head>' || CASE WHEN doc_id % 2 = 0 THEN {LD} ELSE '' END || CASE WHEN doc_id % 3 < 2 THEN {OG} ELSE '' END || CASE WHEN doc_id % 5 < 3 THEN {META} ELSE '' END || CASE WHEN doc_id % 4 < 3 THEN '<title> T ' || {ID} || ' </title>' ELSE '' END
 || '<link rel="canonical" href="http://l/' || {ID} || '"></head><body><h1>H ' || {ID} || '</h1>' || CASE WHEN doc_id % 7 < 4 THEN '<time datetime="2020-02-0' || CAST(doc_id % 7 AS STRING) || '">then</time>' ELSE '' END || '<article>Written on 2021-03-04, they say</article></body></html>'"""
META_SQL = f"""
WITH k AS (SELECT doc_id, {ID} AS id, doc_id % 2 = 0 AS ld, doc_id % 3 < 2 AS og, doc_id % 5 < 3 AS meta FROM documents)
SELECT doc_id, CASE WHEN ld THEN 'LD ' || id WHEN og THEN 'OT' || id WHEN doc_id % 4 < 3 THEN 'T ' || id ELSE 'H ' || id END AS title,
 CASE WHEN og THEN 'OD' || id WHEN meta THEN 'MD' || id END AS description, CASE WHEN ld THEN 'A ' || id WHEN og THEN 'OA' || id WHEN meta THEN 'MA' || id END AS author,
 CASE WHEN ld THEN 'A ' || id || '|B' WHEN NOT og AND meta THEN 'MA' || id ELSE '' END AS authors,
 CASE WHEN ld THEN '2024-01-02' WHEN og THEN '2023-01-' || id WHEN meta THEN '2022-01-' || id WHEN doc_id % 7 < 4 THEN '2020-02-0' || CAST(doc_id % 7 AS STRING) ELSE '2021-03-04' END AS date_published,
 CASE WHEN og THEN '2023-02-' || id WHEN meta THEN '2022-02-' || id END AS date_modified, CASE WHEN og THEN 'Site' || id END AS site_name, CASE WHEN ld THEN 'Pub' END AS publisher,
 CASE WHEN ld THEN 'http://c/' || id WHEN og THEN 'http://o/' || id ELSE 'http://l/' || id END AS canonical_url, CASE WHEN ld THEN 'http://i/' || id || '.png' WHEN og THEN 'http://oi/' || id END AS og_image, CASE WHEN og THEN 'two' || id END AS og_type,
 CASE WHEN meta THEN 'a' || id || '|b|c' ELSE '' END AS keywords, CASE WHEN ld THEN 'Sec' WHEN og THEN 'OS' || id END AS section, CASE WHEN ld THEN 'de' WHEN meta THEN 'fr' ELSE 'es' END AS language,
 CAST(CASE WHEN ld THEN doc_id ELSE 6 END AS BIGINT) AS word_count, CAST(greatest(CASE WHEN ld THEN doc_id ELSE 6 END // 200, 1) AS BIGINT) AS reading_time_minutes, CASE WHEN ld THEN 'json_ld' ELSE 'meta_tags' END AS extraction_method FROM k
"""


@query(META_SQL)
def page_metadata_built(s, d):
    docs = table(s, d, "documents").select("doc_id", F.expr(HEADS).alias("html"))
    out = pages.metadata(docs, ["doc_id"])
    return out.withColumns({c: F.array_join(c, "|") for c in ("authors", "keywords")})


@query(f"SELECT doc_id, title IS NOT NULL OR description IS NOT NULL AS essential FROM ({META_SQL})")
def page_essentials(s, d):
    docs = table(s, d, "documents").select("doc_id", F.expr(HEADS).alias("html"))
    return pages.metadata(docs, ["doc_id"]).select("doc_id", pages.has_essentials(F.col("title"), F.col("description")).alias("essential"))


# --- tables

TABLES = [
    f"'<table><thead><tr><th>A</th><th>B ' || {ID} || '</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td></td></tr></tbody></table>'",
    f"'<table><tr><th>X<th>Y<tr><td>3<td>' || {ID} || '</table>'",
    "'<table role=\"Presentation\"><tr><td>h1</td><td>h2</td></tr><tr><td>a</td><td>b</td></tr></table>'",
    f"'<table><tr><td>outer<table><tr><td>inner ' || {ID} || '</td></tr></table></td></tr></table>'",
    "'<table><tr><td>' || repeat('x', 200) || '</td></tr></table><table><tr><td>' || repeat('y', 80) || '</td></tr></table>'",
]
_cases = lambda xs: "CASE " + " ".join(f"WHEN doc_id % 5 = {k} THEN {x}" for k, x in enumerate(xs)) + " END"


@query(f"""
SELECT doc_id, 0 AS table_index, {_cases([f"'A|B ' || {ID}", "'X|Y'", "'h1|h2'", f"'outerinner ' || {ID} || '|inner ' || {ID}", "repeat('x', 200)"])} AS headers, {_cases(["'1,2'", f"'3,' || {ID}", "'a,b'", f"'inner ' || {ID}", "''"])} AS rows, {_cases(["5", "3", "-2", "-2", "4"])} AS score FROM documents
UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 5 = 3 THEN 'inner ' || {ID} ELSE repeat('y', 80) END, '', CASE WHEN doc_id % 5 = 3 THEN 1 ELSE 3 END FROM documents WHERE doc_id % 5 >= 3
""")
def page_tables_built(s, d):
    docs = table(s, d, "documents").select("doc_id", F.expr(_cases(TABLES)).alias("html"))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), "|")
    return pages.tables(docs, ["doc_id"], least=None).select("doc_id", "table_index", F.array_join("headers", "|").alias("headers"), rows.alias("rows"), "score")


@query(f"SELECT doc_id, count(*) AS tables FROM documents WHERE doc_id % 5 IN (0, 4) GROUP BY doc_id")  # noqa: F541
def page_data_tables(s, d):
    docs = table(s, d, "documents").select("doc_id", F.expr(_cases(TABLES)).alias("html"))
    return pages.tables(docs, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("tables"))


# --- density: the markup is as it is serialised, so its bytes are those of the text

DENSE = f"""'<html lang="x"><head><title>T</title></head><body>' || CASE WHEN doc_id % 2 = 0 THEN '<article>' ELSE '<div>' END || '<p>' || repeat('word ', CAST(doc_id % 90 AS INT)) || 'A &amp; B</p><a href="/x">link ' || {ID} || '</a><a>no link</a>' || CASE WHEN doc_id % 2 = 0 THEN '</article>' ELSE '</div>' END || '</body></html>'"""


@query(f"""
WITH h AS (SELECT doc_id, strlen({DENSE}) AS bytes, doc_id % 90 + 7 AS words, 5 * (doc_id % 90) + 5 + 5 + strlen({ID}) + 7 AS text_bytes, 5 + strlen({ID}) AS link_bytes FROM documents),
x AS (SELECT doc_id, least(10.0 * words / bytes, 1)::DOUBLE AS text, (1 - least(link_bytes / text_bytes, 1))::DOUBLE AS link, CASE WHEN doc_id % 2 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS tag FROM h)
SELECT doc_id, round(text, 9) AS text_density, round(link, 9) AS link_density, tag AS tag_score, round(0.4 * text + 0.2 * link + 0.2 * tag, 9) AS final_score, CASE WHEN 0.4 * text + 0.2 * link + 0.2 * tag < 0.48 THEN 'slow' ELSE 'fast' END AS routing FROM x
""")
def page_density_built(s, d):
    docs = table(s, d, "documents").select("doc_id", F.expr(DENSE).alias("html"))
    out = pages.density(docs, ["doc_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("text_density", "link_density", "final_score")})


@query(f"SELECT doc_id, routing = 'slow' AS slow FROM ({SQL['page_density_built']})")
def slow_paths(s, d):
    return pages.slow_path(table(s, d, "documents").select("doc_id", F.expr(DENSE).alias("html")), ["doc_id"])


# --- links that are relative to their page

HREFS = ["''", f"'/x/' || {ID} || '?b=2&a=1#f'", "'rel.html'", f"'../up/' || {ID}", f"'?p=' || {ID} || '&utm_source=z'", "'//Other.Example.com/y'", "'HTTP://Example.com:80/a/./b?Ref=1&k=v&k=w'"]
_links = lambda xs: "CASE " + " ".join(f"WHEN doc_id % 7 = {k} THEN {x}" for k, x in enumerate(xs)) + " END"


@query("SELECT doc_id, " + _links(["'https://base.example.org/a/b/c?q=1'", f"'https://base.example.org/x/' || {ID} || '?a=1&b=2'", "'https://base.example.org/a/b/rel.html'", f"'https://base.example.org/a/up/' || {ID}", f"'https://base.example.org/a/b/c?p=' || {ID}", "'https://other.example.com/y'", "'http://example.com/a/./b?k=w'"]) + " AS normalized FROM documents")
def url_relative(s, d):
    return table(s, d, "documents").select("doc_id", urls.normalize_url(F.expr(_links(HREFS)), F.lit("https://base.example.org/a/b/c?q=1#top")).alias("normalized"))


# --- records, alerts, metrics

NOW = "CAST(1700000000 AS BIGINT)"


@query("SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT doc_id, md5('doc:' || doc_id || chr(1) || doc_id) AS h FROM documents)")
def record_ids(s, d):
    c = F.col("doc_id").cast("string")
    return table(s, d, "documents").select("doc_id", records.record_id(F.concat(F.lit("doc:"), c), c).alias("id"))


@query("SELECT doc_id, doc_id % 2 = 0 AS kept FROM documents")
def embedding_checks(s, d):
    v = F.array_repeat(F.lit(0.5), F.when(F.col("doc_id") % 2 == 0, T.EMBEDDING_SIZE).otherwise(3))
    return table(s, d, "documents").select("doc_id", T.checked_embedding(v.cast("array<float>"), strict=False).isNotNull().alias("kept"))


@query("SELECT count(*) AS count, count(*) FILTER (WHERE text <> '') AS enriched_count, count(*) FILTER (WHERE doc_id % 4 = 0) AS deleted_count FROM documents")
def record_counts(s, d):
    docs = table(s, d, "documents")
    r = records.new_records(docs, F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.col("doc_id"), F.col("text"), F.lit(1_700_000_000))
    done = records.enriched(r, F.lit(1_800_000_000))
    return records.stored_counts(records.soft_deleted(done, F.col("content_hash") % 4 == 0, F.lit(1_800_000_001)))


@query("SELECT count(*) FILTER (WHERE text <> '') AS processed, count(*) FILTER (WHERE text IS NULL OR text = '') AS errors FROM documents")
def worker_counts(s, d):
    docs = table(s, d, "documents")
    r = records.new_records(docs, F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.col("doc_id"), F.col("text"), F.lit(1_700_000_000))
    return records.worker_counts(records.enriched(r, F.lit(1_800_000_000), with_embedding=False))


@query("SELECT doc_id AS content_hash, 'third' AS title FROM documents")
def record_last_update(s, d):
    """Of several updates of a record the last counts."""
    docs = table(s, d, "documents")
    r = records.new_records(docs, F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.col("doc_id"), F.col("text"), F.lit(1_700_000_000))
    up = lambda at, title: records.touched(r, F.lit(at)).withColumn("title", F.lit(title))
    return records.upserted(r, up(1_700_000_003, "third").unionByName(up(1_700_000_001, "first")).unionByName(up(1_700_000_002, "second"))).select("content_hash", "title")


@query("""
SELECT event_id AS seq, 'CUSTOM_CRITICAL' AS alert_type, 'SEV-1' AS severity, 'user ' || user_id AS message, 'error' AS level FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'CUSTOM_WARNING', 'SEV-3', 'seen ' || user_id, 'warn' FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'MEMORY_PRESSURE', 'SEV-2', 'Memory usage at 97.0%', 'error' FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, 'CIRCUIT_BREAKER_OPEN', 'SEV-3', 'Circuit breaker opened for domain ' || user_id, 'warn' FROM events WHERE event_type = 'click'
""")
def alert_kinds(s, d):
    e = table(s, d, "events").select("ts", F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("domain"), "event_type", F.lit(97.0).alias("used_percent"))
    of = lambda k: e.where(F.col("event_type") == k)
    got = events.critical(of("error"), F.concat(F.lit("user "), "domain")).unionByName(events.warning(of("signup"), F.concat(F.lit("seen "), "domain"))).unionByName(events.memory_alerts(of("view"))).unionByName(events.circuit_alerts(of("click")))
    return got.select("seq", "alert_type", "severity", "message", events.log_level(F.col("severity")).alias("level"))


GAUGE_NAMES = list(metrics.GAUGES)
_name = "CASE " + " ".join(f"WHEN event_id % {len(GAUGE_NAMES)} = {k} THEN '{g}'" for k, g in enumerate(GAUGE_NAMES)) + " END"
_kept = "CASE metric " + " ".join(f"WHEN '{k}' THEN least(greatest(value, {lo}), {hi})" for k, (lo, hi) in metrics.RANGES.items()) + " ELSE value END"


@query(f"SELECT metric, label, {_kept} AS value FROM (SELECT {_name} AS metric, event_type AS label, arg_max(value, (ts, value)) AS value FROM events GROUP BY 1, 2)")
def metric_gauge_families(s, d):
    return metrics.gauges(table(s, d, "events").select("ts", F.expr(_name).alias("metric"), F.col("event_type").alias("label"), "value"))


COUNTER_NAMES = list(metrics.COUNTERS)
_counter = "CASE " + " ".join(f"WHEN event_id % {len(COUNTER_NAMES)} = {k} THEN '{g}'" for k, g in enumerate(COUNTER_NAMES)) + " END"


@query(f"SELECT {_counter} AS metric, event_type AS label, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def metric_counter_families(s, d):
    return metrics.counters(table(s, d, "events").select("ts", F.expr(_counter).alias("metric"), F.col("event_type").alias("label"), F.lit(1.0).alias("value")))


LABEL = "CASE WHEN event_type = 'error' THEN 'a \"b\" \\ c' ELSE event_type END"
ESCAPED = "replace(replace(label, '\\', '\\\\'), '\"', '\\\"')"
_bucket = " UNION ALL ".join(f"SELECT '{b}' AS le, {b} AS bound" for b in map(float, metrics.BOUNDS)) + " UNION ALL SELECT '+Inf', 1e300"


@query(f"""
WITH e AS (SELECT {LABEL} AS label, round(value) AS value FROM events), n AS (SELECT label, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM e GROUP BY label),
h AS (SELECT label, le, count(*) FILTER (WHERE value <= bound) AS n FROM e, ({_bucket}) b GROUP BY label, le)
SELECT 'requests_total' AS metric, unnest(['# HELP requests_total {metrics.HELP["requests_total"]}', '# TYPE requests_total counter']) AS line
UNION ALL SELECT 'request_duration_seconds', unnest(['# HELP request_duration_seconds {metrics.HELP["request_duration_seconds"]}', '# TYPE request_duration_seconds histogram'])
UNION ALL SELECT 'requests_total', 'requests_total{{status="' || {ESCAPED} || '"}} ' || n FROM n
UNION ALL SELECT 'request_duration_seconds', 'request_duration_seconds_bucket{{path_type="' || {ESCAPED} || '",le="' || le || '"}} ' || n FROM h
UNION ALL SELECT 'request_duration_seconds', unnest(['request_duration_seconds_sum{{path_type="' || {ESCAPED} || '"}} ' || total, 'request_duration_seconds_count{{path_type="' || {ESCAPED} || '"}} ' || n]) FROM n
""")
def metric_exposition(s, d):
    e = table(s, d, "events").select("ts", F.when(F.col("event_type") == "error", 'a "b" \\ c').otherwise(F.col("event_type")).alias("label"), F.round("value").alias("value"))
    counts = metrics.counters(e.select("ts", F.lit("requests_total").alias("metric"), "label", F.lit(1.0).alias("value")))
    parts = metrics.histogram_parts(e.withColumn("metric", F.lit("request_duration_seconds")))
    return exposition_text(parts.unionByName(counts, allowMissingColumns=True), metrics.FAMILIES).select("metric", "line")
