"""Page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from enquira.operators import pages as P
from enquira.sources import html_items as H

from .adapters import table
from .entries import query


def _q(s: str) -> str:
    return s.replace("'", "''")


def _text_sql(c: str) -> str:
    v = f"regexp_replace({c}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"
    v = f"regexp_replace({v}, '(?s)<[^>]*>', ' ', 'g')"
    for mark, raw in P.ENTITIES:
        v = f"replace({v}, '{mark}', '{_q(raw)}')"
    return f"trim(regexp_replace({v}, '\\s+', ' ', 'g'))"


TEXT = _text_sql("html")


def _score(c: str, patterns: list[str], points: int) -> str:
    return " + ".join(f"CASE WHEN regexp_matches({c}, '(?i){_q(p)}') THEN {points} ELSE 0 END" for p in patterns)


@query("page_text", f"SELECT page_id, {TEXT} AS page_text FROM pages")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", P.page_text(F.col("html")).alias("page_text"))


@query(
    "page_render_triage",
    f"""SELECT page_id, js_score, html_score, CASE WHEN js_score > html_score THEN 'javascript' ELSE 'html' END AS route FROM (
      SELECT page_id, {_score('html', P.FRAMEWORKS, 3)} + {_score('lower(substr(html, 1, 50000))', P.SCRIPTS, 1)} + CASE WHEN n > 2000 AND t < greatest(200, floor(n * CAST(0.03 AS DOUBLE))) THEN 3 ELSE 0 END + CASE WHEN regexp_matches(html, '{P.STRONG}') THEN 4 ELSE 0 END AS js_score,
        {_score('html', P.STATIC, 1)} + CASE WHEN n > 500 AND t > n * CAST(0.1 AS DOUBLE) THEN 2 ELSE 0 END AS html_score FROM (SELECT page_id, html, length(html) AS n, length({TEXT}) AS t FROM pages))""",
)
def page_render_triage(spark, d):
    return P.render_triage(table(spark, d, "pages"))


@query(
    "resolve_links",
    """SELECT page_id, pos, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN starts_with(h, '/') THEN host || h
      ELSE CASE WHEN length(folder) > length(host) THEN folder ELSE host || '/' END || h END AS link FROM (SELECT page_id, url, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS h, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract(url, '^(https?://[^?#]*/)', 1) AS folder
      FROM (SELECT page_id, url, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS l FROM pages))""",
)
def resolve_links(spark, d):
    return P.links(table(spark, d, "pages"))


def _field(c: str, length: int, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"trim(substr(nullif(regexp_extract({c}, '(?i){_q(p)}'), ''), 1, {length}))" for p in patterns) + ")"


#: What a page says of its course, by page_id; the given pages are of invented words.
_SAYS = [
    "Postgraduate applicants hold a Bachelor degree, upper second class.", "A Bachelor degree of 2:1 is asked of all who begin their Masters.", "English: an IELTS score of 6.5, no part below 6.",
    "International Foundation Year for holders of a KCSE, grade C+.", "A scholarship is available to international students.", "Contact our regional manager: office@example.com or WhatsApp.", "",
]
_SAID = "CASE page_id % 7 " + " ".join(f"WHEN {n} THEN '{_q(x)}'" for n, x in enumerate(_SAYS)) + " END"


# a page's text is one line, the sentence another
@query("extract_requirements", "SELECT page_id, " + ", ".join(f"{_field('t', n, patterns)} AS {name}" for name, n, patterns in P.REQUIREMENTS) + f" FROM (SELECT page_id, trim({TEXT} || ' ' || {_SAID}) AS t FROM pages)")
def extract_requirements(spark, d):
    rows = table(spark, d, "pages").withColumn("t", F.concat_ws("\n", P.page_text(F.col("html")), F.concat(F.lit("  "), F.expr(_SAID))))
    return rows.select("page_id", *P.extract_requirements(F.col("t")))


@query(
    "explode_bullets",
    "SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS bullet FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\n•·]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)",
)
def explode_bullets(spark, d):
    return P.bullets(table(spark, d, "documents"), "doc_id", "text")


_KW = ", ".join(f"('{w}')" for w in ["the", "entry", "ing", "une"])


@query(
    "keyword_in_context",
    f"SELECT doc_id, kw, replace(substr(text, greatest(p0 - 80, 1), p0 + 200 - greatest(p0 - 80, 1)), chr(10), ' ') AS excerpt FROM (SELECT doc_id, text, kw, instr(lower(text), kw) AS p0 FROM documents CROSS JOIN (VALUES {_KW}) v(kw)) WHERE p0 > 0",
)
def keyword_in_context(spark, d):
    return P.keyword_in_context(table(spark, d, "documents"), "doc_id", "text", ["the", "entry", "ing", "une"])


@query(
    "keyword_snippet",
    f"SELECT doc_id, kw, trim(regexp_replace(substr(text, p0, 800), '\\s+', ' ', 'g')) AS snippet FROM (SELECT doc_id, text, kw, instr(lower(text), kw) AS p0 FROM documents CROSS JOIN (VALUES {_KW}) v(kw)) WHERE p0 > 0",
)
def keyword_snippet(spark, d):
    return P.keyword_snippet(table(spark, d, "documents"), "doc_id", "text", ["the", "entry", "ing", "une"])


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
_FIRST = f"SELECT host, try_no, substr(t, 1, 5000) AS page_text, length(t) AS text_length FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY try_no) AS r FROM (SELECT {_HOST} AS host, page_id AS try_no, {TEXT} AS t FROM pages) WHERE length(t) >= 1000) WHERE r = 1"


def _by_host(spark, d):
    return table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.col("page_id").alias("try_no"), "html")


@query("first_good_source", _FIRST)
def first_good_source(spark, d):
    return P.first_good_source(_by_host(spark, d), "host", 1000)


@query("first_good_source_by_status", _FIRST.replace("WHERE length(t) >= 1000", "WHERE length(t) >= 1000 AND coalesce(CASE try_no % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END, 0) < 400"))
def first_good_source_by_status(spark, d):
    """Every fifth page came with 404, every other fifth one has no status."""
    status = F.when(F.col("try_no") % 5 == 0, 404).when(F.col("try_no") % 5 != 1, 200)
    return P.first_good_source(_by_host(spark, d).withColumn("status", status), "host", 1000)


@query("fill_missing_sources", f"SELECT h.host, page_text, coalesce(text_length, 0) AS text_length, CASE WHEN page_text IS NULL THEN 'Could not access page' END AS error FROM (SELECT DISTINCT {_HOST} AS host FROM pages) h LEFT JOIN ({_FIRST}) f ON h.host = f.host")
def fill_missing_sources(spark, d):
    return P.fill_missing_sources(_by_host(spark, d), first_good_source(spark, d), "host")


@query(
    "overlay_patch",
    """SELECT coalesce(b.o_orderkey, p.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL OR (p.o_orderkey IS NOT NULL AND p.g IS NOT NULL) THEN p.v ELSE b.v END AS v, CASE WHEN b.o_orderkey IS NULL OR (p.o_orderkey IS NOT NULL AND p.g IS NOT NULL) THEN 'patch' ELSE 'base' END AS origin
      FROM (SELECT o_orderkey, o_orderpriority AS v FROM orders WHERE o_orderkey % 3 <> 0) b FULL JOIN (SELECT o_orderkey, o_orderstatus AS v, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS g FROM orders WHERE o_orderkey % 2 = 0) p ON b.o_orderkey = p.o_orderkey""",
)
def overlay_patch(spark, d):
    o = table(spark, d, "orders")
    base = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    patch = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("v"), F.when(F.col("o_orderkey") % 5 == 0, 1).alias("g"))
    return P.overlay_patch(base, patch, "o_orderkey", "v", "g")


_SECTIONED = "(SELECT doc_id, 'Intro' || chr(10) || 'Fees' || chr(10) || text || chr(10) || ' entry ' || chr(10) || 'needs ' || lang || chr(10) || 'fees' || chr(10) || 'end' AS t FROM documents)"


@query(
    "split_sections",
    f"""SELECT doc_id, section, CAST(start AS INT) AS start, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE pos > start), '') AS body FROM (
      SELECT doc_id, pos, line, last_value(section IGNORE NULLS) OVER w AS section, last_value(CASE WHEN section IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS start FROM (
        SELECT doc_id, pos, line, CASE WHEN lower(line) IN ('fees', 'entry') THEN lower(line) END AS section FROM (SELECT doc_id, unnest(range(len(l))) AS pos, trim(unnest(l), ' ') AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM {_SECTIONED})))
      WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) WHERE section IS NOT NULL GROUP BY doc_id, section, start""",
)
def split_sections(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Intro\nFees\n"), "text", F.lit("\n entry \nneeds "), "lang", F.lit("\nfees\nend")).alias("t"))
    return P.split_sections(rows, "doc_id", "t", ["Fees", "Entry"])


@query(
    "page_items",
    """SELECT page_id, CAST(pos AS INT) AS pos, title, CASE WHEN starts_with(h, '/') THEN host || h ELSE h END AS url FROM (SELECT page_id, host, unnest(range(len(l))) AS pos, unnest(l) AS h, unnest(t) AS title FROM (
      SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS l, regexp_extract_all(nav, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t FROM (SELECT page_id, url, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages)))""",
)
def page_items(spark, d):
    """The entries of every page's menu."""
    found = H.page_items(table(spark, d, "pages"), "nav li", {"title": "b::text, a::text", "url": "a::attr(href)"})
    return found.where("error is null").drop("error")
