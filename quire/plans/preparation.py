"""Queries over announcements of titles, blocks in markup, and texts made ready to be spoken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import announce, markup, segment, speech
from quire.plans.base import query, table

#: What is said at the start of a line's reading, by the line's place.
SAID = (("Chapter", "Seven."), ("Prologue",), ("Twenty", "three"), ("part", "2,"), ())
_SAID = f"[{', '.join('[' + ', '.join(repr(w) for w in s) + ']::VARCHAR[]' for s in SAID)}]"
_SPOKEN = f"(SELECT doc_id, line_idx, list_concat({_SAID}[1 + line_idx % 5], w) AS w FROM (SELECT doc_id, i - 1 AS line_idx, list_filter(regexp_split_to_array(l[i], '\\s+'), lambda x: x <> '') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"
_PAUSED = "((j + 1 + line_idx) % 6 = 0 OR (j + line_idx) % 11 = 3 OR (j + 1 + line_idx) % 11 = 3)"
_ENDS = f"list_filter(range(b, least(len(w), 20)), lambda j: regexp_matches(w[j + 1], '[.!?]$') OR (j + 1 < least(len(w), 20) AND {_PAUSED}))"


@query(f"""SELECT doc_id, CAST(line_idx AS INT) AS line_idx, CAST(CASE WHEN len(w) < 2 THEN 0 WHEN named THEN 1 WHEN b IS NULL THEN 0 ELSE coalesce(({_ENDS})[1] + 1, b) END AS INT) AS length FROM (
SELECT *, line_idx % 5 = 1 OR (line_idx % 5 = 4 AND lower(rtrim(w[1], '.,!?:;')) IN {announce.NAMED}) AS named, CASE line_idx % 5 WHEN 0 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN CASE WHEN lower(rtrim(w[1], '.,!?:;')) IN {announce.NUMBERED} THEN 2 WHEN regexp_matches(rtrim(w[1], '.,!?:;'), '^0*[1-9][0-9]{{0,2}}$') THEN 1 END END AS b FROM {_SPOKEN}) WHERE len(w) > 0""")
def title_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA19: words of each line's reading that announce its title.

    Word i of line l is said from 0.4 i + 0.7 ((i + l) // 6) on for 0.3 seconds; at (i + l) % 11 = 3 a silence of 0.65 starts before its end.
    """
    said = F.array(*[F.array(*[F.lit(w) for w in s]).cast("array<string>") for s in SAID])
    lines = segment.lines(table(spark, sf_dir, "documents"), ["doc_id"])
    w = lines.select("doc_id", "line_idx", F.concat(F.get(said, F.col("line_idx") % 5), tx.fields("line")).alias("w"))
    at = F.col("pos") * 0.4 + F.floor((F.col("pos") + F.col("line_idx")) / 6) * 0.7
    words = w.select("doc_id", "line_idx", F.posexplode("w").alias("pos", "w")).withColumn("s", at).withColumn("e", F.col("s") + 0.3)
    silences = words.where((F.col("pos") + F.col("line_idx")) % 11 == 3).select("doc_id", "line_idx", (F.col("e") - 0.05).alias("a"), (F.col("e") + 0.6).alias("b"))
    starts = w.where("size(w) > 0").select("doc_id", "line_idx", F.lit(0).alias("start"))
    return announce.announcements(starts, words, silences, ["doc_id", "line_idx"]).select("doc_id", "line_idx", "length")


_BLOCK = markup.BLOCK
_SHOWN = "trim(regexp_replace(translate(regexp_replace({}, '(?s)<[^>]*>', '', 'g'), '‘’“”', '''''\"\"'), '\\s+', ' ', 'g'))"
_HEADED = "(SELECT page_id, page_id % 5 AS work, CASE WHEN page_id % 3 <> 0 THEN '<div class=\"h\">Running <b>Head</b> ' || page_id % 5 || '</div>' ELSE '' END || html AS html FROM pages)"
_PAGES = f"(SELECT page_id, work, string_split_regex(html, '{_BLOCK}') AS b, regexp_extract_all(html, '{_BLOCK}') AS f FROM {_HEADED})"


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chapters of five works, two in three of them under the running header of their work."""
    work = F.col("page_id") % 5
    head = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<div class="h">Running <b>Head</b> '), work.cast("string"), F.lit("</div>"))).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", work.alias("work"), F.concat(head, "html").alias("html"))


@query(f"""WITH p AS {_PAGES}, n AS (SELECT work, count(*) AS pages FROM p GROUP BY 1), h AS (SELECT work, line FROM (SELECT DISTINCT page_id, work, line FROM (SELECT page_id, work, {_SHOWN.format('unnest(f)')} AS line FROM p)) JOIN n USING (work) WHERE line <> '' AND len(string_split(line, ' ')) <= 12 GROUP BY work, line, pages HAVING pages >= 4 AND count(*) >= greatest(4, ceil(pages * 0.5))),
hs AS (SELECT work, list(line) AS lines FROM h GROUP BY 1)
SELECT page_id, CAST(length(html) AS INT) AS size, md5(html) AS html_md5 FROM (SELECT page_id, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || CASE WHEN i > len(f) OR list_contains(coalesce(lines, []), {_SHOWN.format('f[i]')}) THEN '' ELSE f[i] END), '') AS html FROM p LEFT JOIN hs USING (work))""")
def pages_without_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH24, AGG13: pages without the blocks that are running headers, all else byte for byte the same."""
    pages = headed(spark, sf_dir)
    out = markup.without_header_blocks(pages, markup.header_blocks(pages, "work", "page_id", "html"), "work", "html")
    return out.select("page_id", F.length("html").alias("size"), F.md5("html").alias("html_md5"))


@query(f"""SELECT page_id, CAST(i - 1 AS INT) AS n, CAST(sum(length(b[i])) OVER (PARTITION BY page_id ORDER BY i) + coalesce(sum(length(f[i])) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(f[i]) AS BIGINT) AS size, {_SHOWN.format('f[i]')} AS text FROM (SELECT page_id, b, f, unnest(range(1, len(f) + 1)) AS i FROM {_PAGES})""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTH24: blocks of pages with their places."""
    b = markup.block_spans(headed(spark, sf_dir), ["page_id"], "html")
    return b.select("page_id", "n", "start", (F.col("stop") - F.col("start")).alias("size"), "text")


_BOUND = "(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<h2>Chapter 1</h2>' || html || '<h3 class=\"c\">XIV.</h3><p>tail</p><h5>Letter <i>to</i> a friend</h5>end' ELSE '<p>Lead</p><h1>Part One</h1>' || html END AS html FROM pages)"
_PARTS = f"(SELECT page_id, list_concat(flatten(list_transform(range(1, len(f) + 1), lambda i: [b[i], f[i]])), [b[len(b)]]) AS w FROM (SELECT page_id, string_split_regex(html, '{markup.HEADING}') AS b, regexp_extract_all(html, '{markup.HEADING}') AS f FROM {_BOUND}))"
_CUTS = f"(SELECT page_id, w, CASE WHEN len(a) < 2 THEN [1] WHEN w[1] <> '' OR a[1] > 2 THEN list_concat([1], a) ELSE a END AS a FROM (SELECT page_id, w, list_filter(range(2, len(w) + 1, 2), lambda i: regexp_matches(regexp_replace(w[i], '(?s)<[^>]+>', '', 'g'), '{markup.CHAPTER_LIKE}')) AS a FROM {_PARTS}))"


@query(f"""SELECT page_id, CAST(k - 1 AS INT) AS n, trim(regexp_replace(regexp_extract(html, '{markup.FIRST_HEADING}', 1), '<[^>]*>', '', 'g')) AS title, CAST(length(html) AS INT) AS size, md5(html) AS html_md5 FROM (
SELECT page_id, k, array_to_string(w[a[k]:coalesce(a[k + 1] - 1, len(w))], '') AS html FROM (SELECT page_id, w, a, unnest(range(1, len(a) + 1)) AS k FROM {_CUTS}))""")
def page_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA27: pages cut before their chapter headings; the parts joined are the page."""
    p = table(spark, sf_dir, "pages")
    bound = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<h2>Chapter 1</h2>"), "html", F.lit('<h3 class="c">XIV.</h3><p>tail</p><h5>Letter <i>to</i> a friend</h5>end'))).otherwise(F.concat(F.lit("<p>Lead</p><h1>Part One</h1>"), "html"))
    c = p.select("page_id", F.posexplode(markup.chapters_of_page(bound)).alias("n", "c"))
    return c.select("page_id", "n", "c.title", F.length("c.html").alias("size"), F.md5("c.html").alias("html_md5"))


#: Lines of documents with marks among them by their place; the title is the first words of the text or, by turns, one in capitals.
MARKS = ((3, "Produced by hand"), (8, ""), (11, "Visit www.gutenberg.org for more"), (14, "There are several editions of this ebook in the Project Gutenberg collection"), (15, "Click on any of the filenumbers"), (16, "1234 (plain)"), (18, "Project Gutenberg Editor's Note:"))
_MARKED = "CASE line_idx % 20 " + " ".join(f"WHEN {n} THEN '{m.replace(chr(39), chr(39) * 2)}'" for n, m in MARKS) + " WHEN 6 THEN upper(replace(substr(line, 1, 60), 'ß', 'ss')) ELSE line END"
_TITLE = "CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:3], ' ') ELSE 'THE TALE' END"
_ML = f"(SELECT doc_id, title, line_idx, trim({_MARKED}) AS t FROM (SELECT doc_id, {_TITLE} AS title, i - 1 AS line_idx, l[i] AS line FROM (SELECT doc_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents))))"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 2 == 0, F.array_join(F.slice(tx.fields("text"), 1, 3), " ")).otherwise("THE TALE")
    place = F.col("line_idx") % 20
    line = F.when(place == 6, F.upper(F.replace(F.left("line", F.lit(60)), F.lit("ß"), F.lit("ss"))))
    for n, m in MARKS:
        line = line.when(place == n, m)
    return segment.lines(docs.select("doc_id", title.alias("title"), "text"), ["doc_id", "title"]).withColumn("line", line.otherwise(F.col("line")))


@query(f"""SELECT doc_id, line_idx, t AS line FROM (SELECT *, max(CASE WHEN NOT taken AND intro THEN line_idx END) OVER w AS open, max(CASE WHEN NOT taken AND NOT intro AND NOT regexp_matches(t, '(?i)^Click on any of the file ?numbers|^\\d{{2,6}}\\s*\\(|^$') THEN line_idx END) OVER w AS shut FROM (
SELECT *, coalesce(lag(label AND ends_with(t, ':')) OVER (PARTITION BY doc_id ORDER BY line_idx), false) AS taken FROM (SELECT doc_id, CAST(line_idx AS INT) AS line_idx, t, regexp_matches(t, '(?i)^There are several editions of this ebook in the Project Gutenberg') AS intro, regexp_matches(t, '(?i)Project Gutenberg(''?s)? Editor''?s Note') AS label FROM {_ML})) WINDOW w AS (PARTITION BY doc_id ORDER BY line_idx))
WHERE NOT taken AND NOT label AND (open IS NULL OR shut > open)""")
def apparatus_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCA25: lines without lists of editions and editors' notes (here no two labels in a row)."""
    lines = marked(spark, sf_dir).withColumn("line", F.trim("line")).drop("title")
    return speech.without_apparatus(lines, ["doc_id"])


_CASED = "array_to_string(list_transform(regexp_extract_all(lower({0}), '[a-z0-9_]+|[^a-z0-9_]+'), lambda x: CASE WHEN regexp_matches(x, '^[a-z]') THEN upper(x[1]) || x[2:] ELSE x END), '')"
_CAPS = "(regexp_matches({0}, '\\pL') AND NOT regexp_matches({0}, '\\p{{Ll}}'))"
_OPENING = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')[1:24]"
_OPENS = " OR ".join(f"contains(t, '{m}')" for m in speech.REGION_OPENS)
_SKIPS = " OR ".join(f"contains(lower(t), '{m.replace(chr(39), chr(39) * 2)}')" for m in speech.SKIPPED_LINES)
_PLAIN_TITLE = " OR ".join(f"contains(lower(title), '{m}')" for m in speech.SKIPPED_TITLES)
_UPTO = "OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH m AS {_ML}, r AS (SELECT *, max(CASE WHEN {_OPENS} THEN line_idx END) OVER (PARTITION BY doc_id ORDER BY line_idx) AS open, max(CASE WHEN t = '' THEN line_idx END) {_UPTO} AS shut FROM m), i AS (SELECT *, CASE WHEN t = '' THEN 'gap' WHEN lower(t) = lower(title) OR {_SKIPS} THEN 'skip' WHEN {_CAPS.format('t')} AND strlen(t) < 80 THEN 'head' ELSE 'body' END AS kind FROM r WHERE open IS NULL OR shut >= open),
k AS (SELECT *, max(CASE WHEN kind IN ('head', 'body') THEN line_idx END) {_UPTO} AS prev, max(CASE WHEN kind = 'gap' THEN line_idx END) {_UPTO} AS gap, max(CASE WHEN kind = 'head' THEN line_idx END) {_UPTO} AS ph FROM i),
s AS (SELECT *, coalesce((gap IS NOT NULL AND (prev IS NULL OR gap > prev)) OR ph = prev, false) AS paused, {_CASED.format('t')} AS cased FROM k),
g AS (SELECT doc_id, {_OPENING.format("string_agg(t, chr(10) ORDER BY line_idx)")} AS opening FROM i GROUP BY 1),
d AS (SELECT doc_id, any_value(title) AS title FROM m GROUP BY 1), h AS (SELECT doc_id, CASE WHEN title = '' OR ({_PLAIN_TITLE}) OR (len({_OPENING.format('title')}) > 0 AND coalesce(opening, [])[1:len({_OPENING.format('title')})] = {_OPENING.format('title')}) THEN '' ELSE CASE WHEN {_CAPS.format('title')} THEN {_CASED.format('title')} ELSE title END || '.' || chr(10) || chr(10) END AS shown FROM d LEFT JOIN g USING (doc_id)),
b AS (SELECT doc_id, string_agg(CASE WHEN prev IS NULL AND shown = '' THEN '' WHEN kind = 'head' THEN CASE WHEN paused THEN '' ELSE chr(10) || chr(10) END ELSE CASE WHEN paused THEN chr(10) || chr(10) ELSE ' ' END END || CASE WHEN kind = 'head' THEN cased || CASE WHEN regexp_matches(cased, '[.!?]$') THEN '' ELSE '.' END || chr(10) || chr(10) ELSE t END, '' ORDER BY line_idx) AS body FROM s JOIN h USING (doc_id) WHERE kind IN ('head', 'body') GROUP BY 1)
SELECT doc_id, regexp_replace(shown || coalesce(body, ''), '^\\s+|\\s+$', '', 'g') AS speech FROM h LEFT JOIN b USING (doc_id)""")
def speech_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEG15, OTH23: documents made ready to be spoken."""
    listed = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    texts = marked(spark, sf_dir).groupBy("doc_id", "title").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
    return speech.prepared(texts, ["doc_id"], "title", "text")
