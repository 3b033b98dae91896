"""Queries for links and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet.functions import authors, dates, html, page_fields, urls
from broadsheet.operators import frontier
from broadsheet.operators.tail_author import tail_author
from broadsheet.plans import pages as page_plan
from broadsheet.queryset import fixtures, sql
from broadsheet.queryset.registry import query
from broadsheet.session import new_path
from broadsheet.sources import sites


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The character references that the pages and the inserted markup hold.
_REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _unescape(expr: str) -> str:
    for name, char in _REFERENCES:
        expr = f"replace({expr}, {_quote(name)}, {_quote(char)})"
    return expr


@query("seed_sites", r"SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+', 0) || '/' AS url FROM pages")
def seed_sites(spark, sf_dir):
    """Site lists made from the pages' hosts, strings and objects mixed, written as JSON files and read back."""
    pages = fixtures.table(spark, sf_dir, "pages")
    site = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url")), F.lit("/"))
    entry = F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct(site.alias("url")))).otherwise(
        F.concat(F.lit('"'), site, F.lit('"')))
    # A list file holds the sites of at most 500 pages.
    lists = pages.groupBy(F.floor(F.col("page_id") / 500).alias("block")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list(entry), ",\n"), F.lit("\n]")).alias("value"))
    path = new_path(spark, "sites")
    sites.write_sites(lists.select("value"), path)
    return sites.read_sites(spark, path).distinct()


@query("pages_scan", "SELECT page_id, url, html FROM pages")
def pages_scan(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages").select("page_id", "url", "html")


_HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']"""
sql.part("links", f"""
  SELECT page_id, url, CAST(position - 1 AS BIGINT) AS position, {_unescape("href")} AS href FROM (
    SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS position
    FROM (SELECT page_id, url, regexp_extract_all(html, '{_HREF}', 1) AS l FROM pages))""")
sql.part("page_links", r"SELECT * FROM links WHERE NOT regexp_matches(href, '^(mailto:|tel:|javascript:|#)')", "links")
sql.part("resolved", r"""
  SELECT *, CASE WHEN href = '' THEN regexp_replace(url, '#.*$', '')
      WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href
      WHEN href LIKE '//%' THEN split_part(url, ':', 1) || ':' || href
      WHEN href LIKE '/%' THEN split_part(url, ':', 1) || '://' || host || href
      WHEN href LIKE '?%' THEN regexp_replace(url, '[?#].*$', '') || href
      ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target
  FROM (SELECT *, split_part(split_part(split_part(url, '/', 3), '?', 1), '#', 1) AS host FROM page_links)""", "page_links")
sql.part("classified", r"""
  SELECT *, contains(target, host) AS same_site, CASE WHEN regexp_matches(target, '\.html|\.htm|\.amp') THEN 'article'
    WHEN len(string_split(replace(target, 'https://' || host, ''), '/')) <= 3 THEN 'section' END AS kind FROM resolved""", "resolved")


def _positioned(df):
    return df.withColumn("position", F.col("position").cast("bigint"))


def _pages(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "pages")


def _resolved(spark, sf_dir):
    kept = frontier.links(_pages(spark, sf_dir)).filter(urls.is_page_link(F.col("href")))
    return kept.withColumn("target", urls.resolve(F.col("base"), F.col("href")))


@query("link_extract", sql.statement("SELECT page_id, position, href FROM links", "links"))
def link_extract(spark, sf_dir):
    return _positioned(frontier.links(_pages(spark, sf_dir)).select("page_id", "position", "href"))


@query("link_filter", sql.statement("SELECT page_id, position, href FROM page_links", "page_links"))
def link_filter(spark, sf_dir):
    kept = frontier.links(_pages(spark, sf_dir)).filter(urls.is_page_link(F.col("href")))
    return _positioned(kept.select("page_id", "position", "href"))


@query("link_resolve", sql.statement("SELECT page_id, position, target FROM resolved", "resolved"))
def link_resolve(spark, sf_dir):
    return _positioned(_resolved(spark, sf_dir).select("page_id", "position", "target"))


@query("link_same_site", sql.statement("SELECT page_id, position, target, same_site FROM classified", "classified"))
def link_same_site(spark, sf_dir):
    same = urls.same_site(F.col("url"), F.col("target")).alias("same_site")
    return _positioned(_resolved(spark, sf_dir).select("page_id", "position", "target", same))


@query("link_classify", sql.statement(
    "SELECT page_id, position, target, kind FROM classified WHERE same_site AND kind IS NOT NULL", "classified"))
def link_classify(spark, sf_dir):
    return _positioned(frontier.page_links(_pages(spark, sf_dir)).select("page_id", "position", "target", "kind"))


# The walk starts at the first page of each host and goes over the links that the given pages hold.
sql.part("walk", """
  SELECT url, 'section' AS kind, 0 AS depth FROM (
    SELECT arg_min(url, page_id) AS url FROM pages GROUP BY split_part(split_part(split_part(url, '/', 3), '?', 1), '#', 1))
  UNION
  SELECT c.target, c.kind, w.depth + 1 FROM walk w JOIN classified c ON c.url = w.url
  WHERE w.depth < 5 AND w.kind = 'section' AND c.same_site AND c.kind IS NOT NULL""", "classified")


@query("link_frontier", sql.statement("SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY url", "walk"))
def link_frontier(spark, sf_dir):
    """Addresses reached from the first page of each host along the pages' own links."""
    pages = _pages(spark, sf_dir)
    firsts = pages.groupBy(urls.authority(F.col("url")).alias("host")).agg(F.min_by("url", "page_id").alias("url"))
    found = frontier.walk(frontier.page_links(pages).select("url", "target", "kind"), firsts.select("url"))
    return found.select("url", F.col("depth").cast("bigint").alias("depth"))


# Page fields.

_STRIP_TAGS = "regexp_replace({}, '<[^>]*>', '', 'g')"
_TITLE = sql.strip(sql.collapse(_unescape(_STRIP_TAGS.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"))))
_AREA = "regexp_extract(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?is)<article[^>]*>(.*)</article>', 1)"
_SPACED = (f"regexp_replace(regexp_replace({_AREA}, '(?is)<h1[^>]*>.*?</h1>', '', 'g'), "
           r"'(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[2-6]|tr)\b[^>]*>', ' ', 'g')")
_TEXT = sql.strip(sql.collapse(_unescape(_STRIP_TAGS.format(_SPACED))))
sql.part("page_text", f"SELECT page_id, url, html, {_TITLE} AS title, {_TEXT} AS content FROM pages")


@query("page_text", sql.statement("SELECT page_id, title, content FROM page_text", "page_text"))
def page_text(spark, sf_dir):
    return page_plan.parsed(_pages(spark, sf_dir)).select("page_id", html.page_title().alias("title"), html.page_text().alias("content"))


@query("page_min_length", sql.statement(
    "SELECT page_id, length(content) AS chars FROM page_text WHERE length(content) >= 100", "page_text"))
def page_min_length(spark, sf_dir):
    parsed = page_plan.parsed(_pages(spark, sf_dir))
    texts = parsed.select("page_id", F.length(html.page_text()).cast("bigint").alias("chars"))
    return texts.filter(F.col("chars") >= page_fields.MIN_TEXT)


@query("page_source", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source FROM pages")
def page_source(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.authority(F.col("url")).alias("source"))


def _read(spark, sf_dir):
    return page_plan.parsed(fixtures.pages_enriched(spark, sf_dir))


# Bylines. ``names`` mixes bylines, titles, dates, phone numbers and house names.
sql.part("names", """
  SELECT seq, CASE seq % 10 WHEN 0 THEN author WHEN 1 THEN title WHEN 2 THEN publish_date WHEN 3 THEN concat(seq, '. Top')
    WHEN 4 THEN concat('Bộ ', title) WHEN 5 THEN concat(title, ' & Co') WHEN 6 THEN concat('Ban Biên Tập ', seq)
    WHEN 7 THEN concat('Lê C 0912 345 ', 100 + seq % 900) WHEN 8 THEN concat('Trần B • ', seq, ' phút')
    ELSE concat('- ', left(title, 30), ' -') END AS name FROM article_raw""", "article_raw")


def _names(spark, sf_dir):
    seq, title = F.col("seq"), F.col("title")
    which, number = seq % 10, seq.cast("string")
    name = (
        F.when(which == 0, F.col("author")).when(which == 1, title).when(which == 2, F.col("publish_date"))
        .when(which == 3, F.concat(number, F.lit(". Top"))).when(which == 4, F.concat(F.lit("Bộ "), title))
        .when(which == 5, F.concat(title, F.lit(" & Co"))).when(which == 6, F.concat(F.lit("Ban Biên Tập "), number))
        .when(which == 7, F.concat(F.lit("Lê C 0912 345 "), (100 + seq % 900).cast("string")))
        .when(which == 8, F.concat(F.lit("Trần B • "), number, F.lit(" phút")))
        .otherwise(F.concat(F.lit("- "), F.left(title, F.lit(30)), F.lit(" -")))
    )
    return fixtures.article_raw(spark, sf_dir).select("seq", name.alias("name"))


def _valid(name: str) -> str:
    bare = sql.strip(name)
    return rf"""coalesce(NOT regexp_matches({bare}, '{authors.LIST_NUMBER}') AND NOT regexp_matches({bare}, '[?!]')
      AND length({name}) BETWEEN 2 AND 100 AND length(regexp_replace({name}, '[^0-9]', '', 'g')) < 7
      AND NOT regexp_matches({name}, '{authors.DATE_OR_TIME}')
      AND (len(regexp_split_to_array({bare}, '{sql.SPACE}+')) <= 6 OR regexp_matches(lower({name}), '[,&-]|và')
        OR regexp_matches({bare}, '(?i)^{authors.any_of(authors.ORGANISATION_WORDS)}'))
      AND NOT regexp_matches(lower({name}), '{authors.any_of(authors.BANNED_WORDS)}'), false)"""


def _clean(name: str) -> str:
    head = sql.strip(f"split_part({name}, '•', 1)")
    return sql.strip(f"regexp_replace(regexp_replace({head}, '(?i){authors.PHONE}', '', 'g'), '^-|-$', '', 'g')")


@query("author_valid", sql.statement(f"SELECT seq, {_valid('name')} AS valid FROM names", "names"))
def author_valid(spark, sf_dir):
    return _names(spark, sf_dir).select("seq", authors.is_valid_author(F.col("name")).alias("valid"))


_DEMOTED = f"(name <> '' AND (regexp_matches(lower(name), '{authors.any_of(authors.HOUSE_NAMES)}') OR NOT {_valid('name')}))"


@query("author_house", sql.statement(f"""
  SELECT seq, CASE WHEN {_DEMOTED} THEN name END AS fallback, CASE WHEN {_DEMOTED} THEN NULL ELSE name END AS author FROM names""", "names"))
def author_house(spark, sf_dir):
    lowered = authors.demoted(F.col("name"))
    return _names(spark, sf_dir).select(
        "seq", F.when(lowered, F.col("name")).alias("fallback"), F.when(~lowered, F.col("name")).alias("author"))


@query("author_clean", sql.statement(f"SELECT seq, {_clean('name')} AS cleaned FROM names", "names"))
def author_clean(spark, sf_dir):
    return _names(spark, sf_dir).select("seq", authors.clean_candidate(F.col("name")).alias("cleaned"))


sql.part("pages_enriched", """
  SELECT page_id, url, replace(html, '<article>', concat('<article>',
    CASE page_id % 6 WHEN 0 THEN '<meta property="article:published_time" content="2024-04-06T19:33:00+07:00">'
      WHEN 1 THEN '<time datetime="2024-04-07 08:05">x</time>' WHEN 2 THEN '<span class="date">Thứ hai, 6/4/2024, 17:02</span>'
      WHEN 3 THEN '<span class="date">14:29 06/02/2024</span>'
      WHEN 4 THEN '<meta name="pubdate" content="31/02/2024 10:00"><span class="date">05/03/2024</span>' ELSE '' END,
    CASE page_id % 7 WHEN 0 THEN '<a rel="author">Nguyễn Văn A</a>' WHEN 1 THEN '<span class="author-name">Trần B • 15 phút</span>'
      WHEN 2 THEN '<span class="author">Ban biên tập</span>' WHEN 3 THEN '<span class="author">Lê C - 0912 345 678</span>'
      WHEN 4 THEN '<span class="author">15/12/2023</span><meta name="author" content="Phạm D">'
      WHEN 5 THEN '<p style="text-align:right"><strong>Vũ E</strong></p>' ELSE '' END)) AS html FROM pages""")


def _first(pattern: str) -> str:
    return f"nullif({_unescape(f'regexp_extract(html, {_quote(pattern)}, 1)')}, '')"


_PLACES = [
    r'(?is)<a\b[^>]*rel="author"[^>]*>([^<]+)', r'(?is)<[a-z0-9]+\b[^>]*class="author-name"[^>]*>([^<]+)',
    r'(?is)<[a-z0-9]+\b[^>]*class="author"[^>]*>([^<]+)', r'(?is)<p\b[^>]*style="text-align:right"[^>]*><strong>([^<]+)',
]
sql.part("cascade", f"""
  SELECT page_id, url, html, list_filter(list_transform(list_filter([{", ".join(map(_first, _PLACES))}], lambda c: c IS NOT NULL),
    lambda c: {_clean("c")}), lambda c: {_valid("c")})[1] AS author FROM pages_enriched""", "pages_enriched")


@query("author_cascade", sql.statement("SELECT page_id, author FROM cascade", "cascade"))
def author_cascade(spark, sf_dir):
    return _read(spark, sf_dir).select("page_id", page_fields.cascade().alias("author"))


# Paragraphs of the article area: a paragraph ends at "</p>" or where the next one starts.
_NODE_TEXT = sql.strip(r"replace(replace(replace(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), chr(34), ''), '“', ''), '”', '')")
_LABELLED = sql.strip(r"regexp_extract(node, '(?i)(?:Nguồn|Theo|Source)\s*:?\s*(.+)', 1)")
sql.part("tail_nodes", f"""
  SELECT page_id, n, strong, {_NODE_TEXT} AS node FROM (
    SELECT page_id, n, regexp_matches(attrs, '(?i)(style|class|align)="[^"]*right') OR regexp_matches(body, '(?i)<(strong|b|em)>') AS strong,
      {_unescape(_STRIP_TAGS.format("body"))} AS text
    FROM (SELECT page_id, n, regexp_extract(seg, '^([^>]*)>', 1) AS attrs,
        regexp_replace(split_part(seg, '</p>', 1), '^[^>]*>', '') AS body
      FROM (SELECT page_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS n, len(segs) AS total
        FROM (SELECT page_id, regexp_split_to_array(regexp_extract(html, '(?is)<article>(.*)</article>', 1), '<p\\b')[2:] AS segs
          FROM pages_enriched))
      WHERE n > total - 15))""", "pages_enriched")
sql.part("tail", f"""
  SELECT page_id, arg_max(name, n) AS tail FROM (
    SELECT page_id, n, CASE WHEN length(node) BETWEEN 2 AND 100 THEN
      CASE WHEN labelled <> '' AND {_valid("labelled")} THEN labelled WHEN strong AND {_valid("node")} THEN node END END AS name
    FROM (SELECT *, {_LABELLED} AS labelled FROM tail_nodes)) WHERE name IS NOT NULL GROUP BY page_id""", "tail_nodes")


@query("author_tail", sql.statement("SELECT page_id, tail FROM pages LEFT JOIN tail USING (page_id)", "tail"))
def author_tail(spark, sf_dir):
    return _read(spark, sf_dir).select("page_id", tail_author().alias("tail"))


_META = f"""nullif({_first('(?is)<meta name="author" content="([^"]*)"')}, '')"""
_SHOWN = _first(r'(?is)<span class="author">([^<]+)')
sql.part("shown", f"SELECT page_id, {_META} AS meta, coalesce({_SHOWN}, '') AS name FROM pages_enriched", "pages_enriched")


@query("author_resolve", sql.statement(f"""
  SELECT page_id, coalesce(CASE WHEN {_DEMOTED} THEN name END, CASE WHEN {_valid("meta")} THEN meta END, 'Unknown') AS author
  FROM shown""", "shown"))
def author_resolve(spark, sf_dir):
    """Last resort: the shown byline if it is only a fallback, else the meta author, else the word."""
    place = html.both("page", lambda nodes, words: html.taken(nodes, words, "text", html.having("author")))
    shown = F.col("shown")
    fallback = F.when(authors.demoted(shown), shown)
    return _read(spark, sf_dir).withColumn("shown", F.expr(place)).select(
        "page_id", F.coalesce(fallback, page_fields.meta_author(), F.lit("Unknown")).alias("author"))


# Dates.
_DATE_PLACES = {
    0: r'(?is)<meta property="article:published_time" content="([^"]*)"', 1: r'(?is)<time datetime="([^"]*)"',
    2: r"(?is)<time\b[^>]*>([^<]+)", 3: r'(?is)<meta name="pubdate" content="([^"]*)"', 11: r'(?is)<span class="date">([^<]+)',
}
sql.part("date_candidates", f"""
  SELECT page_id, position, raw FROM (
    {" UNION ALL ".join(f"SELECT page_id, {n}::BIGINT AS position, {_first(p)} AS raw FROM pages_enriched" for n, p in _DATE_PLACES.items())})
  WHERE raw IS NOT NULL""", "pages_enriched")


def _parsed(raw: str) -> str:
    text = sql.strip(sql.collapse(raw))
    cases = []
    for pattern, (year, month, day, hour, minute) in dates.DATE_FORMS:
        def group(g, pattern=pattern):
            return f"regexp_extract({text}, '{pattern}', {g})" if g else "'0'"
        stamp = f"try_cast(concat({group(year)}, '-', {group(month)}, '-', {group(day)}, ' ', lpad({group(hour)}, 2, '0'), ':', lpad({group(minute)}, 2, '0'), ':00') AS TIMESTAMP)"
        cases.append(f"WHEN regexp_matches({text}, '{pattern}') THEN {stamp}")
    return f"CASE {' '.join(cases)} END"


def _candidates(spark, sf_dir):
    found = page_fields.date_candidates()
    exploded = _read(spark, sf_dir).select("page_id", F.posexplode(found).alias("position", "raw"))
    return _positioned(exploded.filter(F.col("raw").isNotNull()))


@query("date_candidates", sql.statement("SELECT * FROM date_candidates", "date_candidates"))
def date_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)


# Date texts of every page in a few spellings, impossible days included.
sql.part("date_texts", """
  SELECT page_id, CASE page_id % 8
    WHEN 0 THEN concat('2024-', m, '-', d, 'T', h, ':05:00+07:00') WHEN 1 THEN concat(d, '/', m, '/2024, ', h, ':07')
    WHEN 2 THEN concat(h, ':09  ', d, '-', m, '-2024') WHEN 3 THEN concat('Thứ hai, ', d, '/', m, '/2023')
    WHEN 4 THEN concat('2024-', m, '-', d) WHEN 5 THEN concat('Ngày ', d, '/', m, '/2024', chr(160), h, ':30 PM')
    WHEN 6 THEN concat('  2023-', m, '-', d, '   ', h, ':59:59') ELSE url END AS raw
  FROM (SELECT page_id, url, 1 + page_id % 12 AS m, 1 + page_id % 31 AS d, page_id % 24 AS h FROM pages)""")


@query("date_parse", sql.statement(
    f"SELECT page_id, strftime({_parsed('raw')}, '%Y-%m-%d %H:%M:%S') AS parsed FROM date_texts", "date_texts"))
def date_parse(spark, sf_dir):
    page_id = F.col("page_id")
    m, d, h = (x.cast("string") for x in (1 + page_id % 12, 1 + page_id % 31, page_id % 24))
    which = page_id % 8

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    raw = (
        F.when(which == 0, text("2024-", m, "-", d, "T", h, ":05:00+07:00")).when(which == 1, text(d, "/", m, "/2024, ", h, ":07"))
        .when(which == 2, text(h, ":09  ", d, "-", m, "-2024")).when(which == 3, text("Thứ hai, ", d, "/", m, "/2023"))
        .when(which == 4, text("2024-", m, "-", d)).when(which == 5, text("Ngày ", d, "/", m, "/2024\xa0", h, ":30 PM"))
        .when(which == 6, text("  2023-", m, "-", d, "   ", h, ":59:59")).otherwise(F.col("url"))
    )
    parsed = F.date_format(dates.parse_date(raw), dates.DATE_TEXT)
    return _pages(spark, sf_dir).select("page_id", parsed.alias("parsed"))


sql.part("page_dates", f"""
  SELECT page_id, coalesce(strftime(arg_min(stamp, position), '%Y-%m-%d %H:%M:%S'), 'Unknown') AS publish_date
  FROM pages LEFT JOIN (SELECT page_id, position, {_parsed("raw")} AS stamp FROM date_candidates) c USING (page_id)
  GROUP BY page_id""", "date_candidates")


@query("date_render", sql.statement("SELECT * FROM page_dates", "page_dates"))
def date_render(spark, sf_dir):
    """First real date of each page as text."""
    found = page_fields.publish_date(F.col("url"))
    return _read(spark, sf_dir).select("page_id", dates.render_date(found).alias("publish_date"))


@query("page_to_item", sql.statement(f"""
  SELECT e.page_id, e.title, e.content, e.url, regexp_extract(e.url, '^[a-z]+://([^/?#]*)', 1) AS source,
    coalesce(cascade.author, tail.tail, CASE WHEN {_valid("shown.meta")} THEN shown.meta END, 'Unknown') AS author, d.publish_date
  FROM (SELECT page_id, url, {_TITLE} AS title, {_TEXT} AS content FROM pages_enriched) e
    JOIN cascade USING (page_id) LEFT JOIN tail USING (page_id) JOIN shown USING (page_id) JOIN page_dates d USING (page_id)
  WHERE length(e.content) >= 100""", "pages_enriched", "cascade", "tail", "shown", "page_dates"))
def page_to_item(spark, sf_dir):
    return page_plan.page_items(fixtures.pages_enriched(spark, sf_dir))
