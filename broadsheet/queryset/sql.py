"""Shared pieces of the DuckDB statements the queries are checked against."""

from __future__ import annotations

from broadsheet.functions import text

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(expr: str) -> str:
    return f"regexp_replace({expr}, '{SPACE}+', ' ', 'g')"


def clean(expr: str) -> str:
    out = collapse(expr)
    for pattern in text.JUNK_PATTERNS:
        out = f"regexp_replace({out}, '(?i){pattern}', '', 'g')"
    return strip(out)


def half_up(part: str, whole: str, scale: int) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN (2*({part})*{scale} + ({whole})) // (2*({whole})) ELSE 0 END"


def ratio(part: str, whole: str, digits: int) -> str:
    return f"CAST({half_up(part, whole, 10 ** digits)} AS DOUBLE) / {10 ** digits}.0"


def percent(part: str, whole: str) -> str:
    return f"CAST({half_up(part, whole, 1000)} AS DOUBLE) / 10.0"


PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (list(needs), sql)


def statement(select: str, *needs: str) -> str:
    """``select`` after the named parts and everything they need, each once."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in PARTS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + select


part("article_raw", """
  SELECT doc_id AS seq,
    concat('https://src', CAST(uid % 20 AS varchar), '.example.com/', CAST(uid AS varchar), '.html') AS url,
    trim(left(split_part(text, '.', 1), 80)) AS title, text AS content,
    CASE doc_id % 7 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Nguyễn A, Trần B' WHEN 2 THEN 'Lê C và Phạm D'
      WHEN 3 THEN 'Hoàng E (TTXVN) - Vũ F' ELSE concat('Writer ', CAST(doc_id % 13 AS varchar)) END AS author,
    CASE WHEN doc_id % 11 = 0 THEN 'Unknown' WHEN doc_id % 53 = 0 THEN '31/12/2023 10:00'
      ELSE concat('2024-', lpad(CAST(1 + doc_id % 12 AS varchar), 2, '0'), '-',
                  lpad(CAST(1 + doc_id % 28 AS varchar), 2, '0'), ' 08:30:00') END AS publish_date
  FROM (SELECT doc_id, text, CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS uid FROM documents)""")

part("article_metadata", """
  SELECT seq, sha256(url) AS url_hash, url, title, content, author, publish_date FROM article_raw
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1""", "article_raw")

part("chosen", """
  SELECT *, row_number() OVER (ORDER BY seq) AS article_id FROM (
    SELECT * FROM article_metadata QUALIFY row_number() OVER (PARTITION BY title ORDER BY seq) = 1)""",
     "article_metadata")

part("judged", f"""
  SELECT *, CASE WHEN reason IS NULL THEN 'ok' WHEN reason LIKE 'missing%' THEN 'skipped' ELSE 'error' END AS status,
    split_part(url, '/', 3) AS domain, CAST(try_strptime(publish_date, '%Y-%m-%d %H:%M:%S') AS DATE) AS date,
    {clean("content")} AS text
  FROM (SELECT *, CASE WHEN author = 'Unknown' THEN 'missing_author' WHEN publish_date = 'Unknown' THEN 'missing_date'
      WHEN try_strptime(publish_date, '%Y-%m-%d %H:%M:%S') IS NULL THEN 'bad_date' END AS reason FROM chosen)""",
     "chosen")

part("loaded", "SELECT * FROM judged WHERE status = 'ok'", "judged")


def split_authors(expr: str) -> str:
    """List of names in a byline text."""
    first = rf"regexp_split_to_array(regexp_replace({expr}, '\(.*?\)', '', 'g'), '(?i){SPACE}+và{SPACE}+')[1]"
    names = rf"list_filter(list_transform(regexp_split_to_array({first}, ',|{SPACE}*-{SPACE}*'), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"CASE WHEN len({names}) > 0 THEN {names} ELSE ['Unknown'] END"


part("article_authors", f"""
  SELECT DISTINCT article_id, unnest({split_authors("author")}) AS author_name FROM loaded""", "loaded")

part("dim_source", """
  SELECT row_number() OVER (ORDER BY domain) AS source_id, domain FROM (SELECT DISTINCT domain FROM loaded)""", "loaded")
part("dim_time", """
  SELECT row_number() OVER (ORDER BY date) AS time_id, date, day(date) AS day, month(date) AS month, year(date) AS year
  FROM (SELECT DISTINCT date FROM loaded)""", "loaded")
part("dim_author", """
  SELECT row_number() OVER (ORDER BY author_name) AS author_id, author_name
  FROM (SELECT DISTINCT author_name FROM article_authors)""", "article_authors")
part("dim_content", "SELECT article_id AS content_id, url_hash, text AS content FROM loaded", "loaded")
part("fact_articles", """
  SELECT article_id, url_hash, title, source_id, time_id, article_id AS content_id, length(text) AS content_length
  FROM loaded JOIN dim_source USING (domain) JOIN dim_time USING (date)""", "loaded", "dim_source", "dim_time")
part("fact_article_authors", """
  SELECT article_id, author_id FROM article_authors JOIN dim_author USING (author_name)""", "article_authors", "dim_author")

# Recursive chunking. Pieces are cut before "." (level 1), long ones before " " (level 2), long ones of
# those per character (level 3). A run is a stretch of neighbouring pieces of one level and parent.
part("chunk_atoms", """
  SELECT article_id, i1, i2, i3, CASE WHEN length(p1) < 800 THEN 1 WHEN length(p2) < 800 THEN 2 ELSE 3 END AS level, p3 AS piece
  FROM (
    SELECT *, unnest(CASE WHEN length(p2) >= 800 THEN regexp_extract_all(p2, '(?s).') ELSE [p2] END) AS p3,
      generate_subscripts(CASE WHEN length(p2) >= 800 THEN regexp_extract_all(p2, '(?s).') ELSE [p2] END, 1) AS i3
    FROM (
      SELECT *, unnest(CASE WHEN length(p1) >= 800 THEN regexp_extract_all(p1, ' [^ ]*|[^ ]+') ELSE [p1] END) AS p2,
        generate_subscripts(CASE WHEN length(p1) >= 800 THEN regexp_extract_all(p1, ' [^ ]*|[^ ]+') ELSE [p1] END, 1) AS i2
      FROM (
        SELECT article_id, unnest(l) AS p1, generate_subscripts(l, 1) AS i1
        FROM (SELECT article_id, regexp_extract_all(text, '\\.[^.]*|[^.]+') AS l FROM loaded))))""", "loaded")
part("chunk_runs", """
  SELECT article_id, run, list(piece ORDER BY i1, i2, i3) AS pieces, min(i1) AS r1, min(i2) AS r2,
    list_prepend(0::BIGINT, list(total ORDER BY i1, i2, i3)) AS ends, count(*) AS n
  FROM (
    SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY article_id, run ORDER BY i1, i2, i3) AS BIGINT) AS total
    FROM (
      SELECT *, sum(turn) OVER (PARTITION BY article_id ORDER BY i1, i2, i3) AS run
      FROM (
        SELECT *, CASE WHEN (level, CASE WHEN level > 1 THEN i1 ELSE 0 END, CASE WHEN level > 2 THEN i2 ELSE 0 END)
            IS DISTINCT FROM lag((level, CASE WHEN level > 1 THEN i1 ELSE 0 END, CASE WHEN level > 2 THEN i2 ELSE 0 END))
            OVER (PARTITION BY article_id ORDER BY i1, i2, i3) THEN 1 ELSE 0 END AS turn
        FROM chunk_atoms)))
  GROUP BY article_id, run""", "chunk_atoms")
part("chunk_windows", """
  SELECT article_id, run, n, ends, 0::BIGINT AS s,
    len(list_filter(ends, lambda x: x <= 800))::BIGINT - 1 AS e
  FROM chunk_runs
  UNION ALL
  SELECT article_id, run, n, ends, s2, len(list_filter(ends, lambda x: x <= ends[s2 + 1] + 800))::BIGINT - 1
  FROM (
    SELECT *, least(e, greatest(s, len(list_filter(ends, lambda x: x < greatest(ends[e + 1] - 150, ends[e + 2] - 800)))::BIGINT)) AS s2
    FROM chunk_windows WHERE e < n)""", "chunk_runs")
part("chunk_texts", f"""
  SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY run, s, e) - 1 AS chunk_index, chunk
  FROM (SELECT w.article_id, w.run, w.s, w.e, {strip("array_to_string(r.pieces[w.s + 1 : w.e], '')")} AS chunk
    FROM chunk_windows w JOIN chunk_runs r ON w.article_id = r.article_id AND w.run = r.run)
  WHERE chunk <> ''""", "chunk_windows", "chunk_runs")
part("fact_chunks", r"""
  SELECT article_id * 16777216 + chunk_index AS chunk_id, article_id, chunk_index,
    regexp_replace(chunk, '^[. ,!?\n\t]+', '') AS content
  FROM chunk_texts WHERE regexp_replace(chunk, '^[. ,!?\n\t]+', '') <> ''""", "chunk_texts")
