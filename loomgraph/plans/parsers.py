"""Queries on wikitext; pages are made of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import parsers as ps
from loomgraph.plans.base import Book
from loomgraph.session import table

book = Book()
#: The same text in both engines: a page holds 40 events; line kinds follow the row id.
PAGE = """SELECT CAST(floor(row_id / 40) AS {i}) AS page, row_id,
    CASE WHEN row_id % 19 = 0 THEN '== Mục ' || CAST(row_id AS {s}) || ' =='
         WHEN row_id % 7 = 1 THEN {q} || coalesce(CAST(abs(tau_start) AS {s}), 'Thế kỷ') || CASE WHEN tau_start < 0 THEN ' TCN' ELSE '' END || {q}
         WHEN row_id % 7 = 2 THEN {q} || coalesce(CAST(abs(tau_start) AS {s}), '?') || CASE WHEN tau_start < 0 THEN ' TCN' ELSE '' END || ':' || {q} || ' [[' || replace(replace(h_label, '[', ''), ']', '') || '|Sự kiện ' || CAST(row_id AS {s}) || ']] tại [[' || coalesce(t_label, 'X') || ']]'
         WHEN row_id % 7 = 3 THEN ':' || {q} || CAST(row_id % 28 + 1 AS {s}) || ' tháng 5:' || {q} || ' trận [[' || replace(replace(h_label, '[', ''), ']', '') || ']]'
         WHEN row_id % 7 = 4 THEN {q} || CAST(1000 + row_id % 900 AS {s}) || ' - ' || CAST(1010 + row_id % 900 AS {s}) || {q} || ' khởi nghĩa [[E' || CAST(row_id AS {s}) || ']]'
         WHEN row_id % 7 = 5 THEN '::' || {q} || 'không rõ:' || {q} || ' hội thề [[O' || CAST(row_id AS {s}) || ']] và [[P]]'
         ELSE 'văn bản ' || CAST(row_id AS {s}) END AS line FROM {e}"""
P_SQL = "pg AS (" + PAGE.replace("{e}", "historical_events").replace("{s}", "VARCHAR").replace("{i}", "BIGINT").replace("{q}", "repeat(chr(39), 3)") + ")"


def page_lines(spark, d):
    sql = PAGE.replace("{s}", "STRING").replace("{i}", "BIGINT").replace("{q}", "repeat(chr(39), 3)")
    return spark.sql(sql, e=table(spark, d, "historical_events"))


def pages(spark, d):
    p = page_lines(spark, d).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return p


_D, _B, _F = "^" + "'" * 6 + "([^'']+?):" + "'" * 6 + r"\s*(.*)$", "^" + "'" * 6 + "([^'':]+)" + "'" * 6 + "$", "^" + "'" * 6 + "([^'':]+)" + "'" * 6 + r"\s+(.+)$"
_LINK = r"\[\[([^\]|#]+)(?:\|([^\]]+))?\]\]"


def _tok(c):
    v = f"TRY_CAST(nullif(regexp_replace({c}, '[^0-9]', '', 'g'), '') AS INTEGER)"
    return f"CASE WHEN contains(lower({c}), 'tháng') THEN NULL WHEN contains(upper({c}), 'TCN') THEN -{v} ELSE {v} END"


_P1, _P2 = "string_split_regex(trim(span), '\\s*[-–]\\s*')[1]", "string_split_regex(trim(span), '\\s*[-–]\\s*')[2]"
TIMELINE_SQL = rf"""WITH {P_SQL}, l0 AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY row_id) - 1 AS pos, trim(line) AS raw FROM pg),
    l1 AS (SELECT *, regexp_matches(raw, '^(==\s*.*\s*==|===\s*.*\s*===|====\s*.*\s*====)$') AS header, starts_with(raw, ':') AS nested, trim(regexp_replace(raw, '^:+', '')) AS x FROM l0 WHERE raw <> ''),
    l2 AS (SELECT *, CASE WHEN header THEN 'header' WHEN regexp_matches(x, '{_D}') THEN 'dated' WHEN regexp_matches(x, '{_B}') THEN 'bare' WHEN regexp_matches(x, '{_F}') THEN 'free' ELSE 'other' END AS kind FROM l1),
    l3 AS (SELECT *, CASE kind WHEN 'dated' THEN regexp_extract(x, '{_D}', 1) WHEN 'free' THEN regexp_extract(x, '{_F}', 1) WHEN 'bare' THEN regexp_extract(x, '{_B}', 1) END AS span, CASE kind WHEN 'dated' THEN regexp_extract(x, '{_D}', 2) WHEN 'free' THEN regexp_extract(x, '{_F}', 2) END AS d FROM l2),
    l4 AS (SELECT *, {_tok(_P1)} AS a, {_tok(_P2)} AS b, len(string_split_regex(trim(span), '\s*[-–]\s*')) > 1 AS two, trim(coalesce(nullif(regexp_extract(d, '{_LINK}', 2), ''), regexp_extract(d, '{_LINK}', 1))) AS label, trim(regexp_replace(regexp_replace(d, '\[\[[^\]|#]+\|([^\]]+)\]\]', '\1', 'g'), '\[\[([^\]|#]+)\]\]', '\1', 'g')) AS txt FROM l3),
    l5 AS (SELECT *, CASE WHEN NOT two THEN a WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END AS y0, CASE WHEN NOT two THEN a WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS y1, sum(CASE WHEN header THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos) AS section FROM l4),
    l6 AS (SELECT *, last_value(CASE WHEN kind = 'bare' OR (kind = 'free' AND NOT nested) OR (kind = 'dated' AND NOT nested AND txt <> '' AND label <> '') THEN y0 END IGNORE NULLS) OVER (PARTITION BY page, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM l5),
    l7 AS (SELECT *, nested AND carried IS NOT NULL AND (contains(lower(span), 'tháng') OR y0 IS NULL) AND (kind = 'dated' OR y0 IS NOT NULL) AS use FROM l6 WHERE kind IN ('dated', 'free') AND txt <> '' AND label <> '')
    SELECT page, pos, label AS h_label, CASE WHEN use THEN carried ELSE y0 END AS tau_start, CASE WHEN use THEN carried ELSE y1 END AS tau_end, txt AS vi_context FROM l7 WHERE CASE WHEN use THEN carried ELSE y0 END IS NOT NULL"""


@book.add("parse_timeline", TIMELINE_SQL)
def _(spark, d):
    return ps.timeline(pages(spark, d), place=False).select("page", "pos", "h_label", "tau_start", "tau_end", "vi_context")


def _label(c):
    return rf"trim(coalesce(nullif(regexp_extract({c}, '{_LINK}', 2), ''), regexp_extract({c}, '{_LINK}', 1)))"


_WORDS = "[" + ", ".join(f"'{m}'" for m in ps.PLACE_MARKERS) + "]"
#: Every position of every place word in the text behind the first link, by trying all of them.
PLACES_SQL = TIMELINE_SQL.replace("txt AS vi_context FROM l7", "txt AS vi_context, d FROM l7") + rf""" ), tl AS (SELECT *, CASE WHEN regexp_matches(d, '{_LINK}') THEN regexp_extract(d, '(?s){_LINK}(.*)$', 3) ELSE d END AS tail, CASE WHEN regexp_matches(d, '{_LINK}') THEN {_label('d')} END AS own FROM tm),
    hit AS (SELECT page, pos, own, k, i, substring(tail, i + length(w), 80) AS near FROM (SELECT *, unnest(range(1, length(tail) + 1)) AS i FROM tl) x, (SELECT unnest(range(1, 9)) AS k, unnest({_WORDS}) AS w) m
        WHERE lower(substring(tail, i, length(w))) = w AND NOT regexp_matches(substring(tail, i + length(w), 1), '[\p{{L}}\p{{N}}\p{{M}}_]') AND (i = 1 OR NOT regexp_matches(substring(tail, i - 1, 1), '[\p{{L}}\p{{N}}\p{{M}}_]'))),
    best AS (SELECT page, pos, arg_min(label, (k, i)) AS place FROM (SELECT *, {_label('near')} AS label FROM hit) WHERE label <> '' AND (own IS NULL OR label <> own) GROUP BY page, pos)
    SELECT page, pos, h_label, 'occurredAt' AS r, coalesce(place, 'Việt Nam') AS t_label, tau_start, tau_end, vi_context FROM tm LEFT JOIN best USING (page, pos)"""
PLACES_SQL = PLACES_SQL.replace("    SELECT page, pos, label AS h_label", "    tm AS (SELECT page, pos, label AS h_label", 1).replace("IN ('dated', 'free') AND txt <> '' AND label <> '')\n", "IN ('dated', 'free') AND txt <> '' AND label <> ''),\n", 1)


@book.add("parse_timeline_places", PLACES_SQL)
def _(spark, d):
    return ps.timeline(pages(spark, d))


HERITAGE = """SELECT CAST(floor(row_id / 60) AS {i}) AS page, row_id,
    CASE WHEN row_id % 29 = 0 THEN '==Vùng ' || CAST(row_id % 5 AS {s}) || '==' WHEN row_id % 11 = 0 THEN '===Tỉnh ' || CAST(row_id % 13 AS {s}) || '===' WHEN row_id % 13 = 0 THEN '|-'
         WHEN row_id % 17 = 0 THEN '|ô || thiếu' ELSE '|[[' || replace(replace(h_label, '[', ''), ']', '') || '#mục]]{{x}} || [http://a.b/c Xã ' || CAST(row_id % 50 AS {s}) || '] || <b>Loại ' || CAST(row_id % 4 AS {s}) || '</b> || ' || coalesce(CAST(abs(tau_start) AS {s}), 'chưa rõ') END AS line FROM {e}"""
H_SQL = "pg AS (" + HERITAGE.replace("{e}", "historical_events").replace("{s}", "VARCHAR").replace("{i}", "BIGINT") + ")"


def heritage_pages(spark, d):
    lines = spark.sql(HERITAGE.replace("{s}", "STRING").replace("{i}", "BIGINT").replace("{{x}}", "{{{{x}}}}"), e=table(spark, d, "historical_events"))
    return lines.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


@book.add("parse_heritage", rf"""WITH {H_SQL}, l0 AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY row_id) - 1 AS pos, line, trim(line) AS x FROM pg),
    l1 AS (SELECT *, sum(CASE WHEN regexp_matches(x, '^==[^=].*==$') THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos) AS rno, last_value(CASE WHEN regexp_matches(x, '^==[^=].*==$') THEN trim(regexp_extract(x, '^==([^=].*?)==$', 1)) END IGNORE NULLS) OVER (PARTITION BY page ORDER BY pos) AS region FROM l0),
    l2 AS (SELECT *, last_value(CASE WHEN regexp_matches(x, '^===[^=].*===$') THEN trim(regexp_extract(x, '^===([^=].*?)===$', 1)) END IGNORE NULLS) OVER (PARTITION BY page, rno ORDER BY pos) AS province FROM l1),
    l3 AS (SELECT *, string_split(line, '||') AS c FROM l2 WHERE starts_with(line, '|') AND NOT starts_with(line, '|-') AND contains(line, '||') AND coalesce(province, '') <> ''),
    l4 AS (SELECT *, trim(split_part(regexp_extract(c[1], '\[\[([^\]|]+)', 1), '#', 1)) AS h_label FROM l3 WHERE len(c) >= 4)
    SELECT page, pos, h_label, 'locatedIn' AS r, province AS t_label, TRY_CAST(nullif(regexp_extract(c[4], '([0-9]{{4}})', 1), '') AS INTEGER) AS tau_start, trim(regexp_replace(c[2], '\[http[^ ]* ([^\]]+)\]', '\1')) || '; ' || trim(regexp_replace(c[3], '<[^>]+>', '', 'g')) || '; vùng ' || coalesce(region, '') AS vi_context FROM l4 WHERE h_label <> ''""")
def _(spark, d):
    return ps.heritage(heritage_pages(spark, d)).withColumn("vi_context", F.when(F.col("vi_context").endswith("vùng"), F.concat("vi_context", F.lit(" "))).otherwise(F.col("vi_context")))


@book.add("parse_links", rf"WITH {P_SQL} SELECT row_id, trim(coalesce(nullif(regexp_extract(line, '{_LINK}', 2), ''), regexp_extract(line, '{_LINK}', 1))) AS link, regexp_replace(regexp_replace(line, '\[\[[^\]|#]+\|([^\]]+)\]\]', '\1', 'g'), '\[\[([^\]|#]+)\]\]', '\1', 'g') AS cleaned FROM pg")
def _(spark, d):
    return page_lines(spark, d).select("row_id", ps.first_link(F.col("line")).alias("link"), ps.clean_links(F.col("line")).alias("cleaned"))


_SPAN = "CASE row_id % 5 WHEN 0 THEN coalesce(CAST(tau_start AS {s}), 'x') || ' TCN' WHEN 1 THEN '25.' || CAST(100 + row_id % 900 AS {s}) WHEN 2 THEN '42 TCN - ' || CAST(row_id % 90 AS {s}) WHEN 3 THEN '7 tháng 5' ELSE CAST(row_id AS {s}) || '–' || CAST(row_id % 77 AS {s}) || ' - 3' END"
_SS = _SPAN.replace("{s}", "VARCHAR")


@book.add("parse_year_span", f"WITH x AS (SELECT row_id, {_SS} AS span FROM historical_events), y AS (SELECT row_id, {_tok(_P1)} AS a, {_tok(_P2)} AS b, len(string_split_regex(trim(span), '\\s*[-–]\\s*')) > 1 AS two FROM x) SELECT row_id, CASE WHEN NOT two THEN a WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END AS y0, CASE WHEN NOT two THEN a WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS y1 FROM y")
def _(spark, d):
    e = table(spark, d, "historical_events").selectExpr("row_id", _SPAN.replace("{s}", "STRING") + " as span")
    a, b = ps.year_span(F.col("span"))
    return e.select("row_id", a.alias("y0"), b.alias("y1"))


@book.add("parse_event_year", r"""SELECT qid, TRY_CAST(coalesce(nullif(regexp_extract(question, '(?i)ngày\s+([0-9]{1,2})\s+tháng\s+([0-9]{1,2})\s+năm\s+([0-9]{3,4})', 3), ''), nullif(regexp_extract(question, '([0-9]{1,2})/([0-9]{1,2})/([0-9]{3,4})', 3), ''), nullif(regexp_extract(question, '(?i)năm\s+([0-9]{3,4})', 1), ''), nullif(regexp_extract(question, '(^|[^\p{L}\p{N}_])(1[0-9]{3}|20[0-2][0-9])($|[^\p{L}\p{N}_])', 2), '')) AS INTEGER) AS year FROM questions""")
def _(spark, d):
    return table(spark, d, "questions").select("qid", ps.event_year(F.col("question")).alias("year"))


@book.add("parse_caption_year", r"SELECT doc_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '(^|[^\p{L}\p{N}_\p{M}])(1[0-9]{3}|20[0-2][0-9])($|[^\p{L}\p{N}_\p{M}])', 2), '') AS INTEGER), 2014) AS year FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", ps.caption_year(F.col("text")).alias("year"))


@book.add("parse_context", "SELECT doc_id, substring(text, 1, 300) AS context, substring(text, 1, 2000) AS content FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("context"), F.substring("text", 1, 2000).alias("content"))


@book.add("parse_search_markup", """SELECT row_id, replace(replace('<span class="searchmatch">' || h_label || '</span> x', '<span class="searchmatch">', ''), '</span>', '') AS snippet, r || '|' || t AS categories FROM historical_events""")
def _(spark, d):
    s = F.concat(F.lit('<span class="searchmatch">'), "h_label", F.lit("</span> x"))
    return table(spark, d, "historical_events").select("row_id", F.replace(F.replace(s, F.lit('<span class="searchmatch">'), F.lit("")), F.lit("</span>"), F.lit("")).alias("snippet"), F.array_join(F.array("r", "t"), "|").alias("categories"))
