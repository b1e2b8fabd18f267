"""Site-relative line dedup, in DataFrame operations only.

Pages are grouped by host.  A line's ratio is the share of its host's pages that
hold it; lines over ``max_ratio`` on ``min_pages`` pages or more are the site's
boilerplate and are dropped from every page of the host.

The counts run over (host, line digest) and are summed before they are shuffled,
so a host with a third of all pages is spread over its lines.  A host has fewer
boilerplate lines than its pages' mean number of lines over ``max_ratio``, so
the list a host takes back to its pages is short, whatever the host's size.

A null page has no lines; a null address belongs to the host ''.  A line that
repeats within a page counts once for that page, and all its occurrences go
together.  Repeated rows count each as a page.  Pages of any length are read as a
whole.  An empty table gives no rows.  Other columns stay in the column ``row``,
so that their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.llm.shared import written

#: Elements whose text is not shown; inline marks that do not end a line; any other tag ends one.
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
INLINE = r"(?i)</?(?:a|b|i|u|em|strong|span|small|sub|sup|code)(?:\s[^>]*)?>"
TAG = r"<[^>]*>"


def host(url: str) -> Column:
    """Lower-case host of an address, without port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def html_lines(html: str) -> Column:
    """Lines of a page's visible text."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), HIDDEN, ""), INLINE, ""), TAG, "\n")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def text_lines(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")


def boilerplate(pages: DataFrame, max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """(host, drop): digests of each host's boilerplate, from rows of (host, lines)."""
    total = pages.groupBy("host").agg(F.count("*").alias("n_pages"))
    found = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.md5(x.cast("binary"))))).alias("digest"))
    often = found.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = often.join(total, "host").where(F.col("n") > max_ratio * F.col("n_pages"))
    return over.groupBy("host").agg(F.collect_set("digest").alias("drop"))


def deduped(pages: DataFrame, lines: Column, site: Column, max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """(row, host, n_lines, kept): the rows as they came, and of each the lines that stay."""
    facts = pages.select(site.alias("host"), lines.alias("lines"))
    # Written, its size is known: small, it is broadcast and the pages are not shuffled; large, a host's pages can be split.
    drop = written(boilerplate(facts, max_ratio, min_pages), "boilerplate")
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), site.alias("host"), lines.alias("lines"))
    rows = rows.join(drop, "host", "left")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("drop", F.md5(x.cast("binary")))))
    return rows.select("row", "host", F.size("lines").alias("n_lines"), kept.alias("kept"))


def report(pages: DataFrame) -> DataFrame:
    rows = deduped(pages.select("page_id", "url", "html"), html_lines("html"), host("url"))
    return rows.select("row.page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.concat_ws("\n", "kept").alias("kept_text"))


ORACLE = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
        '(?i)</?(?:a|b|i|u|em|strong|span|small|sub|sup|code)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g'), chr(10)),
      lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages
), h AS (SELECT host, count(*) AS n_pages FROM p GROUP BY host),
e AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM p),
o AS (
  SELECT host, list(line) AS drops FROM (
    SELECT e.host, e.line FROM e JOIN h ON h.host = e.host GROUP BY e.host, e.line HAVING count(*) >= 3 AND count(*) > 0.1 * any_value(n_pages)
  ) GROUP BY host
), k AS (
  SELECT page_id, p.host, len(lines) AS n_lines, CASE WHEN drops IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(drops, x)) END AS kept
  FROM p LEFT JOIN o ON o.host = p.host
)
SELECT page_id, host, n_lines::INT AS n_lines, (n_lines - len(kept))::INT AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS kept_text FROM k
"""
