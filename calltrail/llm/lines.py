"""Line deduplication by site-relative frequency: lines on too large a share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, written

#: Share of a host's pages above which a line is boilerplate, and the least number of pages it must be on.
MAX_RATIO, MIN_PAGES = 0.10, 3
# Parts of HTML that hold no text, and tags, which part lines.
HIDDEN = (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->")
TAG = r"<[^>]*>"
EDGES = " \t\r\x0b\x0c"


def html_lines(html: Column) -> Column:
    """Text of a page, one line for each piece between tags; line breaks inside a piece part lines too."""
    text = html
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, TAG, "\n")


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; NULL without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGES))


def _key(line: Column) -> Column:
    return F.xxhash64(_bare(line))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): for each host the hashes of its boilerplate lines.

    At most (average distinct lines of a page) / ``max_ratio`` lines of a host can be that frequent, so the arrays are
    short however large the host. Both counts are partially aggregated, so a hot host or line costs one row per task.
    """
    slim = pages.select(F.col(host).alias("host"), F.col(text).alias("_text"))
    totals = slim.groupBy("host").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split("_text", "\n", -1), _bare), lambda x: x != ""), lambda x: F.xxhash64(x)))
    found = slim.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("on_pages")).filter(F.col("on_pages") >= min_pages)
    return (found.join(totals, found["host"].eqNullSafe(totals["host"])).filter(F.col("on_pages") > max_ratio * F.col("pages"))
            .groupBy(found["host"]).agg(F.collect_list("line").alias("lines")))


def drop_boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, keep_emptied: bool = False,
                     n_lines: str = "_n_lines", n_dropped: str = "_n_dropped") -> DataFrame:
    """``pages`` with ``text`` freed of boilerplate lines, and the columns ``n_lines`` and ``n_dropped`` (lines that are not blank).

    A line is judged without white space at its ends and counts once a page. Within a host (``host``; pages without one
    form a host) a line on at least ``min_pages`` pages and on more than ``max_ratio`` of them is dropped wherever it
    occurs; other lines, blank ones too, keep their order and form. With ``keep_emptied`` a page that would lose all its lines
    loses none.

    Cases: NULL text stays NULL with no lines; repeated rows count as pages of their own; a host of one or two pages
    loses nothing; an empty table stays empty; other columns pass through, whatever their names; the two new ones need names
    that ``pages`` does not have (``shared.free_name`` gives them).
    """
    host_name, bad_name = free_name(pages, "_host"), free_name(pages, "_bad")
    bad = written(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate")
    bad = bad.select(F.col("host").alias(host_name), F.col("lines").alias(bad_name))
    joined = pages.join(bad, F.col(host).eqNullSafe(F.col(host_name)), "left")
    lines = F.split(F.col(text), "\n", -1)
    dropped = lambda x: F.coalesce(F.array_contains(bad_name, _key(x)), F.lit(False)) & (_bare(x) != "")
    kept = F.when(F.col(bad_name).isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x: ~dropped(x)), "\n"))
    filled = F.coalesce(F.size(F.filter(lines, lambda x: _bare(x) != "")), F.lit(0))
    n_bad = F.when(F.col(bad_name).isNull(), 0).otherwise(F.size(F.filter(lines, dropped)))
    if keep_emptied:
        whole = (n_bad > 0) & (n_bad == filled)
        kept, n_bad = F.when(whole, F.col(text)).otherwise(kept), F.when(whole, 0).otherwise(n_bad)
    return joined.select(*[kept.alias(c) if c == text else F.col(c) for c in pages.columns],
                         F.when(F.col(text).isNull(), 0).otherwise(filled).cast("long").alias(n_lines),
                         F.when(F.col(text).isNull(), 0).otherwise(n_bad).cast("long").alias(n_dropped))


LINES_SQL = rf"""
WITH texts AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN[0]}', '', 'g'), '{HIDDEN[1]}', '', 'g'), '{HIDDEN[2]}', '', 'g'), '{TAG}', chr(10), 'g') AS text
  FROM pages),
numbered AS (SELECT row_number() OVER () AS r, * FROM texts),
lines AS (
  SELECT r, host, i, l[i] AS line, trim(l[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS bare
  FROM (SELECT r, host, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, host, string_split(text, chr(10)) AS l FROM numbered))),
totals AS (SELECT host, count(*) AS pages FROM numbered GROUP BY host),
frequent AS (
  SELECT f.host, bare FROM (SELECT host, bare, count(DISTINCT r) AS on_pages FROM lines WHERE bare <> '' GROUP BY host, bare) f
  JOIN totals t ON f.host IS NOT DISTINCT FROM t.host WHERE on_pages >= {MIN_PAGES} AND on_pages > {MAX_RATIO} * pages),
judged AS (SELECT l.*, f.bare IS NOT NULL AS dropped FROM lines l LEFT JOIN frequent f ON l.bare = f.bare AND l.host IS NOT DISTINCT FROM f.host)
SELECT n.page_id, n.host, coalesce(count(*) FILTER (bare <> ''), 0) AS n_lines, coalesce(count(*) FILTER (dropped), 0) AS n_dropped,
  CASE WHEN any_value(n.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') END AS text
FROM numbered n LEFT JOIN judged j ON n.r = j.r GROUP BY n.r, n.page_id, n.host
"""
