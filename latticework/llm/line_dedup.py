"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency is the number of the host's pages
that contain it divided by the number of the host's pages; lines above a ratio
are the site's boilerplate and are dropped from every page of that host.

No text is shuffled. The first pass counts (host, line digest) with partial sums,
so that a hot host or line arrives as one row a task. A host can't have more
boilerplate lines than ``lines a page / ratio``; their digests, grouped by host,
meet the pages by a broadcast if they are few, else by a join on the host in
which adaptive execution splits hot hosts.

Defined results:

* a line is what stands between line feeds, compared without white space at its
  ends; lines without other characters are never counted nor dropped;
* a line counts once a page, however often the page repeats it;
* a null text stays null, with 0 lines; an empty one stays empty, with 1 line;
* a null host is a host of its own; the ratio alone decides, so a host of few
  pages loses lines that one page has, unless ``min_pages`` asks for more;
* repeated rows count as pages of their own; an empty table gives no rows;
* a very long text is split within its row, in memory of a few times its length;
* other columns stay as they are; the counts come as one struct column whose
  name the caller gives, and a column of that name is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, let, table, unwrapped, wrapped

#: A line is boilerplate if more than this share of its host's pages contain it.
RATIO = 0.1
#: Up to so many boilerplate lines, at 16 bytes and some overhead each, are broadcast.
BROADCAST_LINES = 200_000


def _digest(line: Column) -> Column:
    """16 bytes for a line without the white space at its ends; null for a blank one."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.unhex(F.md5(bare)))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if it has none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+|\[[^\]/?#]*\])", 1)
    return F.nullif(F.lower(found), F.lit(""))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = 1) -> DataFrame:
    """(host, digest, pages, host_pages) of each line that is boilerplate on its host."""
    rows = pages.select(host.alias("host"), text.alias("text"))
    of_page = F.array_distinct(F.array_compact(F.transform(F.split("text", "\n", -1), _digest)))
    counts = rows.select("host", F.explode(of_page).alias("digest")).groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages"))
    totals = rows.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("host_pages"))
    often = counts.where(F.col("pages") >= min_pages)
    return often.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("pages") > F.lit(ratio) * F.col("host_pages")).drop("of")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = 1, counts: str = "line_counts", site: Callable[[Column], Column] = lambda host: host) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``.

    ``counts`` names a struct: ``lines`` there were, and ``dropped`` ones. ``site``
    makes the host from the column ``host``, such as host_of() from a URL.
    """
    found = boilerplate(pages, site(F.col(f"`{host}`")), F.col(f"`{text}`"), ratio, min_pages)
    found = cut(found.groupBy("host").agg(F.collect_list("digest").alias("_digests")).withColumnRenamed("host", "_host"))
    lines = found.agg(F.coalesce(F.sum(F.size("_digests")), F.lit(0))).first()[0]
    beside = F.broadcast(found) if lines <= BROADCAST_LINES else found
    doc = F.col("_doc")
    joined = wrapped(pages).join(beside, site(doc[host]).eqNullSafe(F.col("_host")), "left")

    def kept(split: Column) -> Column:
        keep = F.filter(split, lambda x: ~F.coalesce(F.array_contains("_digests", _digest(x)), F.lit(False)))
        return F.when(F.col("_digests").isNull(), split).otherwise(keep)

    both = let(F.split(doc[text], "\n", -1), lambda s: F.struct(F.size(s).alias("lines"), kept(s).alias("kept")))
    out = joined.select("_doc", both.alias("_both"))
    known = doc[text].isNotNull()
    count = F.when(known, F.col("_both.lines")).otherwise(0)
    dropped = F.when(known, F.col("_both.lines") - F.size("_both.kept")).otherwise(0)
    clean = F.when(dropped == 0, doc[text]).otherwise(F.array_join("_both.kept", "\n"))
    told = F.struct(count.cast("long").alias("lines"), dropped.cast("long").alias("dropped"))
    return unwrapped(out, pages.columns, **{text: clean, counts: told})


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = drop_boilerplate(docs)
    return out.select("doc_id", "source", F.col("line_counts.lines").alias("n_lines"), F.col("line_counts.dropped").alias("n_dropped"), "text")


def line_dedup_pages(spark, sf_dir: str) -> DataFrame:
    """Every page without its host's boilerplate lines; a line is on two pages at least."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = drop_boilerplate(pages, "url", "html", min_pages=2, site=host_of)
    return out.select("page_id", host_of(F.col("url")).alias("host"), F.col("line_counts.lines").alias("n_lines"), F.col("line_counts.dropped").alias("n_dropped"), "html")


_SQL = """
WITH pages AS (
  {pages}
), lines AS (
  SELECT DISTINCT host, id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM pages
), counts AS (
  SELECT host, line, count(*) AS pages FROM lines WHERE line <> '' GROUP BY host, line
), totals AS (
  SELECT host, count(*) AS host_pages FROM pages GROUP BY host
), often AS (
  SELECT c.host, list(c.line) AS lines
  FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
  WHERE c.pages >= {least} AND c.pages > 0.1::DOUBLE * t.host_pages
  GROUP BY c.host
), split AS (
  SELECT p.id, p.host, string_split(p.text, chr(10)) AS lines, coalesce(o.lines, []) AS often
  FROM pages p LEFT JOIN often o ON p.host IS NOT DISTINCT FROM o.host
), kept AS (
  SELECT id, host, lines,
    list_filter(lines, lambda x: NOT list_contains(often, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM split
)
SELECT id AS {id}, host AS {host}, coalesce(len(lines), 0)::BIGINT AS n_lines,
  coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
  array_to_string(kept, chr(10)) AS {text}
FROM kept
"""

OP4_SQL = _SQL.format(pages="SELECT doc_id AS id, source AS host, text FROM documents", least=1, id="doc_id", host="source", text="text")
PAGES_SQL = _SQL.format(
    pages="SELECT page_id AS id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\\[\\]]+|\\[[^\\]/?#]*\\])', 1)), '') AS host, html AS text FROM pages",
    least=2, id="page_id", host="host", text="html",
)
