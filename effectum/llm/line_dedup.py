"""Lines that repeat over the pages of a site: site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise

#: A line goes if more than this share of the host's pages hold it, and so many pages at least: on a host with a page or two, every line is on a large share.
RATIO, MIN_HOLDING = 0.08, 3
#: The boilerplate of all hosts is broadcast up to so many bytes, which are counted first; beyond, it is joined by shuffle.
BROADCAST_BYTES = 8 << 20

_BLANK = " \t\r\x0b\f"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(_BLANK)))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_holding: int = MIN_HOLDING) -> DataFrame:
    """For each host with boilerplate: the keys of the lines that more than ``ratio`` of its pages hold, and ``min_holding`` pages at least.

    Each page gives a line once, so the count of a (host, line) is its number of pages; it is summed before the
    shuffle, and so a host with a third of all pages costs no more in one task than its distinct lines. A host's list
    has 1 / ratio times the mean number of lines of a page at most, whatever the number of its pages.
    """
    per_page = pages.select(host.alias("host"), F.array_distinct(F.transform(F.split(text, "\n"), _key)).alias("keys"))
    totals = per_page.groupBy("host").agg(F.count("*").alias("pages"))
    lines = per_page.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    share = round(ratio * 1_000_000)  # whole numbers, so that no rounding decides
    often = lines.where(F.col("n") >= min_holding).where(F.col("key") != _key(F.lit("")))
    often = often.join(totals, often["host"].eqNullSafe(totals["host"])).where(F.col("n") * 1_000_000 > share * F.col("pages"))
    return often.groupBy(lines["host"].alias("host")).agg(F.collect_list("key").alias("often"))


def drop_site_lines(pages: DataFrame, host: Column, text_col: str = "text", *, ratio: float = RATIO, min_holding: int = MIN_HOLDING) -> DataFrame:
    """All rows and columns of ``pages``, without the lines that are boilerplate on their host.

    Adds n_lines and n_dropped. Lines are compared without white space at their ends; lines without any
    other character are never dropped. A null text has no lines and stays null, an empty one has one. Rows with a null host
    form one site. A line that fewer than ``min_holding`` pages hold stays, on a host of any size. Repeated rows count as pages each. A page that loses all lines keeps an empty text. Further columns, whatever their names, pass through
    (n_lines and n_dropped are replaced).

    DataFrame operations only. Texts aren't shuffled unless the boilerplate exceeds ``BROADCAST_BYTES``. Keys
    are 64-bit hashes: a line is wrongly dropped if it meets one of its host's few boilerplate keys, once in about 10^17 lines.
    """
    old = pages.drop("n_lines", "n_dropped")
    site_name, own_name, kept_name = (fresh(n, old.columns) for n in ("site", "often", "kept"))
    text, site, own = F.col(f"`{text_col}`"), F.col(site_name), F.col(own_name)
    often = materialise(boilerplate(pages, host, text, ratio, min_holding), "boilerplate")
    size = often.agg(F.sum(F.size("often") * 8 + 64)).first()[0] or 0
    small = often.select(F.col("host").alias(site_name), F.col("often").alias(own_name))
    small = F.broadcast(small) if size <= BROADCAST_BYTES else small
    joined = old.join(small, host.eqNullSafe(site), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(own, _key(x)))
    out = joined.select(*[F.col(f"`{c}`") for c in old.columns], F.when(own.isNotNull(), kept).alias(kept_name), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"))
    out = out.withColumn("n_dropped", F.when(F.col(kept_name).isNotNull(), F.col("n_lines") - F.size(kept_name)).otherwise(0).cast("long"))
    return out.withColumn(text_col, F.when(F.col("n_dropped") > 0, F.array_join(kept_name, "\n")).otherwise(text)).drop(kept_name)


#: What of a page isn't text, what ends a line, and where a URL has its host.
SCRIPTS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCKS = r"(?is)</?(?:p|div|br|li|ul|ol|nav|h[1-6]|tr|table|article|section|header|footer|title|head|body|html|aside)\b[^>]*>"
TAGS = r"(?s)<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def page_lines(html: Column) -> Column:
    """The visible text of a page: scripts and styles go, block tags end a line, other tags become nothing."""
    out = F.regexp_replace(html, SCRIPTS, "")
    out = F.regexp_replace(out, BLOCKS, "\n")
    return F.regexp_replace(F.regexp_replace(out, TAGS, ""), r"[\n\r]+", "\n")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))
