"""Web pages as documents: titles, sections, text and links by regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain(c: Column, references: tuple[str, ...] | None = None) -> Column:
    """Markup as text: tags become spaces, the common references (or those named) are decoded, white space is single spaces."""
    c = F.regexp_replace(c, "<[^>]*>", " ")
    for a, b in _ENTITIES if references is None else [x for x in _ENTITIES if x[0] in references]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def page_title(html: Column, references: tuple[str, ...] | None = None) -> Column:
    """The first h1, else the title element without its last " - suffix" or " | suffix", else Untitled; `references` as for plain()."""
    h1 = plain(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), references)
    head = F.regexp_replace(plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), references), r"\s+[-|]\s+[^-|]*$", "")
    return F.coalesce(F.nullif(h1, F.lit("")), F.nullif(head, F.lit("")), F.lit("Untitled"))


def page_text(html: Column) -> Column:
    """A page's text without scripts, styles, navigation and footers."""
    for tag in ("script", "style", "nav", "footer", "head"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    return plain(html)


def page_sections(pages: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """(page_id, seq, level, section_id, heading, content): each h1 to h6 with what follows up to the next.

    The id is the tag's own, else the heading's slug.  `references` are those
    that headings decode, as for plain().
    """
    parts = F.regexp_extract_all("html", F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>.*?)(?=<h[1-6][\s>]|\z)"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(parts).alias("seq", "part"))
    heading = plain(F.regexp_extract("part", r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1), references)
    own = F.nullif(F.regexp_extract("part", r"(?is)^<h[1-6][^>]*\bid=[\"']([^\"']+)[\"']", 1), F.lit(""))
    content = page_text(F.regexp_replace("part", r"(?is)^<h[1-6][^>]*>.*?</h[1-6]>", ""))
    return rows.select("page_id", "seq", F.regexp_extract("part", "(?i)^<h([1-6])", 1).cast("int").alias("level"), F.coalesce(own, tx.slugify(heading)).alias("section_id"), heading.alias("heading"), content.alias("content"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, href): distinct links of each page without fragments."""
    links = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"'#]+)"), F.lit(1))
    return pages.select("page_id", F.explode(links).alias("href")).distinct()


def absolute_links(pages: DataFrame, same_site: bool = True) -> DataFrame:
    """(page_id, target): links resolved against their page's address; only those of the same site if asked."""
    site = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    linked = page_links(pages).join(pages.select("page_id", "url"), "page_id")
    folder = F.regexp_extract("url", r"^(https?://[^?#]*/)", 1)
    full = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(site, "href")).otherwise(F.concat(folder, "href"))
    out = linked.select("page_id", site.alias("site"), full.alias("target"))
    return (out.where(F.col("target").startswith(F.col("site"))) if same_site else out).select("page_id", "target").distinct()


def frontier(pages: DataFrame) -> DataFrame:
    """Addresses that pages link to and that aren't among the pages: a crawl's next step."""
    known = pages.select(F.regexp_replace("url", "#.*$", "").alias("target"))
    return absolute_links(pages).select("target").distinct().join(known, "target", "left_anti")


def category(url: Column) -> Column:
    """The first folder of an address's path, or general."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)/", 1), F.lit("")), F.lit("general"))


def page_corpus(pages: DataFrame, least_chars: int = 100, skip: tuple[str, ...] = (), most_pages: int | None = None) -> DataFrame:
    """Pages as documents: short ones, those of skipped categories and repeated contents (the first id stays) are left out.

    The text is the title and then each section's heading and content, a line
    each; boundaries count bytes: the title at level 0, headings at their level,
    section contents at level 5 under the section's id.  `most_pages` ends a
    crawl as asked for; by default there is no limit.
    """
    body = page_text(F.col("html"))
    base = pages.where("html is not null").select("page_id", "url", page_title(F.col("html")).alias("title"), body.alias("body"), category(F.col("url")).alias("category"), "html")
    base = base.where((F.length("body") >= least_chars) & ~F.col("category").isin(list(skip)))
    first = base.groupBy(tx.content_hash(F.col("body")).alias("hash")).agg(F.min("page_id").alias("page_id"))
    base = base.join(first, "page_id")
    if most_pages is not None:
        base = base.orderBy("page_id").limit(most_pages)
    parts = page_sections(base).select("page_id", "seq", "level", "section_id", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("heading").alias("t")), F.struct(F.lit(1).alias("k"), F.col("content").alias("t")))).alias("x"))
    lines = parts.where("x.t <> ''").select("page_id", (2 * F.col("seq") + F.col("x.k") + 1).alias("n"), F.col("x.t").alias("t"), "level", "section_id", (F.col("x.k") == 0).alias("is_heading"))
    lines = lines.unionByName(base.select("page_id", F.lit(0).alias("n"), F.col("title").alias("t"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("section_id"), F.lit(True).alias("is_heading")))
    end = F.sum(F.octet_length("t") + 1).over(Window.partitionBy("page_id").orderBy("n")) - 1
    spans = lines.withColumn("end", end).withColumn("start", F.col("end") - F.octet_length("t"))
    kind = F.when(F.col("n") == 0, "title").when(F.col("is_heading"), "heading").otherwise("content")
    bound = F.struct(F.lit(None).cast("long").alias("docId"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), kind.alias("fieldType"), F.col("section_id").alias("sectionId"), F.when(F.col("is_heading"), F.col("level")).otherwise(F.lit(5)).alias("headingLevel"))
    grouped = spans.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("n", "t", bound.alias("b")))).alias("x"))
    whole = grouped.select("page_id", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("text"), F.transform("x", lambda x: x["b"]).alias("boundaries"))
    meta = base.select("page_id", "title", tx.excerpt(F.col("body")).alias("excerpt"), F.col("url").alias("href"), F.lit("page").alias("kind"), "category", F.lit(None).cast("string").alias("author"))
    return whole.join(meta, "page_id").withColumnRenamed("page_id", "doc_id")
