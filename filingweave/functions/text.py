"""Text, markup and identity functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it (Java's \s is ASCII only).
WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

# Words that name no company.
STOPWORDS = """inc ltd limited llc plc corp corporation co company holding holdings group ab publ kk pte bhd berhad nv sa gmbh kgaa asa oyj spa pty
annual interim quarterly quarter report reports results statement statements financial financials earnings release final draft unaudited audited
condensed consolidated full year half fy cy q1 q2 q3 q4 tanshin document services the and of for""".split()

#: Titles of results filings.
RESULTS = r"(?i)quarterly\s+r(?:e)?p(?:or)?t|\bconsolidated\s+results?\b|\bfinancial\s+results?\b|\binterim\s+(?:financial\s+)?report\b|\bcondensed\s+consolidated\b"
#: What marks one of the tool's own reports (a fixed value).
SELF_REPORT_MARKER = "Auto-generated from a GPT-5.4-mini extraction of entry #"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), f"{WS}+", " "))


def strip_tags(x: Column | str) -> Column:
    """The visible text of a marked-up cell; '' for null. Five entities are decoded, in this order."""
    text = F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), "<[^>]+>", " ")
    for entity, plain in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return collapse(text)


def normalise_title(x: Column | str) -> Column:
    return collapse(F.lower(F.coalesce(_c(x), F.lit(""))))


def identifying_tokens(x: Column | str) -> Column:
    """The distinct words that could name a company: no stopword, no number, no single letter. Null gives []."""
    words = F.split(F.lower(F.coalesce(_c(x), F.lit(""))), "[^a-z0-9]+")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))
    return F.array_except(kept, F.array(*map(F.lit, STOPWORDS)))


def looks_like_results(title: Column | str, kind: Column | str) -> Column:
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(kind), F.lit(""))).rlike(RESULTS)


_ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def links(cell: Column | str) -> Column:
    """array<struct<href,label>> of a cell's well-formed anchors in order; for broken markup see sources.html."""
    found = F.arrays_zip(F.regexp_extract_all(_c(cell), F.lit(_ANCHOR), 1).alias("href"), F.regexp_extract_all(_c(cell), F.lit(_ANCHOR), 2).alias("label"))
    return F.coalesce(F.transform(found, lambda a: F.struct(a["href"].alias("href"), strip_tags(a["label"]).alias("label"))), F.array().cast("array<struct<href:string,label:string>>"))


def is_pdf(href: Column) -> Column:
    return F.substring_index(F.lower(href), "?", 1).endswith(".pdf")


def attachments(cell: Column | str, found: Column | None = None) -> Column:
    """array<struct<filename,url>>: the PDF links of a cell, named by their label or the tail of the url. `found`: the
    cell's links, where they are at hand."""
    return F.transform(
        F.filter(links(cell) if found is None else found, lambda a: is_pdf(a["href"])),
        lambda a: F.struct(F.coalesce(F.nullif(a["label"], F.lit("")), F.substring_index(a["href"], "/", -1)).alias("filename"), a["href"].alias("url")),
    )


def headline(cell: Column | str, found: Column | None = None) -> Column:
    """The label of the first anchor that is no PDF, else the visible text."""
    named = F.filter(links(cell) if found is None else found, lambda a: (a["label"] != "") & ~is_pdf(a["href"]))
    return F.coalesce(F.get(named, F.lit(0))["label"], strip_tags(cell))


def announcement_id(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(url), r"(?i)[?&]ann(?:ouncement)?_id=(\d+)", 1), F.lit(""))


def stock_code(explicit: Column | str, *cells: Column | str) -> Column:
    """The given code, else the stock_code of a link in the cells, else a code in brackets in their text."""
    linked = [F.nullif(F.regexp_extract(_c(x), r"(?i)stock_code=([A-Za-z0-9]+)", 1), F.lit("")) for x in cells]
    bracketed = [F.nullif(F.regexp_extract(strip_tags(x), r"\(([0-9]{4,5}[A-Za-z]{0,2})\)", 1), F.lit("")) for x in cells]
    return F.coalesce(F.nullif(strip_tags(explicit), F.lit("")), *linked, *bracketed)


def safe_filename(name: Column | str, fallback: str = "attachment") -> Column:
    base = F.regexp_replace(F.trim(F.substring_index(F.substring_index(F.coalesce(_c(name), F.lit("")), "?", 1), "/", -1)), "[^A-Za-z0-9._-]+", "_")
    named = F.when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit(fallback)), F.lit(".pdf")))
    return F.substring(named, 1, 120)


def is_pdf_name(name: Column | str) -> Column:
    return F.contains(_c(name), F.lit(".")) & (F.lower(F.substring_index(_c(name), ".", -1)) == "pdf")


def masked_numbers(warning: Column | str) -> Column:
    """A message with its numbers as '#', in lower case: two messages that differ in figures only are equal."""
    return F.trim(F.lower(F.regexp_replace(_c(warning), r"[-+]?\d[\d,]*\.?\d*", "#")))


def folded(x: Column | str) -> Column:
    """A label without asides in brackets, case and extra blanks."""
    return collapse(F.lower(F.regexp_replace(_c(x), f"{WS}*\\([^)]*\\)", "")))


def download_name(company: Column | str, period: Column | str, suffix: str = "report.pdf") -> Column:
    return F.concat_ws("_", F.replace(F.coalesce(_c(company), F.lit("Unknown")), F.lit(" "), F.lit("_")), F.replace(_c(period), F.lit(" "), F.lit("_")), F.lit(suffix))


def escape_xml(x: Column | str) -> Column:
    out = F.coalesce(_c(x), F.lit(""))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def dedup_key(bursa_id: Column | str, code: Column | str, company: Column | str, day: Column | str, title: Column | str) -> Column:
    """`bursa:<id>`, or a hash of issuer, date and headline where there is no id."""
    basis = F.concat_ws("|", F.trim(F.coalesce(_c(code), F.lit(""))), normalise_title(company), F.coalesce(_c(day), F.lit("")), normalise_title(title))
    own = F.nullif(_c(bursa_id).cast("string"), F.lit(""))
    return F.when(own.isNotNull(), F.concat(F.lit("bursa:"), own)).otherwise(F.concat(F.lit("sha256:"), F.sha2(basis, 256)))
