"""Where in a text a quote or a figure stands: offsets, pages and methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingweave.functions.numeric import any_anchored, printed_forms, scale_factor
from filingweave.functions.text import WS

PAD = 60
LABEL_WINDOW = 90
MIN_DIGITS = 3
METHODS = ("llm_verified", "deterministic", "unverified", "prior_entry")
# Captions of the two families of figures.
CAPTIONS = {
    "revenue": r"(?i)revenue|net\s+sales|turnover|total\s+income",
    "pbt": r"(?i)(?:profit|loss|earnings)[^.\n]{0,30}?before\s+(?:tax|taxation)|before\s+(?:tax|taxation)|ordinary\s+(?:profit|income)|pre-?tax",
}


def _quoted(x: Column) -> Column:
    """A word as a literal pattern; every character that is no letter or digit is escaped."""
    return F.regexp_replace(x, r"([^\p{L}\p{N}\s])", r"\\$1")


def loose_pattern(quote: Column) -> Column:
    """A quote as a pattern that ignores case and the amount of white space."""
    words = F.filter(F.split(F.trim(quote), f"{WS}+"), lambda w: w != "")
    return F.concat(F.lit("(?iu)"), F.array_join(F.transform(words, _quoted), f"{WS}+"))


def locate_quote(quote: Column, text: Column) -> Column:
    """struct<start,end> (from 0, end exclusive) of a quote: exact first, then apart from case and white space.

    Null where it isn't found, is null or has fewer than four characters.
    """
    q = F.regexp_replace(quote, f"^{WS}+|{WS}+$", "")
    exact = F.position(q, text) - 1
    pattern = loose_pattern(q)
    loose = F.regexp_instr(text, pattern) - 1
    span = F.when(exact >= 0, F.struct(exact.alias("start"), (exact + F.length(q)).alias("end"))).when(
        loose >= 0, F.struct(loose.alias("start"), (loose + F.length(F.regexp_substr(text, pattern))).alias("end"))
    )
    return F.when((F.length(q) >= 4) & (text != ""), span)


def quote_holds_figure(span: Column, value: Column, label: Column, text: Column) -> Column:
    """Whether the passage holds the figure, as printed under its unit or already in millions."""
    passage = F.substring(text, span["start"] + 1, span["end"] - span["start"])
    factor = F.coalesce(scale_factor(label), F.lit(1.0))
    return any_anchored(F.abs(value) / factor, passage) | any_anchored(F.abs(value), passage)


def figure_hits(form: Column, text: Column) -> Column:
    """array<struct<start,end>> of all places where a form stands as a figure of its own and is no percentage.

    The text is cut at the figure; the running length of the pieces gives the offsets.
    """
    pattern = F.concat(F.lit(r"(?<![\d,.])"), F.replace(form, F.lit("."), F.lit(r"\.")), F.lit(r"(?![\d,.])"))
    pieces = F.split(text, pattern, -1)
    size = F.length(form)
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + size).alias("at"), F.array_append(a["starts"], a["at"] + F.length(p)).alias("starts"))
    starts = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), begun, step)["starts"]
    spans = F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), (s + size).cast("int").alias("end")))
    return F.filter(spans, lambda s: F.substring(text, s["end"] + 1, 1) != "%")


def locate_figure(value: Column, label: Column, text: Column, metric: Column) -> Column:
    """struct<start,end>: form by form, the first place under the metric's caption, else the only place."""
    factor = F.coalesce(scale_factor(label), F.lit(1.0))

    def place(form: Column) -> Column:
        hits = figure_hits(form, text)
        near = lambda s: F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - LABEL_WINDOW), F.least(s["start"], F.lit(LABEL_WINDOW)))
        caption = lambda s: F.when(metric.startswith("revenue"), near(s).rlike(CAPTIONS["revenue"])).when(metric.startswith("pbt"), near(s).rlike(CAPTIONS["pbt"])).otherwise(False)
        under = F.filter(hits, caption)
        return F.when(F.size(under) > 0, F.get(under, F.lit(0))).when(F.size(hits) == 1, F.get(hits, F.lit(0)))

    forms = F.filter(printed_forms(F.abs(value) / factor), lambda f: F.length(F.regexp_replace(f, r"\D", "")) >= MIN_DIGITS)
    return F.get(F.filter(F.transform(forms, place), lambda s: s.isNotNull()), F.lit(0))


def page_for_offset(offset: Column, pages: Column, separator: int = 2) -> Column:
    """The page (from 1) of an offset into the pages joined by a separator; beyond the end the last page."""
    begun = F.struct(F.lit(0).alias("at"), F.lit(0).alias("before"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + separator).alias("at"), (a["before"] + F.when(a["at"] + F.length(p) <= offset, 1).otherwise(0)).alias("before"))
    before = F.aggregate(pages, begun, step)["before"]
    return F.when(offset.isNotNull() & (F.size(pages) > 0), F.least(before + 1, F.size(pages)))


def _cited(span: Column, value: Column, label: Column, text: Column) -> Column:
    return F.when(span.isNotNull() & quote_holds_figure(span, value, label, text), span)


def _told(cited: Column, found: Column, text: Column, from_document: Column) -> Column:
    method = F.when(~from_document, "prior_entry").when(cited.isNotNull(), "llm_verified").when(found.isNotNull(), "deterministic").otherwise("unverified")
    at = F.when(from_document, found)
    start = F.greatest(F.lit(0), at["start"] - PAD)
    return F.struct(
        method.alias("method"),
        at["start"].alias("start"),
        at["end"].alias("end"),
        F.trim(F.substring(text, start + 1, at["end"] + PAD - start)).alias("snippet"),
        F.substring(F.trim(F.substring(text, at["start"] + 1, at["end"] - at["start"])), 1, 200).alias("printed_form"),
    )


def trace(value: Column, label: Column, quote: Column, text: Column, metric: Column, from_document: Column) -> Column:
    """struct<method,start,end,snippet,printed_form>: the quote if it is there and holds the figure, else the figure's
    own place, else `unverified`; `prior_entry` for figures that don't come from this document."""
    cited = _cited(locate_quote(quote, text), value, label, text)
    return _told(cited, F.coalesce(cited, locate_figure(value, label, text, metric)), text, from_document)


def trace_rows(rows: DataFrame, value: Column, label: Column, quote: Column, text: Column, metric: Column, from_document: Column, to: str = "trace") -> DataFrame:
    """Rows with their `trace` as a column; its steps are columns of their own on the way, so that each is worked out
    once a row."""
    steps = rows.withColumn("__value", value).withColumn("__span", locate_quote(quote, text))
    steps = steps.withColumn("__cited", _cited(F.col("__span"), F.col("__value"), label, text))
    steps = steps.withColumn("__found", F.when(F.col("__cited").isNotNull(), F.col("__cited")).otherwise(locate_figure(F.col("__value"), label, text, metric)))
    return steps.withColumn(to, _told(F.col("__cited"), F.col("__found"), text, from_document)).drop("__value", "__span", "__cited", "__found")
