"""Checks of extracted reports: each gives a message or nothing; none blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingweave.functions.text import SELF_REPORT_MARKER, identifying_tokens
from filingweave.operators.audit import FIELDS, unit_audit

PAIRS = tuple((f"revenue_{x}", f"pbt_{x}") for x in ("current", "previous_quarter", "same_quarter_last_year"))
SOURCE_ONLY = r"^(?:Unit scale corrected:|Unit label |None of the extracted figures|This document appears to be a review report)|^\d+ of \d+ figures could not be traced"


def _two(x: Column) -> Column:
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def warnings(current_year: int, columns: set[str]) -> Column:
    """array<string> of the messages of a report row, in rule order; rules whose columns are absent are left out."""
    c = F.col
    last = current_year + 1
    rules: list[Column] = []
    if "fiscal_quarter" in columns:
        rules.append(F.when(~c("fiscal_quarter").isin("Q1", "Q2", "Q3", "Q4"), _say("fiscal_quarter '", c("fiscal_quarter"), "' is not one of Q1/Q2/Q3/Q4")))
    if "fiscal_year" in columns:
        year = c("fiscal_year").try_cast("int")
        rules.append(
            F.when(c("fiscal_year").isNotNull() & year.isNull(), _say("fiscal_year '", c("fiscal_year"), "' cannot be parsed as an integer")).when(
                ~year.between(2000, last), _say("fiscal_year ", year, f" is outside the expected range (2000–{last})")
            )
        )
        if "quarter_end_date" in columns:
            day = c("quarter_end_date").cast("string")
            shape = day.rlike(r"^\d{4}-\d{2}-\d{2}$")
            told = F.substring(day, 1, 4).try_cast("int")
            rules.append(
                F.when(~shape, _say("quarter_end_date '", day, "' is not in YYYY-MM-DD format")).when(
                    F.abs(told - year) > 1, _say("quarter_end_date year (", told, ") does not match fiscal_year (", year, ") — possible extraction error")
                )
            )
    if "currency" in columns:
        rules.append(F.when(~c("currency").rlike("^[A-Z]{3}$"), _say("currency '", c("currency"), "' is not a valid ISO 4217 code (expected 3 uppercase letters, e.g. USD)")))
    rules += [F.when(c(r) < 0, _say(f"{r} is negative (", _two(c(r)), "M) — revenue cannot be negative")) for r, _ in PAIRS if r in columns]
    rules += [
        F.when(
            (c(r) > 0) & (c(p) > c(r)),
            _say(f"{p} (", _two(c(p)), f"M) exceeds {r} (", _two(c(r)), "M) — unusual, though legitimate with one-off gains such as asset disposals or revaluations; confirm against the report"),
        )
        for r, p in PAIRS
        if {r, p} <= columns
    ]
    if "confidence_score" in columns:
        score = c("confidence_score")
        rules.append(
            F.when(~score.between(0, 1), _say("confidence_score ", score, " is outside the valid range [0, 1]")).when(
                score < 0.7, _say("Low confidence score (", F.format_number(score * 100, 0), "%) — results should be reviewed manually")
            )
        )
    if set(FIELDS) <= columns:
        rules.append(F.when(F.coalesce(*map(c, FIELDS)).isNull(), F.lit("No financial values were extracted — the PDF may not contain machine-readable financial tables")))
    if {"company_name", "title", "author"} <= columns:
        meta = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("author", F.lit("")))
        a, b = identifying_tokens("company_name"), identifying_tokens(meta)
        rules.append(
            F.when(
                (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b),
                _say("Document metadata names a different entity than the report body (metadata: '", F.trim(meta), "', extracted: '", c("company_name"), "') — verify the file is the report it claims to be"),
            )
        )
    return F.array_compact(F.array(*rules))


def self_report(text: Column) -> Column:
    """Whether a text is one of the tool's own reports."""
    return F.contains(text, F.lit(SELF_REPORT_MARKER))


def untraced(metrics: Column, total: Column) -> Column:
    """The message naming the untraced figures, null where all are traced."""
    return F.when(F.size(metrics) > 0, _say(F.size(metrics), " of ", total, " figures could not be traced to a line in the document (", F.array_join(metrics, ", "), ") — verify these against the original report before relying on them"))


def carried_forward(prior: Column, fresh: Column) -> Column:
    """Earlier messages that only the source text can give, before the fresh ones."""
    return F.concat(F.filter(prior, lambda w: w.rlike(SOURCE_ONLY)), fresh)


__all__ = ["carried_forward", "self_report", "unit_audit", "untraced", "warnings"]


def type_errors(record: Column | str, kinds: dict[str, str]) -> Column:
    """The fields of a JSON record whose value is of another type than `kinds` says (string or number); null and missing
    values are of any type. Unreadable records have no types to be wrong."""
    text = F.col(record) if isinstance(record, str) else record
    shown = {"string": "STRING", "number": "(BIGINT|DOUBLE|DECIMAL.*)"}
    value = lambda field: F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), F.lit(f"$.{field}"), "variant"))
    wrong = lambda field, kind: F.when(~value(field).rlike(f"^(?:{shown[kind]}|VOID)$"), F.lit(field))
    return F.array_compact(F.array(*(wrong(f, k) for f, k in kinds.items())))
