"""Do the figures of a report stand in its own text, and at the scale its unit label says?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingweave.functions.numeric import MIN_ANCHOR, any_anchored, scale_factor

FIELDS = ("revenue_current", "revenue_previous_quarter", "revenue_same_quarter_last_year", "pbt_current", "pbt_previous_quarter", "pbt_same_quarter_last_year")
SHIFTS = (1.0, 1000.0, 0.001)


def present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def anchor_count(values: Column, factor: Column, shift: float, text: Column) -> Column:
    """How many values, rescaled and turned back into their printed form, stand in the text; small ones don't count."""
    printed = F.transform(values, lambda v: F.abs(v * shift / factor))
    return F.size(F.filter(printed, lambda p: (p >= MIN_ANCHOR) & any_anchored(p, text)))


def unit_audit(values: Column, label: Column, text: Column) -> Column:
    """struct<verdict,shift,hits,hits_as_is>: `no_figures`, `unknown_unit`, `rescaled`, `unanchored` or `ok`.

    Another scale wins only if it finds more figures than the present one, at least three, and two thirds of those
    given. Ties go to the present scale, then to the first candidate.
    """
    figures = present(values)
    factor = scale_factor(label)
    hits = [anchor_count(figures, factor, s, text) for s in SHIFTS]
    best = F.array_max(F.array(*(F.struct(h.alias("hits"), F.lit(int(s == 1.0)).alias("own"), F.lit(-i).alias("place"), F.lit(s).alias("shift")) for i, (h, s) in enumerate(zip(hits, SHIFTS, strict=True)))))
    quorum = F.greatest(F.lit(3), F.ceil(F.size(figures) * F.lit(2) / F.lit(3)).cast("int"))
    wins = (best["shift"] != 1.0) & (best["hits"] > hits[0]) & (best["hits"] >= quorum)
    verdict = (
        F.when((F.size(figures) <= 0) | text.isNull() | (text == ""), "no_figures")
        .when(factor.isNull(), "unknown_unit")
        .when(wins, "rescaled")
        .when(best["hits"] == 0, "unanchored")
        .otherwise("ok")
    )
    told = verdict.isin("rescaled", "unanchored", "ok")
    return F.struct(verdict.alias("verdict"), F.when(wins & told, best["shift"]).otherwise(1.0).alias("shift"), F.when(told, best["hits"]).alias("hits"), F.when(told, hits[0]).alias("hits_as_is"))


def corrected(values: Column, audited: Column) -> Column:
    """All figures at the scale the audit found; the present one where none won."""
    return F.transform(values, lambda v: v * audited["shift"])


def scale_message(audited: Column, label: Column, figures: Column) -> Column:
    """What the audit has to say, null where there is nothing; `figures`: how many were given. The texts are fixed values."""
    quoted = F.when(F.contains(label, F.lit("'")) & ~F.contains(label, F.lit('"')), F.concat(F.lit('"'), label, F.lit('"'))).otherwise(F.concat(F.lit("'"), label, F.lit("'")))
    shown = F.coalesce(label, F.lit("None"))
    by = F.when(audited["shift"] == 1000.0, "1000").otherwise("0.001")
    rescaled = F.concat(
        F.lit("Unit scale corrected: figures were rescaled by "), by, F.lit("x to match the document (unit as reported: "), shown, F.lit("). "), audited["hits"].cast("string"), F.lit(" of "), figures.cast("string"),
        F.lit(" figures now match the printed source, against "), audited["hits_as_is"].cast("string"), F.lit(" before — please verify against the original report"),
    )
    return (
        F.when(audited["verdict"] == "unknown_unit", F.concat(F.lit("Unit label "), F.coalesce(quoted, F.lit("None")), F.lit(" was not recognised — normalisation to millions could not be verified against the document")))
        .when(audited["verdict"] == "unanchored", F.concat(F.lit("None of the extracted figures could be matched against the document text (unit as reported: "), shown, F.lit(") — the scale is unverified and should be checked manually")))
        .when(audited["verdict"] == "rescaled", rescaled)
    )
