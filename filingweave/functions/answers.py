"""Answers of a model as data: usable, cut off, empty or broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS = 100_000


def truncated(text: Column, most: int = MAX_CHARS) -> Column:
    """The text as far as a model is given it."""
    return F.substring(text, 1, most)


def triage(finish_reason: Column, content: Column) -> Column:
    """struct<status,problem>: `cut_off`, `empty`, `not_json` (with the first 200 characters) or `ok`."""
    blank = F.trim(F.coalesce(content, F.lit(""))) == ""
    status = F.when(finish_reason == "length", "cut_off").when(blank, "empty").when(F.try_parse_json(content).isNull(), "not_json").otherwise("ok")
    problem = (
        F.when(status == "cut_off", "The answer was cut off before it was complete")
        .when(status == "empty", F.concat(F.lit("The answer is empty (finish_reason="), F.coalesce(finish_reason, F.lit("none")), F.lit(")")))
        .when(status == "not_json", F.concat(F.lit("The answer is not valid JSON: "), F.substring(content, 1, 200)))
    )
    return F.struct(status.alias("status"), problem.alias("problem"))
