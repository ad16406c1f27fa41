"""Announcement listings: JSON of object or positional rows, and HTML tables, as one table of announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingweave.functions import text as tx
from filingweave.functions.dates import date_in, shown_date
from filingweave.sources.html import read_rows

# Keys a listing may use for each field, in order, and for the list itself.
ALIASES = {
    "bursa_id": ("id", "announcement_id", "ann_id"),
    "title": ("title", "announcement_title", "subject", "name"),
    "stock_code": ("stock_code", "stockcode", "code", "company_code"),
    "company_name": ("company", "company_name", "issuer", "entity"),
    "announcement_type": ("category", "type", "announcement_type", "cat"),
    "announced_at": ("announcement_date", "date", "created_at", "datetime", "date_announced", "announced_at"),
    "url": ("url", "link", "href", "detail_url"),
}
ROOTS = ("data", "records", "results", "items", "announcements")


class ListingError(ValueError):
    """A payload is no listing of a known shape, which is not the same as an empty one."""


def _first(record: Column, entries: Column, field: str) -> Column:
    """The first alias that holds something, by exact name, then apart from case (of keys alike the last)."""
    names = ALIASES[field]
    exact = [F.nullif(F.try_element_at(record, F.lit(n)), F.lit("")) for n in names]

    def alike(name: str) -> Column:
        return F.nullif(F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"], F.lit(""))

    return F.coalesce(*exact, *map(alike, names))


RAW = ("title", "company", "code", "kind", "day", "url", "own_id", "files")


def _announcements(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Announcements of rows with the raw fields `__<name>` of RAW; `__cells` holds the cells of positional rows and is
    null in others. Costly parts are columns of their own, so that each is worked out once a row."""
    c = F.col
    positional = c("__cells").isNotNull()
    staged = rows.select(*keep, *(f"__{n}" for n in RAW), "__cells", tx.links("__title").alias("__links"), shown_date("__day").alias("__shown"))
    pages = F.filter("__links", lambda a: ~tx.is_pdf(a["href"]))
    url = F.when(positional, F.get(pages, F.lit(0))["href"]).otherwise(c("__url"))
    company = F.when(positional, tx.headline("__company")).otherwise(tx.strip_tags("__company"))
    staged = staged.select("*", url.alias("__link"), company.alias("__company_shown"), tx.headline("__title", c("__links")).alias("__headline"), tx.attachments("__title", c("__links")).alias("__linked"))
    cells = [F.get("__cells", F.lit(i)) for i in range(4)]
    return staged.select(
        *keep,
        F.nullif("__headline", F.lit("")).alias("title"),
        F.when(positional, tx.stock_code("__code", "__company", *cells)).otherwise(tx.stock_code("__code", "__company")).alias("stock_code"),
        F.nullif("__company_shown", F.lit("")).alias("company_name"),
        F.nullif(tx.strip_tags("__kind"), F.lit("")).alias("announcement_type"),
        date_in(c("__shown")).alias("announced_at"),
        c("__link").alias("url"),
        F.coalesce("__own_id", tx.announcement_id("__link")).alias("bursa_id"),
        F.when(positional, c("__linked")).otherwise(_files(c("__files"), c("__linked"))).alias("attachments"),
    )


_FILES = "array<struct<filename:string,url:string,name:string,href:string,link:string>>"


def _files(value: Column, linked: Column) -> Column:
    """The attachment list: objects, plain urls, or marked-up text; else those linked in the title."""
    objects = F.transform(F.filter(F.from_json(value, _FILES), lambda f: F.coalesce(f["url"], f["href"], f["link"]).isNotNull()), lambda f: F.struct(F.coalesce(f["filename"], f["name"], F.substring_index(F.coalesce(f["url"], f["href"], f["link"]), "/", -1)).alias("filename"), F.coalesce(f["url"], f["href"], f["link"]).alias("url")))
    urls = F.transform(F.from_json(value, "array<string>"), lambda u: F.struct(F.substring_index(u, "/", -1).alias("filename"), u.alias("url")))
    listed = F.when(value.startswith("[{"), objects).when(value.startswith("["), urls).otherwise(tx.attachments(value))
    return F.when(F.size(listed) > 0, listed).otherwise(linked)


def _object_fields() -> list[Column]:
    """The raw fields of an object row from its map `__r` and its entries `__l`."""
    get = lambda f: _first(F.col("__r"), F.col("__l"), f)
    files = F.coalesce(*(F.nullif(F.try_element_at("__r", F.lit(k)), F.lit("")) for k in ("attachments", "files", "documents")), F.lit(""))
    return [get("title"), get("company_name"), get("stock_code"), get("announcement_type"), get("announced_at"), get("url"), get("bursa_id"), files]


def _cell_fields(cells: Column) -> list[Column]:
    """The raw fields of a positional row (number, date, company, title)."""
    cell, none = [F.get(cells, F.lit(i)) for i in range(4)], F.lit(None).cast("string")
    return [cell[3], cell[2], none, none, cell[1], none, none, none]


def _named(fields: list[Column]) -> list[Column]:
    return [x.alias(f"__{n}") for n, x in zip(RAW, fields, strict=True)]


def from_objects(rows: DataFrame, body: str) -> DataFrame:
    """Announcements of JSON object rows (text in `body`); the other columns stay."""
    keep = [c for c in rows.columns if c != body]
    records = rows.select(*keep, F.from_json(body, "map<string,string>").alias("__r")).select(*keep, "__r", F.map_entries("__r").alias("__l"))
    return _announcements(records.select(*keep, *_named(_object_fields()), F.lit(None).cast("array<string>").alias("__cells")), keep)


def from_cells(rows: DataFrame, cells: str) -> DataFrame:
    """Announcements of positional rows (number, date, company, title); short rows are padded with nulls."""
    keep = [c for c in rows.columns if c != cells]
    return _announcements(rows.select(*keep, *_named(_cell_fields(F.col(cells))), F.coalesce(cells, F.array().cast("array<string>")).alias("__cells")), keep)


def from_rows(rows: DataFrame, body: str) -> DataFrame:
    """Announcements of JSON rows of either shape (text in `body`), told apart row by row in one pass."""
    keep = [c for c in rows.columns if c != body]
    text = F.col(body)
    records = rows.select(*keep, F.from_json(F.when(text.startswith("{"), text), "map<string,string>").alias("__r"), F.from_json(F.when(text.startswith("["), text), "array<string>").alias("__cells"))
    records = records.select("*", F.map_entries("__r").alias("__l"))
    either = [F.when(F.col("__cells").isNotNull(), at).otherwise(of) for of, at in zip(_object_fields(), _cell_fields(F.col("__cells")), strict=True)]
    return _announcements(records.select(*keep, *_named(either), "__cells"), keep)


def from_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Announcements of HTML listings: rows of four cells or more whose second is a date; others are headings."""
    rows = read_rows(pages, key, html).where((F.size("cells") >= 4))
    return from_cells(rows, "cells").where("announced_at is not null and title is not null")


def split_payload(payloads: DataFrame, body: str) -> DataFrame:
    """One row per listing row: the other columns, row_no, row (JSON text), and problem for payloads of no known shape.

    The list is the payload itself or the first of ROOTS that holds a list. An empty list gives no rows.
    """
    keep = [c for c in payloads.columns if c != body]
    text = F.trim(body)
    root = F.from_json(text, "map<string,string>")
    inner = F.coalesce(*(F.when(F.try_element_at(root, F.lit(k)).startswith("["), F.try_element_at(root, F.lit(k))) for k in ROOTS))
    listed = F.from_json(F.when(text.startswith("["), text).otherwise(inner), "array<string>")
    seen = F.array_join(F.array_sort(F.map_keys(root)), ", ")
    problem = F.when(listed.isNull(), F.when(F.size(root) > 0, F.concat(F.lit("no announcement list among the keys: "), seen)).otherwise("not a listing"))
    rows = payloads.select(*keep, listed.alias("__rows"), problem.alias("problem"))
    return rows.select(*keep, "problem", F.posexplode_outer("__rows").alias("row_no", "row")).where("problem is not null or row is not null")


def parse(payloads: DataFrame, body: str, strict: bool = True) -> DataFrame:
    """Announcements of JSON payloads of either row shape. With `strict`, an unknown shape raises ListingError."""
    rows = split_payload(payloads, body)
    if strict:
        bad = rows.where("problem is not null").select("problem").take(1)
        if bad:
            raise ListingError(bad[0][0])
    keep = [c for c in payloads.columns if c != body]
    good = rows.where("problem is null").select(*keep, "row_no", "row")
    return from_rows(good, "row").where("title is not null")


def read_listing_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole listing files of a folder: path, body."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
