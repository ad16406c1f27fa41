"""Files as tables: a watchlist of JSON, and the text of PDF files where a reader is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATCHLIST = "stock_code string, name string, short_name string, is_active boolean, notes string"


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a JSON array that have a code and a name; a missing, broken or other file gives none.

    Entries without is_active are active; of a code given twice the last entry in the file counts.
    """
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], WATCHLIST)
    entries = F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in WATCHLIST.split(', '))}>>")
    rows = text.where("ltrim(value) like '[%'").select(F.posexplode(entries).alias("at", "e")).select("at", "e.*").where("trim(stock_code) <> '' and trim(name) <> ''")
    last = rows.groupBy(F.trim("stock_code").alias("stock_code")).agg(F.max_by(F.struct("name", "short_name", F.coalesce("is_active", F.lit(True)).alias("is_active"), "notes"), "at").alias("e"))
    return last.select("stock_code", "e.*")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, pages array<string>, title, author, creator of PDF files; needs `pypdf` where the tasks run.

    A file that can't be opened has pages null.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    reader = PdfReader(io.BytesIO(content))
                    info = reader.metadata or {}
                    rows.append((name, [p.extract_text() or "" for p in reader.pages], *(str(info.get(k, "")) for k in ("/Title", "/Author", "/Creator"))))
                except Exception:
                    rows.append((name, None, "", "", ""))
            kinds = (pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "pages", "title", "author", "creator"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInArrow(scan, "path string, pages array<string>, title string, author string, creator string")


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines."""
    results.write.mode("error").json(path)
