"""Conversations as PDF files, a page a turn, written and read back."""

from pyspark.sql import functions as F

from docengine.registry import query, table
from docengine.sources import files, pdf

_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
_TURNS = f"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id {_ORDER}) AS page, count(*) OVER (PARTITION BY conv_id) AS pages, coalesce(text, '') AS text
FROM conversations WHERE conv_id IS NOT NULL)"""


def _files(spark, sf):
    """The folder of one file for each conversation."""
    path = files.scratch(spark, "pdf")
    pdf.write(table(spark, sf, "conversations"), path, "conv_id", ["turn", "role", "text"], "text").count()
    return path


@query("s9_pdf_pages", f"WITH {_TURNS} SELECT conv_id, page::INTEGER AS page, pages::INTEGER AS pages, text FROM t")
def pdf_pages(spark, sf):
    """Every page's text; a small split, so that files are packed into several partitions."""
    found = pdf.pages(spark, _files(spark, sf), split=4 << 20)
    return found.select(F.col("title").cast("long").alias("conv_id"), "page", "pages", "text")


@query("s9_pdf_documents", f"WITH {_TURNS} SELECT conv_id, max(pages)::INTEGER AS pages, string_agg('--- Page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS content FROM t GROUP BY conv_id")
def pdf_documents(spark, sf):
    """A file's pages as one content, each under its number."""
    found = pdf.documents(pdf.pages(spark, _files(spark, sf)))
    return found.select(F.col("title").cast("long").alias("conv_id"), "pages", "content")
