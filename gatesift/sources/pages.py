"""Paged documents: page texts in, document texts out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift import rules
from gatesift.operators.analyze import analyze_pdf_text, oversize_analysis_sql
from gatesift.session import written


def assemble_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no",
                   text: str = "text", embedded: str | None = "has_embedded_files",
                   max_bytes: int = rules.MAX_BYTES) -> DataFrame:
    """One row per document: its page texts in page order, without separator.

    Unreadable (NULL) pages are skipped; a document without readable pages has NULL
    text. Documents are measured first, in a pass over the lengths that leaves a narrow table;
    one over ``max_bytes`` gets ``n_bytes`` and NULL text, and its pages are never brought
    together. Empty pages add nothing to a text and stay out too. So a task collects at most
    ``max_bytes`` in as many pages for one document, however many pages it has.
    """
    has_files = F.lit(False) if embedded is None else F.coalesce(F.col(embedded), F.lit(False))
    length = F.octet_length(text)
    sizes = written(pages.groupBy(doc).agg(
        F.coalesce(F.sum(length), F.lit(0)).alias("n_bytes"),
        F.count("*").alias("n_pages"),
        F.max(has_files).alias("has_embedded_files"),
        F.max(length).alias("_gs_longest")), "page-sizes")
    oversize = sizes.filter(F.col("n_bytes") > max_bytes).select(F.col(doc).alias("_gs_over"))
    texts = (
        pages.select(doc, page, text).filter(length > 0)
        .join(oversize, F.col(doc).eqNullSafe(F.col("_gs_over")), "left_anti")
        .groupBy(doc)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(page), F.col(text)))).alias("_gs_p"))
        .select(F.col(doc).alias("_gs_doc"), F.array_join(F.col("_gs_p")[text], "").alias("_gs_text"))
    )
    readable = F.when(F.col("_gs_longest").isNotNull() & (F.col("n_bytes") <= max_bytes),
                      F.coalesce("_gs_text", F.lit("")))
    return sizes.join(texts, F.col(doc).eqNullSafe(F.col("_gs_doc")), "left").select(
        doc, "n_bytes", "n_pages", "has_embedded_files", readable.alias("text"))


def analyze_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no",
                  text: str = "text", embedded: str | None = "has_embedded_files", *,
                  threshold: float = rules.FILE_THRESHOLD,
                  max_bytes: int = rules.MAX_BYTES, output: str = "analysis") -> DataFrame:
    """Analysis of paged documents, each analysed once."""
    docs = assemble_pages(pages, doc, page, text, embedded, max_bytes)
    analysed = analyze_pdf_text(docs, "text", "has_embedded_files", threshold=threshold,
                                output="_gs_analysis")
    oversize = oversize_analysis_sql(rules.PDF_UNSAFE_SUMMARY)
    return analysed.select(*docs.columns, F.expr(
        f"CASE WHEN n_bytes > {max_bytes} THEN {oversize} ELSE _gs_analysis END").alias(output))
