"""The engine's functions under SQL names: register(spark) makes them known to spark.sql."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T

from textloom.functions.vectors import seeded_vector
from textloom.operators.chunking import split_text
from textloom.operators.extract import page_text
from textloom.operators.tables import markdown_tables


class ChunkText:
    """The chunks of one text; null texts give none."""

    def eval(self, text: str, strategy: str = "recursive", max_chars: int = 1500, overlap_chars: int = 150):
        if text:
            for k, part in enumerate(split_text(text, strategy, max_chars, overlap_chars)):
                yield k, part


class ExtractTables:
    """The pipe tables of one text; null texts have none."""

    def eval(self, text: str):
        for k, t in enumerate(markdown_tables(text) if text else ()):
            yield k, t["headers"], len(t["rows"])


def main_texts(pages: pd.Series) -> pd.Series:
    """Main text of HTML pages."""
    return pages.map(lambda m: None if m is None else page_text(m)[0])


def composed(texts: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def mock_vectors(texts: pd.Series) -> pd.Series:
    """Seeded mock vectors of 64 numbers."""
    return texts.map(lambda t: None if t is None else seeded_vector(t, 64).tolist())


def register(spark: SparkSession) -> list[str]:
    """Register chunk_text and extract_tables (table functions), html_to_text, nfc and mock_embedding; returns the names."""
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_index int, text string"))
    spark.udtf.register("extract_tables", F.udtf(ExtractTables, returnType="table_no int, headers array<string>, n_rows int"))
    for name, f, kind in (("html_to_text", main_texts, T.StringType()), ("nfc", composed, T.StringType()), ("mock_embedding", mock_vectors, T.ArrayType(T.DoubleType()))):
        spark.udf.register(name, F.pandas_udf(f, kind))
    return ["chunk_text", "extract_tables", "html_to_text", "mock_embedding", "nfc"]
