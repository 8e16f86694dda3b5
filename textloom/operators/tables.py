"""Tables inside texts: parsing, types, linearisation, chunks and summaries.

A parsed table is a struct<headers:array<string>, rows:array<array<string>>, start:int, end:int>.
"""

from __future__ import annotations

import csv
import html.parser
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions.text import short_hash

_ROW = re.compile(r"(?m)^[ \t]*\|(.*)\|[ \t]*$")
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
TABLE = T.StructType([T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _cells(line: str) -> list[str]:
    inner = line.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner[:-1] if inner.endswith("|") else inner
    return [c.strip() for c in inner.split("|")]


def markdown_tables(text: str) -> list[dict]:
    """Blocks of neighbouring pipe rows; a rule line after the first row is left out; the first row is the header."""
    out, block, at, start = [], [], 0, 0

    def close(end: int) -> None:
        rows = [r for k, r in enumerate(block) if not (k == 1 and _RULE.match(r))]
        if len(block) >= 2:
            cells = [_cells(r) for r in rows]
            out.append({"headers": cells[0], "rows": cells[1:], "start": start, "end": end})
        block.clear()

    for line in text.split("\n"):
        if line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1:
            if not block:
                start = at
            block.append(line)
        else:
            close(at)
        at += len(line) + 1
    close(min(at, len(text)))
    return out


class _Tables(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.cell: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"rows": [], "n": len(self.done) + len(self.open)})
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            if not self.open[-1]["rows"]:
                self.open[-1]["rows"].append([])
            self.cell.append([tag])

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell and self.open:
            parts = self.cell.pop()
            self.open[-1]["rows"][-1].append((parts[0], " ".join("".join(parts[1:]).split())))
        elif tag == "table" and self.open:
            self.done.append(self.open.pop())

    def handle_data(self, data):
        for c in self.cell:
            c.append(data)


def html_tables(text: str) -> list[dict]:
    """Tables of an HTML text, nested ones too; a first row that is all th, else the first row, is the header."""
    p = _Tables()
    p.feed(text)
    out = []
    for t in sorted(p.done, key=lambda t: t["n"]):
        rows = [[c for _, c in r] for r in t["rows"] if r]
        if rows:
            out.append({"headers": rows[0], "rows": rows[1:], "start": 0, "end": 0})
    return out


def csv_table(text: str, delimiter: str = ",") -> list[dict]:
    """One table; quotes and doubled quotes as usual; cells trimmed; the first line is the header."""
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r]
    return [{"headers": rows[0], "rows": rows[1:], "start": 0, "end": len(text)}] if rows else []


_PARSERS = {"markdown": markdown_tables, "html": html_tables, "csv": csv_table, "tsv": lambda t: csv_table(t, "\t")}


def parse_tables(text: Column, kind: str) -> Column:
    """array<table>: the tables of a text of the given kind; null and empty texts have none."""
    parser = _PARSERS[kind]

    @F.pandas_udf(T.ArrayType(TABLE))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parser(t) if t else [])

    return run(text)


def _matches(pattern: str):
    return lambda c: c.rlike(pattern)


def column_types(headers: Column, rows: Column) -> Column:
    """Per column the first of currency, percentage, number, date that all non-empty cells have, else string; string where all are empty."""
    patterns = (("currency", r"^[-+]?[$€£¥]\s?\d[\d,]*(\.\d+)?$|^[-+]?\d[\d,]*(\.\d+)?\s?[$€£¥]$"), ("percentage", r"^[-+]?\d+(\.\d+)?\s?%$"), ("number", r"^[-+]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$"), ("date", r"^\d{4}-\d{2}-\d{2}([T ].*)?$|^\d{1,2}[./]\d{1,2}[./]\d{4}$"))

    def one(i: Column) -> Column:
        cells = F.filter(F.transform(rows, lambda r: F.trim(F.get(r, i))), lambda c: c.isNotNull() & (c != ""))
        kind = F.when(F.size(cells) == 0, F.lit("string"))
        for name, pattern in patterns:
            kind = kind.when(F.forall(cells, _matches(pattern)), F.lit(name))
        return kind.otherwise("string")

    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(headers) - 1, F.lit(0))), one)


def linearize(headers: Column, rows: Column, strategy: str = "row_by_row") -> Column:
    """'Row i: H=v, ...; ...', 'Column 'H': v, ...; ...', or sentences with three sample values a column."""
    at = F.sequence(F.lit(0), F.greatest(F.size(headers) - 1, F.lit(0)))
    if strategy == "row_by_row":
        line = lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.transform(at, lambda k: F.concat(F.get(headers, k), F.lit("="), F.coalesce(F.get(r, k), F.lit("")))), ", "))
        return F.array_join(F.transform(rows, line), "; ")
    values = lambda k, n: F.array_join(F.transform(F.slice(rows, 1, n) if n else rows, lambda r: F.coalesce(F.get(r, k), F.lit(""))), ", ")
    if strategy == "column_by_column":
        return F.array_join(F.transform(at, lambda k: F.concat(F.lit("Column '"), F.get(headers, k), F.lit("': "), values(k, None))), "; ")
    if strategy == "natural_language":
        head = F.concat(F.lit("This table has "), F.size(rows).cast("string"), F.lit(" rows and "), F.size(headers).cast("string"), F.lit(" columns. "))
        return F.concat(head, F.array_join(F.transform(at, lambda k: F.concat(F.lit("The column "), F.get(headers, k), F.lit(" holds values such as "), values(k, 3), F.lit("."))), " "))
    raise ValueError(f"unknown strategy {strategy}")


def summary(headers: Column, rows: Column, caption: Column | None = None) -> Column:
    """'Table with n rows and m columns (a, b, ...)', at most five headers named, and the caption."""
    plural = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    n = F.size(headers)
    named = F.array_join(F.slice(headers, 1, 5), ", ")
    more = F.when(n > 5, F.concat(F.lit(", and "), (n - 5).cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(F.lit("Table with "), plural(F.size(rows), "row"), F.lit(" and "), plural(n, "column"), F.lit(" ("), named, more, F.lit(")"))
    return text if caption is None else F.concat(text, F.when(caption.isNotNull(), F.concat(F.lit(": "), caption)).otherwise(""))


def context_of(text: Column, start: Column, end: Column, size: int = 100) -> Column:
    """struct<before, after, line>: what surrounds a table, trimmed, and its line number from 1."""
    before = F.trim(F.substring(text, F.greatest(start - size, F.lit(0)) + 1, F.least(start, F.lit(size))))
    return F.struct(before.alias("before"), F.trim(F.substring(text, end + 1, F.lit(size))).alias("after"), (F.size(F.split(F.substring(text, F.lit(1), start), "\n", -1))).alias("line"))


def caption(before: Column) -> Column:
    """'Table N: text', 'Figure N: text' or 'Table N' from the last three lines before a table, the nearest first; null if there is none.

    A line reads "Table 2: words", "Table 2 words" or "Table 2"; marks of bold type around it don't count.
    """
    lines = F.filter(F.split(before, "\n"), lambda s: F.trim(s) != "")
    last = F.reverse(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)))

    def one(line: Column) -> Column:
        pattern = r"(?i)^\s*\**(table|figure)\s*(\d+)(?:\s*[:.–-]\s*|\s+|(?=\**\s*$))(.*?)\**\s*$"
        kind, number, words = (F.regexp_extract(line, pattern, k) for k in (1, 2, 3))
        head = F.concat(F.initcap(kind), F.lit(" "), number)
        return F.when(number != "", F.when(words == "", head).otherwise(F.concat(head, F.lit(": "), words)))

    return F.get(F.array_compact(F.transform(last, one)), F.lit(0))


def table_chunks(headers: Column, rows: Column, max_rows: int = 20) -> Column:
    """array<struct<row_start, row_end, is_header, rows>>: fixed ranges of rows, the first is the header chunk; an empty table is one chunk."""
    n = F.size(rows)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(max_rows))
    return F.transform(starts, lambda s: F.struct(s.alias("row_start"), F.least(s + max_rows, n).alias("row_end"), (s == 0).alias("is_header"), F.slice(rows, s + 1, F.lit(max_rows)).alias("rows")))


def extract_tables(df: DataFrame, id_col: str, text_col: str, kind: str = "markdown", strategy: str = "row_by_row", max_rows: int = 20, context_chars: int = 100) -> DataFrame:
    """(id, table_no, table_id, chunk_no, chunk_id, row_start, row_end, is_header, headers, column_types, n_rows, caption, summary, text): every table of every text, in chunks.

    Row numbers in ``text`` begin anew in each chunk. Null ids and texts without tables give no row.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("__t"))
    found = rows.select("id", "__t", F.posexplode(parse_tables(F.col("__t"), kind)).alias("table_no", "t"))
    ctx = context_of(F.col("__t"), F.col("t.start"), F.col("t.end"), context_chars)
    named = found.withColumn("caption", caption(ctx["before"])).withColumn("table_id", short_hash(F.to_json(F.struct("t.headers", "t.rows"))))
    cut = named.select("*", F.posexplode(table_chunks(F.col("t.headers"), F.col("t.rows"), max_rows)).alias("chunk_no", "c"))
    return cut.select(
        "id", "table_no", "table_id", "chunk_no", short_hash(F.concat_ws("-", "table_id", F.lit("chunk"), F.col("chunk_no").cast("string"))).alias("chunk_id"), "c.row_start", "c.row_end", "c.is_header", "t.headers",
        column_types(F.col("t.headers"), F.col("t.rows")).alias("column_types"), F.size("t.rows").alias("n_rows"), "caption", summary(F.col("t.headers"), F.col("t.rows"), F.col("caption")).alias("summary"), linearize(F.col("t.headers"), F.col("c.rows"), strategy).alias("text"),
    )


def table_stats(tables: DataFrame) -> DataFrame:
    """One row: tables, rows and cells found."""
    one = tables.where("chunk_no = 0")
    zero = F.lit(0).cast("bigint")
    return one.agg(F.count("*").alias("tables_found"), F.coalesce(F.sum("n_rows"), zero).alias("total_rows"), F.coalesce(F.sum(F.col("n_rows") * F.size("headers")), zero).alias("total_cells"))
