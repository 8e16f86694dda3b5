"""Documents and responses to text."""

from __future__ import annotations

import html.parser
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textloom.functions.text import extension, normalize_text
from textloom.operators.tables import csv_table

# Elements without text, elements that start a line, and marks of what isn't content.
_SILENT = {"script", "style", "noscript", "iframe", "svg", "template", "head"}
_BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "li", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "form", "br", "hr", "dl", "dt", "dd"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_ASIDE = {"nav", "footer", "header", "aside"}
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search"}
_ASIDE_CLASS = re.compile(r"(?i)\b(nav(bar|igation)?|menu|sidebar|footer|breadcrumbs?|cookie|advert(isement)?|social|share)\b")


class _Page(html.parser.HTMLParser):
    """Collects (text, kind) pieces; ``drop`` says which elements are left out, ``inside`` limits to an element."""

    def __init__(self, drop: set[str], boilerplate: bool, inside: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.drop, self.boilerplate, self.inside = drop, boilerplate, inside
        self.stack: list[tuple[str, bool, bool]] = []
        self.out: list[str] = []
        self.counts = {"headings": 0, "links": 0, "tables": 0}

    def _state(self) -> tuple[bool, bool]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, self.inside is None)

    def handle_starttag(self, tag, attrs):
        hidden, within = self._state()
        a = dict(attrs)
        aside = self.boilerplate and (tag in _ASIDE or a.get("role") in _ASIDE_ROLES or bool(_ASIDE_CLASS.search(f"{a.get('class') or ''} {a.get('id') or ''}")))
        names = {tag, *(f".{c}" for c in (a.get("class") or "").split()), f"#{a['id']}" if a.get("id") else tag}
        hidden = hidden or tag in _SILENT or aside or bool(names & self.drop)
        within = within or tag == self.inside
        if not hidden:
            self.counts["headings"] += bool(re.fullmatch("h[1-6]", tag))
            self.counts["links"] += tag == "a" and "href" in a
            self.counts["tables"] += tag == "table"
            if within and tag in _BLOCKS:
                self.out.append("\n\n" + "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "\n- " if tag == "li" else "\n```\n" if tag == "pre" else "\n")
        if tag not in _VOID:
            self.stack.append((tag, hidden, within))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                _, hidden, within = self.stack[k]
                if not hidden and within and tag in _BLOCKS:
                    self.out.append("\n```\n" if tag == "pre" else "\n\n" if re.fullmatch("h[1-6]", tag) else "\n")
                del self.stack[k:]
                break

    def handle_data(self, data):
        hidden, within = self._state()
        if not hidden and within:
            self.out.append(data)


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t\r\f\v\xa0]+", " ", text)
    text = re.sub(r" ?\n ?", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def page_text(markup: str, remove: tuple[str, ...] = (), main_only: bool = True) -> tuple[str, dict[str, int]]:
    """Markdown-like text of a page in document order, and counts of headings, links and tables.

    ``main_only`` keeps main or article (else the body) without navigation, headers, footers, asides
    and elements of such roles and classes, falling back to the whole text if that leaves fewer than
    100 characters. ``remove`` names elements, .classes or #ids to leave out.
    """

    def read(boilerplate: bool, inside: str | None):
        p = _Page(set(remove), boilerplate, inside)
        p.feed(markup)
        p.close()
        return _tidy("".join(p.out)), p.counts

    whole, counts = read(False, None)
    if not main_only:
        return whole, counts
    low = markup.lower()
    inside = next((t for t in ("main", "article") if f"<{t}" in low), None)
    text, _ = read(True, inside)
    return (text if len(text) >= 100 else whole), counts


_PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("headings", T.IntegerType()), T.StructField("links", T.IntegerType()), T.StructField("tables", T.IntegerType())])


def html_to_text(markup: Column, remove: tuple[str, ...] = (), main_only: bool = True) -> Column:
    """struct<text, headings, links, tables>; null for null."""

    @F.pandas_udf(_PAGE)
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for m in pages:
            text, c = page_text(m, remove, main_only) if m is not None else (None, {})
            rows.append((text, c.get("headings"), c.get("links"), c.get("tables")))
        return pd.DataFrame(rows, columns=["text", "headings", "links", "tables"])

    return F.when(markup.isNotNull(), run(markup))


def needs_render(text: Column, markup: Column) -> Column:
    """Whether a page is only a shell that scripts fill: loading texts, not-found starts, many very short lines, or hardly any text in much markup."""
    low = F.lower(text)
    lines = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    short = (F.size(lines) > 20) & (F.aggregate(lines, F.lit(0), lambda n, s: n + F.length(s)) / F.size(lines) < 30)
    thin = (F.length(markup) > 5000) & (F.length(text) / F.length(markup) < 0.05)
    spa = markup.rlike(r"(?i)id=[\"'](root|app|__next|__nuxt)[\"']|ng-app|data-reactroot") & (F.length(text) < 1000)
    return F.coalesce((F.regexp_count(low, F.lit("loading")) >= 3) | low.rlike(r"^\s*(404|not found|page not found)") | short | thin | spa, F.lit(False))


def csv_to_markdown(text: str, preview: int = 100) -> str:
    """Header, rule and at most ``preview`` rows as a pipe table."""
    t = csv_table(text)
    if not t:
        return ""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(t[0]["headers"]), line(["---"] * len(t[0]["headers"])), *(line(r) for r in t[0]["rows"][:preview])])


def document_text(content: Column, format_: Column, preview: int = 100) -> Column:
    """struct<text, warning>: text of a document by its format: md and txt as they are, csv as a table, json indented, html as page_text; other formats have no text and a warning."""
    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("warning", T.StringType())])

    @F.pandas_udf(out)
    def run(contents: pd.Series, formats: pd.Series) -> pd.DataFrame:
        rows = []
        for c, f in zip(contents, formats):
            f = (f or "txt").lower()
            if c is None:
                rows.append((None, "no content"))
            elif f in ("md", "markdown", "txt", "text"):
                rows.append((c, None))
            elif f in ("csv", "tsv"):
                rows.append((csv_to_markdown(c, preview), None))
            elif f == "json":
                try:
                    rows.append((json.dumps(json.loads(c), indent=2, ensure_ascii=False), None))
                except ValueError:
                    rows.append((c, "not valid json"))
            elif f in ("html", "htm"):
                rows.append((page_text(c)[0], None))
            else:
                rows.append((None, f"no reader for {f}"))
        return pd.DataFrame(rows, columns=["text", "warning"])

    return run(content, format_)


def format_of(content_type: Column, uri: Column) -> Column:
    """html, pdf, plain or unknown: by the content type first, by the extension where that says nothing."""
    t = F.trim(F.lower(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    ext = extension(F.coalesce(uri, F.lit("")))
    by_ext = F.when(ext.isin("html", "htm"), "html").when(ext == "pdf", "pdf").when(ext.isin("txt", "md", "csv", "json", "xml"), "plain").otherwise("unknown")
    return F.when(t.isin("text/html", "application/xhtml+xml"), "html").when(t == "application/pdf", "pdf").when(t.startswith("text/") | t.isin("application/json", "application/xml"), "plain").when(t.isin("", "application/octet-stream", "binary/octet-stream"), by_ext).otherwise("unknown")


def route_responses(df: DataFrame, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Responses (uri, content_type, body binary or text) with extractor, text and error.

    Bodies over the cap, unknown formats and empty texts are errors; pdf needs a reader (pdf_text).
    """
    body = F.col("body").cast("binary")
    marked = df.withColumn("extractor", format_of(F.col("content_type"), F.col("uri"))).withColumn("__raw", F.when(F.octet_length(body) <= max_bytes, F.try_validate_utf8(F.decode(body, "UTF-8"))))
    text = F.when(F.col("extractor") == "html", html_to_text(F.col("__raw"))["text"]).when(F.col("extractor") == "plain", F.col("__raw"))
    error = F.when(F.octet_length(body) > max_bytes, "too large").when(F.col("extractor") == "unknown", "unknown content type").when(F.col("extractor") == "pdf", "no pdf reader").when(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0, "no text")
    return marked.withColumn("text", text).withColumn("error", error).drop("__raw")


def page_slices(text: Column, n_pages: Column, first: int | None = None, last: int | None = None) -> Column:
    """array<struct<page, text, char_count, is_empty>>: a text without page marks cut into slices of equal length; of these the pages from ``first`` to ``last``, both included, if given."""
    slices = _slices(text, n_pages)
    if first is not None or last is not None:
        slices = F.filter(slices, lambda p: (p["page"] >= (first or 1)) & (p["page"] <= (F.lit(last) if last is not None else n_pages)))
    return slices


def _slices(text: Column, n_pages: Column) -> Column:
    size = F.greatest(F.ceil(F.length(text) / n_pages), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(1), n_pages),
        lambda p: F.struct(p.alias("page"), F.substring(text, (p - 1) * size + 1, size).alias("text"), F.length(F.substring(text, (p - 1) * size + 1, size)).alias("char_count"), (F.trim(F.substring(text, (p - 1) * size + 1, size)) == "").alias("is_empty")),
    )


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.contains(F.decode(F.substring(content, 1, 5), "ISO-8859-1"), F.lit("%PDF")), F.lit(False))


def pdf_text(content: Column, reader) -> Column:
    """Text of PDF files by ``reader`` (bytes to text), which the caller supplies; under 50 characters counts as none."""

    @F.pandas_udf(T.StringType())
    def run(files: pd.Series) -> pd.Series:
        def one(b):
            text = reader(bytes(b)) if b is not None else None
            return text if text and len(text.strip()) >= 50 else None

        return files.map(one)

    return normalize_text(run(content))
