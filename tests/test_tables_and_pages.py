from pyspark.sql import functions as F

from textloom.operators import tables
from textloom.operators.extract import csv_to_markdown, document_text, html_to_text, is_pdf, needs_render, page_slices, page_text, pdf_text, route_responses

PAGE = """<html><head><title>t</title><script>var x = "<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav>
<div class="cookie banner">We use cookies</div><main><h1>Title</h1><p>First &amp; second   words that make this body long enough to count as the content of a page.</p>
<ul><li>one</li><li>two</li></ul><pre>code  here</pre><h2>More</h2><p>End of it.</p></main><footer>Imprint</footer></body></html>"""


def test_page_text_keeps_the_main_part_in_order():
    text, counts = page_text(PAGE)
    assert text.startswith("# Title\n\nFirst & second words") and "- one\n\n- two" in text.replace("- one\n- two", "- one\n\n- two")
    assert "Home" not in text and "cookies" not in text and "Imprint" not in text and "var x" not in text
    assert text.index("# Title") < text.index("- one") < text.index("```") < text.index("## More")
    assert counts == {"headings": 2, "links": 1, "tables": 0}
    assert "Home" in page_text(PAGE, main_only=False)[0]
    assert "one" not in page_text(PAGE, remove=("ul",))[0]
    assert "Home" in page_text("<nav>Home</nav><main>short</main>")[0]


def test_html_column_with_nulls(spark):
    got = spark.createDataFrame([(PAGE,), (None,), ("",)], "h string").select(html_to_text(F.col("h")).alias("p")).collect()
    assert got[0]["p"]["headings"] == 2 and got[1]["p"] is None and got[2]["p"]["text"] == ""


def test_markdown_tables():
    text = "intro\nTable 3: Yields\n\n| a | b |\n|---|:-:|\n| 1 | x |\n| 2 |  |\n\nno table |\n| c | d |\n| 3 | 4 |\n\n| lone |"
    one, two = tables.markdown_tables(text)
    assert one["headers"] == ["a", "b"] and one["rows"] == [["1", "x"], ["2", ""]] and text[one["start"] :].startswith("| a | b |")
    assert two["headers"] == ["c", "d"] and two["rows"] == [["3", "4"]]
    assert tables.markdown_tables("") == [] and tables.markdown_tables("| x |\n") == []


def test_html_and_csv_tables():
    got = tables.html_tables("<table><tr><th>A</th><th>B</th></tr><tr><td>1 <b>x</b></td><td><table><tr><td>in</td></tr></table></td></tr></table>")
    assert got[0]["headers"] == ["A", "B"] and got[0]["rows"][0][0] == "1 x" and got[1]["headers"] == ["in"]
    assert tables.csv_table('n, v\n"a, ""b""",2\n')[0] == {"headers": ["n", "v"], "rows": [['a, "b"', "2"]], "start": 0, "end": 18}
    assert csv_to_markdown("a,b\n1,2\n3,4", 1) == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_types_lines_and_summary(spark):
    headers = ["price", "share", "n", "day", "name", "blank"]
    rows = [["$1,200.50", "5%", "1,000", "2024-01-31", "x", ""], ["€3", "7.5 %", "-2.5", "01.02.2024", "4", " "]]
    df = spark.createDataFrame([(headers, rows)], "h array<string>, r array<array<string>>")
    got = df.select(tables.column_types(F.col("h"), F.col("r")).alias("t"), tables.summary(F.col("h"), F.col("r")).alias("s"), tables.linearize(F.col("h"), F.col("r")).alias("l"), tables.table_chunks(F.col("h"), F.col("r"), 1).alias("c")).first()
    assert got["t"] == ["currency", "percentage", "number", "date", "string", "string"]
    assert got["s"] == "Table with 2 rows and 6 columns (price, share, n, day, name, and 1 more)"
    assert got["l"].startswith("Row 1: price=$1,200.50, share=5%") and "; Row 2: price=€3" in got["l"]
    assert [(c["row_start"], c["row_end"], c["is_header"]) for c in got["c"]] == [(0, 1, True), (1, 2, False)]


def test_extract_tables_with_caption_and_empty_input(spark):
    text = "Some lines\n**Table 3: Yields per field**\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {i * i} |" for i in range(5)) + "\nafter"
    df = spark.createDataFrame([("x", text, 1), ("y", None, 2), (None, text, 3), ("z", "no table", 4)], "id string, body string, table_no int")
    got = tables.extract_tables(df, "id", "body", max_rows=2).orderBy("chunk_no").collect()
    assert [(r["id"], r["chunk_no"], r["row_start"], r["row_end"]) for r in got] == [("x", 0, 0, 2), ("x", 1, 2, 4), ("x", 2, 4, 5)]
    assert got[0]["caption"] == "Table 3: Yields per field" and got[2]["text"] == "Row 1: a=4, b=16" and got[0]["column_types"] == ["number", "number"]
    assert tables.table_stats(tables.extract_tables(df, "id", "body", max_rows=2)).first().asDict() == {"tables_found": 1, "total_rows": 5, "total_cells": 10}
    assert tables.extract_tables(df.limit(0), "id", "body").count() == 0


def test_documents_by_format(spark):
    rows = [("a,b\n1,2", "csv"), ('{"k": [1]}', "json"), ("{bad", "json"), ("text", "md"), (PAGE, "html"), ("x", "docx"), (None, "txt")]
    got = spark.createDataFrame(rows, "c string, f string").select(document_text(F.col("c"), F.col("f")).alias("d")).collect()
    assert got[0]["d"]["text"].startswith("| a | b |") and got[1]["d"]["text"] == '{\n  "k": [\n    1\n  ]\n}' and got[2]["d"]["warning"] == "not valid json"
    assert got[3]["d"]["text"] == "text" and got[4]["d"]["text"].startswith("# Title") and got[5]["d"]["text"] is None and got[6]["d"]["warning"]


def test_responses_are_routed(spark):
    rows = [("https://a/x.html", "text/html; charset=utf-8", PAGE), ("https://a/y.txt", "application/octet-stream", "plain words"), ("https://a/z.pdf", None, "%PDF-1.7"), ("https://a/i.png", "image/png", "x"), ("https://a/e", "text/plain", "  "), ("https://a/n", "text/plain", None)]
    df = spark.createDataFrame(rows, "uri string, content_type string, body string")
    got = {r["uri"]: r for r in route_responses(df).collect()}
    assert got["https://a/x.html"]["extractor"] == "html" and got["https://a/x.html"]["error"] is None
    assert got["https://a/y.txt"]["text"] == "plain words" and got["https://a/z.pdf"]["error"] == "no pdf reader" and got["https://a/i.png"]["error"] == "unknown content type"
    assert got["https://a/e"]["error"] == got["https://a/n"]["error"] == "no text"
    assert {r["error"] for r in route_responses(df, max_bytes=5).collect()} >= {"too large"}


def test_shells_slices_and_pdf(spark):
    shell = '<div id="root"></div>' + "<script>1</script>" * 400
    rows = [("Loading Loading loading", "<p>"), ("404 not here", "<p>"), ("\n".join(["ab"] * 30), "<p>"), ("x", shell), ("A real text of a page.", "<p>A real text of a page.</p>"), (None, None)]
    assert [r["n"] for r in spark.createDataFrame(rows, "t string, h string").select(needs_render(F.col("t"), F.col("h")).alias("n")).collect()] == [True, True, True, True, False, False]
    got = spark.createDataFrame([("abcdefg  ", 3)], "t string, n int").select(page_slices(F.col("t"), F.col("n")).alias("p")).first()["p"]
    assert [(p["page"], p["text"], p["is_empty"]) for p in got] == [(1, "abc", False), (2, "def", False), (3, "g  ", False)]
    files = spark.createDataFrame([(bytearray(b"%PDF-1.4 x"),), (bytearray(b"hello"),), (None,)], "b binary")
    assert [r[0] for r in files.select(is_pdf(F.col("b"))).collect()] == [True, False, False]
    assert [r[0] for r in files.select(pdf_text(F.col("b"), lambda b: b.decode() * 20 if b.startswith(b"%PDF") else "short")).collect()] == ["%PDF-1.4 x" * 20, None, None]


def test_captions_in_all_forms_and_safe_names(spark):
    from textloom.functions import text as texts
    from textloom.operators.tables import caption

    rows = [("Table 2: Yields", "Table 2: Yields"), ("table 3 Yields of 2024", "Table 3: Yields of 2024"), ("x\nFigure 4", "Figure 4"), ("**Table 5. Bold**", "Table 5: Bold"), ("Table 1: far\na\nb\nc", None), ("Table 1: one\nTable 2", "Table 2"), ("Tables are 3", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "before string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", caption(F.col("before")).alias("got")).collect())
    names = spark.createDataFrame([("abc-1", True, True, True), ("-abc", False, True, True), ("A_b", False, True, True), ("a/../b", False, False, False), ("/etc/passwd", False, False, False), ("", False, False, False), (None, False, False, False)], "n string, i boolean, t boolean, p boolean")
    got = names.select("i", "t", "p", texts.safe_id(F.col("n")).alias("gi"), texts.safe_tag(F.col("n")).alias("gt"), texts.safe_path(F.col("n")).alias("gp")).collect()
    assert all((r["i"], r["t"], r["p"]) == (r["gi"], r["gt"], r["gp"]) for r in got)
    assert names.select(F.length(texts.random_id()).alias("n")).first()["n"] == 36
