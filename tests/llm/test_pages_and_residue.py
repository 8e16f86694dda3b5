import random

from textloom.llm import boilerplate
from textloom.llm.boilerplate import LINKS, density, lines_of, main_content, page_lines
from textloom.llm.residue import PLACEHOLDER, fit, found, judge_many, judged, real_content, segments, with_slots

random.seed(9)
NOUNS = "barn tractor council ledger shard harvest library goblin silo meadow parcel engine river market".split()


def prose(n=2):
    return " ".join(f"When the {random.choice(NOUNS)} meets the {random.choice(NOUNS)}, every {random.choice(NOUNS)} near the {random.choice(NOUNS)} waits for {random.randint(2, 900)} days." for _ in range(n))


def page(title, body, mid=()):
    head = ["Skip to content", "This site uses cookies to measure visits. Accept all", "Northfield Gazette", "Home | News | Archive | Contact | About us", f"Home > News > {title}", f"# {title}"]
    foot = ["Share this page", "Related pages", "Why the meadow waits", "How to move a silo", "© 2024 Northfield Gazette. All rights reserved.", "Privacy | Terms | Contact", "Back to top"]
    lines, marks = [], []
    for x, own in [*((h, h.startswith("# ")) for h in head), *((b, True) for b in body[:2]), *((m, False) for m in mid), *((b, True) for b in body[2:]), *((f, False) for f in foot)]:
        lines.append(x)
        marks.append(own)
    return "\n".join(lines), marks


def test_lines_of_pages(spark):
    chunks, sources, want = [], [], {}
    for i in range(40):
        title = f"About the {NOUNS[i % 14]} number {i}"
        body = ["Opening hours", prose(), "", prose(3), "- " + prose(1), "Skip to the next ledger if the first one is already sealed.", prose()]
        text, marks = page(title, body, ["Advertisement", "Best boots - now 20% off, order today"] if i % 2 else [])
        chunks.append((f"c{i}", f"s{i}", text, {"source_name": title}, 1))
        sources.append((f"s{i}", "url" if i % 3 else "sitemap", f"https://WWW.site{i % 4}.example/p{i}", title if i % 5 else None, "done"))
        want |= {(f"c{i}", k): not own for k, (own, line) in enumerate(zip(marks, text.split("\n"))) if line.strip()}
    chunks += [("pdf", "p", "Home\nNews\nArchive\nContact", {}, 1), ("null", "s1", None, None, 1), ("blank", "s1", " \n", {}, 1), ("lost", "nowhere", "Home", {}, 1), (None, "s1", "Home", {}, 1), chunks[0]]
    sources += [("p", "pdf", "file.pdf", None, "done"), sources[0], (None, "url", "https://x.example", None, "done")]
    c = spark.createDataFrame(chunks, "chunk_id string, source_id string, text string, metadata map<string,string>, line_no int")
    s = spark.createDataFrame(sources, "source_id string, type string, uri string, source_name string, status string")
    got = {(r["chunk_id"], r["line_no"]): r["boilerplate"] for r in page_lines(c, s).collect()}
    assert set(got) == set(want)
    wrong = [k for k in want if got[k] != want[k]]
    assert len(wrong) <= 0.02 * len(want), wrong[:5]
    kept = {r["chunk_id"]: r["text"] for r in main_content(c, s).collect()}
    assert "cookies" not in kept["c1"] and "Skip to the next ledger" in kept["c1"] and kept["c1"].startswith("# About")
    assert page_lines(c.limit(0), s).count() == 0 and page_lines(c, s.limit(0)).count() == 0


def test_density_prefers_text_without_links():
    assert density(200, 1, 0, 0, 0.3) > density(200, 8, 180, 8, 0.3) >= 0
    assert density(200, 1, 0, 0, 0.3) > density(20, 1, 0, 0, 0.3) > density(20, 1, 20, 1, 0.3)
    assert lines_of("", None) == [] and [k for _, k, _, _ in lines_of("a | b | c", None)] == [LINKS]


def test_density_decides(monkeypatch):
    text, marks = page("About the barn", [prose(), "Opening hours", prose(2), prose(3)])
    marks = [m for m, line in zip(marks, text.split("\n")) if line.strip()]
    assert [not out for _, _, out, _ in lines_of(text, "About the barn")] == marks
    monkeypatch.setattr(boilerplate, "density", lambda *_: 200.0)
    assert not any(out for _, _, out, _ in lines_of(text, "About the barn"))
    monkeypatch.setattr(boilerplate, "density", lambda *_: 1.0)
    assert all(out for _, _, out, _ in lines_of(text, "About the barn"))


def test_long_side_column_text_on_every_page_of_a_site(spark):
    blurb = "Northfield Gazette was founded by three millers who wanted to read about the harvest before the market opened, and it has been printed in the same yard behind the library ever since, on every day but the first of the year."
    assert len(blurb) > 200
    chunks, sources = [], []
    for i in range(30):
        text, _ = page(f"Page {i}", [prose(), prose(2)])
        chunks.append((f"c{i}", f"s{i}", text.replace("Related pages", blurb + "\nRelated pages"), {}))
        sources.append((f"s{i}", "url", f"https://site.example/p{i}", f"Page {i}"))
    c = spark.createDataFrame(chunks, "chunk_id string, source_id string, text string, metadata map<string,string>")
    s = spark.createDataFrame(sources, "source_id string, type string, uri string, source_name string")
    got = {(r["chunk_id"], r["line_no"]): r["boilerplate"] for r in page_lines(c, s).collect()}
    at = chunks[0][2].split("\n").index(blurb)
    assert sum(got[f"c{i}", at] for i in range(30)) >= 28
    hot = {(r["chunk_id"], r["line_no"]): r["boilerplate"] for r in page_lines(c, s, hot_share=10**9).collect()}
    assert hot == got


def test_long_lines_are_tested_for_notices():
    filler = "the ledger of the barn is kept by the council and every parcel in it is measured again when the harvest of the year has been brought in and the engine of the market rests"
    for notice in [
        f"Alle Rechte vorbehalten, {filler}.", f"Todos los derechos reservados, {filler}.", f"(c) 2024 Northfield Gazette, {filler}.", f"Copyright 2024 Northfield Gazette, {filler}.", f"By continuing to read you agree that {filler}.",
        f"We measure visits with tracking pixels, and {filler}.", f"Northfield Gazette is a registered charity, {filler}.", f"There is no spam, {filler}.", f"Subscribe to our newsletter, {filler}.", "\t".join(["Home and garden", "Barns and silos"] * 7) + ".",
    ]:
        assert len(notice) >= 170 and lines_of(notice, None)[0][1] == LINKS, notice
    assert lines_of(filler + ".", None)[0][1] != LINKS


def test_long_paragraphs_that_repeat_over_a_site(spark):
    notice = "The Northfield Gazette is printed by the cooperative of the valley in the old mill beside the river; letters to the editor reach the board by post, and what is sent in stays with the archive of the town, where it may be read on any weekday."
    assert len(notice) > 200
    chunks = [(f"c{i}", f"s{i}", page(f"About the {NOUNS[i % 14]} number {i}", [prose(), prose(3), prose(2)])[0] + "\n" + notice, {"source_name": f"About the {NOUNS[i % 14]} number {i}"}) for i in range(20)]
    c = spark.createDataFrame(chunks, "chunk_id string, source_id string, text string, metadata map<string,string>")
    s = spark.createDataFrame([(f"s{i}", "url", f"https://site.example/p{i}", None) for i in range(20)], "source_id string, type string, uri string, source_name string")
    got = {(r["chunk_id"], r["line_no"]): r["boilerplate"] for r in page_lines(c, s).collect()}
    assert all(got[i, text.count("\n")] for i, _, text, _ in chunks)


def test_placeholders():
    for slot in ["{{name}}", "${city}", "{0}", "<%= page.total %>", "{% date %}", "[[CITY]]", "[Your Name]", "[INSERT DATE]", "<insert total here>", "%FIRST_NAME%", "__PHONE__", "@@version@@", "##TITLE##", "*|AMOUNT|*", "«Total»", "[object Object]"]:
        assert PLACEHOLDER.search(f"Dear {slot}, thank you."), slot
    for plain in ["the set {1, 2, 3} and note [12]", "a label [sic] and 50% of it", '{"top_k": 5}', "__init__ of a class", r"\frac{a}{b}", "100 % sure", "a « b » c"]:
        assert not PLACEHOLDER.search(plain), plain


def test_residue(spark):
    cases = {
        1: "Dear {{name}}, thank you for your order. " + prose(3), 2: "Write `{{name}}` where the name belongs. " + prose(3), 3: "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Vestibulum ante morbi sit amet ipsum dolor.",
        4: "404 - Page not found\nGo back to the start page.", 5: "Please enable JavaScript to view this page.", 6: prose(4) + " Please enable JavaScript to view the map.", 7: "Loading...\nLoading...\nLoading...", 8: "Access denied. You do not have permission to access this page.",
        9: "Home | News | Contact\nSomething went wrong. Please try again later.\n© 2024 Gazette", 10: prose(1), 11: "A barn.", 12: "", 13: None, 14: "xxx xxx xxx xxx xxx xxx xxx xxx", 15: "The study counted every page that said 'page not found' and found it the most common message of all. " + prose(2), 16: "qwe asdkj wqueo lkasd qwoiu asdjk qoweiu aslkdj qwue askdj",
    }
    residue = {1, 3, 4, 5, 7, 8, 9, 14, 16}
    rows = [(k, t, "HTML", 200) for k, t in cases.items()] + [(1000 + k, prose(4), None, 500) for k in range(300)] + [(4, cases[4], "pdf", 200), (None, "404 Not Found", "pdf", 200)]
    df = spark.createDataFrame(rows, "extract_id bigint, text string, extractor_used string, http_status int").withColumnRenamed("http_status", "residue_kind")
    assert {r["extract_id"] for r in found(df).collect()} == residue
    kinds = {r["extract_id"]: r["residue_kind"] for r in judged(df).collect()}
    assert kinds[1] == "placeholder" and kinds[5] == "residue" and kinds[13] == kinds[12] == "" and kinds[6] == ""
    left = real_content(df)
    assert left.columns == df.columns and {r["extract_id"] for r in left.collect()} == {2, 6, 10, 11, 15} | {1000 + k for k in range(300)}
    assert found(df.limit(0)).count() == 0
    assert segments("One. Two!\nThree 3.5 four。五") == ["One.", "Two!", "Three 3.5 four。", "五"]


def test_numbered_or_punctuated_repetition_is_residue():
    filler = ["Item 1 item 2 item 3 item 4 item 5 item 6", "Bla, bla - BLA (bla) bla; Bla", "Row 10: row 11, row 12: row 13, ROW 14: row 15"]
    assert [kind for kind, _ in judge_many([*filler, prose(1)], [])] == ["residue"] * 3 + [""]


def test_slots_are_found_by_their_shape(spark):
    texts = [prose(3) for _ in range(200)]
    models = fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    slots = ["Dear {{first_name}}, " + prose(1), "Total: ${order.total} due", "[Your company]", "%CUSTOMER_NAME%", "<insert date>", "*|FNAME|*", "{0} of {1}", "__DATE__"]
    got = with_slots([*slots, *texts], models.slots)
    assert set(range(len(slots))) <= got and len(got) < 0.5 * len(texts)
    assert [k for k, _ in judge_many(slots, models)] == ["placeholder"] * len(slots)
    assert with_slots([], models.slots) in (set(), {0}) and judge_many([None, "", " "], models) == [("", 0.0)] * 3


def test_models_do_not_depend_on_how_rows_are_spread(spark):
    rows = [(prose(2),) for _ in range(150)] + [("Page not found.",), ("Loading...",)]
    one, many = (fit(spark.createDataFrame(rows, "text string").repartition(n), fit_rows=100) for n in (1, 7))
    assert all((a == b).all() for a, b in zip(one, many)) and (one.slots == many.slots).all()


def test_models_are_fitted_on_all_texts(spark):
    from textloom.llm.residue import grams

    letters = "bcdfghjklmnpqrstvwxz"
    words = ["".join(letters[k // 20**j % 20] for j in range(4)) for k in range(10_400)]
    rows = [(f"The keeper of the mill wrote the word {w} into the ledger before supper.",) for w in words]
    filler = fit(spark.createDataFrame(rows, "text string"))[1]
    assert all((filler[grams(t)] != 0).all() for (t,) in rows)
