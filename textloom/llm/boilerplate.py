"""Problem 1: the main content of web pages, by composite text density over a tree of lines."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.runtime import durable, split_join

# Wordings by which pages mark what isn't content. Whole lines are matched, so a
# sentence of an article that merely uses such words is none.
_LABELS = """
home start menu search login log in log out sign in sign up register my account account profile settings cart basket checkout wishlist shop store
about about us contact contact us help faq support team careers jobs press news blog forum community members partners projects locations
directory gallery downloads library resources reference guides tutorials docs documentation status changelog pricing donate events calendar archive topics sitemap site map
get started visit us follow us find us stay in touch newsletter subscribe unsubscribe share share this page share this article print print this page send to a friend save bookmark
advertisement advertisements sponsored sponsored content promoted ad ads anzeige werbung publicidad
most read most read this week most popular trending popular posts recent posts latest posts latest news top stories editor's picks
related related pages related posts related articles see also you may also like you might also like read next more from this site more on this topic recommended recommended for you further reading on this site
on this page in this article table of contents contents overview tags categories comments leave a comment leave a reply reply no comments
skip to content skip to main content skip to navigation skip to main navigation skip navigation jump to text jump to content jump to main content jump to navigation
back to top scroll up top to top go to top nach oben volver arriba next previous older posts newer posts next page previous page load more show more read more
accept accept all reject reject all accept cookies manage choices manage cookies cookie settings cookie policy got it ok understood ok, understood only necessary i agree agree decline close dismiss
imprint impressum privacy privacy policy data protection terms terms of use terms of service terms and conditions legal notice legal accessibility disclaimer copyright all rights reserved datenschutz aviso legal política de privacidad
join our mailing list enter your e-mail enter your email find us on the usual networks built with theme by powered by hosted at (current)
""".strip().splitlines()
_PHRASES = sorted({p for line in _LABELS for p in [line]}, key=len)
_WORDS_OF_MENUS = {w for line in _LABELS for w in line.split()}
_NOTICE = re.compile(
    r"(?i)(?:^(?:skip|jump) to (?:the )?(?:main |page )?(?:content|text|navigation|menu|search|footer|article|body|top)$)"
    r"|(?:\b(?:this|these|our|the) (?:web ?)?(?:site|sites|pages?|shop|portal)\b|\bwe\b|\bour partners\b|\bwir\b|\bseite\b|\bpartner\b|\butilizamos\b|\busamos\b|^\S+ (?:places|sets|uses|stores)\b).{0,60}\b(?:cookies?|local storage|small files on your (?:device|computer)|tracking (?:tools|pixels))\b"
    r"|^(?:by (?:staying|continuing|using|browsing)\b.{0,60}\b(?:agree|accept|consent)\b.*|(?:see|read) our (?:cookie|privacy)\b.*)$"
    r"|^(?:©|\(c\)|copyright\b)|\ball rights reserved\b|alle rechte vorbehalten|todos los derechos reservados"
    r"|^(?:share|share (?:this|on|via)|tags?|categories|category|filed under|posted in|topics?|schlagwörter|etiquetas)\s*:|^(?:theme by|built with|powered by|hosted (?:at|by|on)|design by|website by)\s+\S+"
    r"|^(?:page reviewed|last (?:updated|reviewed|modified|edited|changed)|edited|updated|reviewed|published|posted|zuletzt geändert|actualizado)\b\s*:?\s*(?:on\s+)?(?:\d{1,2}\.?\s+\w+\s+\d{4}|\d{4}-\d\d-\d\d|\w+\s+\d{1,2},?\s+\d{4})(?:\s+by\b.{0,40})?\.?$"
    r"|^\d+ comments?\b|^page \d+ of \d+|^(?:older|newer) posts\b|^[«‹<]?\s*(?:previous|zurück|anterior)\b\s.{0,20}\b(?:next|weiter|siguiente)\b\s*[»›>]?$"
    r"|\b\d{1,2}\s?% off\b|\border (?:today|now)\b[!.]?$|\bfree shipping\b|^(?:advertisement|anzeige|sponsored)\b\s*:?"
    r"|^\d+ [^\d.!?]{3,50}, [^\d.!?]{2,30} - tel\b|\b(?:tel|phone|fax)\.? ?:? ?[\d ]{5,}$|^enter your e-?mail\b|^(?:subscribe|sign up|join)\b.{0,40}\b(?:newsletter|mailing list|letter)\b|\bno spam\b"
    r"|^[↑▲⌃]|\bmay not be (?:used|copied|reproduced)\b.{0,40}\bwithout (?:leave|permission|consent)\b|^prices include tax\b|\bis a registered (?:body|charity|company|trademark|society)\b|^find us on\b|^follow us on\b"
)
_SEPARATOR = re.compile(r"\s*[|·»›]\s*|\s+[•/>–-]\s+|\t+| {2,}")
_BULLET = re.compile(r"^\s*(?:[-*+•·–]\s+|\d{1,3}[.)]\s+|>\s+)+")
_END = re.compile(r"[.!?…。！？;:][\"'”’»)\]]*$")
_HAN = re.compile("[㐀-鿿]")
_INNER_NAME = re.compile(r"(?<=\s)[A-ZÄÖÜ][\w'’-]+")


def key_of(line: str) -> str:
    """What repeats of a line have in common: no marker, case, digits, inner names or "(current)"."""
    s = _BULLET.sub("", line).strip().lower()
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", s.replace("(current)", ""))).strip(" # ")


_LABEL_SET: set[str] = set()


def _label(key: str) -> bool:
    if not _LABEL_SET:
        for line in _LABELS:
            words = line.split()
            # every run of up to four words within a line of the list is looked up as a label
            _LABEL_SET.update(" ".join(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1))
    return key in _LABEL_SET


def _plain(line: str) -> str:
    s = re.sub(r"\s+", " ", _BULLET.sub("", line).strip().lstrip("# ")).lower()
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def density(chars: int, tags: int, link_chars: float, link_tags: int, body_link_share: float) -> float:
    """Composite text density of a node: characters per tag, adjusted by the links among them."""
    if not chars:
        return 0.0
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + body_link_share * chars + math.e)
    return chars / tags * math.log(max(chars * tags / (max(link_chars, 1) * max(link_tags, 1)), 1)) / max(math.log(base), 0.25)


PROSE, TITLE, SHORT, LINKS = 0, 1, 2, 3


def _leaf(line: str, own: str | None, seen: dict) -> tuple[int, int, int]:
    """(kind, link characters, tags) of one line; ``seen`` remembers those of short lines."""
    s = _plain(line)
    if s == own:
        return TITLE, 0, 1
    known = seen.get(line)
    if known is None:
        parts = [p for p in _SEPARATOR.split(_BULLET.sub("", line).strip()) if p]
        tag = max(1, len(parts)) + bool(_BULLET.match(line))
        if _NOTICE.search(s) or (len(parts) >= 3 and sum(map(len, parts)) / len(parts) < 25) or (len(parts) == 2 and all(_label(p) for p in parts)):
            known = (LINKS, len(s), tag, None)
        elif _label(key_of(line)):
            known = (SHORT, len(s), tag, None)
        else:
            short = len(s) < 70 and not _END.search(s) and len(s.split()) <= 12 or len(s) <= 3
            if not s.isascii() and len(_HAN.findall(s)) >= 12:
                short = False
            known = (SHORT if short else PROSE, 0, tag, parts[-1].lower() if len(parts) >= 2 else None)
        if len(line) < 120:
            if len(seen) > 200_000:
                seen.clear()
            seen[line] = known
    kind, link, tag, end = known
    if own and end and (end == own or (own.startswith(end) and len(end) > 8)):
        return LINKS, len(s), tag  # a trail that ends with the title
    return kind, link, tag


def evidence_of(text: str, title: str | None, seen: dict | None = None) -> list[tuple[int, int, int, int, int, str]]:
    """(line_no, kind, chars, tags, link_chars, line) of the visible lines of one page's text.

    Every line is a leaf of the page's tree. Its tags are the line itself, its marker and its
    separators; its link characters those of labels, notices, trails and runs of short items.
    """
    rows = [(k, line) for k, line in enumerate(text.split("\n")) if line.strip()]
    own = _plain(title) if title else None
    seen = {} if seen is None else seen
    kinds, links, tags = [], [], []
    for _, line in rows:
        kind, link, tag = _leaf(line, own, seen)
        kinds.append(kind)
        links.append(link)
        tags.append(tag)
    chars = [len(line.strip()) for _, line in rows]
    n, i = len(rows), 0
    while i < n:  # runs of short items: a list of links (blank lines don't part it)
        j = i
        while j < n and kinds[j] == SHORT:
            j += 1
        many = j - i >= 4 or (j - i >= 2 and sum(links[k] > 0 for k in range(i, j)) * 2 >= j - i)
        headed = i if many else next((k for k in range(i, j) if links[k]), j)
        for k in range(headed, j):  # what follows a label such as "Most read" is its list
            links[k] = chars[k]
        i = max(j, i + 1)
    return [(no, kind, c, t, x, line) for (no, line), kind, c, t, x in zip(rows, kinds, chars, tags, links)]


#: A node below this density is no content, whatever the page's other nodes are.
LEAST_DENSITY = 100.0


def tree_of(kinds: list[int], chars: list[int], links: list[float]) -> list[tuple[int, int]]:
    """The nodes between the body and its lines, as ranges of lines.

    Lines made of links and other lines part from each other. Of the latter a node takes what stands
    from its first to its last line of prose, with up to two short lines before as headings (none
    before the page's own title); other short lines are nodes of their own.
    """
    out: list[tuple[int, int]] = []
    i, n = 0, len(kinds)
    while i < n:
        link = 2 * links[i] >= chars[i]
        j = i
        while j < n and (2 * links[j] >= chars[j]) == link:
            j += 1
        prose = [] if link else [k for k in range(i, j) if kinds[k] != SHORT]
        if prose:
            first, last = prose[0] if kinds[prose[0]] == TITLE else max(i, prose[0] - 2), prose[-1] + 1
            out += [(a, b) for a, b in ((i, first), (first, last), (last, j)) if a < b]
        else:
            out.append((i, j))
        i = j
    return out


def outside_of(kinds: list[int], chars: list[int], tags: list[int], links: list[float]) -> list[bool]:
    """Per line, whether it lies outside of the page's content, by composite text density.

    Densities of leaves add up to the density sum of their node; the threshold is the least density on
    the path from the node with the greatest sum to the body, at least LEAST_DENSITY, and the nodes
    that reach it are the content, with all their lines.
    """
    if not kinds:
        return []
    link_tags = [0 if not x else t if 2 * x >= c else 1 for c, t, x in zip(chars, tags, links)]
    share = sum(links) / sum(chars)
    nodes = []
    for a, b in tree_of(kinds, chars, links):
        own = density(sum(chars[a:b]), sum(tags[a:b]), sum(links[a:b]), sum(link_tags[a:b]), share)
        nodes.append((sum(density(chars[k], tags[k], links[k], link_tags[k], share) for k in range(a, b)), own, a, b))
    body = density(sum(chars), sum(tags), sum(links), sum(link_tags), share)
    threshold = max(min(max(nodes)[1], body), LEAST_DENSITY)
    out = [True] * len(kinds)
    for _, own, a, b in nodes:
        if own >= threshold:
            out[a:b] = [False] * (b - a)
    return out


def lines_of(text: str, title: str | None, seen: dict | None = None) -> list[tuple[int, int, bool, str]]:
    """(line_no, kind, outside, line) of the visible lines of one page's text, judged by itself."""
    rows = evidence_of(text, title, seen)
    no, kinds, chars, tags, links, lines = (list(c) for c in zip(*rows)) if rows else ([],) * 6
    return list(zip(no, kinds, outside_of(kinds, chars, tags, links), lines))


def with_votes(kind: int, chars: int, links: float, vote: float | None) -> tuple[int, float]:
    """(kind, link_chars) once ``vote``, the share of a line's repeats that lie outside of the content, is known."""
    if kind == TITLE:
        return kind, 0
    if kind == LINKS or vote is None:
        return kind, links
    if vote > 0.5:
        return kind, vote * chars
    return PROSE, 0.2 * vote * chars  # a short line that mostly stands inside is a heading


def _features(batches):
    """Per page the evidence of its visible lines, their first verdicts, and the hashes of what repeats of them share."""
    seen: dict = {}
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("line_no", "kind", "chars", "tags", "links", "outside", "key")}
        for text, title in zip(batch.column("text").to_pylist(), batch.column("title").to_pylist()):
            rows = evidence_of(text, title, seen)
            no, kinds, chars, tags, links, lines = (list(c) for c in zip(*rows)) if rows else ([],) * 6
            for c, values in zip(out, (no, kinds, chars, tags, links, outside_of(kinds, chars, tags, links), [_hash(key_of(x)) for x in lines])):
                out[c].append(values)
        kinds_of = {"outside": pa.bool_(), "key": pa.int64()}
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("site"), *(pa.array(v, pa.list_(kinds_of.get(c, pa.int32()))) for c, v in out.items())], names=["id", "site", *out])


def _verdicts(batches):
    """The final verdict on every line of a page, with the votes (place in the page, share outside) on those that repeat."""
    for batch in batches:
        take, numbers, out = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("line_no", "kind", "chars", "tags", "links", "votes"))
        for k, (no, kinds, chars, tags, links, votes) in enumerate(zip(*columns)):
            votes = {v["at"]: v["vote"] for v in votes or ()}
            changed = [with_votes(kind, c, x, votes.get(i)) for i, (kind, c, x) in enumerate(zip(kinds, chars, links))]
            verdict = outside_of([c[0] for c in changed], chars, tags, [c[1] for c in changed])
            take += [k] * len(no)
            numbers += no
            out += [o and kind != TITLE for o, kind in zip(verdict, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(take, pa.int64())), pa.array(numbers, pa.int64()), pa.array(out, pa.bool_())], names=["chunk_id", "line_no", "boilerplate"])


def page_lines(chunks: DataFrame, sources: DataFrame, prior: float = 3.0, types: tuple[str, ...] = ("url", "sitemap"), hot_share: int = 1000) -> DataFrame:
    """(chunk_id, line_no, boilerplate) for every visible line of every chunk of a web page.

    ``sources`` says by ``type`` what a web page is, by ``uri`` which site it is of and by
    ``source_name`` its title (the chunk's metadata['source_name'] where that is null). Lines are
    parted by line feeds and numbered from 0; lines without visible characters give no row. Chunks
    with null id or text, or whose source isn't a web page, give none either; a repeated chunk_id
    counts once; other columns are ignored; empty tables give an empty result.

    Each chunk is judged by composite text density (see outside_of). Then the verdicts on the same
    line, names and numbers aside, are counted over its site and over all sites, the own verdict
    counting as ``prior`` of them; the share of a line's repeats that lie outside corrects its link
    characters, prose that stands on at least 20 pages and three quarters of its site counts as the
    site's template, and the density of the tree with these decides.

    Sources and lines that hold more than 1 / ``hot_share`` of the rows are joined by broadcast, at
    most ``hot_share`` of them, so neither a site nor a menu line makes a hot task; texts are read
    once and only numbers of their lines are shuffled after that.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    web = (
        sources.where(F.lower("type").isin(*types) & F.col("source_id").isNotNull())
        .groupBy("source_id")
        .agg(F.max("uri").alias("uri"), F.max("source_name").alias("name"))
        .select("source_id", F.xxhash64(F.regexp_replace(F.lower(F.regexp_extract("uri", r"(?i)^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")).alias("site"), "name")
    )
    texts = chunks.where(F.col("chunk_id").isNotNull() & F.col("source_id").isNotNull() & (F.length(F.trim("text")) > 0)).select("chunk_id", "source_id", "text", F.col("metadata")["source_name"].alias("own"))
    joined = split_join(texts, web, "source_id", hot_rows=max(2_000, chunks.count() // hot_share))
    pages = joined.select(F.col("chunk_id").alias("id"), "site", "text", F.coalesce("name", "own").alias("title"))
    shape = "line_no array<int>, kind array<int>, chars array<int>, tags array<int>, links array<int>, outside array<boolean>, key array<bigint>"
    read = pages.mapInArrow(_features, f"id {kind}, site bigint, {shape}")
    one = read.groupBy("id").agg(F.max(F.struct(*[c for c in read.columns if c != "id"])).alias("r")).select("id", "r.*", F.monotonically_increasing_id().alias("page"))
    one = durable(one, "page-lines")  # once written, the pages' numbers stay
    lines = one.select("page", "site", F.posexplode(F.arrays_zip("key", "outside", "kind")).alias("at", "x")).select("page", "site", "at", F.col("x.key").alias("key"), F.col("x.outside").cast("int").alias("o"), F.col("x.kind").alias("kind"))
    by_site = durable(lines.groupBy("site", "key").agg(F.count("*").alias("n"), F.sum("o").alias("n_out")), "page-counts")
    by_key = by_site.groupBy("key").agg(F.sum("n").alias("all"), F.sum("n_out").alias("all_out"), F.count("*").alias("sites")).where("all > 2")
    known = durable(split_join(by_site, durable(by_key, "page-keys"), "key", weight="sites"), "page-known")
    known = durable(split_join(known, web.groupBy("site").agg(F.count("*").alias("n_sources")), "site"), "page-known")
    total = by_site.agg(F.sum("n")).first()[0] or 0
    repeated = split_join(lines, known.withColumn("rows", F.col("n")), ["site", "key"], hot_rows=max(20_000, total // hot_share), weight="rows")
    everywhere = (F.col("all_out") + prior * F.col("o")) / (F.col("all") + prior)
    template = (F.col("kind") == PROSE) & (F.col("n") >= F.greatest(F.lit(20), 0.75 * F.col("n_sources")))
    vote = F.when(template, 1.0).otherwise((F.col("n_out") + 4 * everywhere) / (F.col("n") + 4)).cast("float")
    votes = repeated.groupBy("page").agg(F.collect_list(F.struct("at", vote.alias("vote"))).alias("votes"))  # lines of one page
    return one.join(votes, "page", "left").select("id", "line_no", "kind", "chars", "tags", "links", "votes").mapInArrow(_verdicts, f"chunk_id {kind}, line_no bigint, boilerplate boolean")


def main_content(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(chunk_id, text): the article's own lines of every chunk of a web page, in order; null where none is left."""
    kept = page_lines(chunks, sources).where("not boilerplate").groupBy("chunk_id").agg(F.sort_array(F.collect_list("line_no")).alias("kept"))
    texts = chunks.where(F.col("chunk_id").isNotNull() & F.col("text").isNotNull()).select("chunk_id", "text").dropDuplicates(["chunk_id"])
    lines = F.split("text", "\n", -1)
    return texts.join(kept, "chunk_id").select("chunk_id", F.array_join(F.transform("kept", lambda k: F.get(lines, k.cast("int"))), "\n").alias("text"))
