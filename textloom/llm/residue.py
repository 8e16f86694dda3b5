"""Problem 4: template residue, filler, error and script notices, by character n-gram likelihood ratios."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.functions.shingles import mix
from textloom.runtime import durable, extended, release

ORDER = 5
BUCKETS = 1 << 19

# The labelled sample the filler and notice models are fitted to (bounded: these lists only).
_TOPICS = ["this page", "this document", "this application", "this site", "the map", "the viewer", "the page", "our portal", "the form", "the content"]
_SCRIPTS = ["JavaScript", "Javascript", "JS", "scripts", "scripting", "client-side scripts"]
_SCRIPT_NOTICES = [
    "{S} is disabled in your browser.", "{S} is required to view {T}.", "{S} seems to be off in your browser!", "{S} is blocked in your browser, so {T} stays empty.",
    "{S} could not be loaded in your browser.", "Please enable {S} to use {T}.", "You need to enable {S} to run {T}.", "You have to switch on {S} to use {T}.",
    "Kindly allow {S} to read {T}.", "To go on, turn on {S} to read {T}.", "To continue, activate {S} and reload {T}.", "{T} requires {S}.", "{T} needs {S}. Check the browser options.",
    "{T} depends on {S}. Ask your administrator.", "{T} works only with {S} enabled. Reload after changing the setting.", "{T} does not work without {S}.", "{T} cannot start without {S}.",
    "Note: {T} will not load unless you permit {S}.", "Sorry: {T} stays blank unless you permit {S}.", "Attention: {T} cannot be displayed without {S}.",
    "A modern browser with {S} is required for {T}.", "An up-to-date browser with {S} must be used for {T}.", "Your browser does not support {S}. Please update your browser.",
    "Your browser is too old or scripts are blocked. Nothing can be shown.", "noscript: {T} not available", "noscript: {T} off", "noscript: {T} unsupported", "We are sorry but {T} doesn't work properly without {S} enabled. Please enable it to continue.",
]
_NOTICES = [
    "Bitte aktivieren Sie JavaScript, um fortzufahren.", "Ohne Skripte kann diese Anwendung nicht starten.", "JavaScript ist in Ihrem Browser deaktiviert.", "Diese Seite benötigt JavaScript.", "Die Seite wurde leider nicht gefunden. Zurück zur Übersicht.", "Seite nicht gefunden.", "Zugriff verweigert.", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut.", "Wird geladen...", "Bitte warten...",
    "Para ver esta página hay que activar JavaScript.", "Este visor necesita scripts; su navegador los tiene apagados.", "Active JavaScript en su navegador para continuar.", "La página solicitada no existe o fue retirada.", "Página no encontrada.", "Acceso denegado.", "Se ha producido un error. Inténtelo de nuevo más tarde.", "Cargando...", "Espere por favor...", "Veuillez activer JavaScript pour continuer.", "Page introuvable.", "Accès refusé.",
    "页面不存在。", "请启用 JavaScript 以继续浏览。", "访问被拒绝。", "加载中...", "服务器错误，请稍后再试。",
    "Loading...", "Loading…", "Loading", "Please wait", "Please wait...", "Please wait while the page is loading.", "Fetching data...", "One moment please...", "Still loading the content.", "Redirecting...",
    "404 Not Found", "404 - Page not found", "Page not found", "Not Found", "The page you are looking for could not be found.", "The requested URL was not found on this server.", "The address you asked for does not exist on this host.", "404 - Nothing here", "Go back to the start page.", "Try the search box.", "Oops! We lost that page. Our crew has been told.", "Oops! This link is broken.", "Sorry, this page does not exist or has been removed.", "Return to the home page.",
    "403 Forbidden", "403 - Forbidden", "401 Unauthorized", "Access denied. You do not have leave to view this item.", "Access denied. You do not have permission to access this page.", "You must be logged in to view this content.", "Your session has run out. Sign in again to carry on. (id 4711)", "Your session has expired. Please log in again.",
    "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "503 - Service paused", "Error 500: the server could not finish your request. Reference 7fa0c1", "Error 503: the server could not answer your request. Please try later.", "Error 400: the server could not read your request.", "Something went wrong on our side.", "Something went wrong. Please try again later.", "An unexpected error occurred.", "Database error 1045: could not connect to store 'main'.", "Error establishing a database connection", "Service temporarily unavailable.", "The connection has timed out.", "Traceback: TimeoutError at line 40 in store.handler", "  caused by: connection reset", "Exception in thread main: NullPointerException", "Fatal error: Uncaught exception", "Warning: undefined variable on line 12",
    "Too many requests from your network. Wait 30 seconds.", "Rate limit exceeded. Please slow down.", "Checking that you are not a robot. This takes a few seconds.", "Checking your browser before accessing the site.", "Please complete the captcha to continue.", "Verify that you are human.", "Ray 7a0f3bdd0c",
    "Site under maintenance until March 2024 We are sorry for the trouble.", "We are down for maintenance. Please check back soon.", "This site is under construction.",
]
_FILLER = [
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum tortor quam, feugiat vitae, ultricies eget, tempor sit amet, ante. Donec eu libero sit amet quam egestas semper. Aenean ultricies mi vitae est. Mauris placerat eleifend leo. Quisque sit amet est et sapien ullamcorper pharetra. Vestibulum erat wisi, condimentum sed, commodo vitae, ornare sit amet, wisi. Aenean fermentum, elit eget tincidunt condimentum, eros ipsum rutrum orci, sagittis tempus lacus enim ac dui. Donec non enim in turpis pulvinar facilisis. Nullam neque nulla, porta vulputate, dapibus integer lacinia, etiam classis aptent taciti sociosqu ad litora torquent per conubia nostra, fusce augue velit sodales sagittis, tellus vulputate venenatis.",
    "Sample text.", "Sample text goes here.", "Dummy copy.", "Dummy text.", "Body text here.", "Example paragraph.", "Content goes here.", "Your text here.", "Add your story here. Click to edit this block.", "Placeholder text.", "This is a placeholder paragraph.", "This paragraph only fills the layout and will be replaced before launch.", "Coming soon", "More to come.", "TBD", "To be announced.", "Headline", "Subheadline", "Text text text text text text", "Title of the section", "Short teaser for the section, two lines at most.", "Intro copy to follow (approx. 80 words).", "Insert description here.", "Description goes here.", "test test test test", "xxx xxx xxx xxx xxx xxx", "foo bar foo bar foo bar", "foo bar baz qux", "blah blah blah blah", "asdf asdf asdf qwer qwer", "bla bla bla", "Hello world!", "Edit this text.",
]

# How templates write a value still to be filled in.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\$\{[^{}\n]{1,60}\}|(?<![\w{}$\\])\{(?:\d{1,2}|[A-Za-z_][\w.]{0,30})\}(?!\})|<%[^%\n]{1,60}%>|\{%[^%\n]{1,60}%\}|\[\[[^\[\]\n]{1,60}\]\]"
    r"|\[(?:[Yy]our|YOUR|[Ii]nsert|INSERT|[Ee]nter|ENTER|[Aa]dd|ADD)\s[^\[\]\n]{1,40}\]|<(?:insert|INSERT|your|YOUR|enter|ENTER)\s[^<>\n]{1,40}>|(?<![\w%])%[A-Z][A-Z_]*%(?![\w%])|(?<!\w)__[A-Z][A-Z_]*?__(?!\w)"
    r"|@@\w+@@|##[A-Z_]+##|\*\|[^|\n]{1,40}\|\*|«[A-Z][A-Za-z]*(?:_[A-Za-z]+)*»|\[object \w+\]"
)
_QUOTED = re.compile(r"`[^`\n]*`|(?<!\w)'[^'\n]{1,80}'(?!\w)|\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|(?ms:^[ \t]*(?:```|~~~).*?^[ \t]*(?:```|~~~))|<code>.*?</code>")
_PART = re.compile(r"(?<=[.!?…])(?=\s)|(?<=[。！？])|\n")
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile("[\u3400-\u9fff]")


def _flat(parts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, part numbers) of the character n-grams of several stretches at once.

    Lower case, digits as one, blanks as one; from a Han character on, bigrams. No n-gram spans two parts.
    """
    t = re.sub(r"[^\S\x00]+", " ", re.sub(r"\d+", "0", " \x00 ".join(parts).lower()))
    c = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - order + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(order):
        h = h * np.uint64(0x100000001B3) + c[k : k + n]
    han = (c[:n] >= 0x3400) & (c[:n] <= 0x9FFF)
    if han.any():
        h[han] = (c[:n] * np.uint64(0x1F123BB5) + c[1 : n + 1])[han]
    ends = np.cumsum(c == 0)
    inside = ends[order - 1 :] == np.concatenate(([0], ends[: n - 1]))
    return (mix(h[inside]) % np.uint64(BUCKETS)).astype(np.int64), ends[:n][inside]


def grams(text: str) -> np.ndarray:
    return _flat([text.replace("\x00", " ")])[0]


def _counts(texts) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for t in texts:
        np.add.at(out, grams(t), 1)
    return out


def seed_counts() -> dict[str, np.ndarray]:
    """n-gram counts of the filler and notice samples; keys struck at random stand for themselves."""
    scripts = [x.format(S=s, T=t) for x in _SCRIPT_NOTICES for k, s in enumerate(_SCRIPTS) for t in (_TOPICS[k::3])]
    scripts = [s[0].upper() + s[1:] for s in dict.fromkeys(scripts)]
    rng = np.random.default_rng(3)
    keys = np.array(list("qwertyuiopasdfjkl"))
    mash = [" ".join("".join(rng.choice(keys, rng.integers(3, 9))) for _ in range(12)) for _ in range(1500)]
    return {"notice": _counts(scripts) + 20 * _counts(_NOTICES), "filler": 20 * _counts(_FILLER), "mash": _counts(mash)}


def ratio(counts: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """Log likelihood ratio per n-gram against prose, bounded so that one n-gram decides nothing."""
    p = (counts + 0.05) / (counts.sum() + 0.05 * len(counts))
    q = (prose + 0.05) / (prose.sum() + 0.05 * len(counts))
    r = np.clip(np.log(p / q), -4, 4)
    unseen = counts == 0  # the smaller sample must not win where neither has seen anything
    return np.where(unseen, np.where(prose > 0, np.minimum(r, -0.5), 0), r).astype(np.float32)


def segments(text: str) -> list[str]:
    text = text if text.isascii() else unicodedata.normalize("NFC", text)
    return [s for s in map(str.strip, _PART.split(text)) if s]


def _han(s: str) -> int:
    return 0 if s.isascii() else len(_HAN.findall(s))


def _weight(s: str) -> int:
    """Length of a stretch; a Han character says about as much as three letters."""
    return len(s) + 2 * _han(s)


def _sentence(s: str) -> bool:
    """Whether a stretch reads as a sentence of content rather than a title, menu or imprint line."""
    return _han(s) >= 6 or (len(s) >= 25 and s[-1] in ".!?…:;\"'”»)" and s.count(" ") >= 4 and "|" not in s)


#: Window lengths and the mean log likelihood ratio that a window must exceed.
WINDOWS = ((16, 0.35), (48, 0.1))


def covered_shares(parts: list[str], tables: list[np.ndarray]) -> np.ndarray:
    """Per part, the share of its n-grams in windows whose likelihood ratio favours one of the residue models."""
    g, part = _flat([p.replace("\x00", " ") for p in parts])
    n = len(g)
    size = np.bincount(part, minlength=len(parts))
    if not n:
        return np.zeros(len(parts))
    mask = np.zeros(n, bool)
    for t in tables:
        total = np.concatenate(([0.0], np.cumsum(t[g], dtype=np.float64)))
        for window, least in WINDOWS:
            if n >= window:
                hot = np.flatnonzero((total[window:] - total[:-window] > least * window) & (part[window - 1 :] == part[: n - window + 1]))
                if len(hot):
                    edge = np.zeros(n + 1, np.int64)
                    edge[hot] += 1  # every start comes once
                    edge[hot + window] -= 1
                    mask |= np.cumsum(edge[:-1]) > 0
        window, least = WINDOWS[0]
        short = (size > 0) & (size < window)  # one window over the whole part
        if short.any():
            mean = np.bincount(part, weights=t[g], minlength=len(parts)) / np.maximum(size, 1)
            mask |= (short & (mean > least))[part]
    return np.bincount(part, weights=mask, minlength=len(parts)) / np.maximum(size, 1)


_AT_ONCE = 300_000  # characters that are scored in one go


def judge_many(texts: list[str | None], tables: list[np.ndarray], share: float = 0.5) -> list[tuple[str, float]]:
    """(kind, coverage) of every text; kind is '', 'placeholder' or 'residue'.

    Texts with a window that looks like a slot by the slot model are searched for the notations of
    PLACEHOLDER exactly; without that model (plain tables) all are.
    """
    out = [("", 0.0)] * len(texts)
    waiting: list[tuple[int, list[str]]] = []
    held = 0

    def settle() -> None:
        covered = iter(covered_shares([s for _, parts in waiting for s in parts], tables).tolist())
        for k, parts in waiting:
            residue = prose = 0
            for s, c in zip(parts, covered):
                if c >= 0.7:
                    residue += _weight(s)
                    continue
                if s.count(" ") >= 5:
                    words = _WORD.findall(s.lower())
                    if len(words) >= 6 and len(set(words)) <= max(2, len(words) // 6):  # hardly any different words
                        residue += _weight(s)
                        continue
                if _sentence(s):
                    prose += _weight(s)
            if residue:
                coverage = residue / (residue + prose)
                out[k] = ("residue" if coverage >= share else "", coverage)
        waiting.clear()

    slots_of = getattr(tables, "slots", None)
    suspects = set(range(len(texts))) if slots_of is None else with_slots([t or "" for t in texts], slots_of)
    for k, text in enumerate(texts):
        if not text or not text.strip():
            continue
        slots = list(PLACEHOLDER.finditer(text)) if k in suspects else []
        quoted = [m.span() for m in _QUOTED.finditer(text)] if slots else []
        if any(not any(a <= m.start() < b for a, b in quoted) for m in slots):
            out[k] = ("placeholder", 1.0)
            continue
        waiting.append((k, segments(text)))
        held += len(text)
        if held > _AT_ONCE:
            settle()
            held = 0
    if waiting:
        settle()
    return out


def judge(text: str, tables: list[np.ndarray]) -> tuple[str, float]:
    return judge_many([text], tables)[0]


_RUNS = [(re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"[A-Z]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"[^\S\x00]+"), " ")]
#: n-gram length, buckets, n-grams a window and the log likelihood ratio it must exceed.
SHAPE_ORDER, SHAPE_BUCKETS, SHAPE_WINDOW, SHAPE_LEAST = 3, 1 << 16, 3, -2.0


def _shapes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, text numbers) of the n-grams of the texts' shapes: runs of letters, digits and blanks as one sign each, other signs as they are."""
    t = " \x00 ".join(x.replace("\x00", " ") for x in texts)
    for run, sign in _RUNS:
        t = run.sub(sign, t)
    c = np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - SHAPE_ORDER + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHAPE_ORDER):
        h = h * np.uint64(0x100000001B3) + c[k : k + n]
    return (mix(h) % np.uint64(SHAPE_BUCKETS)).astype(np.int64), np.cumsum(c == 0)[:n]


# The sample of slots still to be filled in, {N} a name in several spellings.
_SLOTS = [
    "{{{N}}}", "{{ {N} }}", "${{N}}", "{{N}}", "{0}", "<%{N}%>", "<%= {N} %>", "{% {N} %}", "[[{N}]]", "[Your {N}]", "[your {N}]", "[YOUR {N}]", "[Insert {N}]", "[insert {N} here]", "[Enter {N}]", "[Add {N}]", "[ADD {N}]",
    "<insert {N}>", "<your {N}>", "<YOUR {N}>", "<enter {N} here>", "%{U}%", "__{U}__", "@@{N}@@", "##{U}##", "*|{U}|*", "«{T}»", "«{T}_{T}»", "[object Object]",
]


def slot_counts() -> np.ndarray:
    """n-gram counts of the shapes of slots."""
    names = [("name", "NAME", "Name"), ("user.name", "USER_NAME", "User"), ("order_id", "ORDER_ID", "Order"), ("date", "DATE", "Date"), ("item 2", "ITEM", "Item")]
    out = np.zeros(SHAPE_BUCKETS)
    for slot in _SLOTS:
        for n, u, t in names:
            filled = slot.replace("{N}", n).replace("{U}", u).replace("{T}", t)
            np.add.at(out, _shapes([filled])[0], 1)
    return out


def with_slots(texts: list[str], table: np.ndarray) -> set[int]:
    """Numbers of the texts in which a window of a few n-grams looks more like a slot than like prose."""
    g, at = _shapes(texts)
    total = np.concatenate(([0.0], np.cumsum(table[g], dtype=np.float64)))
    if len(g) < SHAPE_WINDOW:
        return set(range(len(texts)))
    last = at[np.minimum(np.arange(len(at)) + SHAPE_ORDER + SHAPE_WINDOW - 2, len(at) - 1)]
    hot = (total[SHAPE_WINDOW:] - total[:-SHAPE_WINDOW] > SHAPE_LEAST) & (at == last)[: len(g) - SHAPE_WINDOW + 1]
    return set(np.unique(at[: len(hot)][hot]).tolist())


def _prose(text: str) -> list[str]:
    """The sentences of a text that prose is learnt from, with their digits as 0."""
    return [re.sub(r"\d+", "0", s) for s in segments(text) if _weight(s) >= 40 and _sentence(s)]


def _stretches(tables: "Models | None"):
    """(kind, key, s): the sentences of all texts ('prose'); with ``tables``, those of the texts they judge residue ('out') and all stretches of what is residue nearly throughout ('found')."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = []
            if tables is None:
                out = [("prose", s) for t in texts for s in _prose(t)]
            else:
                for text, (kind, covered) in zip(texts, judge_many(texts, tables)):
                    if kind:
                        out += [("out", s) for s in _prose(text)]
                    if kind == "residue" and covered >= 0.8:
                        out += [("found", s) for s in segments(text)]
            keys = [int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for _, s in out]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array(keys, pa.int64()), pa.array([s for _, s in out], pa.string())], names=["kind", "key", "s"])

    return run


def _tally(batches):
    """(model, bucket, n): the n-gram counts of stretches (kind, s), and of the shapes of prose, summed over a task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for kind in set(batch.column(0).to_pylist()):
            parts = [s.replace("\x00", " ") for s in batch.column(1).filter(pa.array([k == kind for k in batch.column(0).to_pylist()])).to_pylist()]
            counts[kind] = counts.get(kind, 0) + np.bincount(_flat(parts)[0], minlength=BUCKETS)
            if kind != "found":
                counts[f"{kind}-shape"] = counts.get(f"{kind}-shape", 0) + np.bincount(_shapes(parts)[0], minlength=SHAPE_BUCKETS)
    for model, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([model] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["model", "bucket", "n"])


def _counted(stretches: DataFrame) -> dict[str, np.ndarray]:
    """The counts of _tally over all tasks, one number per model and bucket."""
    rows = stretches.select("kind", "s").mapInArrow(_tally, "model string, bucket int, n bigint").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return {m: np.bincount(g["bucket"], weights=g["n"], minlength=SHAPE_BUCKETS if m.endswith("shape") else BUCKETS) for m, g in rows.groupby("model")}


class Models(list):
    """The likelihood-ratio tables of filler, notices and random keys, with that of slots in ``slots``."""

    slots: np.ndarray | None = None


def fit(df: DataFrame, text_col: str = "text", passes: int = 2, fit_rows: int | None = None) -> Models:
    """Likelihood-ratio tables of the filler, notice, key-mashing and slot models against prose.

    The residue models start from the fixed, labelled sample of this module. Prose is learnt from all
    texts of the data; a sentence, its digits aside, counts once over all of them, so the tables don't
    depend on how the data are spread. From the second pass on, sentences that occur only in texts
    that the models so far judge to be residue are taken off the prose again, and stretches of texts
    that are residue nearly throughout join the notices: so wordings that the fixed sample lacks are
    learnt from their like. What reaches the driver is one number per bucket and model. Only a caller
    who gives ``fit_rows`` has the models fitted on so many texts, those with the least hashes.
    """
    seeds = seed_counts()
    texts = df.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"))
    if fit_rows is not None:
        texts = texts.orderBy(F.xxhash64("text"), "text").limit(fit_rows)
    schema = "kind string, key bigint, s string"
    sentences = durable(texts.mapInArrow(_stretches(None), schema).groupBy("kind", "key").agg(F.first("s").alias("s"), F.count("*").alias("n")), "residue-sentences")
    whole = _counted(sentences)
    models, less = None, {}
    for k in range(passes):
        if k:
            judged_out = durable(texts.mapInArrow(_stretches(models), schema).groupBy("kind", "key").agg(F.first("s").alias("s"), F.count("*").alias("n")), "residue-out")
            only = judged_out.where("kind = 'out'").join(sentences.select("key", F.col("n").alias("all")), "key").where(F.col("n") == F.col("all")).select("kind", "s")
            less = _counted(only.unionByName(judged_out.where("kind = 'found'").select("kind", "s")))
            release(judged_out)
        prose = whole.get("prose", np.zeros(BUCKETS)) - less.get("out", 0)
        models = Models(ratio(c + (less.get("found", 0) if name == "notice" else 0), prose) for name, c in seeds.items())
        models.slots = ratio(slot_counts(), whole.get("prose-shape", np.zeros(SHAPE_BUCKETS)) - less.get("out-shape", 0))
    release(sentences)
    return models


def judged(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with ``residue_kind`` ('', 'placeholder', 'residue') and ``residue_coverage``.

    Null, empty and blank texts get '' and 0. Columns of those names are replaced. ``extractor_used``,
    ``content_type`` and ``http_status`` play no part.

    A placeholder outside quotes and code makes 'placeholder'; windows of the text's shape that favour
    the slot model say where to look for one. Else every sentence or line is scored in
    windows of characters against models of filler, of notices and of random keys; stretches covered
    by windows that favour these are residue, other sentences are prose, and titles, menus and
    imprints count as neither. Residue that makes up at least half is 'residue'. The models are fitted
    on all texts (see fit); every text is scored, in one pass.
    """
    tables = fit(df, text_col)

    def run(batches):
        for batch in batches:
            out = judge_many(batch.column("__text").to_pylist(), tables)
            cols = {n: batch.column(n) for n in batch.schema.names if n != "__text"}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([k for k, _ in out], pa.string()), pa.array([c for _, c in out], pa.float64())], names=[*cols, "residue_kind", "residue_coverage"])

    rest = df.drop("residue_kind", "residue_coverage")
    schema = extended(rest, "residue_kind string, residue_coverage double")
    return rest.withColumn("__text", F.col(text_col)).mapInArrow(run, schema)


def found(df: DataFrame, id_col: str = "extract_id", text_col: str = "text") -> DataFrame:
    """(id): ids of records that are residue; a repeated id comes once, null ids are left out."""
    return judged(df.select(id_col, text_col).where(F.col(id_col).isNotNull()), text_col).where("residue_kind != ''").select(id_col).distinct()


def real_content(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with real content: texts that aren't null, empty, blank or residue; columns as they were."""
    kept = judged(df, text_col=text_col).where((F.col("residue_kind") == "") & (F.length(F.trim(F.col(text_col))) > 0))
    return kept.select(*df.columns)
