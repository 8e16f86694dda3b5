"""Text, identity and URL expressions. All lengths and offsets count code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no expression for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize_text(text: Column) -> Column:
    """Line feeds for CRLF, four spaces for a tab, NFC. Every text passes through one Python function, which hands ASCII back as it is."""
    return nfc(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\t"), F.lit("    ")))


def document_id(normalized: Column) -> Column:
    return F.sha2(normalized, 256)


def chunk_id(doc_id: Column, start: Column, end: Column) -> Column:
    """Identity of a chunk from its document and its byte range."""
    return F.sha2(F.concat_ws("|", doc_id, start.cast("string"), end.cast("string")), 256)


def short_hash(text: Column, length: int = 16) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def source_id(kind: Column, uri: Column) -> Column:
    return short_hash(F.concat_ws(":", kind, uri))


def project_chunk_id(source: Column, index: Column) -> Column:
    return short_hash(F.concat_ws(":", source, index.cast("string")), 32)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def host(uri: Column) -> Column:
    """Host name in lower case without www; null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(uri, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def extension(uri: Column) -> Column:
    """Extension of the last path part, lower case, without query and fragment; empty where there is none."""
    path = F.regexp_replace(F.lower(uri), r"[?#].*$", "")
    return F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)


# Media types and the extensions of their files.
MEDIA_TYPES = {"text/html": "html", "application/pdf": "pdf", "text/plain": "txt", "text/markdown": "md", "application/json": "json", "text/csv": "csv", "application/xml": "xml", "text/xml": "xml", "application/octet-stream": "bin"}


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def extension_of_type(content_type: Column) -> Column:
    """Extension for a content type, parameters ignored; 'bin' for unknown ones."""
    plain = F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return F.coalesce(F.element_at(_literal_map(MEDIA_TYPES), plain), F.lit("bin"))


def type_of_extension(ext: Column) -> Column:
    back = {"htm": "text/html", "markdown": "text/markdown", "jsonl": "application/json", "text": "text/plain"} | {v: k for k, v in MEDIA_TYPES.items()} | {"xml": "application/xml"}
    return F.coalesce(F.element_at(_literal_map(back), F.lower(ext)), F.lit("application/octet-stream"))


def safe_id(name: Column) -> Column:
    """Whether a project's id has 1 to 64 lower-case letters, digits and inner hyphens."""
    return F.coalesce((F.length(name) <= 64) & name.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"), F.lit(False))


def safe_tag(tag: Column) -> Column:
    """Whether a tag has 1 to 64 letters, digits, hyphens and underscores."""
    return F.coalesce(tag.rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def safe_path(path: Column) -> Column:
    """Whether a path has 1 to 4,096 characters, no steps upwards, no null character and none of the system's folders."""
    system = r"(?i)/etc/|/proc/|/sys/|C:\\Windows\\|C:\\System"
    return F.coalesce(F.length(path).between(1, 4096) & ~F.contains(path, F.lit("..")) & ~F.contains(path, F.lit("./")) & ~F.contains(path, F.lit("\x00")) & ~path.rlike(system), F.lit(False))


def random_id() -> Column:
    """A random UUID; not the same when a row is computed again, so write it before it is used twice."""
    return F.expr("uuid()")


def safe_url(uri: Column) -> Column:
    """Whether a URL is http(s) with a host that isn't this machine or a private network."""
    private = r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.0\.0\.0|\[?::1)"
    return F.coalesce(uri.rlike(r"(?i)^https?://") & host(uri).isNotNull() & ~host(uri).rlike(private), F.lit(False))
