"""Paths, content hashes and human-readable figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborsim import schema


def extension(path: Column) -> Column:
    """From the last dot of the whole path on, lower-cased; empty without a dot (dots in folders count)."""
    return F.lower(F.regexp_extract(path, r"(?s)(\.[^.]*)\z", 1))


def is_text_path(path: Column) -> Column:
    ext = extension(path)
    return (ext == "") | ext.isin(*schema.TEXT_EXTENSIONS)


def blob_sha(content: Column) -> Column:
    """The content hash that git gives a blob of these bytes."""
    data = content.cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(data).cast("string"), F.char(F.lit(0)))
    return F.sha1(F.concat(head.cast("binary"), data))


def within_size(content: Column, most: int = schema.MAX_BLOB_BYTES) -> Column:
    return F.octet_length(content).between(1, most)


def valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def with_task(text: Column, kind: str) -> Column:
    return F.concat(F.lit(schema.PREFIX_QUERY if kind == "query" else schema.PREFIX_DOCUMENT), text)


def query_text(words: list[str]) -> str:
    if not words:
        raise ValueError("usage: search <words>")
    return " ".join(words)


def fmt_bytes(n: int) -> str:
    for unit, size, places in (("GiB", 1 << 30, 2), ("MiB", 1 << 20, 2), ("KiB", 1 << 10, 1)):
        if n >= size:
            return f"{n / size:.{places}f} {unit}"
    return f"{n} B"


def fmt_duration(seconds: float) -> str:
    ms = seconds * 1000
    if ms >= 1000:
        return f"{seconds:.2f}s"
    return f"{ms:.1f}ms" if ms >= 1 else f"{ms * 1000:.0f}µs"


def fmt_count(n: int) -> str:
    if n >= 1_000_000:
        return f"{n / 1e6:.2f}M"
    return f"{n / 1e3:.1f}K" if n >= 1000 else str(n)
