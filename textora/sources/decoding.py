"""Bytes of a text file as text, or the reason why they are none."""

from __future__ import annotations

#: Reasons for which a file is left out.
EMPTY, UNREADABLE, UNSUPPORTED = "empty", "unreadable", "unsupported"
#: Suffixes of text that are read, by format.
FORMATS = {"txt": "text", "text": "text", "log": "text", "csv": "text", "rst": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html"}
#: Files that systems leave in folders.
JUNK = (".DS_Store", "Thumbs.db", "desktop.ini")


def decoded(raw: bytes) -> tuple[str | None, str | None]:
    """(text, warning): by its byte order mark UTF-16, else UTF-8, else cp1252 with a warning; bytes with a NUL are no text."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return raw.decode("utf-16"), None
        except UnicodeDecodeError:
            return None, "not valid UTF-16"
    if b"\0" in raw:
        return None, "holds NUL bytes"
    try:
        return raw.decode("utf-8-sig"), None
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace"), "read as cp1252"


def kept_name(path: str) -> bool:
    """Whether no part of a relative path is hidden and its name is no system's."""
    parts = [p for p in path.split("/") if p]
    return bool(parts) and not any(p.startswith((".", "~$")) for p in parts) and parts[-1] not in JUNK


def read_text(raw: bytes, path: str) -> dict:
    """A row for a file: format, text with \\n line ends, skipped (a reason) and detail; text is null where skipped is not."""
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    kind = FORMATS.get(suffix)
    if kind is None:
        return {"format": "other", "text": None, "skipped": UNSUPPORTED, "detail": suffix}
    if not raw.strip():
        return {"format": kind, "text": None, "skipped": EMPTY, "detail": None}
    text, said = decoded(raw)
    if text is None:
        return {"format": kind, "text": None, "skipped": UNREADABLE, "detail": said}
    return {"format": kind, "text": text.replace("\r\n", "\n").replace("\r", "\n"), "skipped": None, "detail": said}
