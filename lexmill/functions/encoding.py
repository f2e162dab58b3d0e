"""What bytes are: marks, kinds, strict decoding; as columns and for readers in Python."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a prefix is, the signatures of ZIP files, the codes of errors.
SNIFF_PREFIX = 8192
ZIP_SIGNATURES = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
ERROR_CODES = (
    "read", "permission_denied", "deleted", "modified", "invalid_utf8", "invalid_encoding", "unsupported_utf32",
    "invalid_unicode_path", "corrupt_archive", "corrupt_archive_entry", "unsupported_archive_feature", "scan", "io",
)
#: Longest first, as the mark of UTF-16 LE begins that of UTF-32 LE.
MARKS = ((b"\xff\xfe\x00\x00", "utf32le"), (b"\x00\x00\xfe\xff", "utf32be"), (b"\xef\xbb\xbf", "utf8"), (b"\xff\xfe", "utf16le"), (b"\xfe\xff", "utf16be"))
_CONTROLS = bytes([*range(9), *range(0x0E, 0x20), 0x7F])
#: Windows-1252 where it differs from ISO-8859-1; the five bytes it leaves open stay as they are.
_C1 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


class DecodeError(ValueError):
    """Bytes that aren't text; ``code`` is one of ERROR_CODES."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def reason(code: str, message: str) -> str:
    return f"[{code}] {message}"


def mark_of(prefix: bytes) -> str:
    return next((name for mark, name in MARKS if prefix.startswith(mark)), "none")


def looks_binary(prefix: bytes) -> bool:
    """A NUL, or over a tenth of control characters other than white space."""
    return b"\0" in prefix or 10 * (len(prefix) - len(prefix.translate(None, _CONTROLS))) > len(prefix)


def sniff(prefix: bytes) -> str:
    if mark_of(prefix) != "none":
        return "text"
    if prefix.startswith(ZIP_SIGNATURES):
        return "archive"
    return "binary" if looks_binary(prefix) else "text"


def decode_windows1252_text(data: bytes) -> str:
    return data.decode("latin-1").translate(_C1)


def decode(data: bytes, fallback: str | None = None) -> tuple[str, bool]:
    """Text, and whether the fallback was used; strict, nothing is replaced."""
    mark = mark_of(data)
    if mark in ("utf32le", "utf32be"):
        raise DecodeError("unsupported_utf32", "UTF-32 is not supported")
    if mark in ("utf16le", "utf16be"):
        try:
            return codecs.decode(data[2:], "utf-16-le" if mark == "utf16le" else "utf-16-be"), False
        except UnicodeDecodeError as e:
            raise DecodeError("invalid_encoding", f"invalid UTF-16: {e.reason}") from e
    body = data[3:] if mark == "utf8" else data
    try:
        return body.decode("utf-8"), False
    except UnicodeDecodeError as e:
        if fallback == "windows-1252" and mark == "none":
            return decode_windows1252_text(body), True
        raise DecodeError("invalid_utf8", f"invalid UTF-8 at byte {e.start}") from e


def without_broken_tail(data: bytes) -> bytes:
    """A cut prefix without the bytes of a character that the cut went through."""
    mark = mark_of(data)
    if mark in ("utf16le", "utf16be"):
        body = data[2:]
        body = body[: len(body) // 2 * 2]
        high = body[-1] if mark == "utf16le" and body else body[-2] if body else 0
        return data[:2] + (body[:-2] if 0xD8 <= high < 0xDC else body)
    for back in range(1, min(4, len(data)) + 1):
        b = data[-back]
        if b & 0xC0 != 0x80:
            need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
            return data if back >= need else data[:-back]
    return data


def _hex(prefix: Column, mark: bytes) -> Column:
    return F.substring(prefix, 1, len(mark)) == F.lit(bytearray(mark))


def bom(prefix: Column) -> Column:
    out = F.lit("none")
    for mark, name in reversed(MARKS):
        out = F.when(_hex(prefix, mark), F.lit(name)).otherwise(out)
    return out


def binary_prefix(prefix: Column) -> Column:
    chars = F.decode(prefix, "ISO-8859-1")
    rest = F.translate(chars, _CONTROLS.decode("latin-1")[1:], "")
    return (F.instr(chars, "\0") > 0) | (F.lit(10) * (F.length(chars) - F.length(rest)) > F.length(chars))


def sniffed(content: Column) -> Column:
    prefix = F.substring(content, 1, SNIFF_PREFIX)
    zipped = _hex(prefix, ZIP_SIGNATURES[0]) | _hex(prefix, ZIP_SIGNATURES[1]) | _hex(prefix, ZIP_SIGNATURES[2])
    return F.when(bom(prefix) != "none", "text").when(zipped, "archive").when(binary_prefix(prefix), "binary").otherwise("text")


def decode_windows1252(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, _C1)), "".join(_C1.values()))


def decode_utf8(content: Column) -> Column:
    """Null where the bytes aren't valid UTF-8; a mark at the start is left out."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.when(text.startswith("﻿"), F.substr(text, F.lit(2))).otherwise(text)
