"""Plain text of e-mail messages: parts taken apart, encodings undone, mark-up dropped."""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator
from typing import NamedTuple


class Part(NamedTuple):
    """One leaf of a message: its kind ('plain', 'html' or 'attached') and decoded text."""

    kind: str
    text: str


_FIELD = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:")
_BOUNDARY = re.compile(r"""boundary\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s;]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I)
_TYPE = re.compile(r"^content-type:\s*([^;\s]+)", re.I | re.M)
_ENCODING = re.compile(r"^content-transfer-encoding:\s*([A-Za-z0-9-]+)", re.I | re.M)
_DISPOSITION = re.compile(r"^content-disposition:\s*attachment", re.I | re.M)
_NAME = re.compile(r"""name\*?\s*=\s*"?[^";\n]*\.([A-Za-z0-9]+)""", re.I)
_SUBJECT = re.compile(r"^subject:[ \t]*(.*(?:\n[ \t].*)*)", re.I | re.M)
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=(?:\s+(?==\?))?")
_DROP = re.compile(r"<!--.*?-->|<(style|script|head|title)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_BREAK = re.compile(r"<\s*/?\s*(?:p|div|br|li|ul|ol|tr|table|h[1-6]|blockquote|body|html|hr|pre|noscript)\b[^>]*>", re.I)
_TAG = re.compile(r"<[A-Za-z/!?][^<>]*>")
_SOFT = re.compile(r"=[ \t]*\n")
_HEX = re.compile(rb"=([0-9A-Fa-f]{2})")


def head_and_body(raw: str) -> tuple[str, str]:
    """Headers and body of a message with LF line ends; a text that begins without a header has none."""
    raw = raw.lstrip("\n")
    if not _FIELD.match(raw):
        return "", raw
    head, gap, body = raw.partition("\n\n")
    return head, body if gap else ""


def _unfold(head: str) -> str:
    return re.sub(r"\n[ \t]+", " ", head)


def _text(data: bytes, charset: str | None) -> str:
    for name in (charset, "utf-8", "cp1252"):
        if name:
            try:
                return data.decode(name)
            except (LookupError, UnicodeDecodeError):
                pass
    return data.decode("utf-8", "replace")


def from_quoted_printable(body: str, charset: str | None) -> str:
    body = _SOFT.sub("", body)
    if "=" not in body:
        return body
    data = body.encode("utf-8", "surrogatepass")
    return _text(_HEX.sub(lambda m: bytes([int(m[1], 16)]), data), charset)


_PADDING = re.compile(r"=+")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_WIDE = re.compile(r"utf[-_]?(?:16|32)", re.I)
_CONTROL = bytes([*range(9), *range(14, 32)])


def from_base64(body: str) -> bytes | None:
    """The bytes of all stretches between paddings; None where one is no base64."""
    out = []
    for stretch in _PADDING.split(body):
        kept = _NOT_BASE64.sub("", stretch)
        kept = kept[: len(kept) - (len(kept) % 4 == 1)]
        if kept:
            try:
                out.append(binascii.a2b_base64(kept + "=" * (-len(kept) % 4)))
            except binascii.Error:
                return None
    return b"".join(out)


def readable(data: bytes, charset: str | None) -> str | None:
    """Text of attached bytes, judged by all of them; None where they aren't text."""
    if charset and _WIDE.match(charset):
        try:
            return data.decode(charset)
        except (LookupError, UnicodeDecodeError):
            pass
    if b"\0" in data or (len(data) - len(data.translate(None, _CONTROL))) * 50 > len(data):
        return None
    for name in (charset, "utf-8"):
        if name:
            try:
                return data.decode(name)
            except (LookupError, UnicodeDecodeError):
                pass
    text = data.decode("cp1252", "replace")
    odd = len(text) - len(text.encode("ascii", "ignore"))
    return text if odd * 5 < len(text) else None


def strip_markup(page: str) -> str:
    page = _DROP.sub(" ", page)
    page = _BREAK.sub("\n", page)
    return html.unescape(_TAG.sub("", page))


DEPTH = 20  # parts nested deeper are taken as plain text, undecoded


def parts(raw: str | None, depth: int = 0) -> Iterator[Part]:
    """The text-bearing leaves of a message; null and empty texts have none."""
    if not raw:
        return
    if "\r" in raw:
        raw = raw.replace("\r\n", "\n").replace("\r", "\n")
    head, body = head_and_body(raw) if depth == 0 else _part_head(raw)
    yield from _leaves(_unfold(head) if "\n" in head else head, body, depth)


def _part_head(raw: str) -> tuple[str, str]:
    raw = raw[1:] if raw.startswith("\n") else raw
    if raw.startswith("\n"):
        return "", raw[1:]
    head, gap, body = raw.partition("\n\n")
    return (head, body) if gap or _FIELD.match(head) else ("", raw)


def _leaves(head: str, body: str, depth: int) -> Iterator[Part]:
    found = _TYPE.search(head)
    kind = found[1].lower() if found else "text/plain"
    if kind.startswith("multipart/") and depth < DEPTH:
        b = _BOUNDARY.search(head)
        mark = "--" + (b[1] or b[2] or b[3]) if b else None
        if mark and mark in body:
            pieces = ("\n" + body).split("\n" + mark)
            if pieces[0].strip():
                yield Part("plain", pieces[0])
            for piece in pieces[1:]:
                if piece.startswith("--"):
                    rest = piece[2:]
                    if rest.strip():
                        yield Part("plain", rest)
                    break
                yield from parts(piece, depth + 1) if piece.strip() else ()
            return
        kind = "text/plain"
    if kind == "message/rfc822" and depth < DEPTH:
        inner_head, inner = head_and_body(body)
        yield from _leaves(_unfold(inner_head), inner, depth + 1)
        return
    enc = _ENCODING.search(head)
    enc = enc[1].lower() if enc else ""
    charset = _CHARSET.search(head)
    charset = charset[1] if charset else None
    attached = bool(_DISPOSITION.search(head)) or not kind.startswith("text/")
    if enc == "base64":
        data = from_base64(body)
        if data is None:
            return
        text = readable(data, charset) if attached else _text(data, charset)
        if text is None:
            return
    elif enc == "quoted-printable":
        text = from_quoted_printable(body, charset)
    else:
        text = body
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    is_html = kind == "text/html" or (_name_is_html(head) if attached else text.lstrip()[:15].lower().startswith(("<html", "<!doctype html")))
    if is_html and not attached:
        yield Part("html", text)
    else:
        yield Part("attached" if attached else "plain", strip_markup(text) if is_html else text)


def _name_is_html(head: str) -> bool:
    n = _NAME.search(head)
    return bool(n) and n[1].lower() in ("htm", "html")


def subject(raw: str | None) -> str:
    """The decoded Subject header, '' where there is none."""
    if not raw:
        return ""
    head, _ = head_and_body(raw.replace("\r\n", "\n") if "\r" in raw else raw)
    found = _SUBJECT.search(head)
    if not found:
        return ""

    def word(m: re.Match) -> str:
        try:
            data = binascii.a2b_base64(m[3] + "=" * (-len(m[3]) % 4)) if m[2] in "bB" else _HEX.sub(lambda x: bytes([int(x[1], 16)]), m[3].replace("_", " ").encode())
        except (binascii.Error, ValueError):
            return m[0]
        return _text(data, m[1])

    return _WORD.sub(word, " ".join(found[1].split()))
