"""Text parts of archived e-mails: transfer encodings undone, HTML as what it shows.

Lenient by design: broken headers, missing end boundaries, unknown charsets, damaged base64
and lone line endings give the text that can be read instead of an error.
"""

from __future__ import annotations

import binascii
import html
import re
from typing import NamedTuple

_HEADER = re.compile(r"[!-9;-~]+:")
_TYPE = re.compile(r"^content-type:\s*([\w.+/-]+)(.*?)(?=^\S|\Z)", re.I | re.M | re.S)
_ENCODING = re.compile(r"^content-transfer-encoding:\s*([\w-]+)", re.I | re.M)
_DISPOSITION = re.compile(r"^content-disposition:\s*([\w-]+)", re.I | re.M)
_BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"]*)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([^\s\";]+)", re.I)
_NOT_BASE64 = re.compile(rb"[^A-Za-z0-9+/]")
_HIDDEN = re.compile(r"<(style|script|head|title)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
#: Nested multiparts are followed this deep; what lies deeper is read as text.
DEPTH = 12


class Part(NamedTuple):
    kind: str  # plain, html or another text subtype
    text: str  # decoded, HTML not yet replaced
    attached: bool


def split_message(text: str) -> tuple[str, str]:
    """(headers, body). A text that does not begin with a header is all body."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("From ") and "\n" in text:
        text = text[text.index("\n") + 1 :]
    if text.startswith("\n"):
        return "", text[1:]
    if not _HEADER.match(text):
        return "", text
    head, blank, body = text.partition("\n\n")
    return head, body if blank else ""


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        raw = _NOT_BASE64.sub(b"", body.encode("ascii", "ignore"))
        try:
            data = binascii.a2b_base64(raw[: len(raw) - (len(raw) % 4 == 1)] + b"==")
        except binascii.Error:
            return body
    elif encoding == "quoted-printable":
        data = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
    else:
        return body
    try:
        return data.decode(charset, "replace")
    except (LookupError, ValueError):
        return data.decode("utf-8", "replace")


def _split_parts(body: str, boundary: str) -> list[str] | None:
    """Texts between boundary lines; None if the boundary never comes."""
    mark = "\n--" + boundary
    chunks = ("\n" + body).split(mark)
    if len(chunks) < 2:
        return None
    found = []
    for chunk in chunks[1:]:
        if chunk.startswith("--"):
            break
        line, _, rest = chunk.partition("\n")
        if line.strip():  # a longer boundary that begins like this one
            if found:
                found[-1] += mark + chunk
            continue
        found.append(rest)
    return found


def text_parts(text: str) -> list[Part]:
    """All text parts of a message in their order, attachments of text included."""
    head, body = split_message(text)
    out: list[Part] = []
    _collect(head, body, out, 0)
    return out


def _collect(head: str, body: str, out: list[Part], depth: int) -> None:
    found = _TYPE.search(head)
    kind, params = (found[1].lower(), found[2]) if found else ("text/plain", "")
    if kind.startswith("multipart/") and depth < DEPTH:
        named = _BOUNDARY.search(params)
        chunks = _split_parts(body, named[1] if named[1] is not None else named[2]) if named else None
        if chunks is not None:
            for chunk in chunks:
                if chunk.startswith("\n"):
                    _collect("", chunk[1:], out, depth + 1)
                elif _HEADER.match(chunk):
                    inner, _, rest = chunk.partition("\n\n")
                    _collect(inner, rest, out, depth + 1)
                else:
                    _collect("", chunk, out, depth + 1)
            return
        kind = "text/plain"
    encoding = _ENCODING.search(head)
    charset = _CHARSET.search(params)
    if kind.startswith("message/") and depth < DEPTH:
        _collect(*split_message(body), out, depth + 1)
        return
    if not kind.startswith("text/"):
        return
    disposition = _DISPOSITION.search(head)
    decoded = _decoded(body, encoding[1].lower() if encoding else "", charset[1] if charset else "utf-8")
    attached = bool(disposition and disposition[1].lower() == "attachment")
    out.append(Part(kind[5:], decoded.replace("\r\n", "\n"), attached))


def shown(text: str) -> str:
    """What HTML shows: a tag gives a space, an entity its character."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", text)))


def readable(part: Part) -> str:
    return shown(part.text) if part.kind == "html" else part.text
