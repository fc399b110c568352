"""Lean decoding of raw e-mail text into its subject and its text parts.

Everything here is pure Python over ``str`` and is called from Arrow-batched workers.  It accepts damaged messages: cut bodies, missing
headers, broken boundaries, invalid base64.  ``None`` gives no subject and no parts.
"""

from __future__ import annotations

import binascii
import html
import re

_HEADER_END = re.compile(r"\r?\n\r?\n")
_UNFOLD = re.compile(r"\r?\n[ \t]+")
_HEADER = re.compile(r"^([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*?)[ \t\r]*$", re.M)
_BOUNDARY = re.compile(r'boundary="?([^"\r\n;]+)"?', re.I)
_CHARSET = re.compile(r'charset="?([A-Za-z0-9_.:-]+)"?', re.I)
_ENCODED_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=(?:\s+(?==\?))?")
_NOT_B64 = re.compile(r"[^A-Za-z0-9+/]+")
_DROPPED = re.compile(r"<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", re.I | re.S)
#: Tags inside a word don't separate words; every other tag does.
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|font|a|small|big|sup|sub|wbr|mark|tt|code|o:p)(?:\s[^<>]*)?/?>", re.I)
_BREAK = re.compile(r"<(?:br|/p|p|/div|div|/li|li|/tr|tr|/h\d|h\d|blockquote|/blockquote)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]+")


def _demojibake(m: re.Match) -> str:
    s = m.group()
    for codec in ("cp1252", "latin-1"):
        try:
            return s.encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return s


def repair(text: str) -> str:
    """UTF-8 that was read as a single-byte code, and invisible characters, undone."""
    if text.isascii():
        return text
    return _MOJIBAKE.sub(_demojibake, text).translate(_INVISIBLE)


def _decode(raw: bytes, charset: str) -> str:
    try:
        return raw.decode(charset or "utf-8")
    except (UnicodeDecodeError, LookupError):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8" if charset.lower() in ("", "utf-8", "utf8") else "latin-1", "replace")


def b64(text: str) -> bytes:
    """Base64 in which foreign characters are skipped and a cut tail is dropped."""
    clean = _NOT_B64.sub("", text)
    clean = clean[: len(clean) - (len(clean) % 4 == 1)]
    return binascii.a2b_base64(clean + "=" * (-len(clean) % 4))


def _word(m: re.Match) -> str:
    charset, kind, data = m.groups()
    raw = b64(data) if kind in "bB" else binascii.a2b_qp(data.encode("utf-8", "surrogatepass"), header=True)
    return _decode(raw, charset)


def header_text(value: str) -> str:
    """A header value with its encoded words decoded."""
    return _ENCODED_WORD.sub(_word, value) if "=?" in value else value


def strip_html(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", _BREAK.sub("\n", _INLINE.sub("", _DROPPED.sub(" ", text.replace("\r", "").replace("\n", " ")))))
    return html.unescape(text) if "&" in text else text


def _head(block: str) -> dict[str, str]:
    return {k.lower(): v for k, v in reversed(_HEADER.findall(_UNFOLD.sub(" ", block)))}


def _split(text: str) -> tuple[dict[str, str], str]:
    """Headers and body of an entity; a text that doesn't begin with a header is all body."""
    if text[:2] in ("\r\n", "\n\n") or text[:1] == "\n":
        return {}, text
    first = text[:200].split("\n", 1)[0]
    if not (_HEADER.match(first.rstrip("\r")) or first.startswith("From ")):
        return {}, text
    m = _HEADER_END.search(text)
    return (_head(text[: m.start()]), text[m.end() :]) if m else (_head(text), "")


def _parts(headers: dict[str, str], body: str, out: list[tuple[str, str]]) -> None:
    """Text parts in order.  Entities wait on a stack, so that they may be nested at any depth; each level consumes text."""
    waiting: list[tuple[dict[str, str], str] | str] = [(headers, body)]
    while waiting:
        entity = waiting.pop()
        headers, body = _split(entity) if isinstance(entity, str) else entity
        kind = headers.get("content-type", "text/plain")
        low = kind.lower()
        if low.startswith("multipart/"):
            if m := _BOUNDARY.search(kind):
                pieces = re.split(r"(?:^|\r?\n)--" + re.escape(m.group(1).strip()) + r"(?:--)?[ \t]*(?=\r?\n|$)", body)
                if pieces[0].strip():
                    out.append(("text/plain", pieces[0]))
                rest = (piece.removeprefix("\r").removeprefix("\n") for piece in pieces[1:])
                waiting += [piece for piece in rest if piece.strip()][::-1]
                continue
            low = "text/plain"
        if low.startswith("message/"):
            inner, rest = _split(body)
            if "subject" in inner:
                out.append(("text/plain", header_text(inner["subject"])))
            waiting.append((inner, rest))
            continue
        if not low.startswith("text"):
            continue
        encoding = headers.get("content-transfer-encoding", "").strip().lower()
        if encoding.startswith("base6"):
            charset = m.group(1) if (m := _CHARSET.search(kind)) else ""
            body = _decode(b64(body), charset)
        elif encoding.startswith("quoted"):
            charset = m.group(1) if (m := _CHARSET.search(kind)) else ""
            body = _decode(binascii.a2b_qp(body.encode("utf-8", "surrogatepass")), charset)
        out.append(("text/html" if low.startswith("text/html") else "text/plain", body))


def decode(text: str | None) -> tuple[str, list[str]]:
    """The subject and the text of each readable part (HTML as text), in order.

    Binary attachments are left out.  A message with a plain and an HTML form gives both.
    """
    if not text:
        return "", []
    headers, body = _split(text)
    out: list[tuple[str, str]] = []
    _parts(headers, body, out)
    return repair(header_text(headers.get("subject", ""))), [repair(strip_html(t) if k == "text/html" else t) for k, t in out]
