"""The readable text of a raw e-mail message, and its words.

Readable are all text/plain and text/html parts at any depth, attached and forwarded ones too, with transfer encoding
and charset decoded; of HTML only what a reader sees. Headers, preambles, epilogues and other attachments are not.
Text without headers, with unclosed multiparts, cut-off encodings or unknown charsets is read as far as possible.
"""

from __future__ import annotations

import binascii
import html
import quopri
import re

_BLANK = re.compile(r"\n[ \t]*\n")
_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_TYPE = re.compile(r"^content-type[ \t]*:[ \t]*(.*(?:\n[ \t].*)*)", re.I | re.M)
_ENCODING = re.compile(r"^content-transfer-encoding[ \t]*:[ \t\n]*([^\s;]+)", re.I | re.M)
_BOUNDARY = re.compile(r"""boundary[ \t]*=[ \t]*(?:"([^"]*)"|([^\s;]+))""", re.I)
_CHARSET = re.compile(r"""charset[ \t]*=[ \t]*["']?([^\s;"']+)""", re.I)
_NOT_B64 = re.compile(r"[^A-Za-z0-9+/]")
_WORD = re.compile(r"\w+")

# HTML that is not shown: comments and the contents of these elements.
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script|head|title|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_HIDDEN = re.compile(
    r"""<(\w+)\b[^<>]*?(?:\sstyle\s*=\s*(?:"[^"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)|\shidden(?=[\s>=/]))[^<>]*>""", re.I
)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*|/)?>|<[!?/][^<>]*>")
# Elements that run within a line of text: their tags part no words.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time "
    "tt u var wbr".split()
)


def _drop_hidden(text: str) -> str:
    """Without elements that a style or an attribute hides, up to their end tag of equal depth."""
    while m := _HIDDEN.search(text):
        name, depth, end = m[1], 1, len(text)
        if m[0].endswith("/>") or name.lower() in ("br", "img", "input", "hr", "meta", "link"):
            end = m.end()
        else:
            for t in re.finditer(rf"<(/?){name}\b[^>]*>", text[m.end() :], re.I):
                depth += -1 if t[1] else 1
                if not depth:
                    end = m.end() + t.end()
                    break
        text = text[: m.start()] + " " + text[end:]
    return text


def html_text(text: str) -> str:
    """What a reader sees of HTML: block tags part words, inline tags don't."""
    text = _UNSEEN.sub(" ", text)
    if "hidden" in text or "display" in text:
        text = _drop_hidden(text)
    return html.unescape(_TAG.sub(lambda m: "" if m[2] and m[2].lower() in _INLINE else "\n", text))


def _charset(name: str | None) -> str:
    if not name:
        return "utf-8"
    try:
        "".encode(name)
    except (LookupError, UnicodeError, ValueError):
        return "utf-8"
    return name


def _bytes_text(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(_charset(charset))
    except UnicodeDecodeError:
        return data.decode(_charset(charset), "replace")


def _decoded(body: str, encoding: str, charset: str | None) -> str:
    if encoding == "base64":
        data = _NOT_B64.sub("", body)
        return _bytes_text(binascii.a2b_base64(data[: len(data) - (len(data) % 4 == 1)] + "=" * (-len(data) % 4 % 3)), charset)
    if encoding == "quoted-printable":
        # Characters beyond Latin-1 can't stand for bytes; they are kept as they are, between the decoded stretches.
        parts = re.split(r"([^\x00-\x7f]+)", body)
        if len(parts) == 1:
            return _bytes_text(quopri.decodestring(body.encode("ascii")), charset)
        return "".join(p if i % 2 else _bytes_text(quopri.decodestring(p.encode("ascii")), charset) for i, p in enumerate(parts))
    return body


def _split_head(text: str) -> tuple[str, str]:
    """Header block and body of an entity whose lines end with a line feed; no header block if there is none."""
    if text.startswith("\n"):
        return "", text[1:]
    if not _HEADER.match(text):
        return "", text
    m = _BLANK.search(text)
    return (text[: m.start()], text[m.end() :]) if m else (text, "")


def _walk(message: str, out: list[str]) -> None:
    """The text parts in their order, at any depth: entities that are still to be read wait on a stack."""
    waiting = [(message, "text/plain")]
    while waiting:
        text, default = waiting.pop()
        head, body = _split_head(text)
        kind = _TYPE.search(head) if head else None
        full = kind[1] if kind else default
        media = full.split(";", 1)[0].strip().lower() or default
        found = _ENCODING.search(head) if head else None
        encoding = found[1].lower() if found else "8bit"
        if media.startswith("multipart/") and (b := _BOUNDARY.search(full)) and (mark := b[1] or b[2]):
            pieces = re.split(rf"^--{re.escape(mark)}(--)?[ \t]*$\n?", body, flags=re.M)
            parts = []
            for closing, piece in zip(pieces[1::2], pieces[2::2], strict=True):
                if closing:
                    break
                parts.append((piece, "message/rfc822" if media == "multipart/digest" else "text/plain"))
            waiting.extend(reversed(parts))
        elif media in ("message/rfc822", "message/global"):
            if encoding in ("base64", "quoted-printable"):
                body = _decoded(body, encoding, "utf-8").replace("\r\n", "\n")
            waiting.append((body.lstrip("\n"), "text/plain"))
        elif media in ("text/plain", "text/html"):
            charset = _CHARSET.search(full)
            body = _decoded(body, encoding, charset and charset[1])
            out.append(html_text(body) if media == "text/html" else body)


def readable_text(message: str | None) -> str:
    """All readable parts, one after another; empty for null or empty messages."""
    if not message:
        return ""
    text = message.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("From "):
        text = text.partition("\n")[2]
    out: list[str] = []
    _walk(text, out)
    return "\n".join(out)


def words(text: str) -> list[str]:
    """Runs of letters, digits or underscores, in lower case."""
    return _WORD.findall(text.lower())


def message_words(message: str | None) -> list[str]:
    return words(readable_text(message))
