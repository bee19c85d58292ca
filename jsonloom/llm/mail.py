"""Reading raw e-mail messages: what a recipient sees, and what the sender wrote themselves."""

from __future__ import annotations

import binascii
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass
class Part:
    """A leaf of the message's tree, decoded. kind: 'plain', 'html' or 'other'."""

    kind: str
    text: str
    attached: bool  # as a file, or inside an attached message
    choice: int  # number of the multipart/alternative it belongs to, 0 if none


_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_PARAM = re.compile(r""";\s*([\w*-]+)\s*=\s*("(?:[^"\\]|\\.)*"|[^;\s]*)""")
_BASE64 = re.compile(r"[A-Za-z0-9+/=\s]*", re.A)
_TEXT_FILE = re.compile(r"\.(txt|csv|md|log|tsv|json|xml|html?|eml|text)$", re.I)


def _headers(lines: list[str], at: int) -> tuple[dict[str, str], int]:
    """The headers from line ``at`` on (lower-case names, first wins), and the line after their blank line."""
    out: dict[str, str] = {}
    name = ""
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            return out, at + 1
        if line[0] in " \t":
            if name:
                out[name] += " " + line.strip()
        elif line.startswith(("From ", ">From ")):  # a mailbox's separator, wherever it stands
            name = ""
        elif _HEADER.match(line):
            key, _, value = line.partition(":")
            name = key.strip().lower()
            if name in out:
                name = ""
            else:
                out[name] = value.strip()
        else:  # no header any more: the body began without a blank line
            return out, at
        at += 1
    return out, at


def _params(value: str) -> dict[str, str]:
    out = {}
    for k, v in _PARAM.findall(value):
        if v[:1] == '"':
            v = re.sub(r"\\(.)", r"\1", v[1:-1])
        out.setdefault(k.lower().rstrip("*"), v)
    return out


def _decoded(data: bytes, charset: str) -> str:
    for name in (charset or "utf-8", "utf-8"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeError, ValueError):
            pass
    return data.decode("cp1252", "replace")


def _body(lines: list[str], encoding: str, charset: str) -> str:
    text = "\n".join(lines)
    if encoding == "base64":
        end = next((i for i, x in enumerate(lines) if not _BASE64.fullmatch(x)), len(lines))
        data = re.sub(rb"[^A-Za-z0-9+/]", b"", "".join(lines[:end]).encode("ascii"))
        data = data[: len(data) - (1 if len(data) % 4 == 1 else 0)]
        after = "\n".join(lines[end:])  # what isn't base64 any more was added in plain text
        return _decoded(binascii.a2b_base64(data + b"=" * (-len(data) % 4)), charset) + ("\n" + after if after.strip() else "")
    if encoding == "quoted-printable":
        if text.isascii():
            return _decoded(binascii.a2b_qp(text.encode("ascii")), charset)
        return re.sub(  # 8-bit text that was decoded already stands between the escapes
            r"(?:=[0-9A-Fa-f]{2})+", lambda m: _decoded(bytes.fromhex(m[0].replace("=", "")), charset), re.sub(r"=[ \t]*\n", "", text)
        )
    return text


def _is_text(s: str) -> bool:
    return "�" not in s and not re.search(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]", s)


def _pieces(body: list[str], fence: str) -> list[list[str]]:
    """The lines between the fences of a multipart body; what stands before the first or behind the closing one is dropped."""
    out: list[list[str]] = []
    piece: list[str] | None = None
    for line in body:
        if line.startswith(fence):
            rest = line[len(fence) :].rstrip()
            if rest in ("", "--"):
                if piece is not None:
                    out.append(piece)
                piece = None if rest else []
                continue
        if piece is not None:
            piece.append(line)
    return [*out, piece] if piece else out


def _walk(lines: list[str], start: int) -> Iterator[Part]:
    """The text parts of a message in order, however deep messages and parts are nested."""
    choices = 0
    stack: list[tuple[list[str], int, bool, int]] = [(lines, start, False, 0)]
    while stack:
        lines, start, attached, choice = stack.pop()
        head, at = _headers(lines, start)
        kind_text = head.get("content-type", "text/plain")
        kind = kind_text.split(";", 1)[0].strip().lower()
        params = _params(";" + kind_text.partition(";")[2]) if ";" in kind_text else {}
        disposition = head.get("content-disposition", "")
        name = params.get("name") or _params(";" + disposition.partition(";")[2]).get("filename", "")
        attached = attached or disposition.lower().startswith("attachment") or bool(name)
        encoding = head.get("content-transfer-encoding", "").split(";")[0].strip().lower()
        body = lines[at:]
        if kind.startswith("multipart/") and params.get("boundary"):
            if kind == "multipart/alternative":
                choices += 1
                choice = choices
            stack += [(p, 0, attached, choice) for p in reversed(_pieces(body, "--" + params["boundary"]))]
        elif kind == "message/rfc822":
            inner = _body(body, encoding, "utf-8").split("\n") if encoding in ("base64", "quoted-printable") else body
            stack.append((inner, 0, True, 0))
        elif kind.startswith("text/") or kind.startswith("multipart/") or "/" not in kind:
            text = _body(body, encoding, params.get("charset", ""))
            yield Part("html" if kind == "text/html" else "plain", text, attached, choice)
        elif _TEXT_FILE.search(name) or kind in ("application/octet-stream", "application/json", "application/xml"):
            text = _body(body, encoding, params.get("charset", ""))
            if _is_text(text):
                yield Part("html" if re.search(r"\.html?$", name, re.I) else "plain", text, True, choice)


def parts(raw: str | None) -> list[Part]:
    """The text parts of a message in order. A text without headers is one plain part; NULL or empty has none."""
    if not raw or not raw.strip():
        return []
    lines = raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    at = 0
    while at < len(lines) and not lines[at].strip():
        at += 1
    if lines[at].startswith("From ") and at + 1 < len(lines):
        at += 1
    if not _HEADER.match(lines[at]):
        return [Part("plain", "\n".join(lines[at:]), False, 0)]
    return list(_walk(lines, at))


_DROP = re.compile(r"<(style|script|head|title)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", re.S | re.I)
_QUOTE_BLOCK = re.compile(r"</?blockquote\b[^>]*>", re.I)
_BLOCK = re.compile(r"</?(p|div|table|tr|ul|ol|li|h[1-6]|blockquote|pre|hr|body|html|section|article|dl|dt|dd)\b[^>]*>", re.I)
_BREAK = re.compile(r"<(br|td|th|/td|/th)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")


def html_text(source: str) -> str:
    """The text of HTML: blocks become paragraphs, mark-up within a line vanishes, entities are read."""
    text = _DROP.sub(" ", source)
    text = _BLOCK.sub("\n\n", text)
    text = _BREAK.sub("\n", text)
    return html.unescape(_TAG.sub("", text))


def seen_text(raw: str | None) -> str:
    """What the recipient reads: all text parts and text attachments, quoted and forwarded text
    included, without mark-up. Empty for NULL, empty texts and messages without text."""
    texts = (html_text(p.text) if p.kind == "html" else p.text for p in parts(raw))
    return _INVISIBLE.sub("", "\n\n".join(texts))


# Own text. The patterns cover the mail programs' fixed phrases in English, German, French and Spanish.

_QUOTED = re.compile(r"^\s*(?:[>|}]|:\s*>)")
_INTRO = re.compile(
    r"(?:\b(?:wrote|writes|said|schrieb|escribi[oó]|escribi\S{1,3}|a [ée]crit|a \S{1,3}crit|said the following)\b.{0,60}[:：]|"
    r"^(?:Am|El|Le|On|At)\b.{0,120}[:：])\s*$",
    re.I,
)
_FORWARD = re.compile(
    r"^\s*(?:-{2,}\s*(?:Original Message|Forwarded message|Forwarded by|Urspr\S+ Nachricht|Weitergeleitete Nachricht|"
    r"Message d'origine|Message original|Message transf\S+|Mensaje original|Mensaje reenviado)\b.*|_{10,})\s*$|^\s*Begin forwarded message",
    re.I,
)
_SIGNATURE = re.compile(r"^\s*--\s*$")
_MOJIBAKE = re.compile(r"[ÃÂ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")


def repaired(text: str) -> str:
    """UTF-8 that was read as Windows-1252, read right, wherever the bytes allow it."""

    def fix(m: re.Match[str]) -> str:
        try:
            return bytes(ord(c) if ord(c) < 256 else c.encode("cp1252")[0] for c in m[0]).decode("utf-8")
        except (UnicodeError, ValueError):
            return m[0]

    return _MOJIBAKE.sub(fix, text)


def _own_html(source: str) -> str:
    """HTML without its quoted blocks, as text."""
    out, depth, last = [], 0, 0
    for m in _QUOTE_BLOCK.finditer(source):
        if depth == 0:
            out.append(source[last : m.start()])
        depth = max(0, depth + (-1 if m[0][1] == "/" else 1))
        last = m.end()
    if depth == 0:
        out.append(source[last:])
    return html_text("\n<p>".join(out))


def own_paragraphs(raw: str | None) -> list[str]:
    """The paragraphs the sender of a message wrote: without headers, attachments, quoted and
    forwarded messages, and what follows a signature mark. One of several alternatives is read, the
    plain one if there is one."""
    found = [p for p in parts(raw) if not p.attached]
    plain = {p.choice for p in found if p.choice and p.kind == "plain" and p.text.strip()}
    paragraphs: list[str] = []
    for p in found:
        if p.choice in plain and p.kind == "html":
            continue
        text = repaired(_own_html(p.text) if p.kind == "html" else p.text)
        block: list[str] = []
        signed = False
        for line in [*_INVISIBLE.sub("", text).replace("\xa0", " ").split("\n"), ""]:
            if _FORWARD.match(line):
                break
            if _QUOTED.match(line):
                signed = False
                line = ""
            elif _SIGNATURE.match(line):
                signed = True
                line = ""
            if line.strip():
                block.append(line.strip())
                continue
            if block and not signed and not _INTRO.search(" ".join(block)[-200:]):
                paragraphs.append(" ".join(block))
            elif block and signed:
                signed = False  # the signature ends with its paragraph
            block = []
        if block and not signed:
            paragraphs.append(" ".join(block))
    return [" ".join(p.split()) for p in paragraphs]
