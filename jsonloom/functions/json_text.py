"""Reading JSON text nested beyond what the parser's own stack holds."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

#: Levels of a document that can be read. The labels of a document's nodes grow with its depth, so a bound there must
#: be; deeper ones count as unreadable.
LEVELS = 10_000

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)((?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)")
_WORDS = {"true": True, "false": False, "null": None}


class TooDeep(ValueError):
    """More than LEVELS levels."""


def read_deep(text: str, whole: Callable[[str], Any], real: Callable[[str], Any]) -> Any:
    """The value of a JSON text, without recursion. whole, real: what becomes of number literals. ValueError if it is no
    JSON, TooDeep beyond LEVELS levels. Of repeated keys the last counts."""
    open_: list[Any] = []
    keys: list[str] = []

    def space(i: int) -> int:
        return _SPACE.match(text, i).end()  # type: ignore[union-attr]

    def wrong(i: int) -> ValueError:
        return ValueError(f"no JSON from character {i}")

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise wrong(i)
        k, i = json.decoder.scanstring(text, i + 1, True)
        i = space(i)
        if text[i : i + 1] != ":":
            raise wrong(i)
        keys.append(k)
        return space(i + 1)

    at = space(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            if len(open_) >= LEVELS:
                raise TooDeep(f"more than {LEVELS} levels")
            value: Any = {} if c == "{" else []
            at = space(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                open_.append(value)
                if c == "{":
                    at = key(at)
                continue
        elif c == '"':
            value, at = json.decoder.scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            value, at = (real if m[1] else whole)(m[0]), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise wrong(at)
            value, at = _WORDS[word], at + len(word)
        while open_:  # put the value where it belongs, and close what ends here
            top = open_[-1]
            if isinstance(top, dict):
                top[keys.pop()] = value
            else:
                top.append(value)
            at = space(at)
            c = text[at : at + 1]
            if c == ",":
                at = space(at + 1)
                if isinstance(top, dict):
                    at = key(at)
                break
            if c != ("}" if isinstance(top, dict) else "]"):
                raise wrong(at)
            value, at = open_.pop(), at + 1
        else:
            if space(at) != len(text):
                raise wrong(at)
            return value
