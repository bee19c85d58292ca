"""The binary container: documents with shared values in one blob of ten tables.

Layout (big-endian): version 0 and the number of tables as i32, the tables' offsets as i32, the number of
buckets as u16; then the tables in a fixed order. Tables of fixed-size values are a count and the values;
the others a count, count + 1 offsets, and the bytes. References are a marker byte and four bytes."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Any

from jsonloom.functions.khash import khash_of
from jsonloom.functions.numbers import Exact, classify, int_bytes, int_from_bytes, whole_digits
from jsonloom.kinds import KIND, MARKER, MAX_KEYS
from jsonloom.operators.shred import Number, parse_exact

VERSION = 0
ORDER = ("int", "long", "bigint", "float", "double", "bigdec", "string", "array", "object", "root")
FIXED = {"int": ">i", "long": ">q", "float": ">f", "double": ">d"}
NO_INDEX = 65_535
LARGEST = 1_000_000  # digits of a number
HEADER = 4 + 4 + 4 * len(ORDER) + 2


class BlobError(ValueError):
    """The bytes aren't such a container."""


class _Pool:
    """Values of one table by first use; each once if ``share``."""

    def __init__(self, share: bool) -> None:
        self.items: list[Any] = []
        self.ids: dict[Any, int] | None = {} if share else None

    def add(self, item: Any) -> int:
        if self.ids is None:
            self.items.append(item)
            return len(self.items) - 1
        found = self.ids.setdefault(item, len(self.items))
        if found == len(self.items):
            self.items.append(item)
        return found


class BlobBuilder:
    """Documents one after another to one blob."""

    def __init__(self, *, buckets: int = 128, index_above: int = 2, dedup: bool = True, dedup_primitives: bool = True, numeric_mode: str = "exact", signed_hash: bool = False) -> None:
        if buckets < 1 or buckets >= NO_INDEX or (1 << 32) % buckets:
            raise ValueError("the number of buckets must divide 2^32 and be below 65535")
        self.buckets, self.index_above, self.mode, self.signed = buckets, index_above, numeric_mode, signed_hash
        self.pools = {t: _Pool(dedup if t in ("array", "object", "root") else dedup_primitives) for t in ORDER}
        self.names: set[str] = set()

    def append(self, name: str, value: Any) -> None:
        """Add a parsed document (numbers as Number literals, or int and float) under a new root name."""
        if name in self.names:
            raise ValueError(f"there is a root {name} already")
        self.names.add(name)
        at = self.pools["string"].add(name)
        self.pools["root"].add((at, self._ref(value)))

    def _ref(self, v: Any) -> tuple[int, int]:
        if v is None:
            return MARKER["null"], 0
        if v is True or v is False:
            return MARKER["bit"], int(v)
        if isinstance(v, (Number, int, float)):
            found = classify(v if isinstance(v, Number) else json.dumps(v), self.mode)
            if found is None:
                raise ValueError(f"no number: {v}")
            kind, n = found
            if kind in ("byte", "short"):
                return MARKER[kind], n
            return MARKER[kind], self.pools[kind].add(_stored(n))
        if isinstance(v, str):
            return MARKER["string"], self.pools["string"].add(v)
        if isinstance(v, list):
            return MARKER["array"], self.pools["array"].add(tuple(self._ref(x) for x in v))
        if len(v) > MAX_KEYS:
            raise ValueError(f"an object has more than {MAX_KEYS} keys")
        entries = []
        for k, x in v.items():
            key = self.pools["string"].add(k)
            entries.append((khash_of(k, self.signed), k, key, self._ref(x)))
        return MARKER["object"], self.pools["object"].add(tuple((h, key, ref) for h, _, key, ref in sorted(entries, key=lambda e: e[:2])))

    def _object(self, entries: tuple) -> bytes:
        body = struct.pack(">i", len(entries)) + b"".join(struct.pack(">i", key) + _packed(ref) for _, key, ref in entries)
        if len(entries) <= self.index_above:
            return struct.pack(">H", NO_INDEX) + body
        width, starts, at = (1 << 32) // self.buckets, [], 0
        for b in range(self.buckets):
            while at < len(entries) and entries[at][0] < b * width:
                at += 1
            starts.append(at)  # the first entry of this bucket or a later one
        return struct.pack(f">{self.buckets}H", *starts) + body

    def build(self) -> bytes:
        tables = []
        for t in ORDER:
            items = self.pools[t].items
            if t in FIXED:
                tables.append(struct.pack(">i", len(items)) + b"".join(struct.pack(FIXED[t], x) for x in items))
            elif t == "root":
                tables.append(struct.pack(">i", len(items)) + b"".join(struct.pack(">i", n) + _packed(r) for n, r in items))
            else:
                tables.append(_variable([self._bytes(t, x) for x in items]))
        out, at = [struct.pack(">ii", VERSION, len(ORDER))], HEADER
        for b in tables:
            out.append(struct.pack(">i", at))
            at += len(b)
        return b"".join([*out, struct.pack(">H", self.buckets), *tables])

    def _bytes(self, table: str, x: Any) -> bytes:
        if table == "string":
            return x.encode("utf-8", "surrogatepass")
        if table == "bigint":
            return int_bytes(x)
        if table == "bigdec":
            unscaled, scale, precision, signum = x.parts()
            return struct.pack(">iii", signum, precision, scale) + int_bytes(int(Decimal(unscaled)))
        if table == "array":
            return struct.pack(">i", len(x)) + b"".join(map(_packed, x))
        return self._object(x)


def _stored(n: Any) -> Any:
    """A number as its table holds it. ValueError for one that the container can't: its digits are written out."""
    if not isinstance(n, Exact):
        return n
    if max(n.exponent + len(n.digits), -n.exponent) > LARGEST:
        raise ValueError(f"a number of more than {LARGEST} digits")
    return int(Decimal(n.sign + n.digits + "0" * n.exponent)) if n.whole() else n


def _packed(ref: tuple[int, int]) -> bytes:
    return struct.pack(">Bi", *ref)


def _variable(items: list[bytes]) -> bytes:
    ends, at = [0], 0
    for b in items:
        at += len(b)
        ends.append(at)
    return struct.pack(f">i{len(ends)}i", len(items), *ends) + b"".join(items)


class BlobReader:
    """Reads values where they lie; nothing but the header and the roots is read on opening."""

    def __init__(self, data: bytes, signed_hash: bool = False) -> None:
        if len(data) < HEADER:
            raise BlobError("the header is cut")
        version, count = struct.unpack_from(">ii", data)
        if version != VERSION or count != len(ORDER):
            raise BlobError(f"version {version} with {count} tables")
        offsets = struct.unpack_from(f">{count}i", data, 8)
        if offsets[0] != HEADER or any(a >= b for a, b in zip(offsets, (*offsets[1:], len(data) + 1), strict=True)):
            raise BlobError("the offsets aren't in order")
        self.data, self.signed = data, signed_hash
        self.at = dict(zip(ORDER, offsets, strict=True))
        (self.buckets,) = struct.unpack_from(">H", data, HEADER - 2)
        self.roots: dict[str, tuple[int, int]] = {}
        for i in range(self.count("root")):
            name, kind, ref = struct.unpack_from(">iBi", data, self.at["root"] + 4 + 9 * i)
            self.roots[self.scalar("string", name)] = (kind, ref)

    def count(self, table: str) -> int:
        return struct.unpack_from(">i", self.data, self.at[table])[0]

    def _piece(self, table: str, i: int) -> tuple[int, int]:
        n, at = self.count(table), self.at[table]
        if not 0 <= i < n:
            raise BlobError(f"no row {i} in {table}")
        a, b = struct.unpack_from(">ii", self.data, at + 4 + 4 * i)
        base = at + 4 + 4 * (n + 1)
        return base + a, base + b

    def scalar(self, table: str, i: int) -> Any:
        if table in FIXED:
            if not 0 <= i < self.count(table):
                raise BlobError(f"no row {i} in {table}")
            return struct.unpack_from(FIXED[table], self.data, self.at[table] + 4 + struct.calcsize(FIXED[table]) * i)[0]
        a, b = self._piece(table, i)
        if table == "string":
            return self.data[a:b].decode("utf-8", "surrogatepass")
        if table == "bigint":
            return int_from_bytes(self.data[a:b])
        signum, _, scale = struct.unpack_from(">iii", self.data, a)
        digits = whole_digits(abs(int_from_bytes(self.data[a + 12 : b])))
        return Decimal((1 if signum < 0 else 0, tuple(map(int, digits)), -scale))

    def _entries(self, i: int) -> tuple[int, int, int]:
        """(place of the entries, their number, place of the index or 0)."""
        a, _ = self._piece("object", i)
        (mark,) = struct.unpack_from(">H", self.data, a)
        index = 0 if mark == NO_INDEX else a
        at = a + (2 if mark == NO_INDEX else 2 * self.buckets)
        return at + 4, struct.unpack_from(">i", self.data, at)[0], index

    def field(self, ref: tuple[int, int], key: str) -> tuple[int, int]:
        """The reference of a member, by its bucket. KeyError if there is none or it's no object."""
        if KIND.get(ref[0]) != "object":
            raise KeyError(key)
        at, n, index = self._entries(ref[1])
        lo, hi = 0, n
        if index:
            b = khash_of(key, self.signed) // ((1 << 32) // self.buckets)
            (lo,) = struct.unpack_from(">H", self.data, index + 2 * b)
            if b + 1 < self.buckets:
                (hi,) = struct.unpack_from(">H", self.data, index + 2 * b + 2)
        for i in range(lo, hi):
            name, kind, r = struct.unpack_from(">iBi", self.data, at + 9 * i)
            if self.scalar("string", name) == key:
                return kind, r
        raise KeyError(key)

    def element(self, ref: tuple[int, int], i: int) -> tuple[int, int]:
        """The reference of an element; negative from the end. KeyError out of range or if it's no array."""
        if KIND.get(ref[0]) != "array":
            raise KeyError(i)
        a, _ = self._piece("array", ref[1])
        (n,) = struct.unpack_from(">i", self.data, a)
        j = i + n if i < 0 else i
        if not 0 <= j < n:
            raise KeyError(i)
        return struct.unpack_from(">Bi", self.data, a + 4 + 5 * j)

    def follow(self, root: str, steps: Sequence[str | int]) -> tuple[int, int]:
        """The reference at a path of a root. KeyError where there is none."""
        ref = self.roots[root]
        for s in steps:
            if isinstance(s, str) and KIND.get(ref[0]) == "array" and re.fullmatch(r"-?[0-9]+", s):
                s = int(s)
            ref = self.element(ref, s) if isinstance(s, int) else self.field(ref, s)
        return ref

    def query(self, root: str, steps: Sequence[str | int]) -> Any:
        """The value at a path of a root."""
        return self.value(self.follow(root, steps))

    def value(self, ref: tuple[int, int]) -> Any:
        """The whole value below a reference."""
        kind, n = KIND.get(ref[0]), ref[1]
        if kind is None:
            raise BlobError(f"unknown marker {ref[0]}")
        if kind == "null":
            return None
        if kind == "bit":
            return bool(n)
        if kind in ("byte", "short"):
            return n
        if kind == "array":
            a, _ = self._piece("array", n)
            (size,) = struct.unpack_from(">i", self.data, a)
            return [self.value(struct.unpack_from(">Bi", self.data, a + 4 + 5 * i)) for i in range(size)]
        if kind == "object":
            at, size, _ = self._entries(n)
            out = {}
            for i in range(size):
                name, k, r = struct.unpack_from(">iBi", self.data, at + 9 * i)
                out[self.scalar("string", name)] = self.value((k, r))
            return out
        v = self.scalar(kind, n)
        return float(str(_single(v))) if kind == "float" else v


def _single(v: float) -> Any:
    import numpy as np

    return np.float32(v)


def json_text(value: Any) -> str:
    """JSON text; decimals are written with all their digits."""
    if isinstance(value, Decimal):
        return format(value, "f") if abs(value.adjusted()) < 40 else str(value)
    if isinstance(value, int) and not isinstance(value, bool):
        return whole_digits(value)
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + json_text(v) for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(json_text, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def encode(documents: Mapping[str, Any], **settings: Any) -> bytes:
    """Blob of documents by root name: parsed values, JSON text or UTF-8 bytes."""
    builder = BlobBuilder(**settings)
    for name, doc in documents.items():
        builder.append(name, parse_exact(doc.decode() if isinstance(doc, bytes) else doc) if isinstance(doc, (str, bytes)) else doc)
    return builder.build()


def decode(data: bytes) -> dict[str, Any]:
    """All roots of a blob."""
    reader = BlobReader(data)
    return {name: reader.value(ref) for name, ref in reader.roots.items()}
