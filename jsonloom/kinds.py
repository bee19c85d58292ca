"""Kinds of JSON values and which extractions each of them allows."""

from __future__ import annotations

# The kind markers of the binary format.
MARKER = {
    "null": 0, "bit": 1, "byte": 2, "short": 3, "int": 4, "long": 5, "bigint": 6, "double": 7, "float": 8, "bigdec": 9,
    "string": 10, "array": 11, "object": 12, "root": 15,
}
KIND = {v: k for k, v in MARKER.items()}

# The stored kinds that each extraction accepts. Nothing narrows, nothing reads strings.
ACCEPTS = {
    "byte": ("byte",),
    "short": ("byte", "short"),
    "int": ("byte", "short", "int"),
    "long": ("byte", "short", "int", "long"),
    "bigint": ("byte", "short", "int", "long", "bigint"),
    "float": ("byte", "short", "int", "long", "float"),
    "double": ("byte", "short", "int", "long", "float", "double"),
    "bigdec": ("byte", "short", "int", "long", "float", "double", "bigdec"),
    "string": ("string",),
    "bit": ("bit",),
}
#: bigint and bigdec are texts: no SQL number holds all their digits.
SQL_TYPE = {
    "byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "bigint": "string", "float": "float", "double": "double",
    "bigdec": "string", "string": "string", "bit": "boolean",
}
INLINE = ("null", "bit", "byte", "short")
TABLES = ("int", "long", "bigint", "float", "double", "bigdec", "string", "array", "object", "root")
MAX_KEYS = 65_533  # of an object in the binary container
