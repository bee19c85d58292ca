"""The user's surface: cursors over documents, and packing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jsonloom.functions import extract, paths
from jsonloom.functions.khash import khash
from jsonloom.functions.paths import Step
from jsonloom.operators.aggregate import Aggregate
from jsonloom.sources.datasource import to_variant

__all__ = ["Aggregate", "ArrayCursor", "Cursor", "documents"]


def documents(df: DataFrame, root: str | Column, body: str) -> DataFrame:
    """(root, v): documents of a STRING, BINARY, STRUCT or VARIANT column, parsed. A body that is no JSON gives NULL."""
    r = F.col(root) if isinstance(root, str) else root
    return df.select(r.cast("string").alias("root"), to_variant(F.col(body), df.schema[body].dataType).alias("v"))


class Cursor:
    """A position in the documents of a VARIANT column, and the path that led there. Every move gives a
    new cursor and builds a Column; nothing is computed before the DataFrame runs.

    strict: moves to nowhere and extractions of another kind raise an error in the query, instead of NULL.
    text: the column with the documents' JSON text. With it numbers at fixed paths that VARIANT rounds (with an exponent, or more than
        38 digits) are classified and extracted by their own text, exactly; without it as the doubles they became."""

    def __init__(self, value: Column, path: tuple[Step, ...] = (), strict: bool = False, text: Column | None = None) -> None:
        self.value, self.path, self.strict, self.text = value, path, strict, text

    def _at(self, value: Column, *steps: Step) -> Cursor:
        return Cursor(value, (*self.path, *steps), self.strict, self.text)

    def _to(self, steps: list[Step]) -> Cursor:
        return self._at(paths.compile_steps(self.value, steps, self.strict), *steps)

    def query(self, path: str) -> Cursor:
        """Follow a path of the path language."""
        return self._to(paths.parse_path(path))

    def read(self, *segments: Step) -> Cursor:
        """Follow steps given one by one; a key may hold dots and be empty. ``"[3]"`` is an index."""
        return self._to([int(s[1:-1]) if isinstance(s, str) and s[:1] == "[" and s[-1:] == "]" and s[1:-1].lstrip("-").isdigit() else s for s in segments])

    def field(self, key: str | Column) -> Cursor:
        """The member with exactly this key; an array has none."""
        if isinstance(key, str):
            return self._at(self._checked(paths.field_of(self.value, key)), key)
        return Cursor(self._checked(paths.field_of(self.value, key)), (*self.path, "*"), self.strict)  # of each row another

    def index(self, i: int) -> ArrayCursor:
        """The element at i, from the end if negative; an object has none."""
        return ArrayCursor(self, i)

    def down_index(self, i: int) -> ArrayCursor:
        """Into an array, to its element at i."""
        return ArrayCursor(self, i)

    def down_array(self) -> ArrayCursor:
        """Into an array, to its first element."""
        return ArrayCursor(self, 0)

    def as_object(self) -> Cursor:
        """The same position if an object stands there, else nowhere."""
        return self._at(self._checked(F.when(self.value.try_cast("map<string,variant>").isNotNull(), self.value)))

    def entries(self) -> Column:
        """ARRAY<STRUCT<key, value>> of an object's members in stored order, by key hash; NULL if it is none."""
        members = self.value.try_cast("map<string,variant>")
        order = F.array_sort(F.transform(F.map_keys(members), lambda k: F.struct(khash(k).alias("khash"), k.alias("key"))))
        return F.transform(order, lambda e: F.struct(e["key"].alias("key"), F.try_element_at(members, e["key"]).alias("value")))

    def read_key(self, i: int) -> Cursor:
        """The value of an object's i-th member in stored order."""
        entry = F.try_element_at(self.entries(), F.lit(i + 1 if i >= 0 else i))
        return Cursor(self._checked(entry["value"]), (*self.path, "*"), self.strict)

    def _checked(self, c: Column) -> Column:
        return F.coalesce(c, F.raise_error(F.lit("no such member")).cast("variant")) if self.strict else c

    def _literal(self) -> Column | None:
        return None if self.text is None or "*" in self.path else extract.literal_at(F.when(extract.may_round(self.text), self.text), self.path)

    def kind(self) -> Column:
        literal = self._literal()
        return extract.kind_of(self.value) if literal is None else extract.exact_kind(self.value, literal)

    def is_null(self) -> Column:
        return extract.is_json_null(self.value)

    def size(self) -> Column:
        return extract.size_of(self.value)

    def elements(self) -> Column:
        return extract.elements(self.value)

    def match(self, branches: Mapping[str, Column], default: Column | None = None) -> Column:
        return extract.match_kind(self.value, branches, default)

    def as_(self, target: str) -> Column:
        """The value as byte, short, int, long, bigint, float, double, bigdec, string or bit; bigint and bigdec as text."""
        return extract.as_kind(self.value, target, self.strict, self._literal())

    def render(self) -> str:
        return paths.render_path(self.path)


class ArrayCursor(Cursor):
    """A position in an array, that can move to its neighbours; from nowhere every move leads nowhere. ``at``: the same for all
    rows, or a column (with ``posexplode``, for one) that counts from 0. Where it is a column, as after a move, numbers
    are those that VARIANT holds."""

    def __init__(self, array: Cursor, at: int | Column, inside: Column | None = None) -> None:
        self.inside = extract.elements(array.value) if inside is None else inside
        place = F.lit(at + 1 if at >= 0 else at) if isinstance(at, int) else F.when(at >= 0, at + 1)
        super().__init__(array._checked(F.try_element_at(self.inside, place)), (*array.path, at if isinstance(at, int) else "*"), array.strict, array.text)
        self.array, self.at = array, at

    @staticmethod
    def over(inside: Column, at: Column) -> ArrayCursor:
        """A position in an ARRAY column, its elements taken out of the documents before and maybe read already (then
        ``value`` is all there is to ask for): moves only count, whatever stands in the array. NULL elements are places too."""
        return ArrayCursor(Cursor(inside), at, inside)

    def _moved(self, by: int) -> ArrayCursor:
        if isinstance(self.at, int):
            at = F.lit(self.at) if self.at >= 0 else F.size(self.inside) + self.at
        else:
            at = self.at
        there = self.value.isNotNull() if self.strict else at.between(0, F.size(self.inside) - 1)
        return ArrayCursor(self.array, F.when(there, at + by), self.inside)

    def left(self) -> ArrayCursor:
        """The element before; nowhere before the first."""
        return self._moved(-1)

    def right(self) -> ArrayCursor:
        """The element behind; nowhere behind the last."""
        return self._moved(1)
