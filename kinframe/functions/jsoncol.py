"""JSON text columns as typed data; malformed text is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def owned_json(column: str | Column, struct: T.StructType | str) -> Column:
    """A struct from the text of a JSON object; null where the text is malformed or no object."""
    c = _column(column)
    made = F.from_json(c, struct)
    return F.when(F.get_json_object(c, "$").startswith("{"), made)


def json_array(column: str | Column, element: str = "string") -> Column:
    """An array from the text of a JSON array; null where the text is malformed or no array."""
    c = _column(column)
    return F.when(F.get_json_object(c, "$").startswith("["), F.from_json(c, f"array<{element}>"))


def json_value(column: str | Column, path: str, kind: str = "string") -> Column:
    """The scalar at a path as ``kind``; null if it is missing, an object, an array or not of that kind."""
    found = F.get_json_object(_column(column), path)
    # an object or array comes back as JSON text; a string that only looks like one is told apart by its own parse
    nested = found.rlike(r"^\s*[\[{]") & F.get_json_object(found, "$").isNotNull()
    return F.when(~nested, found).try_cast(kind)
