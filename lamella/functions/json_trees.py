"""JSON trees as text: keys renamed at any depth, and lists of objects grouped by a field."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def renamed_keys(text: Column | str, names: dict[str, str]) -> Column:
    """JSON text with keys renamed at every depth, all at once (an exchange of two names is one).

    A key is a quoted name with a colon behind it. Within a string value quotes are escaped, so what looks
    like a key there isn't one; values, order and white space stay. Names must not hold quotes or backslashes. Null stays null.
    """
    c = F.col(text) if isinstance(text, str) else text
    marks = {old: f"\u0001{i}\u0002" for i, old in enumerate(names)}
    marked = reduce(lambda t, old: F.regexp_replace(t, rf'(?<!\\)"{re.escape(old)}"(?=\s*:)', f'"{marks[old]}"'), names, c)
    return reduce(lambda t, old: F.replace(t, F.lit(f'"{marks[old]}"'), F.lit(f'"{names[old]}"')), names, marked)


def every_key(text: Column | str) -> Column:
    """All keys of a JSON text, at any depth, with repeats, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(c, F.lit(r'(?<!\\)"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))


def grouped(rows: Column | str, field: str, missing: str = "") -> Column:
    """An array of structs as a map from each value of ``field`` to its structs, both in order of first appearance; null values are ``missing``."""
    c = F.col(rows) if isinstance(rows, str) else rows
    name = lambda r: F.coalesce(r[field].cast("string"), F.lit(missing))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(c, name)), lambda k: F.struct(k, F.filter(c, lambda r: name(r) == k))))
