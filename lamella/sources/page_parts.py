"""The passes over the characters of stored pages, in Arrow batches inside tasks; what the parts mean is told in Spark (``result_pages``).

Regular expressions of nested higher-order functions took more time for this than all else (figures in README.md). Patterns mean
what they do in Java: case is ignored for ASCII only, digits and white space are ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from itertools import accumulate, chain, pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[ \t\n\x0b\f\r]"
_TAG, _SPACES = re.compile("<[^>]*>"), re.compile(_SPACE + r"{2,}|[\t\n\x0b\f\r]")  # single spaces stay as they are
_QUOTED = """["'][^"']*"""


def _element(tag: str) -> re.Pattern:
    """An element up to the first end of its tag, with the inside as group 1."""
    end = rf"/(?ai:{tag})>"
    return re.compile(rf"<(?ai:{tag})\b[^>]*>([^<]*+(?:<(?!{end})[^<]*+)*+)<{end}")


_LIST, _TABLE, _ROW, _CELL, _HEAD, _ITEM = (_element(t) for t in ("ul", "table", "tr", "td", "th", "li"))
_LISTS = re.compile(r"<(?ai:ul)\b")


def _opening(tag: str, name: str) -> re.Pattern:
    return re.compile(rf"<(?ai:{tag})\b(?=[^>]*\b(?ai:class){_SPACE}*={_SPACE}*{_QUOTED}\b(?ai:{name})\b)")


_COLUMNS, _BOXES = _opening("td", "row_table"), _opening("tr", "user_box")
_WHOLE = re.compile("-?[0-9]+")
_NUMBERED, _FIRST = re.compile(r"row(?<!\wrow)0*([0-9]+)\b"), re.compile(r"<(?ai:td)\b[^>]*\b(?ai:row)0*1\b")
_FIELDS = ("num", "user_name", "user_aff")
_NUM, _NAME, _AFF = (  # a first letter that is a set of characters is looked for far faster than a word boundary
    re.compile(rf"[cC](?<!\w[cC])(?ai:lass){_SPACE}*={_SPACE}*{_QUOTED}\b(?ai:{n})\b[^\"']*[\"'][^>]*>([^<]*+(?:<(?!/)[^<]*+)*+)</") for n in _FIELDS
)


def _parts(page: str, opening: re.Pattern) -> list[str]:
    """The page from each opening tag to the next one."""
    return [page[a:b] for a, b in pairwise([*(m.start() for m in opening.finditer(page)), len(page)])]


class _Kept(dict):
    """By pieces of text what ``read`` gives for them; short ones, as cells of a matrix are, are kept for when they come again."""

    most = 1 << 14

    def __missing__(self, piece: str) -> str | int | None:
        found = self.read(piece)
        if len(piece) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[piece] = found
        return found


class Texts(_Kept):
    """What ``result_pages.text_of`` gives."""

    def __init__(self, entities: dict[str, str]):
        self.entities = entities

    def read(self, piece: str) -> str:
        plain = _TAG.sub(" ", piece) if "<" in piece else piece
        if "&" in plain:
            for name, char in self.entities.items():
                plain = plain.replace(name, char)
        return _SPACES.sub(" ", plain).strip(" ")


class _Classes(_Kept):
    """What the class of a plain tag names, by the tag's rest from the quote on: the number of a box's field, 3 for a box, 4 for a column, 5 for nothing; 6 for several of these, or if the tag isn't plain."""

    plain = re.compile("[\"']([^\"'<>]*)[\"'][^<>]*")
    words = [re.compile(rf"\b(?ai:{n})\b") for n in (*_FIELDS, "user_box", "row_table")]

    def read(self, piece: str) -> int:
        found = self.plain.fullmatch(piece)
        named = [i for i, w in enumerate(self.words) if w.search(found[1])] if found else [6]
        return 6 if len(named) > 1 else named[0] if named else 5


class _Numbers(_Kept):
    """The whole number of 32 bits at the beginning of a text; null without one."""

    def read(self, piece: str) -> int | None:
        found = _WHOLE.match(piece)
        number = int(found[0]) if found and len(found[0]) < 4000 else None
        return number if number is not None and -(1 << 31) <= number < 1 << 31 else None


def _listed(sizes: Iterable[int], values: pa.Array) -> pa.Array:
    """``values`` dealt out to lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


def _lists(parts: list[Sequence], values: Callable[[list], pa.Array]) -> pa.Array:
    """An array of lists, with ``values`` of all their elements."""
    return _listed(map(len, parts), values(list(chain.from_iterable(parts))))


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def list_tables(html: Column, mark: str, entities: dict[str, str], least_cells: int, matrix: bool = True) -> Column:
    """array<struct<items, heads: array<string>, rows: array<array<struct<text, number: int>>>>>: the lists that hold ``mark`` with the first table before the next list: texts of items, of head cells, and of the cells of each row that has any.

    A cell's number is the whole number at the beginning of its text, null without one. Rows of fewer than ``least_cells`` cells are empty; without ``matrix`` the cells between the first three and the last four are left out.
    """

    def told(cells: list[str]) -> list[str]:
        if len(cells) < least_cells:
            return []
        return cells if matrix or len(cells) <= 7 else cells[:3] + cells[-4:]

    def found(page: str | None, texts: Texts) -> list[tuple]:
        blocks = []
        for part in _parts(page or "", _LISTS):
            head = _LIST.match(part)
            table = _TABLE.search(part) if head and mark in head[1] else None
            if table:
                rows = [told(cells) for r in _ROW.findall(table[1]) if (cells := _CELL.findall(r))]
                blocks.append(([texts[i] for i in _ITEM.findall(head[1])], [texts[h] for h in _HEAD.findall(table[1])], rows))
        return blocks

    def arrow(blocks: list[tuple], texts: Texts) -> pa.Array:
        numbers = _Numbers()

        def read(cells: list[str]) -> pa.Array:
            told = list(map(texts.__getitem__, cells))
            return pa.StructArray.from_arrays([_strings(told), pa.array(map(numbers.__getitem__, told), pa.int32(), size=len(told))], ["text", "number"])

        parts = [_lists([b[i] for b in blocks], _strings) for i in (0, 1)]
        return pa.StructArray.from_arrays([*parts, _lists([b[2] for b in blocks], lambda rows: _lists(rows, read))], ["items", "heads", "rows"])

    @F.arrow_udf("array<struct<items:array<string>,heads:array<string>,rows:array<array<struct<text:string,number:int>>>>>")
    def tables_behind_lists(pages: pa.Array) -> pa.Array:
        texts = Texts(entities)
        return _lists([found(p, texts) for p in pages.to_pylist()], lambda blocks: arrow(blocks, texts))

    return tables_behind_lists(html)


def boxed_columns(html: Column, entities: dict[str, str], only: int | None = None) -> Column:
    """struct<first: int, columns: array<struct<col: int, entries: array<struct<seed: int, name, aff: string>>>>>: the columns of a bracket's page from the left, those numbered ``only`` if given,
    with their entries (0 and null where a part is missing), and how many entries the first column (``row01`` in its tag) has."""

    def wanted(col: int | None) -> bool:
        return col is not None and (only is None or col == only)

    def plain(page: str, told: tuple[list, ...], texts: Texts, classes: _Classes, numbers: _Numbers) -> tuple[int, list[list]] | None:
        """What ``found`` gives, by one pass over the classes of a page; null where one's tag isn't plain or a field holds more than text."""
        parts = page.split(" class=")
        if page.lower().count("class") != len(parts) - 1:
            return None
        first, column, open_box, columns = None, None, False, []
        for before, part in pairwise(parts):
            end = part.find(">")
            named = classes[part[:end]] if end >= 0 else 6
            if named < 3:
                if open_box:
                    close = part.find("<", end)
                    if not part.startswith("</", close):
                        return None
                    if told[named][-1] is None:
                        told[named][-1] = texts[part[end + 1 : close]]
            elif named < 5:
                tag = before[before.rfind(">") + 1 :]
                name = tag[tag.find("<") :].lower()
                if tag.count("<") != 1 or (name[:3] in ("<td", "<tr") and len(name) > 3):
                    return None
                if named == 3 and name == "<tr" and column:
                    column[1] += 1
                    open_box = wanted(column[0])
                    if open_box:
                        for field in told:
                            field.append(None)
                elif named == 4 and name == "<td":
                    number, open_box = _NUMBERED.search(part, 0, end), False
                    if not number:
                        return None
                    column = [numbers[number[1]], 0]
                    columns.append(column)
                    if first is None and _FIRST.match("<td class=" + part[:end]):
                        first = column
            elif named == 6:
                return None
        return first[1] if first else 0, [c for c in columns if wanted(c[0])]

    def found(page: str, told: tuple[list, ...], texts: Texts, classes: _Classes, numbers: _Numbers) -> tuple[int, list[list]]:
        """How many boxes the first column has, and number and boxes of each column wanted; the fields of these boxes are added to ``told``."""
        before = len(told[0])
        if read := plain(page, told, texts, classes, numbers):
            return read
        for field in told:
            del field[before:]
        pieces, columns = _parts(page, _COLUMNS), []
        for piece in pieces:
            number = _NUMBERED.search(piece)
            col = numbers[number[1]] if number else None
            if wanted(col):
                boxes = _parts(piece, _BOXES)
                columns.append([col, len(boxes)])
                for field, pattern in zip(told, (_NUM, _NAME, _AFF), strict=True):
                    field.extend(texts[m[1]] if (m := pattern.search(b)) else None for b in boxes)
        return len(_BOXES.findall(next((p for p in pieces if _FIRST.match(p)), ""))), columns

    @F.arrow_udf("struct<first:int,columns:array<struct<col:int,entries:array<struct<seed:int,name:string,aff:string>>>>>")
    def user_boxes(pages: pa.Array) -> pa.Array:
        texts, classes, numbers = Texts(entities), _Classes(), _Numbers()
        told = nums, names, affs = [], [], []  # of all boxes, as lists of texts are made far faster than a list for each box
        read = [found(p or "", told, texts, classes, numbers) for p in pages.to_pylist()]
        columns = list(chain.from_iterable(r[1] for r in read))
        seeds = pa.array([max(numbers[n or ""] or 0, 0) for n in nums], pa.int32())
        entries = pa.StructArray.from_arrays([seeds, *(_strings([t or None for t in field]) for field in (names, affs))], ["seed", "name", "aff"])
        boxed = pa.StructArray.from_arrays([pa.array([c[0] for c in columns], pa.int32()), _listed([c[1] for c in columns], entries)], ["col", "entries"])
        return pa.StructArray.from_arrays([pa.array([r[0] for r in read], pa.int32()), _listed([len(r[1]) for r in read], boxed)], ["first", "columns"])

    return user_boxes(html)
