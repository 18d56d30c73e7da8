"""Texts set in boxes: lines by the widths of their characters, and the largest type size at which a text fits.

Widths are whole thousandths of the type size, given as a table of characters and one width for all others, so a line's width is exact
arithmetic and needs no font. A word wider than the box is broken between characters. Lines and sizes are Arrow functions: words are measured
once a text, and a size is given up at its first line too many.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, col

#: Characters and their width; others have OTHER.
WIDTHS: tuple[tuple[str, int], ...] = (("iljI.,:;!|'`", 260), (" ftr()[]{}\"/-", 340), ("mwMW@%", 880), ("ABCDEFGHKLNOPQRSTUVXYZĐÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂƯƠ", 690), ("0123456789", 560))
OTHER, HEIGHT = 550, 940
ELLIPSIS = "…"

_EACH = {c: width for characters, width in WIDTHS for c in characters}
_FITTED = pa.struct([("size", pa.int32()), ("lines", pa.list_(pa.string()))])


@dataclass(frozen=True)
class Box:
    width: int
    lines: int
    height: int
    largest: int
    least: int
    spacing: int
    step: int = 2


# The boxes of a card's title and summary.
TITLE, SUMMARY = Box(968, 4, 246, 64, 48, 12), Box(968, 5, 250, 40, 34, 10)


def em(text: Column, widths: tuple[tuple[str, int], ...] = WIDTHS, other: int = OTHER) -> Column:
    """Width of a text at a type size of 1000."""
    out = F.length(text) * other
    for characters, width in widths:
        out = out + (F.length(text) - F.length(F.translate(text, characters, ""))) * (width - other)
    return out.cast("int")


def _em(text: str) -> int:
    return sum(_EACH.get(c, OTHER) for c in text)


def _lines(words: list[tuple[str, int]], most: int, enough: int | None = None) -> list[str]:
    """Lines of words with their widths, none wider than `most`; a word that is too wide as pieces of as many characters as fit, one at least.
    With `enough`, no more than one line above it is made."""
    lines: list[str] = []
    line, width, space = "", 0, _EACH[" "]
    for word, e in words:
        if e > most:
            if line:
                lines.append(line)
            line, width = "", 0
            for c in word:
                w = _EACH.get(c, OTHER)
                if line and width + w > most:
                    lines.append(line)
                    line, width = c, w
                else:
                    line, width = line + c, width + w
        elif line and width + space + e <= most:
            line, width = f"{line} {word}", width + space + e
        else:
            if line:
                lines.append(line)
            line, width = word, e
        if enough is not None and len(lines) > enough:
            return lines
    return [*lines, line] if line else lines


def _shortened(line: str, most: int) -> str:
    start = line.rstrip(" ")
    while start and _em(start) + _em(ELLIPSIS) > most:
        start = start[:-1].rstrip(" ")
    return start + ELLIPSIS


def _measured(text: str, known: dict[str, int]) -> list[tuple[str, int]]:
    """The words of a text (white space single) and their widths, which `known` keeps."""
    words = [w for w in text.split(" ") if w]
    for w in words:
        if w not in known:
            known[w] = _em(w)
    return [(w, known[w]) for w in words]


def _fitted(words: list[tuple[str, int]], box: Box) -> tuple[int, list[str]]:
    least = max(1, min(box.least, box.largest))
    for size in range(box.largest, least - 1, -box.step):
        room = min(box.lines, box.height // (size * HEIGHT // 1000 + box.spacing))
        lines = _lines(words, box.width * 1000 // size, room)
        if len(lines) <= room:
            return size, lines
    most = box.width * 1000 // least
    room = max(0, min(box.lines, box.height // (least * HEIGHT // 1000 + box.spacing)))
    lines = _lines(words, most, room)
    if len(lines) <= room or not room:
        return least, lines[:room]
    return least, [*lines[: room - 1], _shortened(lines[room - 1], most)]


def wrap(text: Column | str, size: Column, width: int) -> Column:
    """Lines of a text, white space single: as many words on each as the width takes."""

    @F.arrow_udf("array<string>")
    def lines(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        rows = [None if s is None else _lines(_measured(t, known), width * 1000 // s) for t, s in zip(texts.to_pylist(), sizes.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.string()))

    return lines(clean(col(text)), size)


def shortened(line: Column, size: Column, width: int) -> Column:
    """A line with an ellipsis, without so many of its last characters that both fit."""

    @F.arrow_udf("string")
    def short(lines: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = zip(lines.to_pylist(), sizes.to_pylist(), strict=True)
        return pa.array([None if t is None or s is None else _shortened(t, width * 1000 // s) for t, s in rows], pa.string())

    return short(line, size)


def fit(text: Column | str, box: Box) -> Column:
    """size and lines of a text in a box: the largest size of the box's steps at which all lines fit, else as many lines at the least size
    as the box takes, the last one shortened."""

    @F.arrow_udf("struct<size: int, lines: array<string>>")
    def fitted(texts: pa.Array) -> pa.Array:
        known: dict[str, int] = {}
        rows = [_fitted(_measured(t, known), box) for t in texts.to_pylist()]
        return pa.array([{"size": size, "lines": lines} for size, lines in rows], _FITTED)

    return fitted(clean(col(text)))
