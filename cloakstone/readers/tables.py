"""Tables in text as grids of cells, whatever their layout: separators, boxes, dash rules, aligned columns, tuples and lists, HTML, vertical records.

A grid is a header and rows of cell places. Which headers matter is the caller's: a header line is looked at as a table only if it says so."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

Cell = tuple[int, int]
#: Of a header, how many of its columns matter.
Wanted = Callable[[list[str]], int]


class Grid(NamedTuple):
    heads: list[str]
    rows: list[list[Cell]]
    aligned: bool = False  # columns found by position alone


_BARS = "|│┆┃"
#: A line that only rules: dashes, box corners, padding.
_RULE = re.compile(r"[\s\-=+|:─━═┄┈│┆┃┼╪╬├┤╞╡┌┐└┘┬┴╤╧╭╮╰╯╺╸┠┨┝┥┿]*")
_END = re.compile(r"\s*(?:\(\d+ rows?.*|\[\d+ rows x \d+ columns\].*|\d+ rows? (?:in set|selected).*)?")
_BAND = re.compile(r"\s*-{3,}(?:\s+-{3,})*\s*")
_DTYPES = re.compile(r"(?i)-{2,3}|<?(?:chr|str|int|dbl|lgl|date|dttm|fct)\d*>?|varchar|u?int(?:eger|\d+)?|bigint|double|float\d*|bool(?:ean)?|object|string|timestamp|decimal(?:\(.*\))?|…|\.\.\.?")


def trimmed(s: str, a: int, b: int) -> Cell:
    """Without white space and one pair of quotes around it."""
    while a < b and s[a].isspace():
        a += 1
    while b > a and s[b - 1].isspace():
        b -= 1
    if b - a > 1 and s[a] == s[b - 1] and s[a] in "\"'`":
        a, b = a + 1, b - 1
    return a, b


def split_cells(s: str, a: int, b: int, sep: str) -> list[Cell]:
    """Cells of a line; separators inside double quotes belong to a cell."""
    out, at, quoted = [], a, False
    if '"' not in s[a:b]:
        for piece in s[a:b].split(sep):
            out.append(trimmed(s, at, at + len(piece)))
            at += len(piece) + 1
        return out
    for i in range(a, b):
        if s[i] == '"':
            quoted = not quoted
        elif s[i] == sep and not quoted:
            out.append(trimmed(s, at, i))
            at = i + 1
    return [*out, trimmed(s, at, b)]


def _bars(s: str, a: int, b: int) -> list[Cell]:
    """Cells between bars; the outer ones may be missing."""
    cuts = [i for i in range(a, b) if s[i] in _BARS]
    edges = [a - 1, *cuts, b]
    cells = [trimmed(s, x + 1, y) for x, y in zip(edges, edges[1:], strict=False)]
    if cells and cells[0][0] >= cells[0][1] and s[a:b].lstrip()[:1] in _BARS:
        cells = cells[1:]
    if cells and cells[-1][0] >= cells[-1][1] and s[a:b].rstrip()[-1:] in _BARS:
        cells = cells[:-1]
    return cells


def _texts(s: str, cells: list[Cell]) -> list[str]:
    return [s[a:b].strip("\"'`* ") for a, b in cells]


def _occupied(line: str) -> int:
    """Bit i: character i is no blank."""
    return int("".join("0" if c in " \t" else "1" for c in reversed(line)) or "0", 2)


#: Labels of aligned columns don't end in punctuation.
_SENTENCE = re.compile(r"[.,;:!?](?:\s|$)")


def _aligned(s: str, lines: list[Cell], i: int, wanted: Wanted) -> tuple[Grid, int] | None:
    """Columns parted by positions that are blank on every accepted line. Labels parted by two blanks or by one: what gives a wanted header with
    more columns counts."""
    a, b = lines[i]
    line = s[a:b]
    if _SENTENCE.search(line):
        return None
    best = None
    for gap in (r"\S+(?: \S+)*", r"\S+"):
        heads = list(re.finditer(gap, line))
        matter = wanted([h[0] for h in heads]) if len(heads) > 1 else 0
        if not matter:
            continue
        gaps = [((1 << y.start()) - 1) & ~((1 << x.end()) - 1) for x, y in zip(heads, heads[1:], strict=False)]
        union, j = _occupied(line), i + 1
        taken = []
        while j < len(lines):
            row = s[lines[j][0] : lines[j][1]]
            if _END.fullmatch(row) or _RULE.fullmatch(row):
                if _RULE.fullmatch(row) and row.strip():
                    j += 1
                    continue
                break
            both = union | _occupied(row)
            if any(not g & ~both for g in gaps):
                break
            union, j = both, j + 1
            taken.append(j - 1)
        if taken and (best is None or matter > best[2]):
            free = [(g & ~union).bit_length() - 1 for g in gaps]  # the last blank position of each gap
            best = (heads, [(taken, free)], matter, j)
    if best is None:
        return None
    heads, [(taken, free)], _, j = best
    rows = []
    for k in taken:
        a, b = lines[k]
        cuts = [min(a + c, b) for c in free]
        # what stands left of the first label's column (a row number) is cut off by the blanks before it
        cells = [trimmed(s, x, y) for x, y in zip([a, *cuts], [*cuts, b], strict=True)]
        first = re.match(r"\s*(?:\d+|\.\.)\s+(?=\S)", s[cells[0][0] : cells[0][1] + 1])
        if first and re.match(r"\s", s[lines[i][0] : lines[i][0] + 1]):
            cells[0] = trimmed(s, cells[0][0] + first.end(), cells[0][1])
        rows.append(cells)
    return Grid([h[0] for h in heads], rows, True), j


def _lines(s: str, wanted: Wanted) -> Iterator[Grid]:
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\n]*\n?", s) if m[0]]
    lines = [(a, b - (s[b - 1] == "\n")) for a, b in lines]
    i = 0
    while i < len(lines) - 1:
        a, b = lines[i]
        line = s[a:b]
        if _RULE.fullmatch(line):
            i += 1
            continue
        nxt = s[lines[i + 1][0] : lines[i + 1][1]]
        cut = None
        if any(c in line for c in _BARS):
            cut = _bars
        else:
            sep = next((x for x in "\t,;" if line.count(x) and (len(split_cells(s, a, b, x)) == len(split_cells(s, *lines[i + 1], x)))), None)
            if sep:
                cut = lambda s, a, b, sep=sep: split_cells(s, a, b, sep)
        if cut is None and _BAND.fullmatch(nxt):
            bands = [m.span() for m in re.finditer(r"-{3,}", nxt)]
            bands = [(x, bands[k + 1][0] if k + 1 < len(bands) else 1 << 30) for k, (x, _) in enumerate(bands)]
            cut = lambda s, a, b, bands=bands: [trimmed(s, min(a + x, b), min(a + y, b)) for x, y in bands]
        if cut is None:
            if got := _aligned(s, lines, i, wanted):
                yield got[0]
                i = got[1]
                continue
            i += 1
            continue
        heads = _texts(s, cut(s, a, b))
        if not wanted(heads):
            i += 1
            continue
        rows, i = [], i + 1
        while i < len(lines):
            a, b = lines[i]
            line = s[a:b]
            if line.strip() and _RULE.fullmatch(line):
                i += 1
                continue
            if _END.fullmatch(line):
                break
            cells = cut(s, a, b)
            if len(cells) < len(heads):
                break
            if not all(_DTYPES.fullmatch(t) or not t for t in _texts(s, cells)):
                rows.append(cells)
            i += 1
        if rows:
            yield Grid(heads, rows)


_TUPLE = re.compile(r"[(\[]\s*(?:'[^'\n]{0,500}'|\"[^\"\n]{0,500}\"|[\w.\-]{1,100})(?:\s*,\s*(?:'[^'\n]{0,500}'|\"[^\"\n]{0,500}\"|[\w.\-]{1,100}))+\s*,?\s*[)\]]")
_ITEM = re.compile(r"'[^'\n]*'|\"[^\"\n]*\"|[\w.\-]+")


def _tuples(s: str, wanted: Wanted) -> Iterator[Grid]:
    """Tuples or lists of literals one behind the other, the first of which is the header."""
    grid, end = None, 0
    for m in _TUPLE.finditer(s):
        cells = [trimmed(s, m.start() + c.start(), m.start() + c.end()) for c in _ITEM.finditer(m[0])]
        if grid and re.fullmatch(r"[\s,]*", s[end : m.start()]) and len(cells) == len(grid.heads):
            grid.rows.append(cells)
        else:
            if grid and grid.rows:
                yield grid
            heads = _texts(s, cells)
            grid = Grid(heads, []) if m[0].count("'") + m[0].count('"') == 2 * len(cells) and wanted(heads) else None
        end = m.end()
    if grid and grid.rows:
        yield grid


_ROW = re.compile(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>|</table")
_HTML_CELL = re.compile(r"(?is)<t[hd]\b[^>]*>\s*(?:<(?!/t[hd])[^>]*>\s*)*([^<]*?)\s*(?:<|$)")


def _html(s: str, wanted: Wanted) -> Iterator[Grid]:
    grid = None
    for m in _ROW.finditer(s):
        if not m[1]:
            if grid and grid.rows:
                yield grid
            grid = None
            continue
        cells = [(m.start(1) + c.start(1), m.start(1) + c.end(1)) for c in _HTML_CELL.finditer(m[1])]
        if grid:
            grid.rows.append(cells)
        elif len(cells) > 1 and wanted(heads := _texts(s, cells)):
            grid = Grid(heads, [])
    if grid and grid.rows:
        yield grid


_RECORD = re.compile(r"(?m)^(?:-\[ ?RECORD \d+ ?\][-+]*|\*{3,} ?\d+\. row ?\*{3,}|@ Row \d+)[ ]*$")
_FIELD = re.compile(r"[ \t]*([\w ]{1,60}?)[ \t]*[|:][ \t]+(\S[^\n]*?)[ \t]*(?:\n|$)")


def _vertical(s: str, wanted: Wanted) -> Iterator[Grid]:
    """Records of one `label | value` line for each column, under a line that numbers the record."""
    for m in _RECORD.finditer(s):
        at, heads, cells = m.end() + 1, [], []
        while f := _FIELD.match(s, at):
            heads.append(f[1])
            cells.append(f.span(2))
            at = f.end()
        if len(heads) > 1 and wanted(heads):
            yield Grid(heads, [cells])


def _without_records(s: str) -> str:
    """The text with the lines of vertical records left blank, in place: a line belongs to one layout."""
    out, last = [], 0
    for m in _RECORD.finditer(s):
        at = m.end() + 1
        while f := _FIELD.match(s, at):
            at = f.end()
        out += (s[last : m.start()], re.sub(r"[^\n]", " ", s[m.start() : at]))
        last = max(last, min(at, len(s)))
    return "".join([*out, s[last:]])


def grids(s: str, wanted: Wanted) -> Iterator[Grid]:
    """All tables of a text whose header is wanted."""
    if "<tr" in s or "<TR" in s:
        yield from _html(s, wanted)
    if "RECORD" in s or ". row" in s:
        yield from _vertical(s, wanted)
    if "('" in s or "['" in s or '("' in s or '["' in s:
        yield from _tuples(s, wanted)
    if "\n" in s:
        yield from _lines(_without_records(s) if "RECORD" in s or ". row" in s else s, wanted)
