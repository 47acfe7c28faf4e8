"""Personal data by the name of its field, in text: field: value, INSERT, XML elements, delimited tables. Spans carry personal types ("=" in front)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.labels import field_value, label_class
from .base import Name, reader
from .tables import grids, split_cells

#: A sign between label and value, and the value: quoted, or up to a sign that ends it.
_SEPARATOR = re.compile(r"(?:=>|(?<![:=!<>])[:=](?![:=/]))[ \t]*(?:[rbuf]{1,2}(?=[\"']))?(\"[^\"\n]{1,120}\"|'[^'\n]{1,120}'|`[^`\n]{1,120}`|[^\n\"'`,;|{}\[\]<>]{1,120})")
_IN_LABEL = re.compile(r"[\wÀ-ÿ .\-/]")
_LONGEST_LABEL = 60


def _label(s: str, low: int, at: int) -> tuple[int, int]:
    """Place of the label that ends before a separator: letters, digits, blanks and a few signs, from a letter on."""
    while at > low and s[at - 1] in " \t":
        at -= 1
    if at > low and s[at - 1] in "\"'`":
        at -= 1
    a = at
    while a > low and at - a < _LONGEST_LABEL and _IN_LABEL.match(s[a - 1]):
        a -= 1
    while a < at and not (s[a].isalpha() or s[a] == "_"):
        a += 1
    return a, at


def _class(label: str) -> str:
    """Of a label's last one to three words."""
    words = label.strip().split(" ")
    for n in range(1, min(3, len(words)) + 1):
        if c := label_class(" ".join(words[-n:])):
            return c
    return ""


def _mark(start: int, value: str, of_class: str) -> Iterator[Name]:
    """A value, or each of several names."""
    lead = len(value) - len(value.lstrip())
    value = value.strip().rstrip(".,;")
    start += lead
    if of_class.startswith("name") and re.search(r"[/;&]", value):
        for piece in re.finditer(r"[^/;&]+", value):
            yield from _mark(start + piece.start(), piece[0], of_class)
    elif kind := field_value(of_class, value):
        yield Name(start, start + len(value), "=" + kind)


def _personal(near: str) -> bool:
    return any(_class(m[1]) not in ("", "name_loose", "email") for m in re.finditer(r"([A-Za-zÀ-ÿ_][\wÀ-ÿ\-]{0,40})[\"']?\s*[:=>]", near))


@reader("field", ":", "=")
def field(s: str) -> Iterator[Name]:
    """Labels and values; a name alone counts if its record (braces, or the line) has another personal field."""
    done = 0
    for m in _SEPARATOR.finditer(s):
        begin, end = _label(s, done, m.start())
        done = m.end() if begin < end else done
        of_class = _class(s[begin:end]) if begin < end else ""
        if not of_class:
            continue
        at, value = m.start(1), m[1]
        sign = s[end : m.start(1)]
        if value[0] in "\"'`" and len(value) > 1 and value[-1] == value[0]:
            at, value = at + 1, value[1:-1]
        elif "=" in sign and "=>" not in sign:
            if of_class.startswith("name"):
                value = re.split(r"\s+\S+[=:]", value)[0]
            else:
                value = value.split(" ")[0].split("\t")[0]
        if of_class == "name_loose":
            a, b = s.rfind("{", max(0, begin - 8192), begin), s.find("}", m.end(), m.end() + 8192)
            if a < 0 or b < 0 or s.rfind("}", a, begin) > a:
                a, b = s.rfind("\n", 0, begin) + 1, s.find("\n", m.end())
                b = len(s) if b < 0 else b
            if not _personal(s[a:begin] + " " + s[m.end() : b]):
                continue
            of_class = "name"
        if re.fullmatch(r"[A-Za-z]{1,2}", value.strip()) and of_class not in ("quasi", "sensitive"):
            continue
        yield from _mark(at, value, of_class)


@reader("insert", "insert")
def insert(s: str) -> Iterator[Name]:
    """The column list of an INSERT labels each tuple's values."""
    for m in re.finditer(r"(?i)\binsert\s+into\s+[^\s(]{1,200}\s*\(([^)]{1,4000})\)\s*values\s*", s):
        classes = [label_class(c.strip(" \t\r\n`\"[]")) for c in m[1].split(",")]
        classes = ["name_full" if c == "name_loose" else c for c in classes]
        if not any(classes):
            continue
        at = m.end()
        while tup := re.compile(r"\s*,?\s*\(((?:'(?:[^']|'')*'|[^()'])*)\)").match(s, at):
            values = list(re.finditer(r"\s*(?:'((?:[^']|'')*)'|([^,]+))\s*(?:,|$)", tup[1]))
            for v, c in zip(values, classes, strict=False):
                g = 1 if v[1] is not None else 2
                if c and v[g]:
                    yield from _mark(tup.start(1) + v.start(g), v[g], c)
            at = tup.end()


@reader("xml-field", "</")
def xml(s: str) -> Iterator[Name]:
    for m in re.finditer(r"<([\w:\-]{1,60})(?:\s[^<>]{0,200})?>([^<>\n]{1,120})</\1>", s):
        c = label_class(m[1])
        if c == "name_loose":
            c = "name" if _personal(s[max(0, m.start() - 600) : m.start()] + s[m.end() : m.end() + 600]) else ""
        if c:
            yield from _mark(m.start(2), m[2], c)


def _classes(heads: list[str]) -> list[str]:
    """The class of each column; a lone name counts beside another personal column."""
    found = [label_class(h.strip("\"'`* ")) for h in heads]
    personal = any(c not in ("", "name_loose", "email") for c in found)
    return [("name" if personal else "") if c == "name_loose" else c for c in found]


@reader("delimited")
def delimited(s: str) -> Iterator[Name]:
    """A header with a sensitive column labels the cells below it, in tables of any layout."""
    for grid in grids(s, lambda heads: sum(c not in ("", "email") for c in _classes(heads)) if len(heads) > 1 else 0):
        classes = _classes(grid.heads)
        for row in grid.rows:
            for (a, b), c in zip(row, classes, strict=False):
                if c and a < b:
                    yield from _mark(a, s[a:b], c)


_PERSONAL_VALUE = re.compile(r"[\w.+\-]{1,64}@[\w\-]{1,63}(?:\.[\w\-]{1,63}){1,5}|(?<!\d)\d{3}\.\d{3}\.\d{3}-\d{2}(?!\d)|\(\d{2}\) ?9?\d{4}-?\d{4}(?!\d)")
_FULL_NAME = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ']{1,30}(?:[ ](?:d[aeo]s?|e|van|von|del?|la)){0,2}(?:[ ][A-ZÀ-Þ][a-zà-ÿ']{1,30}){1,5}")


@reader("names-in-line", "@", ")", "-")
def names_in_line(s: str) -> Iterator[Name]:
    """In a delimited line without a header that holds a mail address, a personal number or a phone, a cell that is a full name."""
    for m in re.finditer(r"[^\n]+", s):
        sep = next((x for x in "\t;|," if x in m[0]), None)
        if not sep or not _PERSONAL_VALUE.search(m[0]):
            continue
        for a, b in split_cells(s, m.start(), m.end(), sep):
            if _FULL_NAME.fullmatch(s, a, b):
                yield Name(a, b, "=name")


def describe(text: str, most: int = 262_144) -> list[tuple[str, str]]:
    """(field name, class) of a text's header line, or of its keys; '' where a name says nothing. The first 256 KB are read: a report on names."""
    text = text[:most]
    first = text.split("\n", 1)[0]
    sep = next((x for x in "\t|;," if x in first), None)
    names = [h.strip().strip("\"'`* ") for h in first.split(sep)] if sep and not re.search(r"[:=]\s", first) else [m[1] for m in re.finditer(r"[\"']?([A-Za-zÀ-ÿ_][\wÀ-ÿ.\-]{0,59})[\"']?[ \t]*[:=](?![=/])", text)]
    return [(n, label_class(n)) for n in dict.fromkeys(names) if n]


def crc16(data: str) -> int:
    """CCITT, polynomial 0x1021 from 0xFFFF."""
    crc = 0xFFFF
    for c in data.encode("latin-1", "replace"):
        crc ^= c << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@reader("pix-code", "000201")
def pix_code(s: str) -> Iterator[Name]:
    """A payment code: fields of id, length and value from 000201 to the checksum in field 63, with the network's name in one of 26 to 51."""
    at = s.find("000201")
    while at >= 0:
        p, network, end = at, False, -1
        while re.fullmatch(r"\d{4}", s[p : p + 4]):
            kind, n = int(s[p : p + 2]), int(s[p + 2 : p + 4])
            value = s[p + 4 : p + 4 + n]
            if kind == 63:
                if n == 4 and network and value.upper() == f"{crc16(s[at : p + 4]):04X}" and not s[p + 8 : p + 9].isalnum():
                    end = p + 8
                break
            network |= 26 <= kind <= 51 and "br.gov.bcb.pix" in value.lower()
            p += 4 + n
        if end > 0:
            yield Name(at, end, "=pix")
        at = s.find("000201", end if end > 0 else at + 1)


def recovery_phrase(s: str, words: list[str]) -> Iterator[Name]:
    """12 to 24 words of a wallet's list (2048 words, given) whose checksum holds. Not registered: the list is a parameter."""
    import hashlib

    number = {w: i for i, w in enumerate(words)}
    tokens = [(m.start(), m.end(), number.get(m[0].lower())) for m in re.finditer(r"[A-Za-z]+", s)]
    i = 0
    while i < len(tokens):
        for n in (24, 21, 18, 15, 12):
            part = [t[2] for t in tokens[i : i + n]]
            if len(part) == n and None not in part:
                bits = "".join(f"{x:011b}" for x in part)
                data = int(bits[: n * 32 // 3], 2).to_bytes(n * 4 // 3, "big")
                if f"{hashlib.sha256(data).digest()[0]:08b}"[: n // 3] == bits[n * 32 // 3 :]:
                    yield Name(tokens[i][0], tokens[i + n - 1][1], "=secret")
                    i += n - 1
                    break
        i += 1
