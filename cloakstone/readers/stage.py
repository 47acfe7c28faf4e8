"""One Arrow stage that runs the enabled readers over each whole text and gives their names as findings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import text as T
from . import base, data, dev, encoded, fields, ops

_FINDING = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("real", pa.string()), ("rule", pa.string()), ("strong", pa.bool_())])
DEFAULT = tuple(base.REGISTRY)
__all__ = ["DEFAULT", "data", "dev", "encoded", "fields", "find_names", "ops", "read_names", "visible"]

_ANSI = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]|\x1b\][^\x07]{0,200}\x07|\r(?=\n)|\ufeff")
#: What tools put in front of lines: numbers, file:line of a search, marks of a diff, quotes.
_PREFIX = re.compile(r"[ \t]*\d{1,6}(?:\t|→|[ ]{2}|: |:)|[\w./\-]{3,200}:\d{1,6}:|[+\-](?![+\-])|> ?")
_ESCAPE = re.compile(r"\\(?:u00[0-7][0-9a-fA-F]|[ntr\"\\/])")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r"}

Places = list[int]


def _kept(text: str, cuts: list[tuple[int, int, str]]) -> tuple[str, Places]:
    """The text with spans replaced, and each new character's place in it (one more at the end)."""
    out, places, last = [], [], 0
    for a, b, new in cuts:
        out += (text[last:a], new)
        places += [*range(last, a), *[a] * len(new)]
        last = b
    return "".join([*out, text[last:]]), [*places, *range(last, len(text)), len(text)]


def _unescaped(text: str) -> list[tuple[int, int, str]]:
    """Escapes of a JSON string that holds lines of its own."""
    if "\\n" not in text or text.count("\n") > text.count("\\n"):
        return []
    return [(m.start(), m.end(), _PLAIN.get(m[0][1], chr(int(m[0][2:], 16)) if m[0][1] == "u" else m[0][1])) for m in _ESCAPE.finditer(text)]


_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_MAY_JOIN = re.compile(r"[\"'][ \t]*(?:\+|\.|\|\||&)?[ \t]*\\?\n[ \t]*(?:\+|\.|\|\||&)?[ \t]*[\"']")
#: Between two literals that are one string over two lines: an operator or a backslash, or nothing at all inside parentheses.
_JOINT = re.compile(r"[ \t]*(\+|\.|\|\||&)?[ \t]*(\\)?\n[ \t]*(\+|\.|\|\||&)?[ \t]*")


def _joined(text: str) -> list[tuple[int, int, str]]:
    """String literals that are cut over lines: what stands between the parts, from the closing quote to the next one's opening."""
    if not _MAY_JOIN.search(text):
        return []
    out, last, inside = [], None, False
    for m in _LITERAL.finditer(text):
        gap = _JOINT.fullmatch(text, last.end(), m.start()) if last and text[last.start()] == text[m.start()] else None
        if gap and (any(gap.groups()) or inside):
            out.append((last.end() - 1, m.start() + 1, ""))
        else:
            inside = text[max(0, m.start() - 200) : m.start()].rstrip()[-1:] == "("
        last = m
    return out


def _prefixes(text: str) -> list[tuple[int, int, str]]:
    """Line prefixes, if at least half of the lines that aren't blank have one (two lines or more)."""
    lines = [m for m in re.finditer(r"[^\n]+", text) if m[0].strip()]
    found = [(m.start(), p) for m in lines if (p := _PREFIX.match(m[0]))]
    return [(a, a + p.end(), "") for a, p in found] if len(lines) >= 2 and 2 * len(found) >= len(lines) else []


def visible(text: str) -> tuple[str, Places | None]:
    """The text as its writer saw it: JSON escapes undone (up to three layers), terminal escapes and line prefixes gone, strings that are cut over lines in one; and each character's
    place in the source (None: unchanged)."""
    places: Places | None = None
    steps = [_unescaped] * 3 + [lambda t: [(m.start(), m.end(), "") for m in _ANSI.finditer(t)], _prefixes, _joined]
    for step in steps:
        if cuts := step(text):
            text, at = _kept(text, cuts)
            places = at if places is None else [places[i] for i in at]
    return text, places


_TEMPLATE = re.compile(r"\{\{(.{0,300}?)(?:\}\}|\{\{|$)", re.S)
_ROOT = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\.(?=[A-Za-z_])")
_DOTTED = re.compile(r"[\w.]*")
_PATH_TYPES = frozenset("obj." + e for e in ("column", "database", "index", "procedure", "schema", "table"))


def template_roots(text: str) -> set[str]:
    """First parts of the dotted names in a text's template expressions ({{ fold.ewes }}): variables of a program. A dotted name that begins with one is a path in its data wherever the text has it."""
    return {r for m in _TEMPLATE.finditer(text) for r in _ROOT.findall(m[1])} if "{{" in text else set()


def _under(text: str, start: int, end: int, roots: set[str]) -> bool:
    """Whether the dotted name around a place begins with one of the roots."""
    while start and (text[start - 1].isalnum() or text[start - 1] in "_."):
        start -= 1
    name = text[start : _DOTTED.match(text, end).end()].strip(".")
    return "." in name and name.split(".", 1)[0] in roots


# Words of which examples of connections make their names.
_MODEL = frozenset("host hostname server db database user username usr name login password pass port schema sid service instance node address primary replica master remote my your test".split())
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def model_name(v: str) -> bool:
    """A name as examples of connections have it: one or two words that only say what it is, with a number or joined (host1, dbName, user_name)."""
    pieces = [p.lower() for p in _PIECES.findall(v)]
    return bool(re.fullmatch(r"[A-Za-z]+[_\-]?[A-Za-z]*[_\-]?[0-9]{0,4}", v)) and 1 <= len(pieces) <= 2 and all(p in _MODEL for p in pieces)


def find_names(text: str, readers: tuple[str, ...] = DEFAULT, objects: bool = True) -> list[tuple]:
    """(start, end, type, real, rule, strong) of each reader's names, without repeats; places are the source's."""
    found: dict[tuple, tuple] = {}
    clean, places = visible(text)
    _read(text, clean, places, readers, objects, found)
    if places:  # what a prefix or an escape was part of is read as well
        _read(text, text, None, readers, objects, found)
    return sorted(found.values())


def _read(text: str, clean: str, places: Places | None, readers: tuple[str, ...], objects: bool, found: dict[tuple, tuple]) -> None:
    low, roots = clean.lower(), template_roots(clean)
    for rule in readers:
        needs = base.NEEDS.get(rule)
        if needs and not any(x in low for x in needs):
            continue
        for n in base.REGISTRY[rule](clean):
            start, end = n.start, n.end
            if end <= start or rule in ("connection", "dsn") and model_name(clean[start:end]):
                continue
            if roots and "obj." + n.entity in _PATH_TYPES and _under(clean, start, end, roots):
                continue
            if places:
                start, end = places[start], places[end - 1] + 1
            kind = n.entity[1:] if n.entity[0] == "=" else "obj." + n.entity
            if objects or kind[:4] != "obj.":
                found.setdefault((start, end, kind), (start, end, kind, text[start:end], rule, n.strong))


def read_names(df: DataFrame, text: str = "text", readers: tuple[str, ...] = DEFAULT, into: str = "names") -> DataFrame:
    """df with an array of the readers' findings. Texts under 4 characters have none; each distinct place, type and rule comes once."""
    kind = ArrayType(StructType.fromDDL(T.SPAN[7:-1].replace(":", " ").replace(",", ", ")))
    schema = StructType([*df.schema.fields, StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[] if not t or len(t) < 4 else [dict(zip(("start", "end", "type", "real", "rule", "strong"), n, strict=True)) for n in find_names(t, readers)] for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(_FINDING))], [*b.schema.names, into])

    return df.mapInArrow(run, schema)


class FindSensitive:
    """SQL: SELECT t.*, f.* FROM t, LATERAL find_sensitive(t.text) f."""

    def eval(self, text: str):
        if text and len(text) >= 4:
            yield from find_names(text)


def register(spark) -> None:
    """Makes find_sensitive(text) a table function of the session."""
    spark.udtf.register("find_sensitive", udtf(FindSensitive, returnType=T.SPAN[7:-1].replace(":", " ").replace(",", ", "), useArrow=True))


def with_names(df: DataFrame, text: str = "text", readers: tuple[str, ...] = DEFAULT) -> DataFrame:
    """df whose findings hold the readers' names too."""
    both = read_names(df, text, readers, "_names")
    return both.withColumn("findings", F.concat("findings", F.col("_names").cast(T.SPANS))).drop("_names")


