"""Column builders for text: normalised names, canonical numbers, letter case, and spans of pattern matches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,type:string,real:string,rule:string,strong:boolean>"
SPANS = f"array<{SPAN}>"


def _plain_letters() -> tuple[str, str]:
    """Accented letters whose decomposition is one letter and marks, and those letters."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        d = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(d) == 1 and d[0] != c:
            pairs.append((c, d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _plain_letters()


def without_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{Mn}", "")


def norm_name(c: Column) -> Column:
    """No accents, upper case, single spaces."""
    return F.upper(F.trim(F.regexp_replace(without_accents(c), r"[\s\u0085   -     　]+", " ")))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def canonical_number(c: Column) -> Column:
    """Digits, and a trailing x as its lower case."""
    return F.concat(digits(c), F.when(F.lower(c).endswith("x"), "x").otherwise(""))


def letter_case(c: Column) -> Column:
    """'A' upper case only, 'a' lower case only, 'M' both, '' without letters of a case."""
    upper, lower = F.lower(c) != c, F.upper(c) != c
    return F.when(upper & lower, "M").when(upper, "A").when(lower, "a").otherwise("")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: in a lambda nothing else keeps a shared part from being worked out again at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements that are folded one after another; a fold copies its growing array at each element.
CHUNK = 128


def running(values: Column, op: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """op over what stands before each of one or more integers, from start on. Parts of CHUNK are folded on their own and then carried on (op is associative),
    so the work stays about linear for arrays of a million elements."""
    zero = F.struct(F.lit(start).alias("pos"), F.array().cast("array<int>").alias("out"))
    fold = lambda xs: F.aggregate(xs, zero, lambda a, x: F.struct(op(a["pos"], x).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")))
    parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: fold(F.slice(x, i * CHUNK + 1, F.lit(CHUNK))))
    carried = lambda ps: let(fold(F.transform(ps, lambda p: p["pos"]))["out"], lambda by: F.flatten(F.zip_with(ps, by, lambda p, b: F.transform(p["out"], lambda v: op(v, b)))))
    return let(values, lambda x: let(parts(x), carried))


def prefix_sums(lengths: Column) -> Column:
    """Sums of what stands before each of one or more integers."""
    return running(lengths, lambda a, b: a + b)


def prefix_max(values: Column) -> Column:
    """The greatest of what stands before each of one or more integers of 0 and more; 0 before the first."""
    return running(values, F.greatest)


#: Characters of one piece of a view: 2 to the power of SHIFT.
SHIFT = 10
PIECE = 1 << SHIFT


def view(text: Column) -> Column:
    """The text in pieces of PIECE characters: a part is cut from a piece, and not by counting from the text's beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def short_cut(seen: Column, start: Column, length: Column) -> Column:
    """At most PIECE characters of a view from a position on; '' outside the text."""
    at = F.shiftright(start, SHIFT)
    two = F.concat(F.get(seen, at), F.coalesce(F.get(seen, at + 1), F.lit("")))
    return F.coalesce(F.substr(two, start.bitwiseAND(F.lit(PIECE - 1)) + 1, length), F.lit(""))


def cut(seen: Column, start: Column, end: Column) -> Column:
    """The characters of a view from start to before end."""
    first, last = F.shiftright(start, SHIFT), F.shiftright(end - 1, SHIFT)
    head = F.substr(F.get(seen, first), start.bitwiseAND(F.lit(PIECE - 1)) + 1, end - start)
    rest = F.concat(F.array_join(F.slice(seen, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.substr(F.get(seen, last), F.lit(1), end - last * PIECE))
    return F.when(end <= start, "").when(first == last, head).otherwise(F.concat(head, rest))


def spliced(text: Column, edits: Column, new: Callable[[Column], Column]) -> Column:
    """The text with the parts of edits (structs with start and end, sorted, without overlap) replaced by new(edit)."""
    def put(seen: Column, es: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(es, lambda e: e["end"]))
        parts = F.zip_with(es, F.slice(before, 1, F.size(es)), lambda e, p: F.concat(cut(seen, p, e["start"]), new(e)))
        return F.concat(F.array_join(parts, ""), cut(seen, F.element_at(before, -1), F.length(text)))

    return let(view(text), lambda seen: let(edits, lambda es: put(seen, es)))


def char_at(seen: Column, position: Column) -> Column:
    """The character of a view at a position from 0; '' outside the text."""
    return F.coalesce(F.substr(F.get(seen, F.shiftright(position, SHIFT)), position.bitwiseAND(F.lit(PIECE - 1)) + 1, F.lit(1)), F.lit(""))


def before(seen: Column, start: Column, n: int = 30) -> Column:
    """Up to n characters of a view before a position, in lower case."""
    first = F.greatest(F.lit(0), start - n)
    return F.lower(short_cut(seen, first, start - first))


def located(text: Column, pattern: str, group: int, body: Callable[[Column, Column], Column]) -> Column:
    """body(match, at) of each match of a pattern, leftmost and without overlap. match: gap (before it), match, value (of the group); at: where
    it begins. Gaps and matches add up to the positions. Behind the last match comes a null match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), value.alias("value"))
    lengths = lambda s: F.transform(s, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
    return let(steps, lambda s: F.zip_with(s, prefix_sums(lengths(s)), lambda x, at: body(x, at + F.length(x["gap"]))))


def spans(text: Column, pattern: str, kind: str, keep: Callable[..., Column] | None = None, group: int = 0, rule: str | None = None, strong: bool = True) -> Column:
    """Matches of a pattern, leftmost and without overlap, as an array of spans (code points; end exclusive) of the group's value.

    keep(view, start, end, value) says which matches count (view: of the text). A group must end where the match does (patterns look ahead for what follows)."""
    none = F.array().cast(SPANS)

    def one(x: Column, at: Column) -> Column:
        start = at if group == 0 else at + F.length(x["match"]) - F.length(x["value"])
        span = F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), F.lit(kind).alias("type"), x["value"].alias("real"), F.lit(rule or kind).alias("rule"), F.lit(strong).alias("strong"))
        return F.when(x["match"].isNotNull(), span)

    found = located(text, pattern, group, one)
    good = F.filter(found, lambda e: e.isNotNull()) if keep is None else let(view(text), lambda seen: F.filter(found, lambda e: e.isNotNull() & keep(seen, e["start"], e["end"], e["real"])))
    return F.when(text.rlike(pattern), good.cast(SPANS)).otherwise(none)
