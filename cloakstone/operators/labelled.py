"""Patterns of values that only the words before them tell: a label, a gap, a value. Built from plain lists of words.

Words are written with their accents; a text may leave accents out, and join words by blanks, hyphens or underscores. Each pattern has the value as
group 1, and the match ends where the value does."""

from __future__ import annotations

import re

FOLD = {"á": "[aá]", "â": "[aâ]", "ã": "[aã]", "é": "[eé]", "ê": "[eê]", "í": "[ií]", "ó": "[oó]", "ô": "[oô]", "õ": "[oõ]", "ú": "[uú]", "ç": "[cç]", " ": r"[\s_\-]{1,3}", "-": r"[\s\-]{1,3}"}
OUTSIDE, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}_])"
#: What may stand between a label and its value, besides signs.
FILLERS = ("número", "num", "nº", "n°", "no", "n", "number", "é", "is", "was", "era", "do", "da", "de", "cliente", "titular")


def alternatives(words: tuple[str, ...] | list[str]) -> str:
    """The words as one pattern, the longest first."""
    return "|".join("".join(FOLD.get(c, re.escape(c)) for c in w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def words(text: str) -> list[str]:
    """A list written with commas."""
    return [w.strip() for w in text.split(",")]


def behind(labels: str, value: str, fillers: tuple[str, ...] = FILLERS, signs: int = 6) -> str:
    """A value a few signs and filler words behind a label, on its line."""
    gap = rf"(?:[^\p{{L}}\p{{N}}\n]{{1,3}}(?:{alternatives(fillers)})(?![\p{{L}}\p{{N}}])){{0,3}}[^\p{{L}}\p{{N}}\n]{{0,{signs}}}" if fillers else rf"[^\p{{L}}\p{{N}}\n]{{0,{signs}}}"
    return rf"(?i){OUTSIDE}(?:{alternatives(words(labels))}){gap}(?<![\p{{L}}\p{{N}}])({value}){END}"


def run(stop: str, least: int = 1) -> str:
    """Characters other than blanks, quotes and those of stop, not ending in punctuation."""
    return rf"[^\s\"'`{stop}]{{{least - 1},}}[^\s\"'`{stop}.:!?)\]}}]"


def assigned(labels: str, value: str) -> str:
    """A value given to a key that one of the labels is part of: =, :, := or =>, quotes around either."""
    return rf"(?i)(?:{alternatives(words(labels))})[\w.\-]{{0,40}}[\"'`]?[ \t]*(?::=|=>|=|:)\s*[\"'`]?({value})"


def told(labels: str, copulas: str, value: str, between: int = 4) -> str:
    """A value that a sentence gives: label, a few words, "is", value."""
    return rf"(?i){OUTSIDE}(?:{alternatives(words(labels))})(?:[ \t]+[\p{{L}}\-]+){{0,{between}}}?[ \t]*(?:(?<=[ \t])(?:{alternatives(words(copulas))})(?=[ \t])|=>|[:=])[ \t]*[\"'`]?({value})"


def quoted(labels: str, least: int = 4, between: int = 3) -> str:
    """A quoted value soon behind a label."""
    return rf"(?i){OUTSIDE}(?:{alternatives(words(labels))})(?:[ \t]+[\p{{L}}\-]+){{0,{between}}}?[ \t]+[\"'`]([^\s\"'`]{{{least},}})(?=[\"'`])"


def option(tools: str, flags: str, glued: str, value: str, lead: str = "") -> str:
    """A value behind an option of one of the tools (flags: with a blank or =; glued: directly), and behind its lead."""
    given = [f"(?:{'|'.join(map(re.escape, words(flags)))})[ \\t=]+"] if flags else []
    given += [f"(?:{'|'.join(map(re.escape, words(glued)))})"] if glued else []
    return rf"\b(?:{'|'.join(map(re.escape, words(tools)))})\b(?:[ \t]+[^\s|;&]+)*?[ \t]+(?:{'|'.join(given)})[\"']?{lead}({value})"


def listed(labels: str, item: str, joined: str = r"[\s,;/+]{1,3}(?:(?:e|and|ou|or)\s{1,2})?") -> str:
    """Every item of a list behind a label, each a match of its own: the next item begins where the last match ended."""
    return rf"(?i)(?:{OUTSIDE}(?:{alternatives(words(labels))})[^\p{{L}}\p{{N}}\n]{{0,6}}|\G(?<=[\p{{L}}\p{{N}}]){joined})({item}){END}"


def street(kinds: str, numbers: str) -> str:
    """Kind of street, name, comma, number."""
    return rf"(?i){OUTSIDE}((?:{alternatives(words(kinds))})[ \t]+[^\s,;:\n][^,;:\n]{{1,58}},[ \t]*(?:(?:{alternatives(words(numbers))})\.?[ \t]*)?[0-9]{{1,6}}){END}"


def phrases(*slots: str) -> str:
    """All phrases that take one word from each slot in turn (lists written with commas; an empty word leaves the slot out), as a list written with commas."""
    out = [""]
    for slot in slots:
        out = [f"{a} {w}".strip() for a in out for w in words(slot)]
    return ", ".join(dict.fromkeys(out))


def tied(ties: str, values: str, cased: bool = False) -> str:
    """A value right behind a phrase that ties it to someone, with blanks, a colon or an equals sign between; cased: the value as it is written."""
    flag = "(?-i:" if cased else "(?:"
    return rf"(?i){OUTSIDE}(?:{alternatives(words(ties))})(?:[ \t]*[:=][ \t]*|[ \t\n]{{1,4}})({flag}{values})){END}"


def inflected(some: list[str]) -> str:
    """Alternatives with or without accents, in any number, and in either gender where the word ends in o."""
    forms = [w[:-1] + e for w in some for e in ("o", "a", "os", "as") if w.endswith("o")] + [w + e for w in some for e in ("", "s", "es")]
    return alternatives(forms)
