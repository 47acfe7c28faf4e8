"""Tokens inside encoded text: base64 (plain and of URLs) and percent escapes, within one another up to DEPTH layers. The span is what encodes the token in the outer text."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

from .base import Name, reader

#: Layers that are undone. Each is read once, so the work follows the text's length.
DEPTH = 3
# Beginnings and shapes of public token formats.
TOKENS = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z]{30,}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|dop_v1_[a-f0-9]{64}|shpat_[a-fA-F0-9]{32}|pypi-[A-Za-z0-9_\-]{50,}|(?:AKIA|ASIA)[A-Z2-7]{16})(?![A-Za-z0-9_])"
)
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|senha|secret|token|api_?key)[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"'&,;]{6,200})")
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{20,}={0,2}")
_ESCAPED = re.compile(r"[A-Za-z0-9._~%\-]{6,}+")
_HEX = re.compile(r"%[0-9A-Fa-f]{2}")
_READABLE = re.compile(rb"[\x20-\x7e\t\r\n]{8,}")


def _layers(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """(decoded part, place in text where each of its characters begins, and where it ends)."""
    for m in _RUN.finditer(text):
        body = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        for shift in range(4):  # a run may begin with letters that aren't part of it
            some = body[shift:]
            some = some[: len(some) // 4 * 4 + (0 if len(some) % 4 == 1 else len(some) % 4)]
            raw = base64.b64decode(some + "=" * (-len(some) % 4))
            for r in _READABLE.finditer(raw):
                at = m.start() + shift
                yield r[0].decode("ascii"), [at + 4 * i // 3 for i in range(*r.span())], [at + -(-4 * (i + 1) // 3) for i in range(*r.span())]
    for m in _ESCAPED.finditer(text) if "%" in text else ():
        if not _HEX.search(m[0]):
            continue
        parts = [(m.start() + p.start(), m.start() + p.end(), p[0]) for p in re.finditer(r"%[0-9A-Fa-f]{2}|.", m[0])]
        yield "".join(chr(int(p[1:], 16)) if len(p) == 3 else p for _, _, p in parts), [a for a, _, _ in parts], [z for _, z, _ in parts]


def _found(text: str, depth: int) -> Iterator[tuple[int, int]]:
    for inner, begins, ends in _layers(text):
        spans = [m.span() for m in TOKENS.finditer(inner)] + [m.span(1) for m in _ASSIGNED.finditer(inner) if re.search(r"[0-9]", m[1]) and re.search(r"[A-Za-z]", m[1])]
        if depth > 1 and len(inner) >= 20:
            spans += _found(inner, depth - 1)
        for a, z in spans:
            yield begins[a], ends[z - 1]


@reader("encoded")
def encoded(s: str) -> Iterator[Name]:
    """Tokens and assigned secrets that base64 or percent escapes hide."""
    last = -1
    for a, z in sorted(set(_found(s, DEPTH)), key=lambda x: (x[0], -x[1])):
        if z > last:
            yield Name(a, z, "=secret")
            last = z
