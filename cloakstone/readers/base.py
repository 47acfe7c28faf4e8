"""Readers find names by the structure around them. A reader is a function text -> iterator of Name; the registry runs all in one Arrow stage.

Offsets are code points. Patterns use ASCII classes and bounded repeats, so a long line can't make them slow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple


class Name(NamedTuple):
    start: int
    end: int
    entity: str  # or a personal type with a leading "="
    strong: bool = True


Reader = Callable[[str], Iterator[Name]]
REGISTRY: dict[str, Reader] = {}


#: Lower-case substrings of which a text must hold one before the reader runs; () for none.
NEEDS: dict[str, tuple[str, ...]] = {}


def reader(name: str, *needs: str) -> Callable[[Reader], Reader]:
    """Adds a reader to the stage; a user's own readers are added the same way."""

    def add(f: Reader) -> Reader:
        REGISTRY[name], NEEDS[name] = f, needs
        return f

    return add


# Words that are never a client's name.
PUBLIC = set(
    """localhost root admin default public dbo sys system guest user users username password host hostname port none null nil true false string int integer number bool boolean text
    master main dev test prod staging production development local example sample demo template app api web www db database schema table server service bucket queue topic namespace
    information_schema pg_catalog pg_tables all_tables performance_schema mysql postgres postgresql sqlite oracle mssql redis mongo mongodb kafka rabbitmq elasticsearch nginx node python java
    kubernetes kube-system kube-public docker linux ubuntu debian alpine windows centos runner shared stdin stdout dev-null kind config latest alice bob foo bar baz x y z self this request""".split()
)
PUBLIC_DOMAINS = (
    "github.com gitlab.com bitbucket.org google.com googleapis.com microsoft.com amazonaws.com azure.com windows.net apache.org python.org golang.org go.dev npmjs.org npmjs.com pypi.org docker.io docker.com "
    "quay.io ghcr.io gcr.io k8s.io kubernetes.io example.com example.org example.net mozilla.org w3.org wikipedia.org cloudflare.com openai.com stackoverflow.com medium.com"
).split()
_PLACEHOLDER = re.compile(r"[$<>{}%*()\[\]]|^\.+$|^-+$")
_NUMBER = re.compile(r"^[0-9.,:\-/ ]+$")


def placeholder(v: str) -> bool:
    """A template, an expression, a number or nothing."""
    return not v or bool(_PLACEHOLDER.search(v) or _NUMBER.match(v))


def ownerless(v: str) -> bool:
    return placeholder(v) or v.lower() in PUBLIC


def public_host(h: str) -> bool:
    h = h.lower().rstrip(".")
    return ownerless(h) or any(h == d or h.endswith("." + d) for d in PUBLIC_DOMAINS) or bool(re.fullmatch(r"[0-9.]+", h))


def internal_host(h: str) -> bool:
    """A single label of technical shape, or a name under a private suffix."""
    h = h.lower()
    if public_host(h) or h.endswith((".svc.cluster.local", ".invalid")):
        return False
    if "." not in h:
        return bool(re.search(r"[0-9-]", h))
    return h.rsplit(".", 1)[1] in ("internal", "intra", "interno", "corp", "local", "lan", "intranet", "private", "home")


def identifier(v: str) -> bool:
    return 3 <= len(v) <= 128 and bool(re.search(r"[_.0-9]|[A-Za-z]-[A-Za-z0-9]|[a-z][A-Z]", v)) and not re.fullmatch(r"v?[0-9]+(\.[0-9]+)*|[0-9a-fA-F]{32,64}", v)


def group(m: re.Match, g: int | str, entity: str, strong: bool = True) -> Iterator[Name]:
    """The group's span, unless it is no one's name."""
    if m[g] and not ownerless(m[g]):
        yield Name(m.start(g), m.end(g), entity, strong)


def parts(text: str, start: int, end: int, entities: list[str]) -> Iterator[Name]:
    """Dot-separated parts (quotes around each left out) from the right: entities of the last part, the one before, ..."""
    spans, i = [], start
    for piece in re.finditer(r"\[[^\]\n]{1,128}\]|\"[^\"\n]{1,128}\"|`[^`\n]{1,128}`|[^.\s]+", text[start:end]):
        a, b = start + piece.start(), start + piece.end()
        if text[a] in '["`' and b - a > 2:
            a, b = a + 1, b - 1
        spans.append((a, b))
        i = b
    _ = i
    for (a, b), entity in zip(reversed(spans), entities, strict=False):
        if not ownerless(text[a:b]):
            yield Name(a, b, entity)
