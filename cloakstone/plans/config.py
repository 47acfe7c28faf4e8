"""Options of the engine: an immutable record, also read from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    disabled: tuple[str, ...] = ()  # detector types that don't run
    allowed_email_domains: tuple[str, ...] = ("example.com", "example.org", "example.net")
    allowed_emails: tuple[str, ...] = ()
    internal_domains: tuple[str, ...] = ()
    documents_without_context: bool = False
    public_ip: bool = False
    quasi: bool = False  # field classes that only together point at a person
    objects: bool = True
    extra_patterns: tuple[tuple[str, str], ...] = ()  # (label, regular expression)
    terms: tuple[tuple[str, str], ...] = ()  # (label, value)
    own_key: str = ""  # the key's text form: wherever it stands, it is a secret
    validity_days: int = 90
    no_unmask_tools: tuple[str, ...] = ("WebFetch", "WebSearch", "mcp__")

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Known keys of a JSON object; lists become tuples. Unknown keys fail, so a misspelt option can't be silently ignored."""
        raw = json.loads(text)
        names = {f.name for f in fields(cls)}
        if unknown := set(raw) - names:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        freeze = lambda v: tuple(freeze(x) for x in v) if isinstance(v, list) else v
        return cls(**{k: freeze(v) for k, v in raw.items()})

    def on(self, kind: str) -> bool:
        return kind not in self.disabled
