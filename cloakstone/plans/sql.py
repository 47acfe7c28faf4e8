"""SQL text of keyed ids and check digits, for comparing the expressions with another engine."""

from __future__ import annotations

ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"


def hmac(key: bytes, domain: str, value: str) -> str:
    """Hexadecimal HMAC-SHA256 of domain, 0 and a VARCHAR expression."""
    pad = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in pad).hex(), bytes(b ^ 0x5C for b in pad).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}{domain.encode().hex()}00') || encode({value}))))"


def keyed_id(key: bytes, domain: str, value: str) -> str:
    """Eight base-32 characters."""
    v = f"(('0x' || substr({hmac(key, domain, value)}, 1, 10))::BIGINT)"
    chars = [f"substr('{ALPHABET}', ((v >> {35 - 5 * i}) & 31)::INT + 1, 1)" for i in range(8)]
    return f"(SELECT {' || '.join(chars)} FROM (SELECT {v} AS v))"


def digits_at(text: str, i: int) -> str:
    return f"substr({text}, {i + 1}, 1)::INT"


def weighted(text: str, weights: list[int], start: int = 0) -> str:
    return "(" + " + ".join(f"{w} * {digits_at(text, start + i)}" for i, w in enumerate(weights)) + ")"


def mod11(total: str) -> str:
    return f"(CASE WHEN {total} % 11 < 2 THEN 0 ELSE 11 - {total} % 11 END)"


def all_equal(text: str) -> str:
    return f"(replace({text}, substr({text}, 1, 1), '') = '')"
