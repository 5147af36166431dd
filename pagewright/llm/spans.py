"""Spans as the scanning operators report them: (kind, start, end) in code points."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined; spans hold the kind's place in ``kinds``."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, s, e in spans))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def replaced(text: str, spans: list[tuple[int, int, int]], marks: tuple[str, ...]) -> str:
    """The text with each span replaced by its kind's mark; overlapping spans go together, under the first one's mark."""
    out, at = [], 0
    for s, k, e in sorted((s, k, e) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], marks[k]]
        at = max(at, e)
    return "".join([*out, text[at:]])
