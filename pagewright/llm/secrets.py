"""Secret scan: keyword automaton, anchored expressions, checksums.

One pass of an Aho-Corasick automaton finds the places where a keyword ends; only
there an anchored expression is tried. Long hexadecimal runs have no keyword:
every eighth character is probed instead, and four probes in a row (which any run
of 32 must contain) are a hit. Tokens of formats that carry a checksum of their
own are reported only if it holds. A scan needs no shuffle.

Defined cases: a null or empty text has no spans; repeated rows each give a row; a
null id is kept; an empty table gives an empty result; other columns are not read.
Long texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from ._shared import map_rows

KINDS = ("assign", "access", "hex", "github", "npm")
MARKS = ("[SECRET]", "[ACCESS_KEY]", "[HEX]", "[GITHUB_TOKEN]", "[NPM_TOKEN]")
BASE = 3

# Keywords, prefixes and the digits of the checksums.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_PREFIX = "AKIA"
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_PREFIX = "npm_"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

# Tried on the text with A-Z in lower case, at the start of a keyword.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CHECKED = re.compile(r"[a-z]{3}_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_HEX = re.compile(r"[0-9a-f]+")
_PROBES = re.compile(r"[0-9a-f]{4,}")
_PROBE_STEP = 8


def checksum(payload: str) -> str:
    """CRC-32 of the payload in base 62, six digits."""
    x, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        x, r = divmod(x, 62)
        out = BASE62[r] + out
    return out


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in KEYWORDS:
        found.add_word(word, (0, len(word)))
    found.add_word(ACCESS_PREFIX.lower(), (1, len(ACCESS_PREFIX)))
    for word in GITHUB_PREFIXES:
        found.add_word(word, (3, len(word)))
    found.add_word(NPM_PREFIX, (4, len(NPM_PREFIX)))
    found.make_automaton()
    return found


def find(text: str | None, words: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """The spans of a text, as (place in KINDS, start, end)."""
    if not text:
        return []
    low = text.encode().lower().decode()  # A-Z only, so that places stay the same
    out: list[tuple[int, int, int]] = []
    at = [0] * len(KINDS)
    for last, (kind, length) in words.iter(low):
        start = last + 1 - length
        if start < at[kind]:
            continue
        if kind == 0:
            if m := _ASSIGN.match(low, start):
                at[0] = m.end()
                if m.end() - m.start(1) >= 8:
                    out.append((0, start, m.end()))
        elif kind == 1:
            if m := _ACCESS.match(text, start):
                at[1] = m.end()
                if m.end() - start >= 16:
                    out.append((1, start, m.end()))
        elif (m := _CHECKED.match(text, start)) and checksum(m[1]) == m[2]:
            at[kind] = m.end()
            out.append((kind, start, m.end()))
    for m in _PROBES.finditer(text[_PROBE_STEP - 1 :: _PROBE_STEP]):
        first, end = _PROBE_STEP * m.start(), _PROBE_STEP * (m.end() + 1)  # the probes on either side are no digits
        out += [(2, *run.span()) for run in _HEX.finditer(text, first, end) if run.end() - run.start() >= 32]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>, redacted text) for each row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        words = automaton()

        def each(i, text):
            found = sorted(find(text, words), key=lambda x: (x[1], x[0]))
            return [(i, [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in found], spans.replaced(text, found, MARKS) if found else text)]

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, f"id {kind}, spans array<struct<kind string, start int, end int>>, text string", make, 512)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs``."""
    kind = dict(docs.dtypes)[id_col]

    def make():
        words = automaton()

        def each(i, text):
            found = find(text, words)
            base = [x for x in found if x[0] < BASE]
            n = [sum(x[0] == k for x in base) for k in range(BASE)]
            return [(i, *n, spans.digest(spans.joined(base, KINDS)), spans.joined(found, KINDS))]

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)
