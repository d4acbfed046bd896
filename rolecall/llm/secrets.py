r"""Secret scans: keyword prefilter, anchored patterns near hits only, embedded checks.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over the lower-cased text;
a kind's pattern is tried only where one of its keywords begins. Runs of hexadecimal digits have
no keyword of their own: the text is mapped onto two letters (hexadecimal digit or not) and the
keyword is 24 such digits.

Base kinds (kept whatever else holds): ``assign``, ``access``, ``hex``. Further kinds must also
pass the check that their format embeds: ``github`` and ``npm`` (the last six characters are the
CRC-32 of the rest in base 62), ``jwt`` (the head is base64url JSON that names an algorithm),
``card`` (a payment number after a card keyword; Luhn digit, of the longest group of digits that
has it and ends where digits end), ``pem`` (the armoured body is base64 of a DER sequence or an
OpenSSH key whose lengths fit or, under a ``DEK-Info`` line, of whole cipher blocks).

Defined cases: null or empty text has no spans; matches of one kind are leftmost and do not
overlap, different kinds may; positions are code points, end exclusive; equal starts are ordered
by kind as listed in ``KINDS``. A NUL character is an ordinary character.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds in order, the keyword that opens each pattern and the pattern.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "card", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "card": ("card", "visa", "mastercard", "amex"),
    "pem": ("-----begin ",),
}
PATTERNS = {
    "assign": r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "github": r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])",
    "npm": r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])",
    "jwt": r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)",
    "card": r"(?ai:card|visa|mastercard|amex)[^0-9\n]{0,20}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])",
    "pem": r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----\s*+((?:[A-Za-z0-9-]+:[^\n]*\n(?:[ \t]+[^\s][^\n]*\n)*)*)([A-Za-z0-9+/=\s]+)-----END \1-----",
}
HEX_LEAST = 24
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = bytes.maketrans(bytes(range(256)), bytes(120 if chr(b) in "0123456789abcdef" else 46 for b in range(256)))


def crc_digits(body: str) -> str:
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _jwt(head: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def _der(raw: bytes) -> bool:
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == raw[1] + 2
    size = raw[1] & 0x7F
    return len(raw) == int.from_bytes(raw[2 : 2 + size], "big") + 2 + size


_OPENSSH = b"openssh-key-v1\0"


def _openssh(raw: bytes) -> bool:
    """Magic, three strings, the number of keys, and a string for each and for the private part."""
    at, left = len(_OPENSSH), 3
    counted = False
    while raw.startswith(_OPENSSH) and at + 4 <= len(raw):
        size = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if not left and not counted:
            left, counted = size + 1, True
            continue
        at, left = at + size, left - 1
        if counted and not left:
            return at == len(raw)
    return False


def _pem(headers: str, body: str) -> bool:
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if "DEK-Info:" in headers:
        return len(raw) > 0 and len(raw) % 8 == 0
    return _der(raw) or _openssh(raw)


def _card(m: re.Match) -> int:
    """Where the longest number with a Luhn digit ends, 0 without one."""
    for end in range(m.end(1), m.start(1), -1):
        digits = re.sub(r"[^0-9]", "", m[1][: end - m.start(1)])
        if len(digits) < 13:
            return 0
        whole = end == m.end(1) or not m.string[end].isdecimal()
        if whole and m.string[end - 1].isdecimal() and luhn(digits):
            return end
    return 0


#: Whether a match holds, or where it then ends.
CHECKS = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: crc_digits(m[1]) == m[2],
    "npm": lambda m: crc_digits(m[1]) == m[2],
    "jwt": lambda m: _jwt(m[1]),
    "card": _card,
    "pem": lambda m: _pem(m[2], m[3]),
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found: dict[str, list[str]] = {}
    for kind, names in KEYWORDS.items():
        for name in names:
            found.setdefault(name, []).append(kind)
    automaton = ahocorasick.Automaton()
    for name, kinds in found.items():
        automaton.add_word(name, (len(name), kinds))
    automaton.make_automaton()
    return automaton, {k: re.compile(p) for k, p in PATTERNS.items()}


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind as listed."""
    if not text:
        return []
    automaton, patterns = _automaton()
    raw = text.encode("utf-8", "surrogatepass")
    begins: dict[str, list[int]] = {}
    for last, (size, kinds) in automaton.iter(raw.lower().decode("utf-8", "surrogatepass")):
        for kind in kinds:
            begins.setdefault(kind, []).append(last - size + 1)
    out = []
    for kind, starts in begins.items():
        free = 0
        for start in sorted(starts):
            if start >= free and (m := patterns[kind].match(text, start)):
                free = m.end()
                if good := CHECKS[kind](m):
                    free = free if good is True else good
                    out.append((start, free, kind))
    digits = raw.translate(_HEX)
    at = digits.find(b"x" * HEX_LEAST)
    while at >= 0:
        end = digits.find(b".", at)
        end = len(digits) if end < 0 else end
        start = len(raw[:at].decode("utf-8", "surrogatepass")) if not text.isascii() else at
        out.append((start, start + end - at, "hex"))
        at = digits.find(b"x" * HEX_LEAST, end)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secrets(text: Column | str) -> Column:
    """Column with the array of (kind, start, end) of all secrets in ``text``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in scan(t.as_py())] for t in texts], kind)

    return find(F.col(text) if isinstance(text, str) else text)
