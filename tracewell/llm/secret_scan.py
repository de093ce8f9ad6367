"""Secrets in text: keyword automaton, anchored patterns near its hits, checksums.

An Aho-Corasick automaton over ASCII-lowered text finds the keywords of all
kinds in one pass; a pattern is tried only where one of its keywords begins.
Runs of hexadecimal digits have no keyword of their own, so a second automaton
looks for the shortest run that counts in the text mapped to character
classes.  Tokens with an embedded checksum are reported only if it is right.

Texts are flattened to one byte per code point before the search (lead bytes
of UTF-8 stand for characters outside ASCII, which no pattern has), so all
offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

HEX_LEAST, ACCESS_LEAST, VALUE_LEAST = 32, 16, 8

#: Kinds in the order that breaks ties of a start; the first three are the base.
KINDS = ("assign", "access", "hex", "forge", "registry", "pem")

# Published formats of credentials.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
FORGE = re.compile(rb"(gh[opsur]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
REGISTRY = re.compile(rb"(npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
PEM = re.compile(rb"-----BEGIN ((?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY)-----")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "gho_": "forge", "ghp_": "forge", "ghs_": "forge", "ghu_": "forge", "ghr_": "forge",
    "npm_": "registry",
    "-----begin ": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: What can be between a key's BEGIN and its END.
_PEM_BODY = bytes(c for c in range(256) if chr(c) not in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/= \t\n\x0b\x0c\r\\:,-")
_CONTINUATION = bytes(range(0x80, 0xC0))
_HEX_CLASS = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))


def checksum_base62(body: bytes) -> bytes:
    """The CRC-32 of body as six digits of base 62."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out.encode()


def _checked(m: re.Match) -> bool:
    return checksum_base62(m[2]) == m[3]


def pem_end(flat: bytes, m: re.Match) -> int | None:
    """Where the key ends that m begins: at an END of its label before any other BEGIN or END, with nothing strange between.

    The next BEGIN ends the search, so each part of a text is looked through once.
    """
    begin = flat.find(b"-----BEGIN ", m.end())
    stop = flat.find(b"-----END ", m.end(), begin if begin >= 0 else len(flat))
    end = b"-----END " + m[1] + b"-----"
    if stop <= m.end() or not flat.startswith(end, stop) or len(flat[m.end() : stop].translate(None, _PEM_BODY)) < stop - m.end():
        return None
    return stop + len(end)


#: Of each kind: its pattern, and what a match has to hold; a match that fails still takes its characters.
RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= VALUE_LEAST),
    "access": (ACCESS, lambda m: len(m[0]) >= ACCESS_LEAST),
    "forge": (FORGE, _checked),
    "registry": (REGISTRY, _checked),
    "pem": (PEM, lambda m: True),  # and where its key ends: pem_end()
}


def scanner():
    """A function of a text to its spans, (start, place of the kind, end) in order."""
    keywords = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        keywords.add_word(word, (kind, len(word)))
    keywords.make_automaton()
    runs = ahocorasick.Automaton()
    runs.add_word("h" * HEX_LEAST, HEX_LEAST)
    runs.make_automaton()
    place = {kind: i for i, kind in enumerate(KINDS)}

    def scan(text: str) -> list[tuple[int, int, int]]:
        flat = text.encode("utf-8", "surrogatepass").translate(None, _CONTINUATION)
        spans, ends = [], dict.fromkeys(KINDS, 0)
        for last, (kind, length) in keywords.iter(flat.lower().decode("latin-1")):
            if (start := last + 1 - length) < ends[kind]:
                continue
            pattern, holds = RULES[kind]
            if m := pattern.match(flat, start):
                if kind == "pem":
                    if end := pem_end(flat, m):
                        ends[kind] = end
                        spans.append((start, place[kind], end))
                    continue
                ends[kind] = m.end()
                if holds(m):
                    spans.append((start, place[kind], m.end()))
        end = 0
        for last, length in runs.iter(flat.translate(_HEX_CLASS).decode("latin-1")):
            if last >= end:  # the first hit in a run: the run begins where the hit does
                m = HEX.match(flat, last + 1 - length)
                spans.append((m.start(), place["hex"], end := m.end()))
        return sorted(spans)

    return scan


def _worker():
    scan = scanner()

    def work(part: list[str]):
        out = [[] for _ in range(6)]
        for text in part:
            spans = scan(text)
            named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
            kinds = [k for _, k, _ in spans]
            base = ",".join(n for n, k in zip(named, kinds) if k < 3)
            for column, value in zip(out, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), ",".join(named), len(spans))):
                column.append(value)
        return out

    return work


def scan_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of df: counts and spans of secrets.

    Returns id_col, n_assign, n_access, n_hex, base_sha256, spans, n_spans.
    Null and empty texts have no spans; null and repeated ids stay, a row
    each; an empty table gives an empty table.  Whole texts are read, one scan
    and no shuffle.
    """
    long, string = pa.int64(), pa.string()
    fields = [("n_assign", long), ("n_access", long), ("n_hex", long), ("base_sha256", string), ("spans", string), ("n_spans", long)]
    return map_texts(df, id_col, text_col, fields, _worker)
