"""Secret scan: a keyword automaton, anchored patterns near its hits, then embedded checksums.

Each text is read once by two Aho-Corasick automata: one over its lower-cased letters with the
keywords of all kinds, one over its character classes, whose only keyword is a run of 32 hex
digits.  A pattern is tried only where a keyword was hit, anchored there.  Kinds whose tokens
carry a checksum are kept only if it holds; the others only if they are long enough.

Kinds, in the order of ties: ``assign`` (a value of 8 or more characters assigned to a
telling name), ``access`` (access key ids), ``hex`` (32 or more hex digits); and, with a checksum,
``github`` and ``npm`` (CRC-32 in base 62 in the last six characters), ``xprv`` (base 58 with a double
SHA-256), ``age`` and ``nsec`` (Bech32).  Matches of one kind never overlap; those of two kinds may.

Positions are code points, ends exclusive.  Defined cases: null and empty texts have no
secrets; every row gives one row, repeated rows and null ids too; an empty table gives an empty one;
other columns are not read, and pass through ``redact`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.store import small_batches

# The keywords of each kind (lower case) and the pattern that is anchored at them.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
    "age": ("age-secret-key-1",),
    "nsec": ("nsec1",),
}
PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "xprv": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107,108}(?![0-9A-Za-z])"),
    "age": re.compile(rb"(AGE-SECRET-KEY-)1([02-9AC-HJ-NP-Z]{58})(?![0-9A-Za-z])"),
    "nsec": re.compile(rb"(nsec)1([02-9ac-hj-np-z]{58})(?![0-9A-Za-z])"),
}
KINDS = ("assign", "access", "hex", "github", "npm", "xprv", "age", "nsec")
BASE_KINDS = KINDS[:3]
HEX_RUN = 32
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"

_ORDER = {kind: i for i, kind in enumerate(KINDS)}
_CLASS = bytes(104 if byte in b"0123456789abcdef" else 32 for byte in range(256))  # "h" or blank


def crc_base62(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of ``body``."""
    value, digits = zlib.crc32(body), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits))


def base58_holds(token: bytes) -> bool:
    """The last four of the 82 bytes are the head of a double SHA-256 of the others."""
    value = 0
    for byte in token:
        value = value * 58 + BASE58.index(byte)
    if value >= 1 << 8 * 82:
        return False
    data = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_residue(prefix: bytes, digits: bytes) -> int:
    """Residue of the checksum polynomial over prefix and digits; 1 where the checksum holds."""
    prefix = prefix.lower()
    state = 1
    for value in chain((c >> 5 for c in prefix), (0,), (c & 31 for c in prefix), (BECH32.index(c) for c in digits.lower())):
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ value
        for bit, term in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            if top >> bit & 1:
                state ^= term
    return state


VALID = {
    "assign": lambda m: len(m[2]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "hex": lambda m: len(m[0]) >= HEX_RUN,
    "github": lambda m: crc_base62(m[1]) == m[2],
    "npm": lambda m: crc_base62(m[1]) == m[2],
    "xprv": lambda m: base58_holds(m[0]),
    "age": lambda m: bech32_residue(m[1], m[2]) == 1,
    "nsec": lambda m: bech32_residue(m[1], m[2]) == 1,
}


@lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of keywords and of classes; made once in a worker."""
    words, classes = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for keyword in keywords:
            words.add_word(keyword, (kind, len(keyword)))
    classes.add_word("h" * HEX_RUN, ("hex", HEX_RUN))
    words.make_automaton()
    classes.make_automaton()
    return words, classes


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets of one text, by start and then by kind."""
    words, classes = _automata()
    # One byte a code point: no pattern holds a character outside ASCII.
    raw = text.encode("latin-1", "replace")
    past, found = dict.fromkeys(KINDS, 0), []
    for end, (kind, length) in chain(words.iter(raw.lower().decode("latin-1")), classes.iter_long(raw.translate(_CLASS).decode("latin-1"))):
        start = end + 1 - length
        hit = PATTERNS[kind].match(raw, start) if start >= past[kind] else None
        if hit:
            past[kind] = hit.end()
            if VALID[kind](hit):
                found.append((start, hit.end(), kind))
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``secrets``: an array of (kind, start, end), by start and then by kind.  A map over rows."""
    small_batches(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in find(text.as_py() or "")] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "secrets"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, secrets array<struct<kind: string, start: bigint, end: bigint>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; overlapping ones by that of the first.

    A null text stays null.
    """

    @F.pandas_udf("string")
    def hide(texts):
        def one(text):
            out, past = [], 0
            for start, end, kind in find(text):
                if start >= past:
                    out += [text[past:start], f"[{kind}]"]
                past = max(past, end)
            return "".join([*out, text[past:]])

        return texts.map(one, na_action="ignore")

    small_batches(docs.sparkSession)
    return docs.withColumn(text_col, hide(docs[text_col]))


def count_of(kind: str) -> Column:
    """Number of secrets of a kind in a row of ``scan``."""
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")


def joined(secrets: Column) -> Column:
    """kind:start:end of the secrets, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_only() -> Column:
    """Secrets of the kinds that carry no checksum."""
    return F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
