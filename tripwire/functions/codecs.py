"""Decoders as column expressions: Base64, hex, Morse, Caesar rotation.

All are total: bad input gives NULL, never an error (ANSI-safe ``try_*``).
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripwire.constants import MORSE
from tripwire.regex import NON_PRINTABLE

ALPHABET = string.ascii_lowercase + string.ascii_uppercase


def rot_alphabet(n: int) -> str:
    """Replacement alphabet for a Caesar shift of ``n`` (ASCII letters only, case kept)."""
    lo = "".join(chr((i + n) % 26 + 97) for i in range(26))
    return lo + lo.upper()


def rot_n(text: Column, n) -> Column:
    """Caesar rotation; ``n`` may be an int or an integer column (1..25)."""
    if isinstance(n, int):
        return F.translate(text, ALPHABET, rot_alphabet(n % 26))
    table = F.array(*[F.lit(rot_alphabet(r)) for r in range(26)])
    return F.call_function("translate", text, F.lit(ALPHABET),
                           F.element_at(table, F.pmod(n, F.lit(26)) + 1))


def printable_ok(txt: Column, min_len: int) -> Column:
    """> 75 % printable code points and at least ``min_len`` of them."""
    n = F.length(txt)
    share = (n - F.regexp_count(txt, F.lit(NON_PRINTABLE))) / F.greatest(n, F.lit(1))
    return (n >= min_len) & (share > 0.75)


def utf8_replace(binary: Column) -> Column:
    """bytes.decode('utf-8', errors='replace')."""
    return F.call_function("make_valid_utf8", binary.cast("string"))


def b64_bytes(blob: Column) -> Column:
    """Strict Base64 decode (standard or URL-safe alphabet, auto padding).

    Valid exactly when Python's ``b64decode(blob + '=' * (-len % 4), validate=True)`` is:
    data length not 1 mod 4 and no excess padding.
    """
    core = F.translate(F.rtrim(blob, F.lit("=")), "-_", "+/")
    m = F.length(core)
    k = F.length(blob) - m
    r = F.pmod(m, F.lit(4))
    valid = ((r == 0) & (k == 0)) | (r == 2) | ((r == 3) & (k <= 1))
    padded = F.concat(core, F.repeat(F.lit("="), F.pmod(-m, F.lit(4))))
    return F.when(valid, F.call_function("try_to_binary", padded, F.lit("base64")))


def b64_decode_printable(blob: Column) -> Column:
    txt = utf8_replace(b64_bytes(blob))
    return F.when(printable_ok(txt, 4), txt)


def hex_decode(h: Column) -> Column:
    """bytes.fromhex(h).decode('utf-8', 'replace'); NULL for odd length."""
    return F.when(F.pmod(F.length(h), F.lit(2)) == 0,
                  utf8_replace(F.call_function("try_to_binary", h, F.lit("hex"))))


def hex_decode_printable(h: Column, min_len: int = 3) -> Column:
    txt = hex_decode(h)
    return F.when(printable_ok(txt, min_len), txt)


def morse_decode(tokens: Column) -> Column:
    """Map each dot/dash token to its letter, '?' when unknown, joined without spaces."""
    pairs = ", ".join(f"'{code}', '{letter}'" for code, letter in MORSE.items())
    table = F.expr(f"map({pairs})")
    return F.array_join(
        F.transform(tokens, lambda t: F.coalesce(F.call_function("try_element_at", table, t), F.lit("?"))), "")
