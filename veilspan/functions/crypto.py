"""Keyed hashing and format-preserving encryption.

HMAC-SHA256 is a column expression. Keys are arguments and have no defaults. Their padded forms are literals in the plan,
so let Spark hide such strings (its setting for patterns of secret text) where plans are logged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64


def _pads(key: str | bytes) -> tuple[str, str]:
    raw = key.encode() if isinstance(key, str) else key
    if not raw:
        raise ValueError("an empty key protects nothing")
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sha256(key: str | bytes, value: Column) -> Column:
    """Lowercase hex of the value's (UTF-8) HMAC-SHA256."""
    inner, outer = _pads(key)
    digest = F.sha2(F.concat(F.unhex(F.lit(inner)), value.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(digest)), 256)


def hmac_sha256_sql(key: str | bytes, value: str) -> str:
    """The same in DuckDB's SQL."""
    inner, outer = _pads(key)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


# --- AES for single blocks, for the Feistel rounds: tables are computed from the field's rule ---


@lru_cache(maxsize=1)
def _sbox() -> bytes:
    box, p, q = bytearray(256), 1, 1
    while True:
        p ^= (p << 1 & 0xFF) ^ (0x1B if p & 0x80 else 0)
        q ^= q << 1 & 0xFF
        q ^= q << 2 & 0xFF
        q ^= q << 4 & 0xFF
        q ^= 0x09 if q & 0x80 else 0
        box[p] = q ^ (q << 1 | q >> 7) & 0xFF ^ (q << 2 | q >> 6) & 0xFF ^ (q << 3 | q >> 5) & 0xFF ^ (q << 4 | q >> 4) & 0xFF ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    return bytes(box)


def _double(x: np.ndarray) -> np.ndarray:
    return (x << 1 ^ np.where(x & 0x80, 0x1B, 0)).astype(np.uint8)


class AesBlocks:
    """Encrypts many 16-byte blocks at once under one key of 16, 24 or 32 bytes."""

    def __init__(self, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("an AES key has 16, 24 or 32 bytes")
        self.box = np.frombuffer(_sbox(), np.uint8)
        words, n = [key[i : i + 4] for i in range(0, len(key), 4)], len(key) // 4
        self.rounds, factor = n + 6, 1
        for i in range(n, 4 * (self.rounds + 1)):
            word = words[-1]
            if i % n == 0:
                word = bytes(self.box[[word[1], word[2], word[3], word[0]]])
                word = bytes([word[0] ^ factor]) + word[1:]
                factor = factor << 1 ^ (0x11B if factor & 0x80 else 0)
            elif n > 6 and i % n == 4:
                word = bytes(self.box[list(word)])
            words.append(bytes(a ^ b for a, b in zip(words[i - n], word, strict=True)))
        self.keys = np.frombuffer(b"".join(words), np.uint8).reshape(-1, 16)
        self.shift = np.array([4 * ((c + r) % 4) + r for c in range(4) for r in range(4)])

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        state = blocks ^ self.keys[0]
        for number in range(1, self.rounds + 1):
            state = self.box[state][:, self.shift]
            if number < self.rounds:
                columns = state.reshape(-1, 4, 4)
                every = columns[:, :, 0] ^ columns[:, :, 1] ^ columns[:, :, 2] ^ columns[:, :, 3]
                following = np.roll(columns, -1, axis=2)
                state = (columns ^ every[:, :, None] ^ _double(columns ^ following)).reshape(-1, 16)
            state = state ^ self.keys[number]
        return state


class DigitCipher:
    """FF3-1: format-preserving encryption of digit strings, 56-bit tweak, eight Feistel rounds."""

    RADIX, ROUNDS, LEAST, MOST = 10, 8, 6, 56

    def __init__(self, key_hex: str, tweak_hex: str):
        tweak = bytes.fromhex(tweak_hex)
        if len(tweak) != 7:
            raise ValueError("the tweak has 7 bytes")
        self.aes = AesBlocks(bytes.fromhex(key_hex)[::-1])
        self.halves = tweak[:3] + bytes([tweak[3] & 0xF0]), tweak[4:] + bytes([(tweak[3] & 0x0F) << 4])

    def _round(self, number: int, half: list[int]) -> list[int]:
        tweak = self.halves[1 if number % 2 == 0 else 0]
        head = tweak[:3] + bytes([tweak[3] ^ number])
        blocks = np.array([list((head + value.to_bytes(12, "big"))[::-1]) for value in half], np.uint8).reshape(-1, 16)
        return [int.from_bytes(bytes(row[::-1]), "big") for row in self.aes.encrypt(blocks)]

    def _run(self, digits: list[str], encrypt: bool) -> list[str]:
        """All strings together, round by round. Numbers are written with the last digit first, as the method has it."""
        for d in digits:
            if not (d.isascii() and d.isdigit() and self.LEAST <= len(d) <= self.MOST):
                raise ValueError(f"only {self.LEAST} to {self.MOST} digits can be encrypted")
        sizes = [(-(-len(d) // 2), len(d) // 2) for d in digits]
        a = [int(d[:u][::-1]) for d, (u, _) in zip(digits, sizes, strict=True)]
        b = [int(d[u:][::-1]) for d, (u, _) in zip(digits, sizes, strict=True)]
        for number in range(self.ROUNDS) if encrypt else reversed(range(self.ROUNDS)):
            widths = [s[number % 2] for s in sizes]
            if encrypt:
                a, b = b, [(x + y) % 10**w for x, y, w in zip(a, self._round(number, b), widths, strict=True)]
            else:
                b, a = a, [(x - y) % 10**w for x, y, w in zip(b, self._round(number, a), widths, strict=True)]
        return [str(x).zfill(u)[::-1] + str(y).zfill(v)[::-1] for x, y, (u, v) in zip(a, b, sizes, strict=True)]

    def encrypt(self, digits: list[str]) -> list[str]:
        return self._run(digits, True)

    def decrypt(self, digits: list[str]) -> list[str]:
        return self._run(digits, False)

    def formatted(self, values: list[str], encrypt: bool = True) -> list[str]:
        """The digits of each value encrypted or decrypted in their places; other characters stay."""
        done = iter(self._run(["".join(c for c in v if c.isdigit()) for v in values], encrypt))
        out = []
        for value in values:
            digits = iter(next(done))
            out.append("".join(next(digits) if c.isdigit() else c for c in value))
        return out


def _digits_udf(key_hex: str, tweak_hex: str, encrypt: bool) -> Callable[[Column], Column]:
    def run(values: pd.Series) -> pd.Series:
        cipher, out = DigitCipher(key_hex, tweak_hex), pd.Series([None] * len(values), index=values.index, dtype=object)
        fit = values.map(lambda v: v is not None and DigitCipher.LEAST <= sum(c.isascii() and c.isdigit() for c in v) <= DigitCipher.MOST)
        if fit.any():
            out[fit] = cipher.formatted(list(values[fit]), encrypt)
        return out

    return F.pandas_udf(run, T.StringType())


def encrypt_digits(value: Column, key_hex: str, tweak_hex: str) -> Column:
    """Format-preserving encryption in the value's own format; null for null and for values with too few or many digits."""
    return _digits_udf(key_hex, tweak_hex, True)(value)


def decrypt_digits(value: Column, key_hex: str, tweak_hex: str) -> Column:
    return _digits_udf(key_hex, tweak_hex, False)(value)
