"""CRC-32 of joined byte strings from the checksums of their parts, and CRC-32 as SQL."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed value of the format: the reversed polynomial.
POLYNOMIAL = 0xEDB88320

# One step of the checksum for every byte value, as a list column `t` of one row.
TABLE_SQL = f"""crc_table AS (SELECT list(c ORDER BY k) AS t FROM (
  WITH RECURSIVE r(k, step, c) AS (
    SELECT k, 0, k::UBIGINT FROM range(256) x(k)
    UNION ALL SELECT k, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, {POLYNOMIAL}::UBIGINT) ELSE c // 2 END FROM r WHERE step < 8)
  SELECT k, c FROM r WHERE step = 8))"""


def crc_sql(values: str) -> str:
    """CRC-32 of a list of byte values, next to `crc_table`."""
    return f"xor(4294967295::UBIGINT, list_reduce({values}, lambda c, b: xor(c // 256, t[(xor(c, b) % 256 + 1)::BIGINT]), 4294967295::UBIGINT))"


def ascii_sql(text: str) -> str:
    """The byte values of an ASCII text."""
    return f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UBIGINT)"


def utf8_sql(text: str) -> str:
    """The byte values of any text."""
    return f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::UBIGINT)"


@lru_cache(maxsize=1)
def _doubling() -> list[np.ndarray]:
    """Tables (4 bytes by 256 values) that carry a checksum over 1, 2, 4, ... 2**31 zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    step = np.zeros((4, 256), np.uint32)
    values = np.arange(256, dtype=np.uint32)
    for k in range(4):
        shifted = values << np.uint32(8 * k)
        step[k] = (shifted >> np.uint32(8)) ^ one[shifted & 0xFF]
    tables = [step]
    for _ in range(31):
        tables.append(np.stack([_apply(tables[-1], row) for row in tables[-1]]))
    return tables


def _apply(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    byte = np.uint32(0xFF)
    return table[0, values & byte] ^ table[1, (values >> 8) & byte] ^ table[2, (values >> 16) & byte] ^ table[3, values >> 24]


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of strings A followed by strings B, from the checksums of both (uint32) and the byte lengths of B."""
    out = first.astype(np.uint32)
    left = np.asarray(length, np.int64).copy()
    for table in _doubling():
        odd = np.flatnonzero(left & 1)
        if len(odd):
            out[odd] = _apply(table, out[odd])
        left >>= 1
        if not left.any():
            break
    return out ^ second
