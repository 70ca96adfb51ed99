"""Pieces of DuckDB SQL that several operators' oracles share."""

from __future__ import annotations


def nibble_table(polynomial: int = 0xEDB88320) -> list[int]:
    """What a CRC of the reflected ``polynomial`` makes of each value of its last four bits."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (polynomial if value & 1 else 0)
        out.append(value)
    return out


def crc32_of(text: str) -> str:
    """The CRC-32 of the SQL expression ``text`` in UTF-8, as an unsigned number; its characters are ASCII or U+00C0 to U+00FF."""
    table = "[" + ", ".join(f"{x}::UBIGINT" for x in nibble_table()) + "]"
    halves = (
        f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [(unicode(ch) & 15)::UBIGINT, (unicode(ch) >> 4)::UBIGINT] "
        "ELSE [3::UBIGINT, 12::UBIGINT, ((unicode(ch) - 64) & 15)::UBIGINT, ((unicode(ch) - 64) >> 4)::UBIGINT] END))"
    )
    return f"xor(list_reduce({halves}, lambda c, x: xor(c >> 4, {table}[((xor(c, x) & 15) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)"
