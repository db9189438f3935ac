"""Parts of the DuckDB SQL that several queries of this subpackage share."""

from __future__ import annotations


def words_sql(text: str) -> str:
    """The words of a text as a list."""
    return rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"


def crc32_sql(name: str, rows: str) -> str:
    """CTE `name`: the rows with `crc`, the CRC-32 (as of zlib) of their ASCII column `crc_of`; null gives null."""
    table = "list_transform(range(0, 256), lambda b: list_reduce(range(0, 8), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)), b))"
    step = "lambda x, y: xor(x >> 8, crc_table[(xor(x, y) & 255) + 1])"
    codes = "list_transform(string_split(crc_of, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"{name}_table AS (SELECT {table} AS crc_table),\n{name} AS (SELECT * EXCLUDE (crc_table, crc_of), xor(list_reduce({codes}, {step}, 4294967295), 4294967295) AS crc FROM ({rows}), {name}_table)"
