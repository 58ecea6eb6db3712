"""CRC-32 as SQL text, for the SQL that queries are compared with."""

#: A table expression ``crc`` with the list ``t`` of the checksum's 256 steps.
TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def crc32(hexed: str) -> str:
    """The checksum of the bytes that a column has in hexadecimal digits, beside ``crc``'s ``t``."""
    return f"xor(list_reduce(list_prepend(4294967295, [('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT for i in range(length({hexed}) // 2)]), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295)"
