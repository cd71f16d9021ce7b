"""SQL pieces for the checks: CRC-32 in DuckDB, which has no function for it."""

#: Tables of a WITH clause: the 256 remainders of the polynomial.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc32(text: str, table: str = "t") -> str:
    """SQL of the unsigned CRC-32 of the UTF-8 bytes of the expression ``text``; ``table``: the column of crc_table."""
    digits = f"hex(encode({text}))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, strlen({text})), lambda i: ('0x' || substr({digits}, 2 * i::INT + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"
