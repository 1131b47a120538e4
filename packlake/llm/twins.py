"""SQL twins that need a checksum DuckDB lacks, written out bit by bit."""

# crc32 of a list of bytes: the table of the reflected polynomial 0xEDB88320, then one step a byte
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i)))"""


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a string's UTF-8 bytes; ``crc_table`` must be in scope."""
    code = f"list_transform(range(1, length(hex({text})) // 2 + 1), lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, crc_table.t[xor(c, b) % 256 + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), {step}), 4294967295)"
