"""SQL text that Spark and DuckDB both run: the few functions that are spelled differently are placeholders."""

from __future__ import annotations

import hashlib
import re

SPARK = {
    "micros": "unix_micros(CAST(ts AS TIMESTAMP))", "div": "DIV", "json_k": "CAST(get_json_object(props, '$.k') AS BIGINT)", "percentile": "percentile", "first_known": "first_value({0}) IGNORE NULLS",
    "hour": "pmod(t_us DIV 3600000000, 24)", "string": "STRING",
    "hash": "CAST(conv(substr(md5(CAST({0} AS STRING)), 1, 8), 16, 10) AS BIGINT)", "chars": "split({0}, '')", "explode": "explode({0})", "sequence": "sequence({0})", "sha256": "sha2({0}, 256)", "matches": "regexp_like({0})",
    "sub": "regexp_replace({0})", "sha1": "sha1({0})", "fixed": "format_string({0})", "list": "array({0})", "kept": "array_compact({0})", "sorted": "sort_array({0})", "joined": "array_join({0})", "part": "slice({0})",
    "hmac": "sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), CAST({0} AS BINARY)), 256))), 256)", "pick_max": "max_by({0})", "listed": "array_join(sort_array(collect_set({0})), ',')",
    # How often each character of a text occurs; entropy in bits of such counts, of so many in all.
    "counted": "transform(array_distinct(array_remove(split({0}, ''), '')), c -> length({0}) - length(replace({0}, c, '')))", "size": "size({0})",
    "entropy": "aggregate({0}, 0e0, (a, n) -> a - n * 1e0 / n_chars * ln(n * 1e0 / n_chars)) / ln(2e0)",
    # Depth of a text of braces alone; names of a JSON object.
    "depth": "aggregate(split({0}, ''), named_struct('at', 0, 'most', 0), (s, c) -> named_struct('at', s.at + CASE c WHEN '{{{{' THEN 1 WHEN '}}}}' THEN -1 ELSE 0 END, 'most', greatest(s.most, s.at + CASE c WHEN '{{{{' THEN 1 ELSE 0 END)), s -> s.most)",
    "keys": "coalesce(size(json_object_keys({0})), 0)",
}
DUCKDB = {
    "micros": "epoch_us(ts)", "div": "//", "json_k": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "percentile": "quantile_cont", "first_known": "first_value({0} IGNORE NULLS)",
    "hour": "(t_us // 3600000000) % 24", "string": "VARCHAR",
    "hash": "CAST('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8) AS BIGINT)", "chars": "string_split({0}, '')", "explode": "unnest({0})", "sequence": "generate_series({0})", "sha256": "sha256({0})", "matches": "regexp_matches({0})",
    "sub": "regexp_replace({0}, 'g')", "sha1": "sha1({0})", "fixed": "printf({0})", "list": "[{0}]", "kept": "list_filter({0}, lambda x: x IS NOT NULL)", "sorted": "list_sort({0})", "joined": "array_to_string({0})", "part": "list_slice({0})",
    "hmac": "sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({0}))))", "pick_max": "arg_max({0})", "listed": "array_to_string(list_sort(list(DISTINCT {0})), ',')",
    "counted": "list_transform(list_distinct(string_split({0}, '')), lambda c: length({0}) - length(replace({0}, c, '')))", "size": "len({0})",
    "entropy": "list_sum(list_transform({0}, lambda n: -n * 1e0 / n_chars * ln(n * 1e0 / n_chars))) / ln(2e0)",
    "depth": "coalesce(list_max(list_transform(range(1, length({0}) + 1), lambda i: 2 * length(replace(substr({0}, 1, i), '}}}}', '')) - i)), 0)",
    "keys": "coalesce(len(json_keys({0})), 0)",
}


#: Key of keyed hashes; a deployment sets its own before the first query is built.
KEY = b"skytally"


def pads(key: bytes) -> dict[str, str]:
    """The two padded forms of a key (hexadecimal) that a keyed hash is made of."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    return {"inner": bytes(b ^ 0x36 for b in block).hex(), "outer": bytes(b ^ 0x5C for b in block).hex()}


PADS = pads(KEY)
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def fill(text: str, dialect: dict[str, str]) -> str:
    """Replaces ``<name>`` and ``<name:argument>``; decimal numbers become doubles, as both engines else compute with few places."""

    def one(m: re.Match) -> str:
        found = dialect.get(m[1])
        if found is None:
            return m[0]
        return found.format(m[2], **PADS) if m[2] is not None else found

    before = None
    while before != text:  # innermost first: an argument may hold placeholders
        before, text = text, re.sub(r"<(\w+)(?::([^<>]*))?>", one, text)
    return _DECIMAL.sub(r"\1e0", text)
