"""SQL functions under the names that texts written for other engines use, as temporary SQL functions: Catalyst inlines them, so they cost what their bodies cost.

Where Spark has a function of the same name with another meaning, Spark's own is left alone.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from marlstone.model import MEDIA

#: name: (parameters, result, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "media_uri": (f"m {MEDIA}", "STRING", "m.uri"),
    "media_type": (f"m {MEDIA}", "STRING", "m.media_type"),
    "strpos": ("s STRING, part STRING", "INT", "instr(s, part)"),
    "starts_with": ("s STRING, part STRING", "BOOLEAN", "startswith(s, part)"),
    "ends_with": ("s STRING, part STRING", "BOOLEAN", "endswith(s, part)"),
    "to_hex": ("n BIGINT", "STRING", "lower(hex(n))"),
    "sha256": ("s STRING", "STRING", "sha2(s, 256)"),
    "sha512": ("s STRING", "STRING", "sha2(s, 512)"),
    "gcd": ("a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(1, 92), named_struct('a', abs(a), 'b', abs(b)), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"),
    "lcm": ("a BIGINT, b BIGINT", "BIGINT", "if(a = 0 or b = 0, 0L, abs(a div aggregate(sequence(1, 92), named_struct('a', abs(a), 'b', abs(b)), (s, i) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a) * b))"),
    "array_length": ("a ARRAY<STRING>", "INT", "if(a is null or size(a) = 0, null, size(a))"),
    "array_has": ("a ARRAY<STRING>, x STRING", "BOOLEAN", "array_contains(a, x)"),
    "array_has_any": ("a ARRAY<STRING>, b ARRAY<STRING>", "BOOLEAN", "arrays_overlap(a, b)"),
    "array_has_all": ("a ARRAY<STRING>, b ARRAY<STRING>", "BOOLEAN", "size(array_except(b, a)) = 0"),
    "array_to_string": ("a ARRAY<STRING>, sep STRING", "STRING", "array_join(a, sep)"),
    "string_to_array": ("s STRING, sep STRING", "ARRAY<STRING>", r"split(s, concat('\\Q', sep, '\\E'))"),
    "regexp_match": ("s STRING, pattern STRING", "ARRAY<STRING>", "nullif(slice(regexp_extract_all(s, pattern, 0), 1, 1), array())"),
    "date_bin": ("width INTERVAL DAY TO SECOND, t TIMESTAMP, origin TIMESTAMP", "TIMESTAMP", "timestamp_micros(unix_micros(origin) + CAST(floor((unix_micros(t) - unix_micros(origin)) / (extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + extract(SECOND FROM width) * 1000000)) AS BIGINT) * CAST(extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + extract(SECOND FROM width) * 1000000 AS BIGINT))"),
    "to_timestamp_millis": ("n BIGINT", "TIMESTAMP", "timestamp_millis(n)"),
    "to_timestamp_micros": ("n BIGINT", "TIMESTAMP", "timestamp_micros(n)"),
    "to_timestamp_seconds": ("n BIGINT", "TIMESTAMP", "timestamp_seconds(n)"),
    "trunc_number": ("x DOUBLE", "DOUBLE", "if(x < 0, ceil(x), floor(x))"),
}


def register(spark: SparkSession, *names: str) -> None:
    """Register all functions, or those named, for this session."""
    for name in names or FUNCTIONS:
        parameters, result, body = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
