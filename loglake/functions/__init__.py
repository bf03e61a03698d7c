from loglake.functions.levels import (
    level_by_content,
    level_from_http_status,
    level_or_unknown,
    normalize_level,
)
from loglake.functions.text import (
    attr,
    contains_like,
    decode_json,
    encode_json,
    is_blank,
    json_attr,
    regexp_match,
    tokenize,
    trim_space,
)
from loglake.functions.times import first_date, parse_datetime, time_bucket

__all__ = [
    "attr", "contains_like", "decode_json", "encode_json", "first_date", "is_blank",
    "json_attr", "level_by_content", "level_from_http_status",
    "level_or_unknown", "normalize_level", "parse_datetime", "regexp_match",
    "time_bucket", "tokenize", "trim_space",
]
