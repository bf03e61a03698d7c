"""Encoding detection and decoding to UTF-8, with built-in functions only."""

from __future__ import annotations

import codecs

from pyspark.sql import Column, functions as F

UTF8 = "UTF-8"

# The single-byte encodings read, by name and Python codec.
SINGLE_BYTE = {
    "Windows-1251": "cp1251",
    "Windows-1252": "cp1252",
    "ISO-8859-1": "latin-1",
    "ISO-8859-5": "iso8859-5",
}

# The most frequent Russian letters in both cases, which tell the Cyrillic encodings apart.
FREQUENT_LETTERS = "оеаинтсрвлОЕАИНТСРВЛ"

_HIGH = "".join(chr(code) for code in range(0x80, 0x100))


def _decoded_high(codec: str) -> str:
    """The upper half of a code page; bytes without a meaning become U+FFFD."""
    table = codecs.decode(bytes(range(0x80, 0x100)), codec, errors="replace")
    return table


def _letters_as_bytes(codec: str) -> str:
    return "".join(chr(b) for b in FREQUENT_LETTERS.encode(codec))


# Frequent letters that a break outweighs.
BREAK_WEIGHT = 3

# What is counted of bytes read as ISO-8859-1. No pattern reaches over a line feed, so the
# counts of a content are the sums of those of its lines.
BYTE_COUNTS = {
    # words of high bytes only, as Cyrillic writes them
    "high_words": r"(?<![A-Za-z\x{80}-\x{FF}])[\x{A1}-\x{FF}]{2,}(?![A-Za-z\x{80}-\x{FF}])",
    # high bytes next to ASCII letters, as in western words
    "mixed_pairs": r"[A-Za-z][\x{C0}-\x{FF}]|[\x{C0}-\x{FF}][A-Za-z]",
    "cp1251_letters": "[" + _letters_as_bytes("cp1251") + "]",
    "iso5_letters": "[" + _letters_as_bytes("iso8859-5") + "]",
    # a capital right after a small letter, as the wrong one of the two shows them
    "cp1251_breaks": r"[\x{E0}-\x{FF}](?=[\x{C0}-\x{DF}])",
    "iso5_breaks": r"[\x{D0}-\x{EF}](?=[\x{B0}-\x{CF}])",
    # printed by Windows-1252 alone
    "controls": r"[\x{80}-\x{9F}]",
}


def byte_counts(content: Column) -> dict[str, Column]:
    """Counts that tell the encoding: of a whole content, or of a part that ends at a line feed.

    They are added up over the parts of a file. ``broken`` counts parts that are no UTF-8; the
    others cost nothing for parts in ASCII.
    """
    latin = F.decode(content, "ISO-8859-1")
    valid = F.is_valid_utf8(content)
    plain = valid & (F.octet_length(content) == F.char_length(content.cast("string")))
    counts = {"broken": F.when(valid, 0).otherwise(1)}
    for name, pattern in BYTE_COUNTS.items():
        counts[name] = F.when(plain, 0).otherwise(F.regexp_count(latin, F.lit(pattern)))
    return {name: F.when(content.isNull(), 0).otherwise(count).cast("bigint") for name, count in counts.items()}


def encoding_of(counts: dict[str, Column]) -> Column:
    """Name of the encoding of a content with these counts: the one rule for all files.

    A content without a part that is no UTF-8, an empty one included, is UTF-8. Otherwise words
    of high bytes only mean Cyrillic, high bytes next to ASCII letters a western encoding.
    """
    likely = {name: counts[f"{name}_letters"] - BREAK_WEIGHT * counts[f"{name}_breaks"] for name in ("cp1251", "iso5")}
    cyrillic = F.when(likely["cp1251"] >= likely["iso5"], "Windows-1251").otherwise("ISO-8859-5")
    western = F.when(counts["controls"] > 0, "Windows-1252").otherwise("ISO-8859-1")
    guess = F.when(counts["high_words"] > counts["mixed_pairs"], cyrillic).otherwise(western)
    return F.when(counts["broken"] == 0, UTF8).otherwise(guess)


def detect_encoding(content: Column) -> Column:
    """Name of a whole content's encoding; all of its bytes are looked at."""
    return encoding_of(byte_counts(content))


def decode_text(content: Column, encoding: Column) -> Column:
    """Content as text; an unknown encoding is read as UTF-8.

    Single-byte code pages are read as ISO-8859-1 and their upper half is mapped, which
    needs no session setting.
    """
    latin = F.decode(content, "ISO-8859-1")
    utf8 = F.decode(F.encode(F.make_valid_utf8(content.cast("string")), "UTF-8"), "UTF-8")
    text = utf8
    for name, codec in SINGLE_BYTE.items():
        mapped = latin if codec == "latin-1" else F.translate(latin, _HIGH, _decoded_high(codec))
        text = F.when(encoding == name, mapped).otherwise(text)
    return text
