"""Text matching and tokenising functions (Column -> Column)."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

# Code points trimmed as white space (the Unicode White_Space property
# without U+000A, which never occurs inside a line).
SPACE_CODES = (0x09, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE_CHARS = "".join(map(chr, SPACE_CODES))

# The same set as a regular-expression class.
SPACE_CLASS = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Words left out of term counts.
STOP_WORDS = (
    "the", "a", "an", "is", "to", "in", "of", "and", "or", "for",
    "on", "at", "by", "with", "this", "that", "it", "be", "as", "from",
)

TOKEN_PATTERN = "([a-z0-9_-]+)"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, keeping the expression small."""
    return F.get(F.transform(F.array(value), body), 0)


def trim_space(text: Column) -> Column:
    """Trim white space, line ends included, from both ends.

    Most text begins and ends with a visible ASCII character and is returned as it is.
    """
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    visible = first.between("!", "~") & last.between("!", "~")
    return F.when(visible, text).otherwise(F.trim(text, F.lit(SPACE_CHARS + "\n")))


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS + "\n")) == ""


# POSIX classes, escapes that mean the same in both dialects, and what stands for the others.
POSIX_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit",
}
SAME_ESCAPES = set("AzdDwWtnrfa")
OTHER_ESCAPES = {
    "v": r"\x0B", "C": "(?s:.)",
    # words are made of ASCII letters, digits and "_"; what Java takes for a boundary depends on its version
    "b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", "B": r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))",
}
RE2_SPACE = r"\t\n\f\r "
RE2_NO_SPACE = r"\x{0}-\x{8}\x{B}\x{E}-\x{1F}\x{21}-\x{10FFFF}"
# Escapes without a meaning inside a class.
NOT_IN_CLASS = set("AzbBC")

# Classes that grow when case is folded, as code points: under folding RE2 counts the two
# letters that fold to an ASCII one, while Java's shorthands stay as they are.
FOLDED_CLASSES = {
    "word": ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)), "alnum": ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)),
    "alpha": ((0x41, 0x5A), (0x61, 0x7A)), "lower": ((0x41, 0x5A), (0x61, 0x7A)), "upper": ((0x41, 0x5A), (0x61, 0x7A)),
}
LONG_S_AND_KELVIN = ((0x17F, 0x17F), (0x212A, 0x212A))

_CODE_POINT = re.compile(r"x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|(0[0-7]{0,2}|[1-7][0-7]{1,2})")


def _folded_class(name: str, negated: bool) -> str:
    """The inside of a Java class for a shorthand under case folding."""
    spans = [*FOLDED_CLASSES[name], *LONG_S_AND_KELVIN]
    if negated:
        edges = [0, *[x for low, high in spans for x in (low - 1, high + 1)], 0x10FFFF]
        spans = list(zip(edges[::2], edges[1::2], strict=True))
    return "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in spans if low <= high)


def _escape(pattern: str, i: int, in_class: bool, fold: bool) -> tuple[str, int]:
    """The escape at ``i`` for Java, and the place behind it; ``fold`` is set where case is folded."""
    if i + 1 >= len(pattern):
        raise ValueError(f"bad regular expression {pattern!r}: trailing backslash")
    char = pattern[i + 1]
    if char in "pP":
        found = re.compile(r"\{(\^?)(\w+)\}|(\w)").match(pattern, i + 2)
        if not found:
            raise ValueError(f"bad regular expression {pattern!r}: bad character property")
        name = found[2] or found[3]
        sign = char if not found[1] else ("P" if char == "p" else "p")
        return f"\\{sign}{{{name if len(name) < 3 else 'Is' + name}}}", found.end()
    if char == "Q":
        end = pattern.find(r"\E", i + 2)
        text = pattern[i + 2:] if end < 0 else pattern[i + 2:end]
        return "".join(re.escape(c) for c in text), len(pattern) if end < 0 else end + 2
    code = _CODE_POINT.match(pattern, i + 1)
    if code:
        value = int(code[3], 8) if code[3] else int(code[1] or code[2], 16)
        if value > 0x10FFFF:
            raise ValueError(f"bad regular expression {pattern!r}: \\{code[0]} is no character")
        return f"\\x{{{value:X}}}", code.end()
    if fold and char in "wW":
        codes = _folded_class("word", char == "W")
        return (codes if in_class else f"[{codes}]"), i + 2
    if char in "sS":
        codes = RE2_SPACE if char == "s" else RE2_NO_SPACE
        return (codes if in_class else f"[{codes}]"), i + 2
    if in_class and char in NOT_IN_CLASS:
        raise ValueError(f"bad regular expression {pattern!r}: \\{char} in a class")
    if char in OTHER_ESCAPES:
        return OTHER_ESCAPES[char], i + 2
    if char in SAME_ESCAPES or not char.isalnum():
        return pattern[i:i + 2], i + 2
    raise ValueError(f"bad regular expression {pattern!r}: \\{char} is not supported")


def _character_class(pattern: str, i: int, fold: bool) -> tuple[str, int]:
    """The class that opens at ``i`` for Java, where ``[`` and ``&&`` inside it would have a meaning."""
    out, i = "[", i + 1
    if pattern[i:i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(pattern) and (pattern[i] != "]" or first):
        posix = re.compile(r"\[:(\^?)(\w+):\]").match(pattern, i)
        if posix:
            if posix[2] not in POSIX_CLASSES and posix[2] not in ("space", "word"):
                raise ValueError(f"bad regular expression {pattern!r}: {posix[0]}")
            short = {"space": "sS", "word": "wW"}.get(posix[2])
            if fold and posix[2] in FOLDED_CLASSES:
                out += _folded_class(posix[2], bool(posix[1]))
            else:
                out += f"\\{short[bool(posix[1])]}" if short else f"\\{'P' if posix[1] else 'p'}{{{POSIX_CLASSES[posix[2]]}}}"
            i = posix.end()
        elif pattern[i] == "\\":
            part, i = _escape(pattern, i, True, fold)
            out += part
        else:
            out += "\\" + pattern[i] if pattern[i] in "[]&^" else pattern[i]
            i += 1
        first = False
    if i >= len(pattern):
        raise ValueError(f"bad regular expression {pattern!r}: missing ]")
    return out + "]", i + 1


def java_pattern(pattern: str) -> str:
    """Rewrite an RE2 pattern so that Java's engine reads it the same way.

    Case folding covers all of Unicode; only U+000A ends a line; ``$`` is the very end of
    the text, or of a line under ``(?m)``; ``[`` and ``&&`` inside a class are plain;
    POSIX classes are translated. What RE2 lacks (look-around, back-references,
    possessive and atomic groups) raises ``ValueError``.
    """
    out, i, multi, fold, outer, folds = [], 0, False, False, [], False
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            part, i = _escape(pattern, i, False, fold)
            out.append(part)
            continue
        if char == "[":
            part, i = _character_class(pattern, i, fold)
            out.append(part)
            continue
        if char == "(":
            outer.append((multi, fold))
            group = re.compile(r"\(\?(?:P?<(\w+)>|([imsU]*)(?:-([imsU]+))?([:)]))").match(pattern, i)
            if pattern.startswith("(?", i) and not group:
                raise ValueError(f"bad regular expression {pattern!r}: {pattern[i:i + 4]} is not supported")
            if group and "U" in (group[2] or "") + (group[3] or ""):
                raise ValueError(f"bad regular expression {pattern!r}: the flag U is not supported")
            if group and group[1] is None:
                multi = (multi or "m" in group[2]) and "m" not in (group[3] or "")
                fold = (fold or "i" in group[2]) and "i" not in (group[3] or "")
                folds = folds or "i" in group[2]
                if group[4] == ")":
                    outer.pop()
            if group and group[1]:  # Java's names have no underscore
                out.append(f"(?<{group[1]}>" if re.fullmatch("[A-Za-z][A-Za-z0-9]*", group[1]) else "(")
            else:
                out.append(group[0] if group else "(")
            i = group.end() if group else i + 1
            continue
        repeat = re.compile(r"\{(\d+)(?:,(\d*))?\}").match(pattern, i) if char == "{" else None
        if char in "*+?" or repeat:
            if repeat and max(int(n) for n in repeat.groups() if n) > 1000:
                raise ValueError(f"bad regular expression {pattern!r}: repeat count over 1000")
            part = repeat[0] if repeat else char
            i += len(part)
            if pattern[i:i + 1] == "?":
                part, i = part + "?", i + 1
            if re.compile(r"[*+?]|\{\d+(,\d*)?\}").match(pattern, i):
                raise ValueError(f"bad regular expression {pattern!r}: nested repetition")
            out.append(part)
            continue
        if char == ")":
            if not outer:
                raise ValueError(f"bad regular expression {pattern!r}: unexpected )")
            multi, fold = outer.pop()
        out.append({
            "$": r"(?=\n|\z)" if multi else r"\z", "^": r"(?<![^\n])" if multi else r"\A", "{": r"\{", "}": r"\}", "]": r"\]",
        }.get(char, char))
        i += 1
    if outer:
        raise ValueError(f"bad regular expression {pattern!r}: missing )")
    return ("(?du)" if folds else "(?d)") + "".join(out)


def check_pattern(pattern: str) -> None:
    """Raise ``ValueError`` for a bad pattern before any data is read."""
    rewritten = java_pattern(pattern)
    spark = SparkSession.getActiveSession()
    if spark is None:
        return  # what only Java can tell is left to the query
    try:
        spark.sql("SELECT '' RLIKE :p", args={"p": rewritten}).collect()
    except Exception as exc:  # the error class differs between classic and Connect
        raise ValueError(f"bad regular expression {pattern!r}") from exc


def regexp_match(text: Column, pattern: str) -> Column:
    """Unanchored, case-sensitive match; NULL or empty text never matches."""
    return F.coalesce((text != "") & text.rlike(java_pattern(pattern)), F.lit(False))


def _like_to_regex(q: str) -> str:
    parts = re.split(r"([%_]+)", q)
    out = []
    for part in parts:
        if part and set(part) <= {"%", "_"}:
            out.append(part.replace("%", ".*").replace("_", "."))
        elif part:
            out.append(r"\Q" + part.replace(r"\E", r"\E\\E\Q") + r"\E")
    return "(?is)" + "".join(out)


def contains_like(text: Column, q: str) -> Column:
    """``text LIKE '%q%'`` folding ASCII letters only; ``%`` and ``_`` in q are wildcards.

    A plain ASCII needle is first looked for with a byte search over the lower-cased
    text, which rejects most rows cheaply; the regular expression then decides.
    """
    q = q.strip("%") if set(q) - {"%"} else ""
    if q == "":
        return text.isNotNull()
    exact = text.rlike(_like_to_regex(q))
    if q.isascii() and not set(q) & {"%", "_"}:
        return F.contains(F.lower(text), F.lit(q.lower())) & exact
    return exact


def attr(attrs: Column, key: str) -> Column:
    """Value of one attribute of a string map as text; NULL when absent."""
    return F.try_element_at(attrs, F.lit(key))


def json_attr(attrs: Column, key: str) -> Column:
    """The same for attributes kept as JSON text."""
    return F.get_json_object(attrs, f"$.{key}")


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits, ``_`` and ``-``."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def encode_json(value: Column) -> Column:
    return F.to_json(value)


def decode_json(text: Column, schema) -> Column:
    """Struct of the decoded ``value`` and, where the text is not such JSON, the ``text`` itself."""
    value = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    bad = text.isNotNull() & F.try_parse_json(text).isNull()
    return F.struct(F.when(~bad, value).alias("value"), F.when(bad, text).alias("text"))


def quote_literal(text: Column) -> Column:
    r"""Quote text for use inside a regular expression (``\Q`` ... ``\E``)."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def quote_replacement(text: Column) -> Column:
    """Quote text for use as a regular-expression replacement."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(escaped, F.lit("$"), F.lit("\\$"))
