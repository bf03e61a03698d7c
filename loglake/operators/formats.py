"""Log formats: how a record begins, goes on and is taken apart.

A format is a plain description; all of its work is done by Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loglake.functions.levels import level_from_http_status, level_in_text, level_of_word
from loglake.functions.memo import memo
from loglake.functions.text import SPACE_CLASS, is_blank, let, trim_space
from loglake.functions.times import first_date, millis_to_ts, with_datetime

SAMPLE_LINES = 20

# Fixed patterns: the beginning of a record in each format, after leading white space.
ORACLE_HEAD = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[-+]\d{2}:\d{2}"
WEBLOGIC_HEAD = r"####<"
WLS_STDOUT_HEAD = (
    r"<(?:[A-Z][a-z]{2} \d{1,2}, \d{4} \d{1,2}:\d{2}:\d{2} (?:AM|PM)(?: [^>\n]+)?>"
    r"|\d{4}-\d{2}-\d{2} GMT[-+]\d+ \d{2}:\d{2}:\d{2}>)"
)
JAVA_HEAD = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}[\t\f\r ]+(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\b"
ACCESS_HEAD = r'\S+ \S+ \S+ \[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [-+]\d{4}\] "'
ODL_HEAD = r"\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+[+-]\d{2}:\d{2}\]"

# Fixed pattern: time, code and message at the end of a head with the separator inside the message.
WEBLOGIC_TAIL = r".*?> <(\d+)> <([^<>\[\]]*)> <(.*)"

# Fixed pattern: lines that go on with a record in the java format.
JAVA_CONTINUATION = r"^(?:\s+at |Caused by:|\t|\s+\.\.\. )"

# Fixed patterns: the fields of a head line.
JAVA_FIELDS = (
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\s+(INFO|WARN|ERROR|DEBUG|TRACE|FATAL)\s*"
    r"(?:\[([^\]]*)\])?\s*([^\s]+)\s*-\s*(.*)"
)
ACCESS_FIELDS = r'(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\S+).*'
ODL_FIELDS = (
    r"\[([^\]]+)\] \[([^\]]*)\] \[([^\]]*)\] \[[^\]]*\] \[([^\]]*)\] "
    r"\[tid: ([^\]]*)\] \[userId: ([^\]]*)\] \[ecid: ([^\]]*)\]\s*(.*)"
)

FIELD_NAMES = ("ts", "ts_raw", "tz_offset", "tz_inferred", "level", "component", "message", "attrs")


@dataclass(frozen=True)
class Record:
    """Columns of a record on its way to its fields. Each is made by a projection of its own.

    ``head`` is the first line, trimmed; ``rest`` what follows the first line feed, or NULL;
    ``groups`` and ``more`` are what a format's ``groups`` and ``more`` gave, NULL for a
    record without a head.
    """

    raw: Column
    head: Column
    rest: Column
    groups: Column
    more: Column

    def group(self, i: int) -> Column:
        return F.get(self.groups, F.lit(i))


@dataclass(frozen=True)
class FormatSpec:
    """A named log format.

    ``head``          pattern a record's first line begins with (None: every line is a record)
    ``whole_line``    the head pattern must cover the whole trimmed line
    ``continuation``  pattern of the lines that go on with a record (None: every line does)
    ``keep_blank``    for line formats: blank lines are records too
    ``detects``       False for a format that is never chosen by content
    ``multiline``     False for a format with a head pattern whose records are single lines

    How a record is taken apart, one of:

    ``groups``, ``more``, ``take``  functions of a Record: the head's texts as an array, further
                      ones that need those, and the parts (see ``PART_TYPES``) by name; ``message`` is trimmed
                      afterwards and, where ``adds_rest``, followed by the record's other lines
    ``fields``        function raw record -> struct of parts (see ``parts``)
    ``parse_batch``   for work Columns cannot do: a function that takes a pandas Series of raw
                      records and the default zone and returns a pandas frame with any of
                      ``BATCH_COLUMNS``; it gets Arrow batches, the other fields are filled in
    ``frame_fields``  the same with whole frames: a function that takes records and the default
                      zone and returns the records with FIELD_NAMES
    """

    name: str
    fields: Callable[[Column], Column] | None = None
    head: str | None = None
    whole_line: bool = False
    continuation: str | None = None
    keep_blank: bool = False
    multiline: bool = True
    detects: bool = True
    frame_fields: Callable[[DataFrame, str], DataFrame] | None = None
    groups: Callable[[Record], Column] | None = None
    more: Callable[[Record], Column] | None = None
    take: Callable[[Record], dict[str, Column]] | None = None
    parse_batch: Callable[[pd.Series, str], pd.DataFrame] | None = None

    @property
    def line_pattern(self) -> str | None:
        """Pattern a head line matches, tested on the untrimmed line."""
        if self.head is None:
            return None
        end = rf"{SPACE_CLASS}*\z" if self.whole_line else ""
        return rf"^{SPACE_CLASS}*(?:{self.head}){end}"

    @property
    def split_pattern(self) -> str | None:
        """Line feeds of a whole text that come right before a head line."""
        if self.head is None:
            return None
        end = rf"{SPACE_CLASS}*(?:\n|\z)" if self.whole_line else ""
        return rf"\n(?={SPACE_CLASS}*(?:{self.head}){end})"

    @property
    def assembles(self) -> bool:
        return self.head is not None and self.multiline

    def is_head(self, line: Column) -> Column:
        return line.rlike(self.line_pattern)

    def continues(self, line: Column) -> Column:
        """Lines that may go on with an open record."""
        if self.continuation is None:
            return F.lit(True)
        return line.rlike(self.continuation) | is_blank(line)


# ---- field extraction --------------------------------------------------------

# The text parts a format takes out of a record. Times and levels are worked out of them
# afterwards, once for all formats, which keeps the plan small.
PART_TYPES = {
    "ts_raw": "string",         # the time as written
    "ts_text": "string",        # the time to be parsed, when the time is text
    "millis": "bigint",         # the time, when it is given as epoch milliseconds
    "keep_ts_raw": "boolean",   # keep ts_raw even if no time could be read
    "level_word": "string",     # a severity word
    "level_content": "string",  # text whose content tells the level
    "status": "bigint",         # an HTTP status that tells the level
    "component": "string",
    "message": "string",
    "attrs": "map<string,string>",
}


PART_STRUCT = "struct<" + ",".join(f"{name}:{kind}" for name, kind in PART_TYPES.items()) + ">"


def parts(**values: Column) -> Column:
    """A struct of the given parts, the others NULL."""
    return F.struct(*[
        values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in PART_TYPES.items()
    ])


def _by_format(specs: Sequence[FormatSpec], value: Callable[[FormatSpec], Column | None], kind: str) -> Column:
    """``value`` of the record's format, told by its number."""
    chain = F
    for number, spec in enumerate(specs):
        column = value(spec)
        if column is not None:
            chain = chain.when(F.col("_number") == number, column.cast(kind))
    return F.lit(None).cast(kind) if chain is F else chain


def parse_fields(records: DataFrame, specs: Sequence[FormatSpec], default_tz: str) -> DataFrame:
    """Records (..., format, raw_line) of formats described by Columns, with FIELD_NAMES.

    All formats go through the same few projections: number of the format and first line,
    groups of the head, parts, time, fields. What a stage makes is a column for the next
    one, so no pattern is matched twice and every stage is compiled.
    """
    kept = [c for c in records.columns if c not in FIELD_NAMES]
    specs, key = tuple(specs), tuple(specs)
    raw = F.col("raw_line")
    record = Record(raw, F.col("_head"), F.col("_rest"), F.col("_groups"), F.col("_more"))

    def number() -> Column:
        chain = F
        for i, spec in enumerate(specs):
            chain = chain.when(F.col("format") == spec.name, i)
        return chain.otherwise(len(specs))

    def grouped(spec: FormatSpec) -> Column | None:
        if spec.groups is None:
            return None
        groups = spec.groups(record)
        return groups if spec.head is None or not spec.multiline else F.when(spec.is_head(record.head), groups)

    taken: dict[FormatSpec, dict[str, Column]] = {}

    def part(name: str, kind: str) -> Column:
        if not taken:  # once for all parts, as building these takes long
            taken.update({spec: spec.take(record) for spec in specs if spec.take})

        def value(spec: FormatSpec) -> Column | None:
            if spec.fields:
                return F.col(f"_own.{name}") if name in PART_TYPES else None
            return taken[spec].get(name) if spec in taken else None

        return _by_format(specs, value, kind)

    end = F.instr(raw, "\n")
    staged = records.select(
        *kept, memo(("number", key), number).alias("_number"), trim_space(F.substring_index(raw, "\n", 1)).alias("_head"),
        F.when(end > 0, F.substr(raw, end + 1)).alias("_rest"),
    )
    own = F.lit(None) if not any(s.fields for s in specs) else memo(
        ("own", key), lambda: _by_format(specs, lambda s: s.fields(raw) if s.fields else None, PART_STRUCT))
    staged = staged.select("*", memo(("groups", key), lambda: _by_format(specs, grouped, "array<string>")).alias("_groups"), own.alias("_own"))
    staged = staged.select("*", memo(
        ("more", key), lambda: _by_format(specs, lambda s: s.more(record) if s.more else None, "array<string>")).alias("_more"))
    built = [i for i, spec in enumerate(specs) if spec.take]
    staged = staged.select(*kept, "_rest", F.col("_number").isin(built).alias("_built"), *[
        memo(("part", name, key), lambda name=name, kind=kind: part(name, kind)).alias(f"_{name}")
        for name, kind in {**PART_TYPES, "adds_rest": "boolean"}.items() if name != "adds_rest" or built
    ])
    text = F.when(F.col("_built"), trim_space(F.col("_message"))).otherwise(F.col("_message"))
    others = [c for c in staged.columns if c not in ("_message", "_built", "_rest", "_adds_rest")]
    adds = F.coalesce("_adds_rest", F.lit(False)) & F.col("_rest").isNotNull() if built else F.lit(False)
    staged = staged.select(*[c for c in others], "_rest", adds.alias("_adds"), text.alias("_message"))
    first = F.when(F.col("_message") != "", F.concat("_message", F.lit("\n"), "_rest")).otherwise(F.col("_rest"))
    staged = staged.select(*others, F.when(F.col("_adds"), first).otherwise(F.col("_message")).alias("_message"))
    return resolve_parts(staged, kept, default_tz)


def resolve_parts(records: DataFrame, kept: Sequence[str], default_tz: str) -> DataFrame:
    """Rows with the columns ``kept`` and the parts, each after an underscore, turned into fields."""
    def text(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    timed = with_datetime(records, "_ts_text", default_tz).withColumns({
        "ts": F.coalesce(F.col("time_ts"), millis_to_ts(F.col("_millis"))),
        "_word": F.lower(trim_space(F.col("_level_word"))), "_low": F.lower(F.col("_level_content")),
    })
    has_ts = F.col("ts").isNotNull()
    level = F.coalesce(
        level_of_word(F.col("_word")), level_in_text(F.col("_low")),
        F.when(F.col("_status").isNotNull(), level_from_http_status(F.col("_status"))),
    )
    return timed.select(
        *kept,
        "ts",
        F.coalesce(F.when(has_ts | F.col("_keep_ts_raw"), F.col("_ts_raw")), F.lit("")).alias("ts_raw"),
        F.when(has_ts & F.col("_millis").isNotNull(), "Z").otherwise(F.coalesce("time_offset", F.lit(""))).alias("tz_offset"),
        F.coalesce("time_inferred", F.lit(False)).alias("tz_inferred"),
        level.alias("level"),
        text(F.col("_component")).alias("component"),
        text(F.col("_message")).alias("message"),
        F.coalesce("_attrs", F.create_map().cast("map<string,string>")).alias("attrs"),
    )


# What ``parse_batch`` may return. ``ts`` is a time in UTC; or ``ts_text`` a text in a known
# layout; ``level`` is a severity word; ``attrs`` holds dicts of texts.
BATCH_COLUMNS = {
    "ts": "timestamp_ntz", "ts_text": "string", "ts_raw": "string", "level": "string", "component": "string", "message": "string",
    "attrs": "map<string,string>",
}


def parse_batches(records: DataFrame, spec: FormatSpec, default_tz: str) -> DataFrame:
    """Records of a format whose parser is a function over batches, with FIELD_NAMES.

    Only the raw record goes to the function and back with its fields beside the other
    columns, so one Arrow pass does it. What it leaves out is NULL; a time given as text is
    read as in any other format.
    """
    kept = [f for f in records.schema.fields if f.name not in FIELD_NAMES]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`_b_{n}` {t}" for n, t in BATCH_COLUMNS.items()])
    parse = spec.parse_batch

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = parse(batch["raw_line"], default_tz).reset_index(drop=True)
            if len(made) != len(batch):
                raise ValueError(f"the parser of {spec.name} returned {len(made)} rows for {len(batch)} records")
            columns = {f"_b_{n}": made[n] if n in made else pd.Series([None] * len(made), dtype=object) for n in BATCH_COLUMNS}
            yield pd.concat([batch[names].reset_index(drop=True), pd.DataFrame(columns)], axis=1)

    parsed = records.select(*names).mapInPandas(run, schema)
    given = F.col("_b_ts").isNotNull()
    found = with_datetime(parsed, "_b_ts_text", default_tz)
    raw_ts = F.coalesce(F.col("_b_ts_raw"), F.col("_b_ts_text"), F.lit(""))
    nothing = F.lit("")
    return found.select(
        *names,
        F.coalesce("_b_ts", "time_ts").alias("ts"), raw_ts.alias("ts_raw"),
        F.when(given, "Z").otherwise(F.coalesce("time_offset", nothing)).alias("tz_offset"),
        (~given & F.coalesce("time_inferred", F.lit(False))).alias("tz_inferred"),
        level_of_word(F.lower(trim_space(F.col("_b_level")))).alias("level"),
        F.nullif("_b_component", nothing).alias("component"), F.nullif("_b_message", nothing).alias("message"),
        F.coalesce("_b_attrs", F.create_map().cast("map<string,string>")).alias("attrs"),
    )


def attr_map(**values: Column) -> Column:
    return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])


def groups(head: Column, pattern: str, count: int) -> Column:
    """All capture groups of one match; a head holds no line feed, so that separates them.

    The array has fewer than ``count`` items when the pattern does not match.
    """
    replacement = "\n".join(f"${i}" for i in range(1, count + 1))
    return F.split(F.regexp_replace(head, rf"(?s)^(?:{pattern})\z", replacement), "\n")


def _headed(r: Record, **values: Column) -> dict[str, Column]:
    """Parts of a record with a head; without one its text is the message and nothing else is known."""
    known = r.groups.isNotNull()
    out = {name: F.when(known, value) for name, value in values.items() if name != "message"}
    return {**out, "message": F.when(known, values["message"]).otherwise(r.raw)}


def _matched(r: Record, count: int, **values: Column) -> dict[str, Column]:
    """The same where the head may not be as expected: then only the lines after it are the message."""
    full = F.size(r.groups) == count
    out = {name: F.when(full, value) for name, value in values.items() if name != "message"}
    message = F.when(r.groups.isNull(), r.raw).when(full, values["message"]).otherwise("")
    return {**out, "message": message, "adds_rest": r.groups.isNotNull()}


def oracle_parts(r: Record) -> dict[str, Column]:
    """``more`` holds the other lines, trimmed: they begin with the first one that is not blank."""
    body = F.substring_index(F.get(r.more, F.lit(0)), "\n", 1)
    return _headed(
        r, ts_raw=r.head, ts_text=r.head, keep_ts_raw=F.lit(True), level_content=r.raw,
        message=F.coalesce(F.nullif(body, F.lit("")), r.head),
    )


def _inside(head: Column, prefix: str) -> Column:
    """A head line without its opening and one closing bracket."""
    size = F.length(head) - len(prefix)
    return F.substr(head, F.lit(len(prefix) + 1), size - F.when(head.endswith(">"), 1).otherwise(0))


def weblogic_groups(r: Record) -> Column:
    """Fields between ``> <``; a head holds no line feed, so that can stand for it."""
    return F.split(F.replace(_inside(r.head, "####<"), F.lit("> <"), F.lit("\n")), "\n")


def weblogic_tail(r: Record) -> Column:
    """Time, code and message; a message with the separator in it is found by the time and code before it."""
    n = F.size(r.groups)
    last3 = F.slice(r.groups, F.greatest(n - 2, F.lit(1)), F.lit(3))
    regular = (n < 3) | trim_space(F.get(r.groups, n - 3)).rlike(r"^[+-]?\d+\z")
    shifted = _inside(r.head, "####<").rlike(rf"(?s)^(?:{WEBLOGIC_TAIL})\z")
    return F.when(regular | ~shifted, last3).otherwise(groups(_inside(r.head, "####<"), WEBLOGIC_TAIL, 3))


def weblogic_parts(r: Record) -> dict[str, Column]:
    n, k = F.size(r.groups), F.size(r.more)
    tail = [F.get(r.more, k - 3 + i) for i in range(3)]
    located = attr_map(machine=r.group(3), server=r.group(4), thread=r.group(5))
    coded = attr_map(millis=tail[0], code=tail[1])
    return _headed(
        r, ts_raw=r.group(0), keep_ts_raw=F.lit(True), millis=F.when(n >= 3, trim_space(tail[0]).try_cast("bigint")),
        level_word=r.group(1), component=F.when(n >= 3, r.group(2)), message=tail[2], adds_rest=F.lit(True),
        attrs=F.when(n >= 6, F.map_concat(located, coded)).when(n >= 3, coded),
    )


def wls_stdout_parts(r: Record) -> dict[str, Column]:
    moment = trim_space(r.group(0))
    return _headed(
        r, ts_raw=moment, ts_text=moment, keep_ts_raw=F.lit(True), level_word=r.group(1), component=r.group(2),
        message=F.coalesce(r.group(3), F.lit("")), adds_rest=F.lit(True),
    )


def java_parts(r: Record) -> dict[str, Column]:
    thread = r.group(2)
    return _matched(
        r, 5, ts_raw=r.group(0), ts_text=r.group(0), keep_ts_raw=F.lit(True), level_word=r.group(1),
        attrs=F.when(thread != "", attr_map(thread=thread)), component=r.group(3), message=r.group(4),
    )


def access_parts(r: Record) -> dict[str, Column]:
    g = [r.group(i) for i in range(7)]
    full = F.size(r.groups) == 7
    status = F.coalesce(g[5].try_cast("bigint"), F.lit(0))
    found = dict(
        ts_raw=trim_space(g[1]), ts_text=g[1], keep_ts_raw=F.lit(True), status=status, component=F.concat_ws(" ", g[2], g[3]),
        attrs=attr_map(host=g[0], method=g[2], path=g[3], proto=g[4], status=status.cast("string"), size=g[6]),
    )
    message = F.when(full, F.concat_ws(" ", g[2], g[3], g[4])).otherwise(r.raw)
    return {**{name: F.when(full, value) for name, value in found.items()}, "message": message}


def odl_parts(r: Record) -> dict[str, Column]:
    return _matched(
        r, 8, ts_raw=trim_space(r.group(0)), ts_text=r.group(0), keep_ts_raw=F.lit(True), component=r.group(1), level_word=r.group(2),
        attrs=attr_map(module=r.group(3), tid=r.group(4), userId=r.group(5), ecid=r.group(6)), message=r.group(7),
    )


def text_parts(r: Record) -> dict[str, Column]:
    """``groups`` holds the trimmed text, ``more`` the date in it."""
    date = F.get(r.more, F.lit(0))
    return dict(ts_raw=date, ts_text=date, keep_ts_raw=F.lit(False), level_content=r.group(0), message=r.group(0))


# ---- registry ----------------------------------------------------------------

ORACLE = FormatSpec("oracle", head=ORACLE_HEAD, whole_line=True, groups=lambda r: F.array(r.head), more=lambda r: F.array(trim_space(r.rest)),
                    take=oracle_parts)
WEBLOGIC = FormatSpec("weblogic", head=WEBLOGIC_HEAD, groups=weblogic_groups, more=weblogic_tail, take=weblogic_parts)
WLS_STDOUT = FormatSpec(
    "wls_stdout", head=WLS_STDOUT_HEAD, groups=lambda r: F.split(_inside(r.head, "<"), "> <", 4), take=wls_stdout_parts)
JAVA = FormatSpec(
    "java", head=JAVA_HEAD, continuation=JAVA_CONTINUATION, groups=lambda r: groups(r.head, JAVA_FIELDS, 5), take=java_parts)
ACCESS = FormatSpec(
    "access", head=ACCESS_HEAD, multiline=False, keep_blank=True, groups=lambda r: groups(trim_space(r.raw), ACCESS_FIELDS, 7),
    take=access_parts)
ODL = FormatSpec("odl", head=ODL_HEAD, groups=lambda r: groups(r.head, ODL_FIELDS, 8), take=odl_parts)
TEXT = FormatSpec(
    "text", detects=False, groups=lambda r: F.array(trim_space(r.raw)), more=lambda r: F.array(first_date(r.group(0))), take=text_parts)

BUILTIN_FORMATS = (ORACLE, WEBLOGIC, WLS_STDOUT, JAVA, ACCESS, ODL, TEXT)
# Order in which formats are tried; any other name ranks 50.
DETECTION_ORDER = {"oracle": 0, "weblogic": 1, "wls_stdout": 2, "java": 3, "access": 4, "odl": 5, "text": 100}

_FORMATS: dict[str, FormatSpec] = {spec.name: spec for spec in BUILTIN_FORMATS}


def register_format(spec: FormatSpec) -> None:
    """Add a format; one with the name of a known format replaces it."""
    if spec.detects and spec.head is None:
        raise ValueError("a format that is detected by content needs a head pattern")
    _FORMATS.pop(spec.name, None)
    _FORMATS[spec.name] = spec


def unregister_format(name: str) -> None:
    """Drop a registered format; a built-in one returns to its first meaning."""
    _FORMATS.pop(name, None)
    for spec in BUILTIN_FORMATS:
        if spec.name == name:
            _FORMATS[name] = spec


def formats() -> list[FormatSpec]:
    """All formats in the order they are tried."""
    return sorted(_FORMATS.values(), key=lambda spec: DETECTION_ORDER.get(spec.name, 50))


def format_by_name(name: str) -> FormatSpec:
    return _FORMATS[name]


def any_head(lines: Column, spec: FormatSpec) -> Column:
    return F.exists(lines, lambda line: spec.is_head(line))


def detect_in(lines: Column) -> Column:
    """Format of an array of sample lines: the first one any line begins a record of."""
    detecting = [spec for spec in formats() if spec.detects]
    return let(lines, lambda sample: F.coalesce(
        *[F.when(any_head(sample, spec), spec.name) for spec in detecting], F.lit("text")
    ))
