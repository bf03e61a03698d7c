"""From text to logical records.

Two ways give the same records:

* ``split_records`` works on a whole text in one row. It is narrow: no shuffle, no
  window, so ingesting any number of ordinary files is a single map stage.
* ``assemble_lines`` works on the lines of files too big for one row. A file is read in
  blocks; each block is solved on its own, a small table of blocks carries the state and
  the record number from one to the next, and only records cut by a block border meet
  again. No task ever holds more than one block of a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loglake.functions.memo import memo
from loglake.functions.text import is_blank, let, trim_space
from loglake.operators.formats import FIELD_NAMES, SAMPLE_LINES, FormatSpec, detect_in, formats, parse_batches, parse_fields
from loglake.session import compile_in_parts
from loglake.sources.encodings import byte_counts, decode_text, encoding_of


# ---- whole texts -------------------------------------------------------------


def clean_text(content: Column) -> Column:
    """Drop a byte-order mark, the last line feed and carriage returns at line ends.

    An empty content has no line at all and gives NULL, unlike one blank line.
    """
    text = F.regexp_replace(F.regexp_replace(content, r"^\x{FEFF}", ""), r"\n\z", "")
    text = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r+(?=\n|\z)", "")).otherwise(text)
    return F.when(content != "", text)


# Characters looked at first for the sample lines of a text.
HEAD_CHARS = 1 << 16


def sample_lines(text: Column, count: int = SAMPLE_LINES) -> Column:
    """The first non-blank lines of a cleaned text.

    The beginning of the text mostly holds enough of them; only if not, all is split.
    """
    def first(part: Column) -> Column:
        return F.slice(_non_blank(F.split(part, "\n")), 1, count)

    # what comes after the last line feed of the beginning may be half a line
    head = F.substring_index(F.substring(text, 1, HEAD_CHARS), "\n", -1)
    begin = F.substring(text, 1, HEAD_CHARS)
    begin = F.substr(begin, F.lit(1), F.length(begin) - F.length(head))
    found = let(first(begin), lambda some: F.when(F.size(some) == count, some).otherwise(first(text)))
    return F.coalesce(found, F.array().cast("array<string>"))


def _trim_first_line(record: Column) -> Column:
    end = F.instr(record, "\n")
    cut = F.concat(trim_space(F.substring_index(record, "\n", 1)), F.substr(record, end))
    return F.when(end == 0, trim_space(record)).otherwise(cut)


def _non_blank(lines: Column) -> Column:
    return F.filter(lines, lambda line: ~is_blank(line))


def _split_segment(segment: Column, spec: FormatSpec) -> Column:
    """Records of a text part that begins with a head line, or that holds no head."""
    lines = F.split(segment, "\n")
    if spec.continuation is None:
        headed = F.array(_trim_first_line(segment))
    else:
        after_head = F.slice(lines, 2, F.size(lines))
        stop = F.array_position(F.transform(after_head, spec.continues), F.lit(False)).cast("int")
        cut = F.concat(
            F.array(_trim_first_line(F.array_join(F.slice(lines, 1, stop), "\n"))),
            _non_blank(F.slice(lines, stop + 1, F.size(lines))),
        )
        headed = F.when(stop == 0, F.array(_trim_first_line(segment))).otherwise(cut)
    return F.when(spec.is_head(F.substring_index(segment, "\n", 1)), headed).otherwise(_non_blank(lines))


def records_in(text: Column, spec: FormatSpec) -> Column:
    """All records of a cleaned text as an array, in order."""
    if not spec.assembles:
        lines = F.split(text, "\n")
        found = lines if spec.keep_blank else _non_blank(lines)
    else:
        found = F.flatten(F.transform(F.split(text, spec.split_pattern), lambda part: _split_segment(part, spec)))
    return F.coalesce(found, F.array().cast("array<string>"))


def records_by_format(text: Column, fmt: Column, specs: list[FormatSpec] | None = None) -> Column:
    branches = F
    for spec in specs or formats():
        branches = branches.when(fmt == spec.name, records_in(text, spec))
    return branches.otherwise(F.array().cast("array<string>"))


def detect_text(texts: DataFrame, column: str = "text") -> DataFrame:
    """Texts with ``format``, detected from their first non-blank lines."""
    return texts.withColumn("format", memo(("format", column, tuple(formats())), lambda: detect_in(sample_lines(F.col(column)))))


def split_records(texts: DataFrame, column: str = "text", specs: list[FormatSpec] | None = None) -> DataFrame:
    """One row (..., seq, raw_line) per record of rows holding a whole cleaned text.

    ``texts`` has a ``format`` column; all other columns but the text are kept.
    """
    kept = [c for c in texts.columns if c != column]
    specs = specs or formats()
    records = memo(("records", column, tuple(specs)), lambda: records_by_format(F.col(column), F.col("format"), specs))
    exploded = texts.select(*kept, F.posexplode(records).alias("at", "raw_line"))
    return exploded.select(*kept, (F.col("at") + 1).cast("bigint").alias("seq"), "raw_line")


# ---- lines of big files ------------------------------------------------------


def _per_format(fmt: Column, specs: list[FormatSpec], value, default: Column) -> Column:
    branches = [F.when(fmt == spec.name, value(spec)) for spec in specs]
    return F.coalesce(*branches, default)


def _line_flags(lines: DataFrame, specs: list[FormatSpec]) -> DataFrame:
    """What each line does, whatever comes before it.

    ``always``  it begins a record
    ``weak``    it begins a record unless one is open
    ``mark``    1 opens a record that may go on, 0 ends it, NULL leaves it as it is
    """
    line, fmt = F.col("value"), F.col("format")
    no = F.lit(False)
    key = tuple(specs)
    is_head = memo(("head", key), lambda: _per_format(fmt, specs, lambda s: s.is_head(line) if s.assembles else no, no))
    goes_on = memo(("goes on", key), lambda: _per_format(fmt, specs, lambda s: s.continues(line) if s.assembles else no, no))
    multiline = _per_format(fmt, specs, lambda s: F.lit(s.assembles), no)
    keeps_blank = _per_format(fmt, specs, lambda s: F.lit(s.keep_blank), no)
    flagged = lines.select("*", is_head.alias("head"), goes_on.alias("goes_on"), is_blank(line).alias("blank"),
                           multiline.alias("multiline"), keeps_blank.alias("keeps_blank"))
    other = F.col("multiline") & ~F.col("head") & ~F.col("goes_on")
    single = ~F.col("multiline") & (~F.col("blank") | F.col("keeps_blank"))
    return flagged.select(
        *lines.columns, "head",
        (F.col("head") | other | single).alias("always"),
        (F.col("multiline") & ~F.col("head") & F.col("goes_on") & ~F.col("blank")).alias("weak"),
        F.when(F.col("head"), 1).when(other, 0).alias("mark"),
    )


def _state_before(order: Window) -> Column:
    return F.last("mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def block_table(flagged: DataFrame) -> DataFrame:
    """For each block of a file: the state it begins in, the records before and in it.

    The one window per file runs over blocks, not lines.
    """
    order = Window.partitionBy("file_id", "block").orderBy("pos")
    local = flagged.withColumn("before", _state_before(order))

    def count(test: Column) -> Column:
        return F.count(F.when(test, 1))

    per_block = local.groupBy("file_id", "block").agg(
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("pos"))).alias("last_mark"),
        count(F.col("always") | (F.col("weak") & (F.col("before") == 0))).alias("sure"),
        count(F.col("weak") & F.col("before").isNull()).alias("leading"),
    )
    blocks = Window.partitionBy("file_id").orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    begun = per_block.withColumn("begin", F.coalesce(F.last("last_mark", ignorenulls=True).over(earlier), F.lit(0)))
    own = F.col("sure") + F.when(F.col("begin") == 0, F.col("leading")).otherwise(0)
    return begun.withColumn("own", own).select(
        "file_id", "block", "begin", "own", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("records_before")
    )


def assemble_lines(
    lines: DataFrame, detected: DataFrame | str, specs: list[FormatSpec] | None = None
) -> DataFrame:
    """Records (file_id, ..., seq, raw_line) from lines (file_id, block, pos, value).

    ``pos`` orders the lines of a block and ``block`` the blocks of a file. ``detected``
    gives each file's format (file_id, format and, for bytes still to be decoded, encoding)
    or is the one format of all files; its other columns are carried to the records.

    What is known of a file is first spread over its blocks, so the lines are shuffled once,
    by (file, block), for the join, the windows and the grouping alike, and a huge file is
    never a single key. Only the records at block borders are shuffled again.
    """
    if isinstance(detected, str):
        carried = ["format"]
        known = lines.withColumn("format", F.lit(detected))
    else:
        carried = [c for c in detected.columns if c not in ("file_id", "encoding")]
        blocks = lines.select("file_id", "block").distinct().join(detected, "file_id")
        known = lines.join(blocks.hint("shuffle_hash"), ["file_id", "block"])
        if "encoding" in detected.columns:
            known = known.withColumn("value", decode_text(F.col("value").cast("binary"), F.col("encoding"))).drop("encoding")
    flagged = _line_flags(known.withColumn("value", F.rtrim("value", F.lit("\r"))), specs or formats())
    table = block_table(flagged)
    order = Window.partitionBy("file_id", "block").orderBy("pos")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = flagged.withColumn("before", _state_before(order)).join(table, ["file_id", "block"])
    is_open = F.coalesce("before", "begin") == 1
    placed = placed.withColumn("starts", F.col("always") | (F.col("weak") & ~is_open)).withColumn("is_open", is_open)
    numbered = placed.withColumn("nth", F.sum(F.col("starts").cast("int")).over(running))
    text = F.when(F.col("head"), trim_space(F.col("value"))).otherwise(F.col("value"))
    kept = numbered.where(F.col("starts") | F.col("is_open")).select(
        "file_id", *carried, "block", "pos", "nth", (F.col("records_before") + F.col("nth")).cast("bigint").alias("seq"),
        text.alias("line"),
        # a record can only be cut at the first or the last place of a block
        ((F.col("nth") == 0) | (F.col("nth") == F.col("own"))).alias("at_border"),
    )

    def joined(pieces: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
        collected = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("parts"))
        return collected.select(*keys, F.array_join(F.transform("parts", lambda x: x[text]), "\n").alias("raw_line"))

    keys = ["file_id", "block", "nth", *carried, "seq"]
    inner = joined(kept.where(~F.col("at_border")), keys, "pos", "line")
    border = joined(kept.where("at_border"), keys, "pos", "line")
    border = joined(border, ["file_id", *carried, "seq"], "block", "raw_line")
    columns = ["file_id", *carried, "seq", "raw_line"]
    return inner.select(*columns).unionByName(border.select(*columns))


def detect_lines(lines: DataFrame) -> DataFrame:
    """Format of each file (file_id, format) from its first non-blank lines.

    The format is the best rank any sample line has, so only small integers are ranked by
    position; the rank filter is applied in each task before the shuffle.
    """
    specs = [spec for spec in formats() if spec.detects]
    value = F.col("value")
    rank = F.coalesce(*[F.when(spec.is_head(value), i) for i, spec in enumerate(specs)], F.lit(len(specs)))
    ranked = lines.where(~is_blank(value)).select("file_id", "block", "pos", rank.alias("format_rank"))
    order = Window.partitionBy("file_id").orderBy("block", "pos")
    head = ranked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_LINES)
    found = head.groupBy("file_id").agg(F.min("format_rank").alias("best"))
    names = F.array(*[F.lit(spec.name) for spec in specs], F.lit("text"))
    every = lines.select("file_id").distinct()
    return every.join(found, "file_id", "left").select(
        "file_id", F.coalesce(F.get(names, F.col("best")), F.lit("text")).alias("format")
    )


def encoding_of_lines(lines: DataFrame) -> DataFrame:
    """Encoding of each file (file_id, encoding) from the bytes of its lines.

    The counts of the lines are added up in each task before the shuffle, so a file of any
    size is told by the rule for whole contents.
    """
    counts = byte_counts(F.col("value").cast("binary"))
    summed = lines.groupBy("file_id").agg(*[F.sum(count).alias(name) for name, count in counts.items()])
    return summed.select("file_id", encoding_of({name: F.col(name) for name in counts}).alias("encoding"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``line_no`` from 1 in file order, numbered block by block."""
    per_block = lines.groupBy("file_id", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    table = per_block.select("file_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"))
    order = Window.partitionBy("file_id", "block").orderBy("pos")
    counted = lines.withColumn("nth", F.row_number().over(order)).join(table, ["file_id", "block"])
    return counted.withColumn("line_no", F.col("lines_before") + F.col("nth")).drop("lines_before", "nth")


# ---- fields ------------------------------------------------------------------


def parse_records(records: DataFrame, default_tz: str = "UTC") -> DataFrame:
    """Records (..., format, raw_line) with the fields their format has.

    All formats described by Columns are read in one pass; records of a format that brings
    its own function are taken out, run through it and added back.
    """
    compile_in_parts(records.sparkSession)
    columns = [c for c in records.columns if c not in FIELD_NAMES]
    own = [spec for spec in formats() if spec.frame_fields or spec.parse_batch]
    common = records.where(~F.coalesce(F.col("format").isin([s.name for s in own]), F.lit(False))) if own else records
    parsed = parse_fields(common, [spec for spec in formats() if spec not in own], default_tz)

    def alone(spec: FormatSpec) -> DataFrame:
        rows = records.where(F.col("format") == spec.name)
        done = parse_batches(rows, spec, default_tz) if spec.parse_batch else spec.frame_fields(rows, default_tz)
        return done.select(*columns, *FIELD_NAMES)

    return reduce(lambda a, b: a.unionByName(b), [alone(spec) for spec in own], parsed)
