"""Column expressions on single text values: lines, stamps, lists, numbers, masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from logweft import fixed_values as fv

# Characters a Unicode-aware strip removes from both ends of a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
BLOCK_ID = r"(?U)blk_-?\d+"
LOOSE_BLOCK_ID = r"blk_[-0-9]+"
STAMP = r"(?U)^(\d{6})\s+(\d{6})"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def clean_line(raw: Column) -> Column:
    """Invalid UTF-8 becomes the replacement character, then the ends are stripped."""
    return strip(F.make_valid_utf8(raw))


def block_id(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, BLOCK_ID, 0), F.lit(""))


def loose_block_id(line: Column) -> Column:
    """Dashboard form; a line without a block gets an id derived from its text."""
    found = F.regexp_extract(line, LOOSE_BLOCK_ID, 0)
    return F.when(found != "", found).otherwise(F.concat(F.lit("blk_"), F.xxhash64(line)))


def log_time(line: Column) -> Column:
    """``yymmdd hhmmss`` at the line start as TIMESTAMP_NTZ, null when impossible.

    Years 69-99 belong to the 1900s. Second 60 is no clock time here, while
    ``try_make_timestamp_ntz`` would roll it over, hence the extra test.
    """
    clock = F.regexp_extract(line, STAMP, 2)
    number = lambda text, at: F.substring(text, at, 2).try_cast("int")
    yy = number(line, 1)
    return F.when(
        (clock != "") & (number(clock, 5) < 60),
        F.try_make_timestamp_ntz(
            yy + F.when(yy >= 69, 1900).otherwise(2000),
            number(line, 3),
            number(line, 5),
            number(clock, 1),
            number(clock, 3),
            number(clock, 5).cast("decimal(16,6)"),
        ),
    )


def clock_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 by the clock reading itself: the session's time
    zone and its daylight saving play no part."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_between(first: Column, last: Column) -> Column:
    return (clock_seconds(last) - clock_seconds(first)).cast("double")


def keyword_events(line: Column) -> Column:
    """Dashboard guess of event ids from words in a line; E1 when nothing fits."""
    hits = F.array_compact(
        F.array(*[F.when(F.contains(line, F.lit(word)), F.lit(event)) for word, event in fv.KEYWORD_EVENTS])
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("E1")))


def comma_list(text: Column, keep_empty: bool = False) -> Column:
    parts = F.transform(F.split(text, ",", -1), strip)
    return parts if keep_empty else F.filter(parts, lambda part: part != "")


def bracket_list(text: Column) -> Column:
    """``[E5,E22]`` or ``['E5', 'E22']`` to an array without blanks and quotes."""
    inner = F.btrim(strip(text), F.lit("[]"))
    parts = F.filter(F.split(inner, ",", -1), lambda part: strip(part) != "")
    return F.transform(parts, lambda part: F.btrim(strip(part), F.lit("\"' ")))


def sampled_list(text: Column) -> Column:
    """As :func:`bracket_list`, and elements left empty after unquoting go too."""
    return F.filter(bracket_list(text), lambda part: part != "")


def raw_bracket_list(text: Column) -> Column:
    """Brackets off, split on commas, nothing trimmed: ``[]`` gives one empty item."""
    return F.split(F.btrim(text, F.lit("[]")), ",", -1)


def number_list(text: Column) -> Column:
    """JSON list of numbers; anything malformed gives an empty array."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def number(text: Column) -> Column:
    return strip(text).try_cast("double")


def python_list(items: Column) -> Column:
    """Array rendered as ``['a', 'b']``, and ``[]`` when empty."""
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    )


def one_decimal(tenths: Column) -> Column:
    """An integral number of tenths as text with one decimal."""
    n = tenths.cast("bigint")
    return F.concat((n / 10).cast("bigint").cast("string"), F.lit("."), (n % 10).cast("string"))


def latency_text(seconds: Column) -> Column:
    """Seconds, minutes or hours, rounded half up; ``unknown`` for null."""
    return (
        F.when(seconds.isNull(), "unknown")
        .when(seconds < 60, F.concat(F.floor(seconds + 0.5).cast("string"), F.lit(" seconds")))
        .when(seconds < 3600, F.concat(one_decimal(F.floor((seconds * 10 + 30) / 60)), F.lit(" minutes")))
        .otherwise(F.concat(one_decimal(F.floor((seconds * 10 + 1800) / 3600)), F.lit(" hours")))
    )


def fill(form: str, **slots: Column) -> Column:
    """A fixed format with ``{name}`` slots as one ``concat``; ``{{`` is a brace."""
    from string import Formatter

    pieces: list[Column] = []
    for text, name, _, _ in Formatter().parse(form):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            pieces.append(slots[name].cast("string"))
    return F.concat(*pieces)


def contains_any(items: Column, wanted: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains(items, w) for w in wanted])


# -- masking ---------------------------------------------------------------

# Long runs make the plain path, address and number forms retry at every
# character of the run. A retry inside a run can only fail where the try at the
# run's start failed, so a try is allowed only where the run starts or where the
# previous match ended (\G). With possessive runs the scan is linear. An address
# run may hold dots, at most two in a row once dot runs are squeezed.
_ADDRESS = r"(?:\G|(?<=\G\.)|(?<=\G\.\.)|(?<!\w)(?<!\w\.)(?<!\w\.\.))\w[\w.]*+@\w[\w.]*+(?:-\w[\w.]*+)?"
_PATH = r"(?:\G|(?<![a-zA-Z0-9]))[a-zA-Z0-9]*+[:.]*+[/\\]+[^/\\\s\[\]][^\s\[\]]*+"
_WITH_DIGIT = r"(?:\G|(?<![a-zA-Z.:\-_]))[a-zA-Z.:\-_]*+\d[a-zA-Z0-9.:\-_]*+"
# None of the forms behind this test can begin between two ASCII letters or
# digits unless a match just ended there: one quick test instead of eight.
_NOT_INSIDE_WORD = r"(?:\G|(?<![a-zA-Z0-9])|(?![a-zA-Z0-9]))"


def mask_pattern() -> str:
    """The fixed list as one pattern. Words, dates, addresses and hexadecimal forms are
    the list's own; paths, mail addresses and words with digits are in linear form."""
    words = fv.MASK_PATTERNS[:4]
    named = fv.MASK_PATTERNS[4:8]
    hardware = fv.MASK_PATTERNS[8:10]
    hexadecimal = fv.MASK_PATTERNS[11:13]
    last = [_PATH, *hexadecimal, _ADDRESS, _WITH_DIGIT]
    return "(?U)" + "|".join(
        [
            *words,
            f"{_NOT_INSIDE_WORD}(?:{'|'.join(named)})",
            *hardware,
            f"{_NOT_INSIDE_WORD}(?:{'|'.join(last)})",
        ]
    )


def squeeze_dots(text: Column) -> Column:
    return F.regexp_replace(text, r"[.]{3,}", ".. ")


def mask_parameters(text: Column) -> Column:
    """Dot runs shortened, then every variable part replaced by ``<*>``."""
    return F.regexp_replace(squeeze_dots(text), mask_pattern(), fv.MASK)


# -- sentences -------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Pieces between full stops that end the text or precede white space."""
    pieces = F.transform(F.split(text, r"(?U)\.(?:\s+|$)", -1), strip)
    return F.filter(pieces, lambda piece: piece != "")


def squeeze_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")
