"""SQL expressions over text: masks, shapes, character classes, grouping keys.

Each function takes and returns Spark SQL text. A profile needs hundreds of
expressions, and one parsed text costs far less to hand to the JVM than the tree of
``Column`` calls that says the same.
"""

from __future__ import annotations

import string

from pyspark.sql import types as T

from tabproof.functions.types import STRING, column_class, is_floating

# What a published shape may hold.
MAX_SHAPE_LENGTH = 60
ALLOWED_SHAPE = r"^[aA9\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]*\z"

# The characters of Unicode category Zs.
SPACE_SEPARATORS = "".join(
    chr(c) for c in (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
)

# Texts up to this many characters are grouped as they are, longer ones by digest.
_DIGEST_OVER = 64


def quote_name(name: str) -> str:
    """A column or table name in backticks."""
    return "`" + name.replace("`", "``") + "`"


def quote_text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def format_mask(text: str, chars: int | None = None) -> str:
    """Digits to 9, letters to A or a, any other non-ASCII character to a.

    The whole text is masked, or its first ``chars`` characters.
    """
    head = text if chars is None else f"substr({text}, 1, {chars})"
    # Most texts are plain ASCII, where one character table does what the patterns do.
    table = string.ascii_uppercase + string.ascii_lowercase + string.digits
    plain = f"translate({head}, '{table}', '{'A' * 26 + 'a' * 26 + '9' * 10}')"
    masked = head
    for pattern, symbol in (
        (r"\p{N}", "9"),
        (r"\p{Lu}", "A"),
        (r"\p{Ll}", "a"),
        (r"[^\p{ASCII}]", "a"),
    ):
        masked = f"regexp_replace({masked}, r'{pattern}', '{symbol}')"
    return f"if(octet_length({head}) = length({head}), {plain}, {masked})"


def collapse_runs(shape: str) -> str:
    """Write each run of three or more equal characters as ``c{n}``."""
    return (
        f"array_join(transform(regexp_extract_all({shape}, r'(?s)((.)\\2*)', 1), run -> "
        "if(length(run) >= 3, concat(substr(run, 1, 1), '{', length(run), '}'), run)), '')"
    )


def shape_problem(shape: str) -> str:
    """Why a shape may not be published, or NULL when it may."""
    return (
        f"case when length({shape}) > {MAX_SHAPE_LENGTH} then 'too long' "
        rf"when not regexp_replace({shape}, r'\{{\d+\}}', '') rlike r'{ALLOWED_SHAPE}' "
        "then 'unmasked characters' end"
    )


def stripped(text: str) -> str:
    """The text without space separators at its ends. Tabs and line ends stay."""
    return f"trim(both {quote_text(SPACE_SEPARATORS)} from {text})"


def _is_space(character: str) -> str:
    return f"locate({character}, {quote_text(SPACE_SEPARATORS)}) > 0"


def is_blank(text: str) -> str:
    """Not empty, but nothing except space separators."""
    return f"({text} <> '' and {_is_space(f'left({text}, 1)')} and {stripped(text)} = '')"


def is_untrimmed(text: str) -> str:
    """Starts or ends with a space separator. Looks at the two end characters only."""
    ends = f"{_is_space(f'left({text}, 1)')} or {_is_space(f'right({text}, 1)')}"
    return f"({text} <> '' and ({ends}))"


def class_lengths(text: str) -> dict[str, str]:
    """Number of characters of each class in one text.

    Each class is taken out of what the ones before left, so only the first reads the whole text, and
    none reads a text of which nothing is left.
    """
    out, left = {"chars": f"length({text})"}, text
    for name, members in (("alpha", "[A-Za-z]+"), ("digit", "[0-9]+"), ("space", r"\s+"), ("punct", r"\p{Punct}+")):
        rest = f"if({left} = '', '', regexp_replace({left}, r'{members}', ''))"
        out[name] = f"length({left}) - length({rest})"
        left = rest
    return out


def key_digest(text: str) -> str:
    """A stand-in for a text in grouping keys, never longer than 65 characters.

    Long texts are replaced by a marked SHA-256, so a shuffle that only needs to
    tell values apart does not carry whole documents. Short texts stay as they
    are and cannot equal a digest, which is always 65 characters long.
    """
    return f"if(length({text}) <= {_DIGEST_OVER}, {text}, concat('#', sha2({text}, 256)))"


def group_key(column: str, data_type: T.DataType) -> str:
    """A column as a grouping key of its own type; long texts by digest."""
    return key_digest(column) if column_class(data_type) == STRING else column


def value_key(column: str, data_type: T.DataType) -> str:
    """A text that is equal for two values exactly when the values are equal.

    Lets columns of different types share one ``(column, value)`` grouping.
    """
    if column_class(data_type) == STRING:
        return key_digest(column)
    if isinstance(data_type, T.BinaryType):
        return key_digest(f"hex({column})")
    if is_floating(data_type):
        # Adding zero folds -0.0 into 0.0.
        return f"string({column} + 0.0d)"
    if isinstance(data_type, T.TimestampType):
        # Wall-clock text repeats when clocks go back; instants do not.
        return f"string(unix_micros({column}))"
    return f"string({column})"


def digest_pair(value: str) -> tuple[str, str]:
    """Two 64-bit digests of a value of any hashable type under different seeds; the first is NULL for NULL."""
    return f"if({value} is null, null, xxhash64({value}))", f"xxhash64(1L, {value})"


def value_digest(column: str, data_type: T.DataType) -> tuple[str, str]:
    """Two numbers that are equal for two values of a column when the values are; the first is NULL for NULL.

    Whole numbers, dates and booleans stand for themselves. All else has 128 bits of digests, so
    groupings that only tell values apart carry no texts.
    """
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return f"bigint({column})", "0L"
    if isinstance(data_type, T.DateType):
        return f"bigint(unix_date({column}))", "0L"
    if column_class(data_type) == STRING or isinstance(data_type, (T.BinaryType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
        return digest_pair(column)
    if is_floating(data_type):
        return digest_pair(f"({column} + 0.0d)")  # folds -0.0 into 0.0
    return digest_pair(f"string({column})")
