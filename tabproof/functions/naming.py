"""Table names from file labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TABLE_NAME_LENGTH = 64

# Names that would clash with SQL keywords get a suffix.
RESERVED_NAMES = (
    "table", "select", "from", "where", "group", "order", "by", "join",
    "union", "all", "and", "or", "not", "null", "true", "false", "case", "when",
    "then", "else", "end", "as", "on", "in", "is", "like", "between", "default",
)


def base_table_name(label: Column) -> Column:
    """Lower-case identifier made from a file name or a URL."""
    # A plus sign is a plain character in a path, so keep it from decoding to a space.
    path = F.regexp_extract(label, r"^(?i:https?)://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    decoded = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), label)
    name = F.when(label.rlike(r"^(?i:https?):"), decoded).otherwise(label)
    name = F.regexp_replace(name, r"(?i)\.(gz|zst|bz2)\z", "")
    name = F.regexp_replace(name, r"\.[^.]+\z", "")
    slug = F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_")
    slug = F.regexp_replace(slug, r"^_+|_+\z", "")
    # Room for the prefix and for a counter.
    slug = F.substring(slug, 1, MAX_TABLE_NAME_LENGTH - 8)
    # The names given to labels without a usable word, to digits and to keywords.
    return (
        F.when(slug == "", F.lit("t_table"))
        .when(slug.rlike("^[0-9]"), F.concat(F.lit("t_"), slug))
        .when(slug.isin(*RESERVED_NAMES), F.concat(slug, F.lit("_tbl")))
        .otherwise(slug)
    )


def is_safe_table_name(name: Column) -> Column:
    return name.rlike(r"^[a-z][a-z0-9_]*\z") & (F.length(name) <= MAX_TABLE_NAME_LENGTH)
