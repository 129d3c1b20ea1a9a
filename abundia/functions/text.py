"""Text expressions for taxonomy labels and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(columns: Sequence[str | Column], separator: str = ", ") -> Column:
    """Join values with a separator. Empty text is kept, NULL reads ``NA``."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def taxon_name(columns: Sequence[str]) -> Column:
    """One label from all ranks; blank trailing ranks vanish.

    A blank rank between two filled ones leaves ``", , "`` in the label.
    """
    spaced = F.trim(F.regexp_replace(joined(columns), ",", " "))
    return F.regexp_replace(spaced, "  ", ", ")


def known(column: str, unknown: str) -> Column:
    """The column, with empty or missing text replaced by ``unknown``."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.when(text == "", F.lit(unknown)).otherwise(text)


def class_label(phylum: str = "phylum", klass: str = "class") -> Column:
    """``"phylum, class"`` with unknown classes named as such."""
    return joined([phylum, known(klass, "unknown class")])


def strip_first_item(column: str) -> Column:
    """Drop the first comma-separated item of a label."""
    return F.regexp_replace(F.col(column), r"^[^,]+,\s*", "")


def site_key(column: str) -> Column:
    """``PREFIX..KEY_SAMPLE`` -> ``KEY``; a text without that form is kept."""
    key = F.regexp_extract(F.col(column), r"\.\.([^_]+)_", 1)
    return F.when(key == "", F.col(column)).otherwise(key)


def split_part(column: str, separator: str, index: int) -> Column:
    """The ``index``-th part (from 0) of a separated text, NULL when missing."""
    return F.get(F.split(F.col(column), separator), F.lit(index))


def short_label(column: str) -> Column:
    """First two tokens (cut at blank or underscore), then up to the first dot."""
    tokens = F.split(F.col(column), " |_")
    second = F.coalesce(F.get(tokens, F.lit(1)), F.lit("NA"))
    return F.regexp_replace(F.concat_ws(" ", F.get(tokens, F.lit(0)), second), r"\..*", "")


def percent_text(share: Column, digits: int = 0) -> Column:
    """A share as text, such as ``12%``."""
    return F.concat(F.format_string(f"%.{digits}f", F.round(share * 100, digits)), F.lit("%"))
