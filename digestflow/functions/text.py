"""Text columns: canonical forms, hashes, titles.

Python's Unicode tables are needed for NFKC and case folding, so these two go through Arrow, a batch at a time; all
else is built-in functions.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNIT_SEPARATOR = "\x1f"
#: Unicode white space at either end.
_ENDS = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def blank_to_null(text: Column) -> Column:
    """Null for texts that are blank after stripping, else the stripped text."""
    return F.nullif(stripped(text), F.lit(""))


@F.pandas_udf(StringType())
def canonical_text(text: pd.Series) -> pd.Series:
    """NFKC, case folded, white space collapsed; null stays null."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split()), na_action="ignore")


@F.pandas_udf(StringType())
def display_text(text: pd.Series) -> pd.Series:
    """NFKC; each line's white space collapsed, blank lines dropped, an empty line between; null if nothing is left."""

    def shown(t: str) -> str | None:
        lines = (" ".join(line.split()) for line in unicodedata.normalize("NFKC", t).splitlines())
        return "\n\n".join(filter(None, lines)) or None

    return text.map(shown, na_action="ignore")


@F.pandas_udf(StringType())
def collapsed(text: pd.Series) -> pd.Series:
    """NFKC with collapsed white space; null if blank."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()) or None, na_action="ignore")


@F.pandas_udf(StringType())
def join_distinct(parts: pd.Series) -> pd.Series:
    """The parts that differ by more than case and white space, in order, an empty line between; null if none."""

    def joined(row: Sequence[str | None]) -> str | None:
        kept: dict[str, str] = {}
        for part in row:
            lines = [line.rstrip() for line in (part or "").strip().splitlines()]
            text = "\n".join(lines).strip()
            if text:
                kept.setdefault(" ".join(text.split()).casefold(), text)
        return "\n\n".join(kept.values()) or None

    return parts.map(joined, na_action="ignore")


def content_hash(text: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical_text(text), 256)


def stable_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *parts), 256)


def material_id(source_id: Column, external_id: Column) -> Column:
    return stable_hash(source_id, external_id)


def fallback_external_id(url: Column, title: Column) -> Column:
    return F.sha2(F.concat(url, F.lit("\n"), F.coalesce(title, F.lit(""))), 256)


def cluster_id(member_ids: Column) -> Column:
    """The same for any order of the members."""
    return F.sha2(F.array_join(F.array_sort(member_ids), UNIT_SEPARATOR), 256)


def first_line(text: Column, limit: int = 240) -> Column:
    """The first line that isn't blank, cut to ``limit`` characters with an ellipsis; null if there is none."""
    lines = F.filter(F.transform(F.split(text, r"\R"), stripped), lambda x: x != "")
    line = F.get(lines, F.lit(0))
    return F.when(F.char_length(line) > limit, F.concat(F.substring(line, 1, limit - 1), F.lit("…"))).otherwise(line)


def truncated(text: Column, limit: int) -> Column:
    """Stripped, and cut to ``limit`` characters with an ellipsis."""
    text = stripped(text)
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def choose_title(extracted: Column, raw: Column, text: Column) -> Column:
    """The extracted or else the raw title, collapsed, 500 characters; else the text's first line, 240 characters."""
    given = F.substring(collapsed(F.coalesce(F.nullif(extracted, F.lit("")), raw)), 1, 500)
    return F.coalesce(given, F.substring(F.get(F.split(text, r"\R"), F.lit(0)), 1, 240))


def dedup_text(title: Column, text: Column, max_chars: int | None = None) -> Column:
    """What similarity is computed from; max_chars (4000, say) is for encoders that take no more of a text."""
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    return F.concat(stripped(title), F.lit("\n"), stripped(text))


def merge_metadata(raw: Column, extraction: Column) -> Column:
    """raw: map<string,string>; extraction: a struct, null for none -> JSON of raw with the extraction nested in it."""
    own = F.transform_values(raw, lambda k, v: v.cast("variant"))
    more = F.create_map(F.lit("extraction"), F.to_variant_object(extraction))
    return F.when(extraction.isNull(), F.to_json(own)).otherwise(F.to_json(F.map_concat(own, more)))
