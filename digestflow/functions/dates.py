"""Publication dates as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

#: Month names in the genitive, as dates have them.
RUSSIAN_MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")

_ZONE = r"(?:Z|[+-]\d{2}:?\d{2})$"
_RUSSIAN = r"(\d{1,2})\s+([А-Яа-яЁё]+)\s+(\d{4})(?:\s+(\d{1,2}):(\d{2}))?"


def parse_datetime(text: Column, formats: Sequence[str] = (), naive_tz: str = "Europe/Moscow") -> Column:
    """The first reading that works: ISO, RFC 822, ``formats`` (Spark patterns), "d month yyyy [hh:mm]" in Russian.

    Dates without a zone are in naive_tz.  The session's time zone must be UTC.
    """
    text = stripped(text)
    zoned = text.rlike(_ZONE)
    # ISO: Spark's cast reads it, with or without a zone
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(text, "^(.{10})T", "$1 ")))
    iso = F.when(zoned, iso).otherwise(F.to_utc_timestamp(iso, naive_tz))
    mail = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|UT|Z)$", " +0000")
    named = mail.rlike(r"[+-]\d{4}$")
    with_zone = [F.try_to_timestamp(mail, F.lit(f"d MMM yyyy HH:mm{s} Z")) for s in (":ss", "")]
    without = [F.to_utc_timestamp(F.try_to_timestamp(mail, F.lit(f"d MMM yyyy HH:mm{s}")), naive_tz) for s in (":ss", "")]
    mail = F.when(named, F.coalesce(*with_zone)).otherwise(F.coalesce(*without))
    given = [F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(f)), naive_tz) for f in formats]
    part = [F.regexp_extract(text, _RUSSIAN, i) for i in range(1, 6)]
    months = F.create_map(*[x for i, m in enumerate(RUSSIAN_MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    month = F.try_element_at(months, F.lower(part[1]))
    clock = [F.coalesce(F.nullif(p, F.lit("")), F.lit("0")) for p in part[3:]]
    russian = F.try_to_timestamp(F.format_string("%s-%s-%s %s:%s", part[2], month, part[0], *clock), F.lit("yyyy-M-d H:m"))
    russian = F.to_utc_timestamp(F.when(month.isNotNull(), russian), naive_tz)
    return F.coalesce(iso, mail, *given, russian)
