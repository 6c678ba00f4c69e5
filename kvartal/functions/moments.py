"""Moments and months written in several notations, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_OFFSET = "+04:00"


def moment_us(text: Column, offset: str = LOCAL_OFFSET) -> Column:
    """Microseconds since 1970 of a written moment; NULL where there is none.

    ISO dates with or without offset, ``dd.mm.yyyy hh:mm``, and bare digits as
    seconds (or, with 13 digits, milliseconds).  Without an offset it is local
    time.  The session's time zone plays no part.
    """
    s = F.trim(text)
    dotted = F.regexp_replace(s, r"^(\d{2})\.(\d{2})\.(\d{4})[ T](\d{2}:\d{2}(?::\d{2})?)$", "$3-$2-$1 $4")
    dotted = F.regexp_replace(dotted, r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2})(?!:)", "$1:00")
    zoned = F.when(dotted.rlike(r"^\d{4}-\d{2}-\d{2}[ T].*(Z|[+-]\d{2}:?\d{2})$"), dotted).when(
        dotted.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(dotted, F.lit(" 00:00:00" + offset))
    ).when(dotted.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), F.concat(dotted, F.lit(offset)))
    return (
        F.when(s.rlike(r"^\d{9,11}$"), s.try_cast("bigint") * 1_000_000)
        .when(s.rlike(r"^\d{13}$"), s.try_cast("bigint") * 1000)
        .otherwise(F.unix_micros(zoned.try_cast("timestamp")))
    )


def local_day(text: Column, hours: int = 4) -> Column:
    """Local day number (days since 1970) of a written moment."""
    return F.floor((moment_us(text) / 1_000_000 + hours * 3600) / 86400).cast("int")


def month_number(month: Column) -> Column:
    """``YYYY-MM`` as year * 12 + month; NULL for anything else."""
    ok = month.rlike(r"^\d{4}-\d{2}$")
    return F.when(ok, F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int"))


def month_text(number: Column) -> Column:
    """Inverse of :func:`month_number`."""
    zero = number - 1
    return F.format_string("%04d-%02d", F.floor(zero / 12).cast("int"), (zero % 12 + 1).cast("int"))
