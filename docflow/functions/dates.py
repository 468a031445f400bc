"""Date detection and normalization of text columns, all in built-in column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes that rewrite a text to `year-month-day time`; the extended ones also read `YYYY.MM.DD` and a
# blank between an ISO date and its time.
_TIME = r"(\d{1,2}:\d{1,2}:\d{1,2})"
_YEAR_FIRST = r"^(\d{4})(?:/(\d{1,2})/(\d{1,2})(?: %s)?|-(\d{1,2})-(\d{1,2})(?:T%s)?)$" % (_TIME, _TIME)
_EXTENDED = r"^(\d{4})(?:\.(\d{1,2})\.(\d{1,2})(?: %s)?|-(\d{1,2})-(\d{1,2})(?: %s)?)$" % (_TIME, _TIME)
_DAY_FIRST = r"^(\d{1,2})([/.])(\d{1,2})\2(\d{4})(?: %s)?$" % _TIME
_SHORT_OLD = r"^(\d{1,2})\.(\d{1,2})\.((?:69|[7-9]\d))(?: %s)?$" % _TIME
_SHORT_NEW = r"^(\d{1,2})\.(\d{1,2})\.((?:[0-5]\d|6[0-8]))(?: %s)?$" % _TIME

# A text must hold one of these shapes somewhere before any format is tried.
DATE_GATE = (
    r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{4}/\d{2}/\d{2}"
    r"|\d{4}\.\d{2}\.\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}\.\d{2}\.\d{2}"
)

UNIFIED_FORMAT = "dd.MM.yyyy HH:mm:ss"
UNIFIED_PATTERN = r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}"


def parse_date(text: Column, extended: bool = True) -> Column:
    """Timestamp of a text that is a date in one of the known formats, else null.

    A two-digit year is read as 1969-1999 or 2000-2068.  A rewritten text is marked by a leading `=`, so
    nothing else is parsed.
    """
    shaped = F.regexp_replace(text, _YEAR_FIRST, "=$1-$2$5-$3$6 $4$7")
    if extended:
        shaped = F.regexp_replace(shaped, _EXTENDED, "=$1-$2$5-$3$6 $4$7")
    shaped = F.regexp_replace(shaped, _DAY_FIRST, "=$4-$3-$1 $5")
    shaped = F.regexp_replace(shaped, _SHORT_OLD, "=19$3-$2-$1 $4")
    shaped = F.regexp_replace(shaped, _SHORT_NEW, "=20$3-$2-$1 $4")
    found = F.try_to_timestamp(shaped, F.lit("'='yyyy-M-d [H:m:s]"))
    return F.when(text.rlike(DATE_GATE), found)


def normalize_date(text: Column, extended: bool = True) -> Column:
    """The text in the unified format when it is a date, else the text unchanged."""
    return F.coalesce(F.date_format(parse_date(text, extended), UNIFIED_FORMAT), text)


def parse_unified(text: Column) -> Column:
    """Timestamp of a text that is already in the unified format."""
    return F.when(
        text.rlike(UNIFIED_PATTERN), F.try_to_timestamp(F.substring(text, 1, 19), F.lit(UNIFIED_FORMAT))
    )
