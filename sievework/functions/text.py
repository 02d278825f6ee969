"""Text predicates and rewrites.

All of them are Spark SQL expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: formats and words that decide the results -----------------------------------
MISSING_WORDS = ["", "nan", "<NA>", "None"]
UNKNOWN = "UNKNOWN"
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
CURRENCY = r"^\s*[\$£€]\s?[\d,]+\.?\d*\s*$"
PERCENT = r"^\s*\d+(\.\d+)?\s?%\s*$"
COMMA_NUMBER = r"^\s*\d{1,3}(,\d{3})+(\.\d+)?\s*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
DOLLAR_ONLY = r"^\s*\$[\d,]+\.?\d*\s*$"
PERCENT_TIGHT = r"^\s*\d+(\.\d+)?%\s*$"
PLAIN_NUMBER = r"^\s*-?\d+(\.\d+)?\s*$"
DATE_OR_TIME = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?\s*$"
US_DATE = r"^\d{2}/\d{2}/\d{4}$"
TEXT_DATE = r"^\d{1,2} [A-Za-z]{3} \d{4}$"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DATE_STYLES = {"iso": "ISO (YYYY-MM-DD)", "us": "US (MM/DD/YYYY)",
               "text": "Text (DD Mon YYYY)", "other": "Unknown"}
TOKEN = "[a-z0-9]+"
# -----------------------------------------------------------------------------------------------

# A complete decimal literal: keeps try_cast away from 'nan', 'Infinity', '12d' and the like.
_DECIMAL = r"^-?(\d+\.?\d*|\.\d+)$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Remove outer white space of any kind, Unicode blanks included.

    Texts between two visible ASCII characters have none and stay as they are; looking for each character of the
    others among the blanks takes ten times as long.
    """
    text = c.cast("string")
    last = F.substring(text, -1, 1)
    visible = (text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(visible, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def count_where(condition: Column) -> Column:
    """Number of rows that meet a condition.

    Spark works the conditions of ``count_if`` out in a projection below the aggregate, whose one generated method is
    too long to be compiled where there are many; these stay in the aggregate, which splits its code.
    """
    return F.count(F.when(condition, F.lit(1)))


def is_missing(c: Column) -> Column:
    """Null or the empty text."""
    return c.isNull() | (c == "")


def is_missing_word(c: Column) -> Column:
    """Null, empty, or one of the texts that stand for a missing value; never null itself."""
    return c.isNull() | c.isin(MISSING_WORDS)


# Where a pattern needs a certain sign, the cells without it are ruled out by a plain search first.

def is_currency(c: Column) -> Column:
    return (c.contains("$") | c.contains("£") | c.contains("€")) & c.rlike(CURRENCY)


def is_percent(c: Column) -> Column:
    return c.contains("%") & c.rlike(PERCENT)


def is_comma_number(c: Column) -> Column:
    return c.contains(",") & c.rlike(COMMA_NUMBER)


def is_iso_date(c: Column) -> Column:
    return c.rlike(ISO_DATE)


def is_dollar_only(c: Column) -> Column:
    return c.contains("$") & c.rlike(DOLLAR_ONLY)


def is_percent_tight(c: Column) -> Column:
    return c.contains("%") & c.rlike(PERCENT_TIGHT)


def is_plain_number(c: Column) -> Column:
    return c.rlike(PLAIN_NUMBER)


def is_date_or_time(c: Column) -> Column:
    return c.rlike(DATE_OR_TIME)


def norm_key(c: Column) -> Column:
    """Join key without outer white space, in upper case; null stays null."""
    return F.upper(strip(c))


def is_noisy_key(c: Column) -> Column:
    """Outer white space or any lower-case letter."""
    return (strip(c) != c) | (F.upper(c) != c)


def is_messy_number(c: Column) -> Column:
    """Outer white space or any character other than digits, point and minus."""
    return (strip(c) != c) | c.rlike(r"[^\d.\-]")


def is_clean_number(c: Column) -> Column:
    return c.rlike(_DECIMAL)


def spelling(c: Column) -> Column:
    """What remains of a category once case and outer blanks are ignored."""
    return F.lower(strip(c))


def to_number(c: Column) -> Column:
    """Number hidden in text: keep digits, point and minus; null when nothing parses."""
    kept = F.regexp_replace(c, r"[^\d.\-]", "")
    return F.when(kept.rlike(_DECIMAL), kept.try_cast("double"))


def parse_number(c: Column) -> Column:
    """Number written plainly (sign and exponent allowed), else null."""
    bare = strip(c)
    return F.when(bare.rlike(_NUMBER), bare.try_cast("double"))


def date_style(c: Column) -> Column:
    """Which of the known date spellings a value uses."""
    bare = strip(c)
    return (F.when(bare.rlike(ISO_DATE), DATE_STYLES["iso"])
            .when(bare.rlike(US_DATE), DATE_STYLES["us"])
            .when(bare.rlike(TEXT_DATE), DATE_STYLES["text"])
            .when(bare.isNotNull(), DATE_STYLES["other"]))


def _month_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)


def rewrite_date(c: Column) -> Column:
    """Rewrite the three known date spellings to ISO as text, without checking the calendar."""
    bare = strip(c)
    month = _month_number(F.split_part(bare, F.lit(" "), F.lit(2)))
    us = F.concat_ws("-", F.substring(bare, 7, 4), F.substring(bare, 1, 2), F.substring(bare, 4, 2))
    text = F.concat_ws("-", F.split_part(bare, F.lit(" "), F.lit(3)),
                       F.lpad(month.cast("string"), 2, "0"),
                       F.lpad(F.split_part(bare, F.lit(" "), F.lit(1)), 2, "0"))
    return (F.when(bare.rlike(US_DATE), us)
            .when(bare.rlike(TEXT_DATE) & (month > 0), text)
            .otherwise(bare))


# Shapes of the accepted dates, which exclude each other.  Month before day, and day before month only where the first
# number cannot be a month.
_DASHED = r"^\d{4}-\d{1,2}-\d{1,2}$"
_YEAR_FIRST = r"^\d{4}/\d{1,2}/\d{1,2}$"
_YEAR_LAST = r"^\d{1,2}/\d{1,2}/\d{4}$"
_ISO_WITH_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"
_NAMED_MONTHS = [(r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy")]


def parse_date(c: Column) -> Column:
    """Calendar date of a value in any of the accepted formats, else null.

    Numbers in a checked shape are put in ISO order and cast, which is far faster than a formatter.
    """
    bare, dash = strip(c), F.lit("-")
    year, one = F.substring(bare, -4, 4), F.substring_index(bare, "/", 1)
    two = F.substring_index(F.substring_index(bare, "/", 2), "/", -1)
    year_last = F.coalesce(F.concat(year, dash, one, dash, two).try_cast("date"), F.concat(year, dash, two, dash, one).try_cast("date"))
    named = [F.when(bare.rlike(shape), F.try_to_date(bare, fmt)) for shape, fmt in _NAMED_MONTHS]
    return (F.when(bare.contains("/"), F.when(bare.rlike(_YEAR_LAST), year_last)
                   .when(bare.rlike(_YEAR_FIRST), F.translate(bare, "/", "-").try_cast("date")))
            .when(bare.rlike(_DASHED), bare.try_cast("date"))
            .when(bare.rlike(_ISO_WITH_TIME), F.substring(bare, 1, 10).try_cast("date"))
            .otherwise(F.coalesce(*named)))


def to_iso(c: Column) -> Column:
    """ISO text of a date in any accepted format; anything else stays as it is."""
    return F.coalesce(parse_date(c).cast("string"), c)


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def each(c: Column) -> Column:
    """One row per element, and one null row for an empty array; callers drop that row.

    A plain explode makes the optimizer filter on the size of the array first, which evaluates the
    expression that builds it, here a pass over the text, twice.
    """
    return F.explode_outer(c)


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def label(c: Column, width: int = 80) -> Column:
    """First ``width`` characters, with dots when something was cut."""
    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
