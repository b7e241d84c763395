"""Time expressions; the session time zone is UTC."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3.6e9

# Two-digit years from here on are of the last century, as in POSIX.
FIRST_YEAR_OF_1900S = 69

# What a written time is made of. Names of months count by their first three letters.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    "|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_WEEKDAY = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?[.,]?[ ]+)?"
_YEAR, _DAY = r"(\d{4}|\d{2})", r"(\d{1,2})(?:st|nd|rd|th)?"
_DATES = [
    r"(\d{4})(\d{2})(\d{2})",  # 1 to 3: year, month, day without separators
    r"(\d{4})([-/. ])(\d{1,2})\5(\d{1,2})",  # 4 to 7: year first
    rf"(\d{{1,2}})([-/. ])(\d{{1,2}})\9{_YEAR}",  # 8 to 11: day or month first
    rf"{_DAY}[-/. ]*({_MONTH})[-/., ]*{_YEAR}",  # 12 to 14
    rf"({_MONTH})[-/. ]*{_DAY}(?:,[ ]*|[-/. ]+){_YEAR}",  # 15 to 17
    rf"(\d{{4}})[-/. ]*({_MONTH})[-/. ]*{_DAY}",  # 18 to 20
]
# 21 to 25: hour, minute, second, fraction, and the letter of AM or PM.
_CLOCK = r"(?:[T, ]+(\d{1,2})(?::?([0-5]\d)(?::?([0-5]?\d)(?:[.,](\d{1,6})\d*)?)?)?[ ]*(?:([ap])\.?m\.?)?)?"
# 26 to 28: sign, hours and minutes of the offset; UTC by name has none.
_OFFSET = r"[ ]*(?:z|utc|gmt|([+-])(\d{2}):?([0-5]\d)?)?"
_GRAMMAR = rf"(?i)^{_WEEKDAY}(?:{'|'.join(_DATES)}){_CLOCK}{_OFFSET}$"

# Day, month and year with a clock of 24 hours or none; and what begins like an ISO literal.
_PLAIN = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})(?:[T ](\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?))?$"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}"

# Groups that say the same in different notations stand side by side: at most one of them is not empty.
_PARTS = {
    "year": "$1$4$11$14$17$18",
    "month": "$2$6",
    "day": "$3$7$12$16$20",
    "first": "$8",
    "second": "$10",
    "name": "$13$15$19",
    "hour": "$21",
    "minute": "$22",
    "second_of_minute": "$23",
    "fraction": "$24",
    "half": "$25",
    "sign": "$26",
    "offset_hours": "$27",
    "offset_minutes": "$28",
    "separator": "$5",
}


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(MICROS_PER_HOUR)


def timestamp_of_parts(parts: Column, iso_day_first: bool) -> Column:
    """The time that the parts of the grammar describe; NULL where they are none."""
    at = {name: F.get(parts, F.lit(i)) for i, name in enumerate(_PARTS)}

    def number(name: str) -> Column:
        # A failed cast costs far more than a test for an empty text.
        return F.when(at[name] != "", at[name].try_cast("int"))

    def or_zero(name: str) -> Column:
        return F.coalesce(number(name), F.lit(0))

    year = number("year")
    full = F.when(F.length(at["year"]) == 4, year).otherwise(
        year + F.when(year < FIRST_YEAR_OF_1900S, 2000).otherwise(1900)
    )
    first, second, month, day = number("first"), number("second"), number("month"), number("day")
    named = F.when(at["name"] != "", (F.position(F.lower(F.substring(at["name"], 1, 3)), F.lit(_MONTHS)) + 2) / 3)
    # Day first where that is a date, else month first.
    day_first = second <= 12
    swapped = (at["separator"] != "") & (day <= 12) if iso_day_first else F.lit(False)
    found_month = F.coalesce(
        named.cast("int"), F.when(swapped, day).otherwise(month), F.when(day_first, second).otherwise(first)
    )
    found_day = F.coalesce(F.when(swapped, month).otherwise(day), F.when(day_first, first).otherwise(second))
    hour = or_zero("hour")
    half = F.lower(at["half"])
    hour = F.when(half == "", hour).when(hour <= 12, hour % 12 + F.when(half == "p", 12).otherwise(0))
    fraction = F.coalesce(F.when(at["fraction"] != "", F.rpad(at["fraction"], 6, "0").try_cast("int")), F.lit(0))
    offset = (or_zero("offset_hours") * 60 + or_zero("offset_minutes")) * F.when(at["sign"] == "-", -1).otherwise(1)
    seconds = (or_zero("second_of_minute") + fraction / F.lit(1_000_000)).cast("decimal(8,6)")
    time = F.try_make_timestamp(full, found_month, found_day, hour, or_zero("minute"), seconds, F.lit("UTC"))
    # Most values are written without an offset, and moving a time costs as much as reading it.
    return F.when(at["sign"] == "", time).otherwise(F.timestamp_add("MINUTE", -offset, time))


def parse_timestamp(c: Column, iso_day_first: bool = False) -> Column:
    """Stripped text as day-first, then ISO, then month-first; NULL where nothing fits.

    One regular expression takes a value apart, whatever its notation: numbers with `/`, `-`, `.` or blanks
    between them, the year first or last and of two or four digits; months by name, before or behind the day;
    eight digits; a weekday before. A clock of 24 hours or with AM and PM and an offset, with or without colon,
    may follow. Each value is read on its own. A date that begins with a year of four digits reads as
    year-month-day unless iso_day_first asks for year-day-month.
    """
    usual = usual_timestamp(c, iso_day_first)
    # A lambda's argument is evaluated once, and not once per use.
    parts = F.array(time_parts(c))
    found = F.get(F.transform(parts, lambda p: timestamp_of_parts(p, iso_day_first)), F.lit(0))
    # A zone by the name of its region is read in ISO literals alone.
    return F.coalesce(usual, found, region_timestamp(c) if iso_day_first else F.lit(None))


def with_timestamp(rows: DataFrame, text: str, iso_day_first: bool = False) -> DataFrame:
    """The rows with the time that a column of stripped text describes in place of that text.

    As `parse_timestamp`, but each step is a column of its own, which later steps read, so that all of it is
    compiled and only values in unusual notations are taken apart.
    """
    c = F.col(text)
    rows = rows.withColumn("_usual", usual_timestamp(c, iso_day_first))
    rows = rows.withColumn("_parts", F.when(F.col("_usual").isNull() & (F.length(c) > 0), time_parts(c)))
    last = region_timestamp(c) if iso_day_first else F.lit(None)
    time = F.coalesce("_usual", timestamp_of_parts(F.col("_parts"), iso_day_first), last)
    return rows.withColumn(text, time).drop("_usual", "_parts")


def usual_timestamp(c: Column, iso_day_first: bool = False) -> Column:
    """Values in the two most usual notations, which only change their places and become literals, else NULL."""
    swapped = [F.regexp_replace(c, F.lit(_PLAIN), F.lit(t)) for t in ("$4-$3-$1 $5", "$4-$1-$3 $5")]
    plain = F.when(c.rlike(_PLAIN), F.coalesce(*[s.try_cast("timestamp") for s in swapped]))
    return plain if iso_day_first else F.when(c.rlike(_ISO), c.try_cast("timestamp")).otherwise(plain)


def region_timestamp(c: Column) -> Column:
    return F.when(c.rlike(_ISO), c.try_cast("timestamp"))


def time_parts(c: Column) -> Column:
    """The parts of a written time by the grammar; of a text that is none, the text."""
    return F.split(F.regexp_replace(c, F.lit(_GRAMMAR), F.lit("|".join(_PARTS.values()))), r"\|")
