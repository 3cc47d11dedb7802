"""Date parsing with ``strptime``-style first-format-wins semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions.constants import MONTH_ABBR, MONTH_FULL
from inkproof.functions.text import let, strip

_MONTHS = {}
for _names in (MONTH_FULL, MONTH_ABBR):
    for _i, _name in enumerate(_names.split("|"), start=1):
        _MONTHS[_name.lower()] = _i


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day).try_cast("date")


def parse_date(text: Column) -> Column:
    """Parse a date string in one of 18 accepted layouts, else NULL.

    The layouts collapse into five shapes.  Within a shape the day/month order that is
    listed first wins and the other is tried when the first is not a real date.  Two-digit
    years pivot at 69.
    """

    def numeric(s: Column) -> Column:
        return let(F.split(s, "[/.-]"), lambda p: in_parts(s, p))

    def marks(s: Column, p: Column) -> tuple[Column, Column]:
        """The characters between the three parts."""
        first = F.length(p[0])
        return F.substring(s, first + 1, F.lit(1)), F.substring(s, first + F.length(p[1]) + 2, F.lit(1))

    def in_parts(s: Column, p: Column) -> Column:
        a, b, tail = (p[i] for i in range(3))
        sep, sep2 = marks(s, p)
        short = F.length(tail) == 2
        year = F.when(short, F.concat(F.when(tail >= "69", "19").otherwise("20"), tail)).otherwise(tail)
        month_first, day_first = _date(year, a, b), _date(year, b, a)
        return F.when(
            sep == sep2,
            F.when(sep == "/", F.coalesce(month_first, day_first))
            .when((sep == "-") & short, day_first)
            .when(sep == "-", F.coalesce(day_first, month_first))
            .when(~short, F.coalesce(month_first, day_first)),
        )

    def iso(s: Column) -> Column:
        def whole(p: Column) -> Column:
            sep, sep2 = marks(s, p)
            return F.when(sep == sep2, _date(p[0], p[1], p[2]))

        return let(F.split(s, "[/.-]"), whole)

    months = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])

    def named(s: Column, shape: str, month: int, day: int) -> Column:
        number = F.try_element_at(months, F.lower(F.regexp_extract(s, shape, month)))
        return _date(F.regexp_extract(s, shape, 3), number.cast("string"), F.regexp_extract(s, shape, day))

    def parse(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-](\d{4}|\d{2})$"), numeric(s))
            .when(s.rlike(r"^\d{4}[/.-]\d{1,2}[/.-]\d{1,2}$"), iso(s))
            .when(s.rlike(r"^[A-Za-z]+\s+\d"), named(s, r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$", 1, 2))
            .when(s.rlike(r"^\d{1,2}\s+[A-Za-z]"), named(s, r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", 2, 1))
        )

    return let(strip(text), parse)


def parse_pdf_date(text: Column) -> Column:
    """``D:YYYYMMDDHHmmSS`` to ISO text; text without a usable date comes back unchanged."""
    shape = r"(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"

    def part(i: int, default: str) -> Column:
        found = F.regexp_extract(text, shape, i)
        return F.when(found == "", F.lit(default)).otherwise(found)

    stamp = F.concat(
        part(1, "0000"), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "),
        part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
    )
    valid = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))
    iso = F.when(
        valid.isNotNull() & (part(1, "0000") != "0000"),
        F.date_format(valid, "yyyy-MM-dd'T'HH:mm:ss"),
    )
    return F.when(F.length(text) > 0, F.when(text.rlike(r"\d{4}"), F.coalesce(iso, text)).otherwise(text))
