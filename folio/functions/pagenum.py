"""Column functions over printed page numbers: arabic, roman, and what a contents line declares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import text as T

#: The forms of a contents line, a strict roman numeral and a number alone on its line; a TOC_LINE's
#: classes count characters of any script.
TOC_LINE = r"(?U)^(.{3,120}?)[.\s]{1,}(\d{1,4}|[ivxlcdm]{1,6}|[IVXLCDM]{1,6})\s*$"
STRICT_ROMAN = r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
ROMAN_MOST = 50
RATIO_MOST = 2.0
TOKEN = r"(?i)^[0-9]{1,4}$|^[ivxlcdm]{1,7}$"
#: A number that ends or begins a line, among blanks or just apart from letters.
TRAILING = r"(?i)(?:^|\s)(\d{1,4}|[ivxlcdm]{1,7})\s*$"
LEADING = r"(?i)^(\d{1,4}|[ivxlcdm]{1,7})(?:\s|$)"
LOOSE_TRAILING = r"(?i)(?<![A-Za-z])(\d{1,4}|[ivxlcdm]{1,7})\s*$"
LOOSE_LEADING = r"(?i)^(\d{1,4}|[ivxlcdm]{1,7})(?![A-Za-z])"


def parse_toc_line(line: Column) -> Column:
    """struct(raw_title, page) of a contents line; null for other lines."""
    return F.when(line.rlike(TOC_LINE), F.struct(F.regexp_extract(line, TOC_LINE, 1).alias("raw_title"), F.regexp_extract(line, TOC_LINE, 2).alias("page")))


def roman_value(numeral: Column) -> Column:
    """Value of a strict roman numeral in lower case: a digit counts against the sum where a greater one follows."""
    worth = lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000).otherwise(0)
    digits = F.transform(F.filter(F.split(numeral, ""), lambda c: c != ""), worth)
    # from the right: each digit adds if it is no less than the greatest one so far at its right
    folded = F.aggregate(F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda s, x: F.struct((s["sum"] + F.when(x < s["last"], -x).otherwise(x)).alias("sum"), x.alias("last")))
    return folded["sum"]


def page_value(page: Column) -> Column:
    """Integer value of a page field; null for letters that are no numeral, and for roman values over 50."""
    low = F.lower(page)
    roman = F.when((low != "") & low.rlike(STRICT_ROMAN), roman_value(low))
    return F.when(page.rlike(r"^[0-9]+$"), page.try_cast("int")).when(roman <= ROMAN_MOST, roman)


def to_roman(value: Column) -> Column:
    """Lower-case roman numeral of a number from 1 to 3999."""
    def place(unit: int, one: str, five: str, ten: str) -> Column:
        d = F.floor(value / unit) % 10
        names = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, names)), (d + 1).cast("int"))

    thousands = F.repeat(F.lit("m"), F.floor(value / 1000).cast("int"))
    return F.when((value >= 1) & (value <= 3999), F.concat(thousands, place(100, "c", "d", "m"), place(10, "x", "l", "c"), place(1, "i", "v", "x")))


def format_page(value: Column, is_roman: Column) -> Column:
    return F.when(is_roman, to_roman(value)).otherwise(value.cast("string"))


def normalize_printed(value: Column, kind: str = "string") -> Column:
    """Canonical text of a printed page number; null for blanks, "null", -1 and what is no number."""
    if kind == "string":
        bare = T.strip(value)
        return F.when((bare != "") & (F.lower(bare) != "null"), bare)
    if kind == "boolean":
        return F.lit(None).cast("string")
    whole = F.when(~F.isnan(value.cast("double")), value.cast("long"))
    return F.when(whole != -1, whole.cast("string"))


def declared_page(printed: Column, is_roman: Column, n_pages: Column) -> Column:
    """A contents line's printed number in plain form if it is plausible in a book of so many pages, else null.

    Numbers have to be positive and at most twice the page count; marked forms such as R42 need a digit.
    """
    value = page_value(printed)
    marked = printed.rlike(r"\d") & ~T.strip(printed).rlike(r"^-\d+$")
    return F.when(value.isNull(), F.when(marked, printed)).when((value > 0) & (value <= RATIO_MOST * n_pages), format_page(value, is_roman))


def first_page(pages: Column) -> Column:
    """First number of a range such as 85-113; null for roman ones."""
    return T.strip(F.split_part(pages, F.lit("-"), F.lit(1))).try_cast("int")


def split_citation(pages: Column) -> Column:
    """struct(start, end) of a range with both ends; null otherwise."""
    parts = F.split(pages, "-")
    ends = F.transform(parts, lambda x: T.strip(x))
    return F.when((F.size(parts) == 2) & (F.get(ends, F.lit(0)) != "") & (F.get(ends, F.lit(1)) != ""), F.struct(F.get(ends, F.lit(0)).alias("start"), F.get(ends, F.lit(1)).alias("end")))


def citation_start(pages: Column) -> Column:
    """What stands before a range's hyphen, or all of it."""
    start = T.strip(F.split_part(pages, F.lit("-"), F.lit(1)))
    return F.when(start != "", start)


def _full_lines(text: Column) -> Column:
    return F.filter(F.transform(T.lines(text), T.strip), lambda x: x != "")


def full_lines(lines: Column | str) -> Column:
    """Lines with more than blanks, as they are."""
    return F.filter(lines, lambda x: x.rlike(r"(?U)\S"))


def printed_page_number(text: Column) -> Column:
    """The page number printed on a page."""
    return printed_of_lines(full_lines(T.lines(text)))


def printed_of_lines(full: Column) -> Column:
    """The page number printed on a page of full lines, which are best worked out before.

    A token alone on one of the first two, then the last two full lines; else a number that ends, then one that
    begins, the first line that is no address and is shorter than 120.
    """
    tail = F.slice(full, F.greatest(F.size(full) - 1, F.lit(1)), 2)
    alone = F.filter(F.transform(F.concat(F.slice(full, 1, 2), tail), T.strip), lambda x: x.rlike(TOKEN))
    plain = lambda lines: F.get(F.filter(lines, lambda x: ~T.is_url_line(x)), F.lit(0))
    # a page seldom begins with three addresses
    first = T.strip(F.coalesce(plain(F.slice(full, 1, 3)), plain(full)))
    short = F.when(F.length(first) < 120, first)
    ending = F.regexp_extract(short, TRAILING, 1)
    leading = F.regexp_extract(short, LEADING, 1)
    return F.when(F.size(full) > 0, F.coalesce(F.get(alone, F.lit(0)), F.when(ending != "", ending), F.when(leading != "", leading)))


def printed_number_loose(text: Column) -> Column:
    """The reading used while ground truth is drafted: lines that look like addresses (three dots too) go first.

    A token alone on the last two, then the first two lines; else a number apart from letters that ends, then one
    that begins, the first line.
    """
    address = lambda x: x.contains("doi.org") | F.lower(x).contains("http") | (F.regexp_count(x, F.lit(r"\.")) >= 3)
    full = F.filter(_full_lines(text), lambda x: ~address(x))
    tail = F.slice(full, F.greatest(F.size(full) - 1, F.lit(1)), 2)
    alone = F.filter(F.concat(tail, F.slice(full, 1, 2)), lambda x: x.rlike(TOKEN))
    short = F.when(F.length(F.get(full, F.lit(0))) < 120, F.get(full, F.lit(0)))
    ending = F.regexp_extract(short, LOOSE_TRAILING, 1)
    leading = F.regexp_extract(short, LOOSE_LEADING, 1)
    return F.when(F.size(full) > 0, F.coalesce(F.get(alone, F.lit(0)), F.when(ending != "", ending), F.when(leading != "", leading)))
