"""Column expressions for form text: folding, exact and normalized values, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, spelt out so that other SQL engines read it alike.
SPACE = r"[ \t\r\n\f\x0B]"
SPACES = " \t\r\n\f\x0b"
#: What counts as a number in a form's cell.
NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def fold(c: Column) -> Column:
    """Lower case, with the sharp s folded to ss."""
    return F.lower(F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss")))


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def normalized_header(c: Column) -> Column:
    return squeeze(F.replace(fold(c), F.lit("_"), F.lit(" ")))


def normalized_column_name(c: Column) -> Column:
    return squeeze(fold(c))


def exact_value(c: Column) -> Column:
    """Line ends as \\n, and no white space at the ends."""
    return strip(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def unicode_alnum(c: Column) -> Column:
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "")


def ascii_alnum(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def number(c: Column) -> Column:
    """The cell as a double, null if it isn't a plain number."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def day_month(c: Column) -> Column:
    """'3-January' and the like as '03jan'; other text by its letters and digits."""
    two_digits = F.regexp_replace(ascii_alnum(c), r"\A(\d)([a-z]{3})[a-z]*\z", "0$1$2")
    return F.regexp_replace(two_digits, r"\A(\d\d)([a-z]{3})[a-z]*\z", "$1$2")


def normal_form(exact: Column, value_type: Column) -> Column:
    """normalized_value() of an exact value."""
    return F.when(value_type == "temperature", exact).when(value_type == "date_dd_mon", day_month(exact)).when(value_type == "english_text", ascii_alnum(exact)).otherwise(squeeze(fold(exact)))


def normalized_value(c: Column, value_type: Column) -> Column:
    """A cell's text for comparison, by its column's type (temperatures by number, see same_value)."""
    return normal_form(exact_value(c), value_type)


def same_exact(x: Column, y: Column, value_type: Column) -> Column:
    """same_value() of two exact values; the type is asked once, outside."""
    numbers = F.coalesce(number(x) == number(y), x == y)
    dates, letters = day_month(x) == day_month(y), ascii_alnum(x) == ascii_alnum(y)
    return F.when(value_type == "temperature", numbers).when(value_type == "date_dd_mon", dates).when(value_type == "english_text", letters).otherwise(squeeze(fold(x)) == squeeze(fold(y)))


def same_value(a: Column, b: Column, value_type: Column) -> Column:
    """Whether two cells agree after normalizing; numbers are compared as numbers where both are."""
    return same_exact(exact_value(a), exact_value(b), value_type)


def first_alias(name: Column, aliases: Sequence[tuple[str, str]]) -> Column:
    """The id of the first (alias, id) in the given order whose alias is in the name."""
    plain = unicode_alnum(name)
    return F.coalesce(*[F.when(plain.contains(alias), value) for alias, value in aliases])


def longest_suffix(name: Column, ids: Sequence[str], tail: str = "") -> Column:
    """The longest id such that the name ends in _id and the tail."""
    return F.coalesce(*[F.when(name.endswith(f"_{i}{tail}"), i) for i in sorted(ids, key=lambda i: (-len(i), i))])


def without_suffix(c: Column, suffix: str) -> Column:
    return F.regexp_replace(c, rf"{suffix}\z", "")


def file_token(c: Column, fallback: Column) -> Column:
    """A text as part of a file name."""
    token = F.regexp_replace(F.regexp_replace(strip(c), "[^A-Za-z0-9_-]+", "_"), r"\A_+|_+\z", "")
    return F.when(token != "", token).otherwise(fallback)


def cell_file_name(key: Column, row: Column, col: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Name of a cell's image, with its place in the table and on the page."""
    token = file_token(F.coalesce(key, F.lit("")), F.format_string("col_%03d", col))
    return F.concat(token, F.format_string("_row_%03d_coords_x%04d_y%04d_w%04d_h%04d.png", row, x, y, width, height))


CELL_FILE = r"\A(.+)_row_(\d+)_coords_x(\d+)_y(\d+)_w(\d+)_h(\d+)\.png\z"


def parsed_cell_file(name: Column) -> dict[str, Column]:
    """The parts of a cell image's name; key '' and row -1 for other names."""
    fits = name.rlike(CELL_FILE)
    out = {"column_key": F.regexp_extract(name, CELL_FILE, 1), "row": F.when(fits, F.regexp_extract(name, CELL_FILE, 2).try_cast("int")).otherwise(-1)}
    return out | {k: F.when(fits, F.regexp_extract(name, CELL_FILE, i).try_cast("int")) for i, k in enumerate(("x", "y", "width", "height"), 3)}


def name_list(c: Column) -> Column:
    """Comma-separated names: blank ones dropped, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), strip), lambda x: x != ""))


def without_fence(c: Column) -> Column:
    """The inside of a text that is one fenced code block, else the text without white space at the ends."""
    inside = r"(?s)\A```(?:json)?[ \t\r\n\f\x0B]*(.*?)[ \t\r\n\f\x0B]*```\z"
    plain = strip(c)
    return F.when(plain.rlike(inside), F.regexp_extract(plain, inside, 1)).otherwise(plain)


def is_divider(key: Column) -> Column:
    return F.lower(key).startswith("divider")


def raw_note(text: Column, raw: Column) -> Column:
    """A note of what was read, where it differs from what was kept."""
    return F.when(raw.isNotNull() & (strip(raw) != strip(F.coalesce(text, F.lit("")))), F.concat(F.lit("read as "), raw))


def elapsed(start: Column, end: Column) -> Column:
    """A duration as 'Nm SSs', or 'Ns' below a minute."""
    s = F.greatest(F.lit(0), F.unix_timestamp(end) - F.unix_timestamp(start))
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), s % 60))


def progress(done: Column, total: Column) -> Column:
    """Percent done, at most 100; 0 without a total."""
    return F.least(F.lit(100.0), F.coalesce(F.try_divide(done * 100.0, total), F.lit(0.0)))


def is_fresh(beat: Column, now: Column, most_seconds: int, ahead_seconds: int = 5) -> Column:
    """Whether a heartbeat is neither too old nor from the future."""
    age = F.unix_micros(now) - F.unix_micros(beat)
    return (age <= most_seconds * 1_000_000) & (age >= -ahead_seconds * 1_000_000)
