"""Column expressions over lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, carriage return, form feed; a vertical tab does not.
BLANKS = r"[ \t\n\r\f]+"


def fields(line: Column, separator: str = ",") -> Column:
    """A line's fields without trailing empty ones; no quoting."""
    return F.split(F.regexp_replace(line, f"{separator}+$", ""), separator)


def words(text: Column) -> Column:
    """The words of a text: never empty, as they are written."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def year_of(date: Column) -> Column:
    """The year of a yyyymmdd text, as text."""
    return F.substring(date, 1, 4)


def number(text: Column, kind: str = "int", strict: bool = True) -> Column:
    """The number a text holds. strict: a bad one fails the job; else it is null."""
    return text.cast(kind) if strict else text.try_cast(kind)


def measure(element: Column, name: str, value: Column) -> Column:
    """value where element is name, exactly; else null."""
    return F.when(element == name, value)


def repaired(html: Column) -> Column:
    """A lone ampersand between spaces becomes an entity, and the spaces go."""
    return F.replace(html, F.lit(" & "), F.lit("&amp;"))


def is_page_name(name: Column) -> Column:
    return name.rlike("^[^~]+$")


def decoded(link: Column) -> Column:
    """URL-decoded, or as it is where that fails."""
    return F.coalesce(F.try_url_decode(link), link)


def target(link: Column) -> Column:
    """The page a relative link to an .html file names, or null."""
    name = F.regexp_extract(decoded(link), r"^\..*/([^~]+)\.html$", 1)
    return F.when(name != "", name)
