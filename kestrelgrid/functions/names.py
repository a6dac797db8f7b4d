"""Taxon and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID = "INVALID_TAXON"
#: Marks of an uncertain or hybrid name; fixed values.
MARKERS = (" sp.", " sp ", " cf.", " cf ", " aff.", " aff ", " x ")


def binomial(name: Column) -> Column:
    """``Genus species`` from a free-form name; INVALID for uncertain, hybrid and one-word names; null stays null.

    White space is Unicode's, as the marks and the words of a name may be set off by a no-break space.
    """
    low = F.lower(name)
    uncertain = F.lit(False)
    for m in MARKERS:
        uncertain = uncertain | F.contains(low, F.lit(m))
    bare = F.regexp_replace(F.regexp_replace(low, r"\(.*?\)", ""), r"(?U)[^a-z\s\-]", "")
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    genus = words.getItem(0)
    good = F.concat(F.upper(F.substring(genus, 1, 1)), F.substr(genus, F.lit(2)), F.lit(" "), words.getItem(1))
    return F.when(name.isNull(), F.lit(None)).when(uncertain | (F.size(words) < 2), F.lit(INVALID)).otherwise(good)


def was_modified(original: Column, cleaned: Column) -> Column:
    return ~F.lower(original).eqNullSafe(F.lower(cleaned))


def safe_file_name(name: Column) -> Column:
    return F.translate(name, " /", "__")


def reasons(items: list[Column]) -> Column:
    """Distinct non-null reasons, sorted, joined by a bar."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*items)))), "|")


def impact_direction(label: Column) -> Column:
    """-1 for labels that begin with Negative, else 1."""
    return F.when(F.startswith(label, F.lit("Negative")), -1).otherwise(1)


#: Abbreviated months in calendar order; fixed values.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month_name(month: Column) -> Column:
    """The abbreviation of a month's number, null for others; rows are put in calendar order by the number."""
    return F.when(month.between(1, 12), F.element_at(F.array(*map(F.lit, MONTHS)), month.cast("int")))
