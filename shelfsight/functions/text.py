"""Sizes, dates and sentences in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a unit, the names of a disk requirement (two words with or without a space), and the memory that is not the system's.
UNIT_BYTES = {"kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "mib": 1024.0**2, "gib": 1024.0**3}
STORAGE_NAMES = ("storage", "hard disk", "hard drive", "disk space", "free disk", "available space", "hdd", "install size", "installation size")
OTHER_MEMORY = ("video", "graphics", "dedicated")


def bound(value: Column, body) -> Column:
    """body(value), where value is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def requirement_lines(html: Column) -> Column:
    """The lines of requirement HTML: lower case, tags as spaces, runs of white space as one space."""
    broken = F.regexp_replace(F.replace(F.lower(F.coalesce(html, F.lit(""))), F.lit("</li>"), F.lit("\n")), r"<br[\s/]*>", "\n")
    untagged = F.regexp_replace(broken, r"<[^>\n]+>", " ")  # a tag ends in its line
    return F.split(F.regexp_replace(untagged, r"(?U)[^\S\n]+", " "), "\n")


def after_storage_name(line: Column) -> Column:
    """What follows the first name of a disk requirement in a line; null without one."""
    names = dict.fromkeys(n for name in STORAGE_NAMES for n in (name, name.replace(" ", "")))
    found = [F.when(F.instr(line, name) > 0, F.struct(F.instr(line, name).alias("at"), F.lit(len(name)).alias("n"))) for name in names]
    return bound(F.array_min(F.array_compact(F.array(*found))), lambda first: F.substring(line, first["at"] + first["n"], F.length(line)))


def after_memory_name(line: Column) -> Column:
    """What follows the first "memory:" or "ram:" of the system in a line; null without one.

    The name stands right before its colon, and no letter before it; the word before it may tell that the memory is another's.
    """
    parts = F.split(line, ":")

    def named(part: Column) -> Column:
        words = F.split(F.rtrim(part), " ")
        last, before = F.element_at(words, -1), F.coalesce(F.try_element_at(words, F.lit(-2)), F.lit(""))
        others = F.lit(False)
        for w in OTHER_MEMORY:
            others = others | before.endswith(w)
        return last.rlike("(^|[^a-z])(memory|ram)$") & ~(last.isin("memory", "ram") & others)

    before_colon = F.slice(parts, F.lit(1), F.size(parts) - 1)
    at = F.array_position(F.transform(before_colon, named), F.lit(True))
    return F.when(at > 0, F.array_join(F.slice(parts, (at + 1).cast("int"), F.size(parts)), ":"))


def first_size(text: Column) -> Column:
    """Bytes of the first number that a unit follows, with nothing or white space between; a comma is a decimal point. Null without one.

    A unit ends where a letter, digit or underscore does not go on; other signs may follow it, but not stand between it and the number.
    """
    words = F.split(F.trim(F.regexp_replace(text, "(?<=[0-9])(?=[a-z])", " ")), " ")
    units = F.create_map(*[F.lit(x) for pair in UNIT_BYTES.items() for x in pair])

    def size(pair: Column) -> Column:
        amount = F.replace(F.regexp_extract(pair["token"], "[0-9]+([.,][0-9]+)?$", 0), F.lit(","), F.lit("."))
        unit = F.regexp_extract(F.coalesce(pair["next"], F.lit("")), r"^[\p{L}\p{N}_]+", 0)
        return F.floor(amount.try_cast("double") * F.try_element_at(units, unit)).cast("long")

    def sizes(tokens: Column) -> Column:
        pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda t, n: F.struct(t.alias("token"), n.alias("next")))
        return F.get(F.filter(F.transform(pairs, size), lambda b: b.isNotNull()), 0)

    return bound(words, sizes)


def _first_above_zero(html: Column, after) -> Column:
    named = F.filter(F.transform(requirement_lines(html), after), lambda rest: rest.isNotNull())
    return F.get(F.filter(F.transform(named, first_size), lambda b: b > 0), 0)


def storage_bytes(minimum: Column, recommended: Column) -> Column:
    """Install size of the minimum requirements, or else of the recommended: the first line that names one above 0; else null."""
    return F.coalesce(_first_above_zero(minimum, after_storage_name), _first_above_zero(recommended, after_storage_name))


def memory_bytes(minimum: Column, recommended: Column) -> Column:
    """System memory, read like `storage_bytes`."""
    return F.coalesce(_first_above_zero(minimum, after_memory_name), _first_above_zero(recommended, after_memory_name))


def lenient_date(text: Column) -> Column:
    """ISO, 'Jan 5, 2020', 'January 5, 2020', '5 Jan 2020', '5 January 2020', '2020', 'Q3 2020'; anything else is null."""
    t = F.trim(text)
    year = F.when(t.rlike(r"^(19|20)\d\d$") & (t != "1900"), F.make_date(t.try_cast("int"), F.lit(1), F.lit(1)))
    q = F.regexp_extract(t, r"^[Qq]([1-4]) +((?:19|20)\d\d)$", 1).try_cast("int")
    q_year = F.regexp_extract(t, r"^[Qq]([1-4]) +((?:19|20)\d\d)$", 2).try_cast("int")
    quarter = F.when(q.isNotNull() & (q_year > 1900), F.make_date(q_year, (q - 1) * 3 + 1, F.lit(1)))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    named = [
        F.when(t.rlike(shape), F.try_to_date(t, fmt))
        for shape, fmt in (
            (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
            (r"^[A-Za-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
            (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
            (r"^\d{1,2} [A-Za-z]{3,} \d{4}$", "d MMMM yyyy"),
        )
    ]
    return F.coalesce(iso, *named, year, quarter)


def rationale(reviews: Column, share: Column, price: Column, size: Column, titles: Column, label: Column) -> Column:
    """One sentence of the signals that put an item on the list; unknown ones are left out. Ties of the percentage go to the even one."""
    positivity = F.when(share.isNotNull(), F.concat(F.lit(" ("), F.format_string("%.0f", F.bround(share * 100)), F.lit("% positive)")))
    cost = F.when(price == 0, F.lit("free")).when(price.isNotNull(), F.concat(F.lit("$"), F.format_string("%.2f", price)))
    gigabytes = F.concat(F.format_string("%.1f", size / 1e9), F.lit("GB on disk"))
    megabytes = F.concat(F.format_string("%.0f", size / 1e6), F.lit("MB on disk"))
    earlier = F.when(titles == 1, F.lit("one earlier title")).otherwise(F.concat(titles.cast("int").cast("string"), F.lit(" earlier titles")))
    return F.concat_ws(
        ", ",
        F.concat(F.lit("In "), label, F.lit(": "), reviews.cast("long").cast("string"), F.lit(" reviews"), F.coalesce(positivity, F.lit(""))),
        cost,
        F.when(size >= 1e9, gigabytes).when(size.isNotNull(), megabytes),
        F.when(titles.isNotNull(), earlier),
        F.lit("which may point to a small scope."),
    )


def item_link(base: Column | str, item_id: Column) -> Column:
    return F.concat(F.lit(base) if isinstance(base, str) else base, F.lit("/"), item_id.cast("string"))


def text_version(text: Column) -> Column:
    """First 12 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)
