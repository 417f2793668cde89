"""Text columns: keyword tests, ids, dates, departments, display formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise import constants as K
from slicewise.functions import numeric as N

_BLANKS = " \t\n\r\x0b\x0c"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def text(c: Column) -> Column:
    """Absent text reads as blank."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def keyword_hits(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.contains(w).cast("int") for w in words])


def description_score(c: Column, wanted=K.WANTED_SERIES_WORDS,
                      unwanted=K.UNWANTED_SERIES_WORDS) -> Column:
    """+1 for every wanted word and -2 for every unwanted word found in the text."""
    low = F.lower(text(c))
    return keyword_hits(low, wanted) - 2 * keyword_hits(low, unwanted)


def number_or(c: Column, default: float) -> Column:
    """Numeric text as a double; blank or malformed text gives the default."""
    return F.coalesce(F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double")), F.lit(default))


def compact_date(c: Column) -> Column:
    """``YYYYMMDD`` -> ISO text, else blank. Eight digits suffice, no calendar check."""
    raw = text(c)
    iso = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    return F.when(raw.rlike("^[0-9]{8}$"), iso).otherwise(F.lit(""))


def compact_datetime(date: Column, time: Column) -> Column:
    """ISO date-time when the time holds at least ``hhmmss``, else the date alone."""
    day = compact_date(date)
    clock = F.substring_index(text(time), ".", 1)
    hms = F.concat_ws(":", F.substring(clock, 1, 2), F.substring(clock, 3, 2), F.substring(clock, 5, 2))
    return (F.when(day == "", F.lit(""))
            .when(F.length(clock) >= 6, F.concat(day, F.lit("T"), hms))
            .otherwise(day))


def calendar_date(c: Column) -> Column:
    """The typed twin of :func:`compact_date`; impossible dates are null."""
    return F.try_to_date(F.nullif(compact_date(c), F.lit("")), "yyyy-MM-dd")


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    ``initcap`` only looks at blanks: it gives "O'neil 3rd", this "O'Neil 3Rd".
    """
    chars = F.split(c, "")

    def cased(ch: Column, i: Column) -> Column:
        after_letter = F.get(chars, i - 1).rlike(r"^\p{L}$")
        return F.when((i > 0) & after_letter, F.lower(ch)).otherwise(F.upper(ch))

    return F.array_join(F.transform(chars, cased), "")


def location(c: Column, departments: dict[str, str] = K.DEPARTMENTS, key: Column | None = None) -> Column:
    """Department text -> location: exact key, else first contained key, else title case.

    ``key`` may name a column that holds the trimmed, lower-cased text already;
    :func:`with_location` computes it once per row.
    """
    key = F.lower(strip(c)) if key is None else key
    exact = reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), departments.items(),
                   F.when(key.isNull() | ((key == "") & (c == "")), F.lit("Unknown")))
    ordered = reduce(lambda acc, kv: acc.when(key.contains(kv[0]), kv[1]),
                     departments.items(), exact)
    return ordered.otherwise(title_case(strip(c)))


def with_location(df: DataFrame, raw: str = "raw_department", out: str = "location") -> DataFrame:
    """Adds the location of a department column."""
    keyed = df.withColumn("_key", F.lower(strip(F.col(raw))))
    return keyed.withColumn(out, location(F.col(raw), key=F.col("_key"))).drop("_key")


def indication_prior(c: Column, priors: dict[str, float] = K.INDICATION_PRIORS,
                     default: float = K.DEFAULT_PRIOR) -> Column:
    low = F.lower(text(c))
    first, *rest = priors.items()
    chain = F.when(low.contains(first[0]), F.lit(first[1]))
    for phrase, prior in rest:
        chain = chain.when(low.contains(phrase), F.lit(prior))
    return chain.otherwise(F.lit(default))


def lookup(c: Column, table: dict[str, str], default: Column | str) -> Column:
    """Keyed lookup in a small fixed table with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    other = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), other)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(file_name(path)) - 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"),
                  F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)


def image_id(path: Column) -> Column:
    """Image id of a file name.

    ``ID_...`` stems are ids already. Otherwise the part after the last ``.``,
    ``_`` or ``-`` (tried in that order) counts when it is alphanumeric; failing
    that the whole stem with unusual characters replaced.
    """
    stem = file_stem(path)

    def tail(sep: str) -> Column:
        last = F.substring_index(stem, sep, -1)
        return F.when(stem.contains(sep) & last.rlike(r"^[\p{L}\p{N}]+$"),
                      F.concat(F.lit("ID_"), last))

    return F.when(stem.startswith("ID_"), stem).otherwise(
        F.coalesce(tail("."), tail("_"), tail("-"),
                   F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")))


def label_image(c: Column) -> Column:
    """``ID_<hex>_<class>`` -> ``ID_<hex>``."""
    return F.substring_index(c, "_", 2)


def label_class(c: Column) -> Column:
    """``ID_<hex>_<class>`` -> third part."""
    return F.get(F.split(c, "_"), F.lit(2))


def label_tail(c: Column) -> Column:
    """The part after the right-most ``_``; ``unknown`` when there is none."""
    return F.when(c.contains("_"), F.substring_index(c, "_", -1)).otherwise(F.lit("unknown"))


def trailing_number(c: Column) -> Column:
    """``name-42`` -> 42."""
    return F.substring_index(c, "-", -1).try_cast("int")


def report_section(c: Column, which: str, body: str = K.BODY_MARKER,
                   bullet: str = K.BULLET_MARKER) -> Column:
    """The text of one labelled section (``body`` or ``bullet``), blank when absent."""
    # Matched on the text itself: upper-casing may change its length ("ß" -> "SS").
    at_body = F.regexp_instr(c, F.lit(f"(?i){body}"))
    at_bullet = F.regexp_instr(c, F.lit(f"(?i){bullet}"))
    if which == "bullet":
        cut = F.substr(c, at_bullet + len(bullet))
        return F.when(at_bullet > 0, strip(cut)).otherwise(F.lit(""))
    start = at_body + len(body)
    cut = F.when(at_bullet > at_body, F.substr(c, start, at_bullet - start)).otherwise(F.substr(c, start))
    return F.when(at_body > 0, strip(cut)).otherwise(F.lit(""))


def fixed(c: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value, halves to even."""
    return N.decimals(c.cast("double"), digits)


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(fixed(c * 100, digits), F.lit("%"))


def signed_mm(c: Column) -> Column:
    """``+12.5 mm`` / ``-3.0 mm``."""
    return F.concat(N.decimals(c.cast("double"), 1, plus=True), F.lit(" mm"))


def clock(seconds: Column) -> Column:
    """Seconds -> ``h:mm:ss``."""
    s = F.floor(seconds).cast("bigint")
    shown = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(s.isNotNull(), shown)


def prevalence_text(rate: Column, min_n: int) -> Column:
    """Percent with two decimals, or ``<min_n studies`` when the rate is withheld."""
    return F.coalesce(percent(rate, 2), F.lit(f"<{min_n} studies"))
