"""String functions as column expressions: no Python runs on the executors. A null gives a null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as a regular expression's character class.
BLANK = r"[\s\x0B\x85\p{Z}]"
TIMESTAMP_NAME = r"\A(\d{4}_\d{2}_\d{2}_\d{6})_([^\n]+)\z"


def snake_case(s: Column) -> Column:
    """Splits at a capital after a small letter or digit, lower-cases, turns blanks and hyphens into single underscores, trims those."""
    s = F.lower(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(F.regexp_replace(s, "[ _-]+", "_"), r"\A_|_\z", "")


def pascal_case(s: Column) -> Column:
    """Each run of ASCII letters and digits with a capital first, joined."""
    return F.regexp_replace(F.initcap(F.regexp_replace(s, "[^a-zA-Z0-9]+", " ")), " ", "")


def camel_case(s: Column) -> Column:
    """pascal_case with a small first letter."""
    p = pascal_case(s)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))


def is_valid_name(s: Column) -> Column:
    return s.rlike(r"\A[a-zA-Z0-9_]+\z")


def sanitized_name(s: Column) -> Column:
    """snake_case with only ASCII letters, digits and underscores, and not a digit first."""
    clean = F.regexp_replace(snake_case(s), "[^a-zA-Z0-9_]", "")
    return F.when(clean.rlike(r"\A[0-9]"), F.concat(F.lit("migration_"), clean)).otherwise(clean)


def parsed_filename(s: Column) -> Column:
    """Struct of timestamp, name and valid, of `YYYY_MM_DD_HHMMSS_name.sql`; both are empty if it isn't valid."""
    stem = F.regexp_replace(s, r"\.sql\z", "")
    return F.struct(F.regexp_extract(stem, TIMESTAMP_NAME, 1).alias("timestamp"), F.regexp_extract(stem, TIMESTAMP_NAME, 2).alias("name"), stem.rlike(TIMESTAMP_NAME).alias("valid"))


def generated_filename(s: Column, at: Column | None = None) -> Column:
    """A script's file name, with the time `at` (now by default) in the session's time zone."""
    return F.concat(F.date_format(F.current_timestamp() if at is None else at, "yyyy_MM_dd_HHmmss"), F.lit("_"), sanitized_name(s), F.lit(".sql"))


def is_vowel(c: Column) -> Column:
    return (F.length(c) == 1) & (F.instr(F.lit("aeiou"), c) > 0)


IRREGULAR = {"person": "people", "child": "children", "foot": "feet", "tooth": "teeth", "mouse": "mice", "goose": "geese"}


def plural(s: Column) -> Column:
    """English plural of a word, lower-cased; an empty word stays empty."""
    w = F.lower(s)
    out = F.when(w == "", w)
    for one, many in IRREGULAR.items():
        out = out.when(w == one, F.lit(many))
    return (
        out.when(w.rlike(r"(?s)[^aeiou]y\z"), F.regexp_replace(w, r"y\z", "ies"))
        .when(w.rlike(r"(s|sh|ch|x|z)\z"), F.concat(w, F.lit("es")))
        .when(w.rlike(r"f\z"), F.regexp_replace(w, r"f\z", "ves"))
        .when(w.rlike(r"fe\z"), F.regexp_replace(w, r"fe\z", "ves"))
        .otherwise(F.concat(w, F.lit("s")))
    )


def table_of(name: Column) -> Column:
    """The table that a script `create_X_table` makes: X, in the plural unless it ends in s."""
    t = F.regexp_replace(F.regexp_replace(name, r"\Acreate_", ""), r"_table\z", "")
    return F.when(t.endswith("s"), t).otherwise(plural(t))


def truncated(s: Column, n: int) -> Column:
    """At most n bytes of UTF-8, the last three as dots if there is room; a character that is cut in two becomes U+FFFD."""
    raw = F.encode(s, "UTF-8")
    cut = F.decode(F.substring(raw, 1, n), "UTF-8") if n <= 3 else F.concat(F.decode(F.substring(raw, 1, n - 3), "UTF-8"), F.lit("..."))
    return F.when(F.octet_length(s) <= n, s).otherwise(cut)


def _padding(s: Column, n: int, fill: str) -> Column:
    return F.repeat(F.lit(fill), F.greatest(F.lit(n) - F.octet_length(s), F.lit(0)))


def padded_left(s: Column, n: int, fill: str = " ") -> Column:
    """As many fill characters in front as s has bytes too few for n; never shorter than s."""
    return F.concat(_padding(s, n, fill), s)


def padded_right(s: Column, n: int, fill: str = " ") -> Column:
    return F.concat(s, _padding(s, n, fill))


def trimmed(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(s, rf"\A{BLANK}+|{BLANK}+\z", "")


def is_blank(s: Column) -> Column:
    return trimmed(s) == ""


def contains(items: Column, item: Column) -> Column:
    """False for a null or empty array."""
    return F.coalesce(F.array_contains(items, item), F.lit(False))


def without_repeats(items: Column) -> Column:
    """The first of each value, in order."""
    return F.array_distinct(items)


def short_checksum(s: Column) -> Column:
    """The first 12 characters and dots, if it has more."""
    return F.when(F.length(s) > 12, F.concat(F.substring(s, 1, 12), F.lit("..."))).otherwise(s)


def checksum(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content, 256)


def quoted(identifier: str) -> str:
    """An identifier for Spark SQL."""
    return "`" + identifier.replace("`", "``") + "`"


_MARKER_LINE = r"(?md)^[^\n]*?-- \+migrate (?:Up|Down)[^\n]*"


def sections(rows: DataFrame, content: str, up: str = "up_sql", down: str = "down_sql") -> DataFrame:
    """rows with the Up and Down sections of a script.

    A line that contains a section's marker begins it and isn't part of it (Up, if it has both); what stands before the first marker belongs
    to none; a section that comes again goes on. The text is split at its marker lines, so the work is linear in its length.
    """
    text = F.col(content)
    parts = F.struct(F.split(text, _MARKER_LINE).alias("pieces"), F.regexp_extract_all(text, F.lit(_MARKER_LINE), F.lit(0)).alias("markers"))

    def section(x: Column, is_up: bool) -> Column:
        def lines(i: Column) -> Column:
            """The lines after marker i (from 0) as one string, null if there are none: line feeds at the ends are those of the marker lines."""
            piece = F.get(x["pieces"], i + 1)
            bare = F.when(i + 1 < F.size(x["markers"]), F.substring(piece, F.lit(1), F.length(piece) - 1)).otherwise(piece)
            return F.when(F.length(bare) > 0, F.substring(bare, F.lit(2), F.length(bare)))

        mine = F.transform(x["markers"], lambda m, i: F.when(m.contains("-- +migrate Up") == F.lit(is_up), lines(i)))
        return F.coalesce(F.array_join(F.filter(mine, lambda y: y.isNotNull()), "\n"), F.lit(""))

    # a generator over an array of one, so that a text is split once however often its parts are looked at
    both = F.inline(F.transform(F.array(parts), lambda x: F.struct(section(x, True).alias("up"), section(x, False).alias("down"))))
    others = [f"`{c}`" for c in rows.columns if c.lower() not in (up.lower(), down.lower())]
    return rows.select(*others, both.alias(up, down))


def statements(rows: DataFrame, sql: str) -> DataFrame:
    """One row for each statement: statement_no (from 0, of all non-empty chunks) and statement; chunks that begin with `--` are left out.

    Splits at every semicolon, also in strings and comments; quillstack.plans.scripts has a splitter that knows those.
    """
    chunks = F.filter(F.transform(F.split(F.col(sql), ";"), trimmed), lambda x: x != "")
    out = rows.select(*rows.columns, F.posexplode(chunks).alias("statement_no", "statement"))
    return out.where(~F.col("statement").startswith("--"))
