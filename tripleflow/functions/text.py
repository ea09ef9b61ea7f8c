"""Column expressions over text lines and binding maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character up to U+0020 counts as blank at the ends of a line.
EDGE_BLANKS = "".join(map(chr, range(0x21)))
LINE_BREAKS = "\\r\\n|\\n|\\r"


def trim_blanks(line: Column) -> Column:
    """Strip every leading and trailing character up to U+0020, not only spaces."""
    return F.btrim(line, F.lit(EDGE_BLANKS))


def tokens(line: Column, delim: str) -> Column:
    """Non-empty pieces between delimiter characters; runs of delimiters collapse."""
    run = "[" + "".join("\\" + c if not c.isalnum() else c for c in delim) + "]+"
    inside = F.btrim(line, F.lit(delim))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, run))


def leading_number(line: Column) -> Column:
    """The first space-separated token as a number; NULL when it is not one."""
    return number_or_null(F.split(line, " ").getItem(0))


# What reads as a number: decimal digits, perhaps grouped by underscores, or a name of no number.
_NUMBER = r"(?i)^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?(e[+-]?\d+)?|\.\d+(_\d+)*(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def number_or_null(text: Column) -> Column:
    """Text as a double.  A plain cast would also take suffixes (``12d``) and hexadecimals."""
    plain = F.regexp_replace(F.trim(text), "_", "")
    return F.when(F.regexp_like(text, F.lit(_NUMBER)), plain.try_cast("double"))


def merge_bindings(left: Column, right: Column) -> Column:
    """Union of two binding maps; the right one wins where both bind a variable."""
    kept = F.map_filter(left, lambda name, _: ~F.map_contains_key(right, name))
    return F.map_concat(kept, right)


def render_bindings(names: list[str]) -> Column:
    """The bindings in columns ``names`` as text: ``{?a=A, ?b=1}``, names sorted."""
    pairs = [F.concat(F.lit(f"?{n}="), F.col(n)) for n in sorted(names)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def render_map(bindings: Column) -> Column:
    """A binding map as text in the same form, keys sorted."""
    pairs = F.transform(
        F.array_sort(F.map_entries(bindings)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return F.concat(F.lit("{"), F.concat_ws(", ", pairs), F.lit("}"))
