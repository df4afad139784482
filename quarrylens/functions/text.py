"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end at the very end opens no further line, and empty text has none."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normal_line(line: Column) -> Column:
    """A line without white space, null where it is too short or only a brace."""
    bare = F.regexp_replace(line, r"(?U)\s+", "")
    return F.when((F.length(bare) >= 4), bare)


def include_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]'), F.lit(1))


def tsv_cell(c: Column) -> Column:
    """Backslash first, then tab, newline and carriage return."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def tsv_row(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[tsv_cell(F.col(c).cast("string")) for c in df.columns]).alias("line"))


def html_text(c: Column) -> Column:
    out = c
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


#: Fixed value: beyond this, milliseconds are no timestamp of 64-bit microseconds.
_MOST_MILLIS = 9_223_372_036_854_000


def scan_time(c: Column) -> Column:
    """Epoch milliseconds as UTC text, years after 9999 without a sign; text that is no number, or beyond what a timestamp holds,
    passes through."""
    ms = F.when(c.rlike(r"^-?[0-9]{1,19}$"), c.try_cast("long"))
    shown = F.date_format(F.timestamp_millis(F.when(ms.between(-_MOST_MILLIS, _MOST_MILLIS), ms)), "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.concat(F.ltrim(shown, F.lit("+")), F.lit(" UTC")), c)


def short_evidence(c: Column, most: int = 500) -> Column:
    """At most ``most`` bytes, then '...'; a character is never cut."""
    data = c.cast("binary")
    cut = F.regexp_replace(F.decode(F.substring(data, 1, most), "UTF-8"), "�+$", "")
    return F.when(F.octet_length(data) > most, F.concat(cut, F.lit("..."))).otherwise(c)


def severity_rank(c: Column, order: tuple[str, ...] = ("low", "medium", "high", "critical")) -> Column:
    """The place of a severity in ``order``, from 1; 0 if it has none."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), c), F.lit(0))


def known(c: Column) -> Column:
    return F.when(c < 0, "unknown").otherwise(c.cast("string"))


def any_cell_contains(df: DataFrame, text: str) -> Column:
    """Whether some cell of a row holds ``text``, in any case; cells are looked at one by one."""
    out = F.lit(False)
    for c in df.columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lower(F.lit(text))), F.lit(False))
    return out
