"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum import config


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_type(path: str | Column) -> Column:
    """B1: lower-case extension without the dot; query string and fragment are cut first.
    A path without an extension gives ''."""
    p = F.regexp_replace(_c(path), r"[?#].*$", "")
    return F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1))


def path_type(path: str | Column) -> Column:
    """B1 for file paths, whose names may hold ``#`` and ``?``: the extension as it stands."""
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))


def id_format(*parts: str | Column) -> Column:
    """``a:b:c``; a NULL part prints as '' (``concat_ws`` would silently drop it)."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit(":"))
        cols.append(F.coalesce(_c(p).cast("string"), F.lit("")))
    return F.concat(*cols)


WS = r"[ \t\n\r\f\x0B]"


def strip_ws(text: str | Column) -> Column:
    """Remove leading and trailing whitespace (space, tab, newline, CR, FF, VT), like a
    Python ``strip()`` on ASCII whitespace; ``trim`` alone removes spaces only."""
    return F.regexp_replace(_c(text), f"^{WS}+|{WS}+$", "")


def clean_title(title: str | Column) -> Column:
    """strip, then delete double quotes (order matters)."""
    return F.replace(strip_ws(title), F.lit('"'), F.lit(""))


def display_title(title: str | Column, n: int = config.TITLE_DISPLAY_LEN) -> Column:
    """A title longer than ``n`` shows its first ``n`` characters and ``..``."""
    t = _c(title)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(".."))).otherwise(t)


def preview(text: str | Column, n: int = config.PREVIEW_LEN) -> Column:
    """First ``n`` characters followed by ``...``."""
    return F.concat(F.substring(F.coalesce(_c(text), F.lit("")), 1, n), F.lit("..."))


def short_id(session_id: str | Column, n: int = config.SESSION_ID_PREFIX_LEN) -> Column:
    return F.substring(_c(session_id), 1, n)


def fill_template(template: str, **values: str | Column) -> Column:
    """F16: fill ``{name}`` placeholders of a literal template with columns.

    The template is cut at the placeholders on the driver and reassembled with ``concat``,
    so nothing in the data (``%``, braces) is ever interpreted as format syntax.
    """
    pieces: list[Column] = []
    rest = template
    while rest:
        starts = [(rest.find("{" + k + "}"), k) for k in values if ("{" + k + "}") in rest]
        if not starts:
            pieces.append(F.lit(rest))
            break
        pos, key = min(starts)
        if pos:
            pieces.append(F.lit(rest[:pos]))
        pieces.append(F.coalesce(_c(values[key]).cast("string"), F.lit("")))
        rest = rest[pos + len(key) + 2:]
    return F.concat(*pieces) if pieces else F.lit("")


def tokens(text: str | Column) -> Column:
    """Lower-case word tokens (letters and digits), empty strings removed."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+"),
                    lambda t: t != "")


def fixed_decimals(x: str | Column, digits: int = 2) -> Column:
    """fixed-decimals formatting."""
    return F.format_string(f"%.{digits}f", _c(x).cast("double"))
