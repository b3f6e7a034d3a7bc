"""Scalar column functions (all native Spark expressions, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusworks import constants as K


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Python ``str.strip()`` - remove every leading/trailing whitespace char."""
    return F.btrim(_c(col), F.lit(K.PY_WHITESPACE))


def basename(col, missing: str | None = K.MISSING_SOURCE) -> Column:
    """last path segment after '/', may be empty; ``missing`` when NULL."""
    b = F.substring_index(_c(col), "/", -1)
    return b if missing is None else F.coalesce(b, F.lit(missing))


# a dot that has a non-dot character somewhere before it in the name
_EXT_PATTERN = r"(?s)^\.*[^.].*(\.[^.]*)$"


def file_ext(col) -> Column:
    """lower-cased extension of the last path segment ('' when none).

    Same rule as Python's ``os.path.splitext``: leading dots do not start an
    extension (``.hidden`` has none, ``a.tar.gz`` has ``.gz``).
    """
    return F.lower(F.regexp_extract(basename(col, None), _EXT_PATTERN, 1))


def reader_for_ext(ext_col) -> Column:
    """Reader name for a lower-cased extension, 'unsupported' otherwise."""
    m = F.create_map(*[F.lit(x) for kv in K.FORMAT_BY_EXTENSION.items() for x in kv])
    return F.coalesce(m[_c(ext_col)], F.lit("unsupported"))


def _tenths_half_even(n: Column, unit: int) -> Column:
    """round(n / unit, 1) with exact half-to-even ties, as a string 'x.y'.

    n / unit is exact in binary for unit = 1024**k, so Python's ``:.1f``
    rounds real ties to even; done here with integer arithmetic only.
    """
    v = n * 10
    q = F.floor(v / unit).cast("long")
    r = v - q * unit
    q = (F.when(r * 2 > unit, q + 1)
         .when((r * 2 == unit) & (q % 2 == 1), q + 1)
         .otherwise(q))
    return F.concat((q / 10).cast("long").cast("string"), F.lit("."), (q % 10).cast("string"))


def format_size(col) -> Column:
    """'<n> B' below 1024, then one decimal KB / MB / GB."""
    n = _c(col).cast("long")
    kb, mb, gb = 1024, 1024 ** 2, 1024 ** 3
    return (F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < mb, F.concat(_tenths_half_even(n, kb), F.lit(" KB")))
            .when(n < gb, F.concat(_tenths_half_even(n, mb), F.lit(" MB")))
            .otherwise(F.concat(_tenths_half_even(n, gb), F.lit(" GB"))))


def preview(col, n: int = K.PREVIEW_LEN) -> Column:
    """first ``n`` characters, '...' appended only when longer."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def safe_name(col) -> Column:
    """every char that is not a letter, digit, '-' or '_' becomes '_'."""
    return F.regexp_replace(_c(col), r"[^\p{L}\p{N}_-]", "_")


def session_id(ts_col, key_col) -> Column:
    """'yyyyMMdd_HHmmss_' + 6 hex chars (deterministic hash of a key)."""
    return F.concat(F.date_format(_c(ts_col), "yyyyMMdd_HHmmss"), F.lit("_"),
                    F.substring(F.sha2(_c(key_col).cast("string"), 256), 1, 6))


def time_string(ts_col) -> Column:
    """Message time format 'yyyy-MM-dd HH:mm:ss'."""
    return F.date_format(_c(ts_col), "yyyy-MM-dd HH:mm:ss")


def short_date(col) -> Column:
    """F8: 'yyyy-MM-dd HH:mm:ss' -> 'dd/MM HH:mm'; unparsable -> first 16 chars."""
    s = _c(col)
    parsed = F.date_format(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")), "dd/MM HH:mm")
    return F.when(s.isNull() | (s == ""), F.lit("")).otherwise(F.coalesce(parsed, F.substring(s, 1, 16)))


def display_role(col, human_roles: Iterable[str] = ("human",)) -> Column:
    """roles in ``human_roles`` are shown as 'user', everything else as 'ai'."""
    return F.when(_c(col).isin(list(human_roles)), F.lit("user")).otherwise(F.lit("ai"))


def fill_template(template_col, content_col, placeholder: str = K.CONTENT_PLACEHOLDER) -> Column:
    """replace every literal ``placeholder`` (not a regex)."""
    return F.replace(_c(template_col), F.lit(placeholder), _c(content_col))


def cap_text(col, n: int, notice: str | None = None) -> Column:
    """cut to ``n`` characters when longer, then append ``notice``."""
    c = _c(col)
    cut = F.substring(c, 1, n)
    if notice:
        cut = F.concat(cut, F.lit(notice))
    return F.when(F.length(c) > n, cut).otherwise(c)


def progress_pct(step_col, total_col, base: float, span: float) -> Column:
    """base + span*step/total (base when total <= 0), clamped to [0, 1]."""
    step, total = _c(step_col).cast("double"), _c(total_col).cast("double")
    raw = F.when(total > 0, F.lit(base) + F.lit(span) * step / total).otherwise(F.lit(base))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def loading_pct(i_col, total_col) -> Column:
    """F15 (file loading): i/total*0.3 + 0.1, clamped."""
    base, span = K.PROGRESS_LOADING
    return progress_pct(i_col, total_col, base, span)


def file_stem(col) -> Column:
    """remove every '.json' from a file name."""
    return F.replace(_c(col), F.lit(".json"), F.lit(""))


def first_present(*cols) -> Column:
    """Python ``a or b``: first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])
