"""Column-expression helpers (built-in functions only, so they stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk level names and cut-offs of the data contract.
LEVEL_LOW, LEVEL_MID, LEVEL_HIGH = "faible", "moyen", "eleve"
LEVEL_LOW_MAX = 30.0      # score < 30  -> faible
LEVEL_HIGH_MIN = 70.0     # score > 70  -> eleve, otherwise moyen

# Cell texts treated as "not filled in".
EMPTY_VALUES = ("", "none", "null", "nan", "nat")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int = 0) -> Column:
    """NumPy-style rounding to ``digits`` decimals: rint(x * 10^d) / 10^d.

    Spark's ``round`` is half-up; ``rint`` is IEEE round-half-even, the same
    float steps as ``np.round`` and DuckDB ``round_even(x * 10^d, 0) / 10^d``.
    """
    scale = float(10 ** digits)
    c = col_(c)
    return F.rint(c * scale) / scale if digits else F.rint(c)


def risk_level(score) -> Column:
    s = col_(score)
    return (F.when(s > LEVEL_HIGH_MIN, LEVEL_HIGH)
            .when(s >= LEVEL_LOW_MAX, LEVEL_MID)
            .otherwise(LEVEL_LOW))


def level_label(level) -> Column:
    """Display label with accents for an internal level."""
    lv = col_(level)
    return (F.when(lv == LEVEL_HIGH, "élevé").when(lv == LEVEL_MID, "moyen")
            .when(lv == LEVEL_LOW, "faible").otherwise(lv))


def mask_email(email) -> Column:
    """``jean.dupont@x.com`` -> ``j*********t@x.com``; local parts of 1-2 chars keep the first char."""
    e = col_(email)
    local = F.substring_index(e, "@", 1)
    n = F.length(local)
    masked = (F.when(n <= 2, F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 1)))
              .otherwise(F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 2),
                                  F.substring(local, -1, 1))))
    dom = F.when(F.instr(e, "@") > 0, F.substring(e, F.instr(e, "@") + 1, F.length(e))).otherwise(F.lit(""))
    return F.concat(masked, F.lit("@"), dom)


# Fixed value: minimal e-mail shape.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def email_valid(email) -> Column:
    return F.coalesce(col_(email).rlike(EMAIL_PATTERN), F.lit(False))


def safe_slug(text) -> Column:
    """Folder-safe name: every char outside ``A-Za-z0-9._@-`` becomes ``_``."""
    return F.regexp_replace(col_(text), r"[^A-Za-z0-9._@-]", "_")


def score_percent(score) -> Column:
    """``42.5`` -> ``42%`` (half-even, as Python's ``{:.0f}``)."""
    return F.concat(F.rint(col_(score)).cast("long").cast("string"), F.lit("%"))


def fixed2(c) -> Column:
    """Two decimals, rounded on the exact binary value (as Python's ``{:.2f}`` and JS
    ``toFixed(2)``): ``format_number`` rounds like that, ``format_string('%.2f')`` rounds
    the shortest decimal form half-up (275814.235 -> .24 although the double is below)."""
    return F.regexp_replace(F.format_number(col_(c), 2), ",", "")


def display_value(c, data_type: str = "string") -> Column:
    """Short display text: floats with 2 decimals, trailing zeros and dot trimmed; NULL -> ''."""
    c = col_(c)
    if data_type in ("double", "float"):
        txt = F.regexp_replace(F.regexp_replace(fixed2(c), r"0+$", ""), r"\.$", "")
        return F.when(c.isNull(), F.lit("")).otherwise(txt)
    return F.coalesce(c.cast("string"), F.lit(""))


def is_filled(text: Column) -> Column:
    return ~F.lower(F.trim(text)).isin(*EMPTY_VALUES)


# Accented letters folded to ASCII (Latin-1 + common Latin Extended).
_ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"


def ascii_slug(text) -> Column:
    """Accents removed, non-letters dropped, lower-cased."""
    folded = F.translate(col_(text), _ACCENTED, _PLAIN)
    return F.lower(F.regexp_replace(folded, "[^A-Za-z]", ""))


# Accepted text date formats, tried in order.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy",
                "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "MMM d, yyyy", "d MMM yyyy")


def tolerant_timestamp(text) -> Column:
    c = col_(text)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(fmt)) for fmt in DATE_FORMATS])


def tolerant_double(text) -> Column:
    return col_(text).try_cast("double")


def capitalize_first(text) -> Column:
    c = col_(text)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def sha256(text) -> Column:
    return F.sha2(col_(text), 256)
