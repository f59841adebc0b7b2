"""Scalar rules as Column expressions (D*, M*, Q*).

Every function here returns a ``Column`` built from Spark built-ins, so it
stays inside whole-stage codegen; none of them is a Python UDF.  ANSI mode
is on in Spark 4, so casts of user strings always go through ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# Fixed values of the reference's rules.
# ---------------------------------------------------------------------------
PHONE_PATTERN = r"^(\+?967|0)?7[0-9]{8}$"          # Yemeni mobile, whitespace removed first
PAYMENT_STATUSES = ("Unpaid", "Paid", "Refunded")
PAYMENT_METHODS = ("Electronic", "Cash", "Kareemi", "Transfer")
REFUND_METHODS = ("Bank Transfer", "Kareemi", "Cash", "Same as Original")
DEVICE_TYPES = ("android", "ios", "web")
CHILD_DISCOUNT = 50                                 # price_child = base_price - 50
PROOF_NOTE = "Submitted by customer"                # note of a payment proof without one
CANCEL_REASON = "Customer request"                  # reason of a cancellation without one
CONFIRM_NOTE = "Payment Status: "                   # audit note of a confirmation, before the status
UNKNOWN_CUSTOMER = "Customer"                       # name in a notice to an unknown user

# A documented subset of PHP's FILTER_VALIDATE_EMAIL: dot-atom local part
# (at most 64 chars), a dotted host name of labels without edge hyphens.
_ATEXT = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]"
_LABEL = r"[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAIL_PATTERN = rf"^{_ATEXT}+(\.{_ATEXT}+)*@({_LABEL}\.)+{_LABEL}\z"
NUMERIC_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


# ---------------------------------------------------------------------------
# D: derived values
# ---------------------------------------------------------------------------
def seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def trip_duration(dep: ColumnOrName, arr: ColumnOrName) -> Column:
    """``"H hours, M minutes"`` from the hour and minute parts of the
    interval: whole days are dropped (25 h -> ``1 hours, 0 minutes``), sign
    ignored, no padding."""
    s = F.abs(seconds_between(dep, arr))
    hours = F.floor(s / 3600) % 24
    minutes = F.floor(s / 60) % 60
    return F.concat(hours.cast("string"), F.lit(" hours, "), minutes.cast("string"), F.lit(" minutes"))


def duration_minutes(dep: ColumnOrName, arr: ColumnOrName) -> Column:
    """Full length of the interval in whole minutes (companion of D1)."""
    return F.floor(F.abs(seconds_between(dep, arr)) / 60)


def hours_before_departure(dep: ColumnOrName, now: ColumnOrName) -> Column:
    """(departure - now) in fractional hours; negative once departed."""
    return seconds_between(now, dep) / F.lit(3600.0)


def refund_amount(price: ColumnOrName, pct: ColumnOrName, fee: ColumnOrName) -> Column:
    """D3: ``max(0, round(price * pct / 100 - fee, 2))`` in decimals
    (HALF_UP on decimals is PHP's half away from zero)."""
    raw = _c(price).cast("decimal(12,2)") * _c(pct).cast("decimal(5,2)") / F.lit(100) - _c(fee).cast("decimal(12,2)")
    return F.greatest(F.lit(0).cast("decimal(12,2)"), F.round(raw, 2).cast("decimal(12,2)"))


def minor_units(price: ColumnOrName) -> Column:
    """PHP ``(int)($price * 100)`` - float multiply then truncation,
    so 19.99 gives 1998."""
    return (_c(price).cast("double") * F.lit(100.0)).cast("bigint")


def minor_units_exact(price: ColumnOrName) -> Column:
    """D4 exact variant: decimal multiply, no float drift (19.99 -> 1999)."""
    return (_c(price).cast("decimal(12,2)") * F.lit(100)).cast("bigint")


# ---------------------------------------------------------------------------
# M: patch rules
# ---------------------------------------------------------------------------
def coalesce_nullif(new: ColumnOrName, old: ColumnOrName) -> Column:
    """M1: ``COALESCE(NULLIF(new, ''), old)``: an empty patch keeps the old value."""
    return F.coalesce(F.nullif(_c(new), F.lit("")), _c(old))


def falsy_default(x: ColumnOrName, default) -> Column:
    """M4: PHP ``$x ?: $default`` for strings - null, ``''`` and ``'0'`` are falsy."""
    x = _c(x)
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(x.isNull() | x.isin("", "0"), d).otherwise(x)


def php_empty(x: ColumnOrName) -> Column:
    """PHP ``empty()`` on a request field: null, ``''`` or ``'0'``."""
    s = _c(x).cast("string")
    return s.isNull() | s.isin("", "0")


# ---------------------------------------------------------------------------
# Q: lenient casts and validation
# ---------------------------------------------------------------------------
_LEADING_NUMBER = r"^\s*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)"
_LONG_MAX, _LONG_MIN = (1 << 63) - 1, -(1 << 63)


def lenient_int(s: ColumnOrName) -> Column:
    """Q1: PHP ``(int)$s``: the leading number after optional blanks, cut to
    its integer part, else 0 (``'12abc'`` -> 12, ``'abc'`` -> 0, ``'7.9'`` -> 7,
    ``'1e3'`` -> 1000); beyond 64 bits the nearest bound.  A number without a
    point or an exponent is exact, others go through a double."""
    num = F.regexp_extract(_c(s).cast("string"), _LEADING_NUMBER, 1)
    whole = F.coalesce(num.try_cast("bigint"), F.when(num.startswith("-"), F.lit(_LONG_MIN)).otherwise(F.lit(_LONG_MAX)))
    wide = num.try_cast("double")
    cut = (F.when(wide >= F.lit(float(_LONG_MAX)), F.lit(_LONG_MAX)).when(wide <= F.lit(float(_LONG_MIN)), F.lit(_LONG_MIN))
           .otherwise(wide.try_cast("bigint")))
    return F.coalesce(F.when(num.rlike(r"^[+-]?[0-9]+$"), whole).otherwise(cut), F.lit(0).cast("bigint"))


def lenient_float(s: ColumnOrName, dtype: str = "decimal(12,2)") -> Column:
    """Q2: PHP ``(float)$s``: leading decimal number, else 0.  The number's
    text is cast straight to ``dtype`` (a decimal column rounds the text
    half-up, as the database does with the value PHP sends).  A number that
    ``dtype`` can't hold is null: the database refuses it, so it must be
    rejected and never read as 0."""
    num = F.regexp_extract(_c(s).cast("string"), _LEADING_NUMBER, 1)
    return F.when(F.coalesce(num, F.lit("")) == "", F.lit(0).cast(dtype)).otherwise(num.try_cast(dtype))


def valid_email(s: ColumnOrName) -> Column:
    """Q3: non-empty and syntactically valid (documented subset of PHP's
    filter: see ``EMAIL_PATTERN``); local part at most 64 chars."""
    s = _c(s)
    local = F.substring_index(s, "@", 1)
    return F.coalesce(
        ~php_empty(s) & s.rlike(EMAIL_PATTERN) & (F.length(local) <= 64) & (F.length(s) <= 320),
        F.lit(False))


def valid_phone(s: ColumnOrName) -> Column:
    """Q4: non-empty; whitespace removed; ``^(\\+?967|0)?7[0-9]{8}$``."""
    s = _c(s)
    return F.coalesce(~php_empty(s) & F.regexp_replace(s, r"\s+", "").rlike(PHONE_PATTERN), F.lit(False))


def normalize_phone(s: ColumnOrName) -> Column:
    """Q5: keep digits; a 9-digit number starting with 7 gets ``967``;
    anything else is returned as its digits (``07...`` stays as is)."""
    d = F.regexp_replace(_c(s), r"[^0-9]", "")
    return F.when((F.length(d) == 9) & d.startswith("7"), F.concat(F.lit("967"), d)).otherwise(d)


def required(x: ColumnOrName) -> Column:
    """Q7: fails for null, ``''`` and an empty array; ``'0'`` and 0 pass."""
    x = _c(x)
    return F.coalesce(~(x.isNull() | (x.cast("string") == "")), F.lit(False))


def positive_int(x: ColumnOrName) -> Column:
    """Q8: numeric (PHP ``is_numeric``) and integer part > 0:
    ``'1.5'`` passes, ``'0.5'`` fails, ``'1d'`` fails."""
    s = _c(x).cast("string")
    return F.coalesce(s.rlike(NUMERIC_PATTERN) & (F.trim(s).try_cast("double") >= 1), F.lit(False))
