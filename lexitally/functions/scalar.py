"""Small scalar helpers used by the run analytics, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MB = 1048576.0  # bytes per MB (1024**2)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``, or 0.0 when the denominator is 0 (not NULL)."""
    n, d = _c(num), _c(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def epoch_micros(ts: str | Column) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Duration ``end - start`` in seconds (F8)."""
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1e6)


_SPLIT = 134217729.0      # 2^27 + 1: cuts a double into two halves of 26 bits


def signed2(x: str | Column) -> Column:
    """Python's ``f"{x: .2f}"``: two decimals, a space where a plus sign would go.

    Python rounds the exact binary value, ties to even (81.975 is 81.97499.. ->
    " 81.97"); Java's formatter, behind ``format_string``, rounds the shortest decimal
    form half-up (" 81.98").  So the rounding is done here, in built-in expressions:
    the whole part is taken off (exactly), the rest f is multiplied by 100 as an
    error-free product (f is cut in two halves whose products are exact, so ``p + err``
    is 100 f to the last bit), and p's fraction, with err where that is a half, decides.
    Exact for all values below 2^63; larger ones, whole numbers all, show the digits
    of their shortest form.  NULL and NaN give NULL.
    """
    def cents(f: Column) -> Column:
        c = f * F.lit(_SPLIT)
        high = c - (c - f)
        return _let(F.struct((f * 100.0).alias("p"),
                             (high * 100.0 - f * 100.0 + (f - high) * 100.0).alias("err")), nearest)

    def nearest(product: Column) -> Column:
        p, err = product["p"], product["err"]
        rest = p - F.floor(p).cast("double")
        # 100 times the whole part is even: the tie's parity is that of the cents alone
        up = (rest > 0.5) | ((rest == 0.5) & ((err > 0.0) | ((err == 0.0) & (F.floor(p) % 2 == 1))))
        return F.floor(p) + F.when(up, F.lit(1)).otherwise(F.lit(0))               # 0 .. 100

    def digits(size: Column) -> Column:
        return _let(F.struct(F.floor(size).alias("whole"), cents(size - F.floor(size).cast("double")).alias("cents")),
                    lambda n: F.concat((n["whole"] + F.when(n["cents"] == 100, F.lit(1)).otherwise(F.lit(0))).cast("string"),
                                       F.lit("."), F.lpad(F.pmod(n["cents"], F.lit(100)).cast("string"), 2, "0")))

    def text(v: Column) -> Column:
        size = F.abs(v)
        number = (F.when(size == float("inf"), F.lit("inf"))
                   .when(size >= 2.0 ** 63, F.format_string("%.2f", size)).otherwise(digits(size)))
        sign = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(" "))   # -0.0, too
        return F.when(v.isNotNull() & ~F.isnan(v), F.concat(sign, number))

    return _let(_c(x).cast("double"), text)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def json_number(doc: str | Column, path: str, default: float = 0.0) -> Column:
    """A number at a JSON path, or ``default`` on a missing/bad document."""
    return F.coalesce(F.get_json_object(_c(doc), path).try_cast("double"),
                      F.lit(default))


def first_field_int(line: str | Column) -> Column:
    """First whitespace-separated field of a line as INT, NULL if not a number."""
    return F.regexp_extract(_c(line), r"^\s*(\S+)", 1).try_cast("int")


def rounded(x: str | Column, places: int = 6) -> Column:
    """Round a double at ``places`` decimals by scaling: ``round(x * 10^p) / 10^p``.

    Spark's ``round`` rounds the shortest decimal form of a double half-up, so
    an average printed as 43.4728125 becomes 43.472813 even though its binary
    value is 43.47281249999...  Scaling in binary floating point rounds the
    value itself, the way C's ``round(x * 10^p) / 10^p`` does, so results agree
    with engines that round like that (the DuckDB oracle among them).  For
    magnitudes below 2^52 Spark's whole-number ``round`` of the scaled value
    equals C's half-away-from-zero ``round``.
    """
    m = float(10 ** places)
    return F.round(_c(x).cast("double") * F.lit(m), 0) / F.lit(m)
