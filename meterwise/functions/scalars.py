"""Column expressions shared by the jobs (all JVM-side, codegen-friendly).

Each helper is a plain ``Column -> Column`` function built from Spark SQL
functions, so it stays inside whole-stage codegen; none of them is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise.config import CHARS_PER_UNIT, MICROS_PER_CENT


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(text) -> Column:
    """Length in UTF-16 code units (what JavaScript's ``.length`` counts)."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("int")


def utf16_prefix(text, units: int) -> Column:
    """The first ``units`` UTF-16 code units of a text (JavaScript's ``slice``); a pair that
    the cut would halve is left out whole."""
    t = col(text)
    wide = F.encode(t, "UTF-16BE")
    halved = F.hex(F.substring(wide, 2 * units - 1, 1)).between("D8", "DB")
    kept = F.when(halved, F.substring(wide, 1, 2 * units - 2)).otherwise(F.substring(wide, 1, 2 * units))
    return F.when(F.length(t) * 2 <= units, t).otherwise(F.decode(kept, "UTF-16BE"))


def js_round(x) -> Column:
    """``Math.round``: half up toward +infinity, on doubles."""
    return F.floor(col(x) + F.lit(0.5))


def js_trim(text) -> Column:
    """``String.prototype.trim``: strips all Unicode white space, not only spaces."""
    return F.regexp_replace(col(text), r"^[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$", "")


def json_text(doc, key: str) -> Column:
    """``doc ->> 'key'`` on a JSON text column: NULL when missing."""
    return F.get_json_object(col(doc), f"$.{key}")


def face_value_micros(metadata) -> Column:
    """Credits of a free order: ``metadata.credits_cents`` (default 0) in micros.

    The cast is ANSI: text that is not an integer raises, as in the reference.
    """
    return F.coalesce(json_text(metadata, "credits_cents"), F.lit("0")).cast("bigint") * F.lit(MICROS_PER_CENT)


def item_units(text) -> Column:
    """Billing units of one item: max(1, ceil(utf16 length / 2000))."""
    return F.greatest(F.lit(1), F.ceil(utf16_length(text) / F.lit(CHARS_PER_UNIT))).cast("int")


def _grouped(q) -> Column:
    """Integer text with thousands separators (en-US)."""
    return F.format_number(q, 0)


def money_text(micros) -> Column:
    """Dollars from micros, en-US currency text with 2 / 4 / 6 decimals by size
    (>= $1, >= $0.01, else), rounded half up on the exact integer micros."""
    m = col(micros).cast("long")
    a = F.abs(m)
    two = F.floor((a + 5000) / 10000).cast("long")
    four = F.floor((a + 50) / 100).cast("long")
    body = (
        F.when(a >= 1_000_000, F.concat(_grouped(F.floor(two / 100).cast("long")), F.lit("."), F.lpad(F.pmod(two, F.lit(100)).cast("string"), 2, "0")))
        .when(a >= 10_000, F.concat(_grouped(F.floor(four / 10000).cast("long")), F.lit("."), F.lpad(F.pmod(four, F.lit(10000)).cast("string"), 4, "0")))
        .otherwise(F.concat(_grouped(F.floor(a / 1_000_000).cast("long")), F.lit("."), F.lpad(F.pmod(a, F.lit(1_000_000)).cast("string"), 6, "0")))
    )
    return F.concat(F.when(m < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), body)


def cents_text(cents) -> Column:
    """Whole dollars from cents, en-US currency text, rounded half up."""
    c = col(cents).cast("long")
    whole = F.floor((F.abs(c) + 50) / 100).cast("long")
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), _grouped(whole))
