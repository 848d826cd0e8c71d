"""Scalar expressions (E1–E21): Column → Column builders, all JVM-side.

No Python UDF is used: HGVS parsing is ``split`` + ``regexp_extract`` + a
literal map, the normal CDF is a rational approximation written as a
column expression (neither Spark nor DuckDB ship ``erf``).
"""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# IUPAC three-letter → one-letter amino-acid codes (the 20 standard residues).
THREE_TO_ONE = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C",
    "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P",
    "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}
# Residue order used by the position landscape (25 one-letter codes).
LANDSCAPE_ORDER = "LAGVSERTIDPKQNFYMHWCXBUZO"
# Secondary-structure collapse: helix codes, strand codes; everything else is coil.
HELIX_CODES = ("H", "G", "I")
STRAND_CODES = ("E", "B")
# Normal CDF rational approximation (Hart 1968 / West 2005), coefficients high → low.
CDF_NUM = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
CDF_SPLIT = 7.07106781186547
CDF_TAIL_CUTOFF = 37.0
SQRT_2PI = 2.506628274631
# Variant notation: reference residue, position, alternative residue.
VARIANT_PATTERN = r"^([A-Za-z]+)(\d+)([A-Za-z]+)$"
# -----------------------------------------------------------------------------

_VARIANT_RE = VARIANT_PATTERN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def three_to_one_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(THREE_TO_ONE.items())])


def hgvs_to_variant_id(col) -> Column:
    """``GENE:p.Leu9Gln`` → ``L9Q``.  The part after the first '.' must be
    letters-digits-letters; stop (``Ter``), unknown residues and unparsable
    strings give NULL.  The position is written without leading zeros."""
    part = F.get(F.split(_c(col), r"\.", -1), 1)
    ok = part.rlike(_VARIANT_RE)
    ref3 = F.regexp_extract(part, _VARIANT_RE, 1)
    pos = F.regexp_extract(part, _VARIANT_RE, 2)
    alt3 = F.regexp_extract(part, _VARIANT_RE, 3)
    m = three_to_one_map()
    ref1, alt1 = F.try_element_at(m, ref3), F.try_element_at(m, alt3)
    out = F.concat(ref1, pos.try_cast("int").cast("string"), alt1)
    return F.when(ok & (alt3 != "Ter"), out)


def variant_position(col) -> Column:
    """Integer position of ``L9Q``-style ids (NULL when unparsable or too large)."""
    return F.when(_c(col).rlike(_VARIANT_RE),
                  F.regexp_extract(_c(col), _VARIANT_RE, 2).try_cast("int"))


def variant_alt(col) -> Column:
    return F.when(_c(col).rlike(_VARIANT_RE), F.regexp_extract(_c(col), _VARIANT_RE, 3))


def variant_ref(col) -> Column:
    return F.when(_c(col).rlike(_VARIANT_RE), F.regexp_extract(_c(col), _VARIANT_RE, 1))


def landscape_position(col) -> Column:
    """Zero-based position (the characters between the first and last)."""
    s = _c(col)
    return F.substring(s, F.lit(2), F.length(s) - 2).try_cast("int") - 1


def landscape_aa_index(col) -> Column:
    """Index of the last residue in ``LANDSCAPE_ORDER`` (NULL if absent)."""
    last = F.substring(_c(col), -1, 1)
    i = F.instr(F.lit(LANDSCAPE_ORDER), last) - 1
    return F.when((F.length(last) == 1) & (i >= 0), i)


def landscape_key(col) -> Column:
    """round((position·25 + index) / 25, 2), half-even like numpy."""
    n = len(LANDSCAPE_ORDER)
    return F.bround((landscape_position(col) * n + landscape_aa_index(col)) / F.lit(float(n)), 2)


def make_variant_id(ref, pos, alt) -> Column:
    """E4."""
    return F.concat(_c(ref), _c(pos).cast("string"), _c(alt))


def residue_at(seq, pos, offset: int = 0) -> Column:
    """E5: residue of ``seq`` at 1-based ``pos`` shifted by ``offset``."""
    return F.substring(_c(seq), (_c(pos) - offset).cast("int"), 1)


def apply_substitution(seq, pos, aa) -> Column:
    """Replace the residue at 1-based ``pos``."""
    return F.overlay(_c(seq), _c(aa), _c(pos).cast("int"), F.lit(1))


def first_difference(wt, mut) -> Column:
    """First 1-based position where the sequences differ over their common
    length; NULL when they agree.  One pass over both: beyond the shorter one
    the comparison is NULL, which is no difference."""
    n = F.least(F.length(_c(wt)), F.length(_c(mut)))
    unequal = F.zip_with(F.split(_c(wt), ""), F.split(_c(mut), ""), lambda a, b: a != b)
    return F.when(n >= 1, F.nullif(F.array_position(unequal, True), F.lit(0)).cast("int"))


def cantor_pair(a, b) -> Column:
    """(a+b)(a+b+1)/2 + b, in long arithmetic (the even factor is halved)."""
    s = _c(a).cast("long") + _c(b).cast("long")
    even = F.pmod(s, F.lit(2)) == 0
    half = F.shiftright(F.when(even, s).otherwise(s + 1), 1)
    return half * F.when(even, s + 1).otherwise(s) + _c(b).cast("long")


def collapse_ss(col) -> Column:
    """E16."""
    c = _c(col)
    return F.when(c.isin(*HELIX_CODES), "H").when(c.isin(*STRAND_CODES), "E").otherwise("C")


def json_param(col, path: str) -> Column:
    """Parameter from JSON text; empty text → NULL."""
    return F.get_json_object(F.nullif(_c(col), F.lit("")), path)


def _horner(x: Column, coeffs) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_cdf(col) -> Column:
    """Standard normal CDF Φ(x), |error| ≲ 1e-15 over the real line."""
    x = _c(col).cast("double")
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    small = e * _horner(a, CDF_NUM) / _horner(a, CDF_DEN)
    frac = a + F.lit(0.65)
    for k in (4, 3, 2, 1):
        frac = a + F.lit(float(k)) / frac
    large = e / frac / F.lit(SQRT_2PI)
    tail = F.when(a > CDF_TAIL_CUTOFF, F.lit(0.0)).when(a < CDF_SPLIT, small).otherwise(large)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_pdf(col) -> Column:
    """Standard normal density φ(x)."""
    x = _c(col).cast("double")
    return F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))


def pooled_z(x, baseline, u, sigma) -> Column:
    """(x − baseline) / √(u² + σ²)."""
    return F.try_divide(_c(x) - _c(baseline), F.sqrt(_c(u) * _c(u) + _c(sigma) * _c(sigma)))


def log2_fold_change(x, baseline) -> Column:
    """log2(x / baseline); non-positive ratios → NULL."""
    r = F.try_divide(_c(x), _c(baseline))
    return F.when(r > 0, F.log2(r))


def squared_error(a, b) -> Column:
    """E21."""
    d = _c(a) - _c(b)
    return d * d
