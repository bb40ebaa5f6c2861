"""Scalar functions on text: field parsing, names, symbols, formulas, lists. All built-in expressions."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The chemical elements that a formula token may name.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
).split()


def _plain_letters() -> tuple[dict[str, str], dict[str, str]]:
    """Letters and digits beyond ASCII whose compatibility decomposition without marks, in lower case, is plain: those that become one character, and those that become several."""
    one, many = {}, {}
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if x in string.ascii_lowercase + string.digits)
        if plain:
            (one if len(plain) == 1 else many)[c] = plain
    return one, many


_ONE, _MANY = _plain_letters()

#: Last space-group number of each crystal system, in order.
SYSTEM_BOUNDS = ((2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic"))


def number_field(text: Column, name: str, anchored: bool = True) -> Column:
    """The number after ``name:``; an uncertainty in parentheses is left out. Unanchored, the end of a longer name matches too."""
    edge = r"\b" if anchored else ""
    return F.regexp_extract(text, rf"(?i){edge}{name}\s*:\s*([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")


def word_field(text: Column, name: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(text, rf"(?i)\b{name}\s*:\s*([a-z]+)", 1)), F.lit(""))


def tuple_of(text: Column, n: int) -> Column:
    """Doubles of ``"(a, b, ...)"``; null unless there are n and all parse."""
    items = F.transform(F.split(F.regexp_replace(text, r"[()\s]", ""), ","), lambda x: x.try_cast("double"))
    return F.when((F.size(items) == n) & F.forall(items, lambda x: x.isNotNull()), items)


def formula_elements(formula: Column) -> Column:
    """Element symbols of a formula in order of first appearance."""
    known = F.array(*(F.lit(e) for e in ELEMENTS))
    return F.array_distinct(F.filter(F.regexp_extract_all(formula, F.lit("[A-Z][a-z]?"), F.lit(0)), lambda e: F.array_contains(known, e)))


def clean_list(items: Column) -> Column:
    """Without nulls and 'nan' texts; null if nothing is left."""
    kept = F.filter(items, lambda x: x.isNotNull() & (F.lower(x) != "nan"))
    return F.when(F.size(kept) > 0, kept)


def float_list(items: Column) -> Column:
    """All items as doubles, or null if any doesn't parse."""
    numbers = F.transform(items, lambda x: x.try_cast("double"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull()), numbers)


def plain_name(name: Column) -> Column:
    """Compatibility decomposition (NFKD) in lower case, of which only letters a-z and digits are kept: accents, widths, styles and ligatures are made plain."""
    spelled = F.create_map(*(F.lit(x) for pair in _MANY.items() for x in pair))
    by_char = F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(F.element_at(spelled, c), c)), "")
    whole = F.when(name.rlike(f"[{''.join(_MANY)}]"), by_char).otherwise(name)
    return F.regexp_replace(F.lower(F.translate(whole, "".join(_ONE), "".join(_ONE.values()))), "[^a-z0-9]", "")


def exact_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def symbols(text: Column) -> Column:
    """Symbols of a list separated by ``|``, ``;`` or ``,``; one in parentheses is an alternative of its own."""
    parts = F.split(text, r"[|;,]")
    each = F.flatten(F.transform(parts, lambda p: F.array(F.trim(F.regexp_replace(p, r"\([^)]*\)", "")), F.regexp_extract(p, r"\(([^)]*)\)", 1))))
    return F.array_distinct(F.filter(F.transform(each, lambda s: F.trim(s)), lambda s: s != ""))


def canonical_symbol(symbol: Column) -> Column:
    """Subscript digits and dashes made plain; marks, underscores and blanks removed."""
    return F.regexp_replace(F.translate(symbol, "₀₁₂₃₄₅₆₇₈₉−–—‐", "0123456789----"), r"[.?_\s]", "")


def crystal_system(number: Column) -> Column:
    """System of a space-group number from 1 to 230."""
    out = F.when(number < 1, F.lit(None))
    for last, name in SYSTEM_BOUNDS:
        out = out.when(number <= last, name)
    return out


def compatible_system(stated: Column, derived: Column) -> Column:
    """Whether a stated system allows a derived one; hexagonal includes trigonal."""
    return (stated == derived) | ((stated == "hexagonal") & (derived == "trigonal"))


def lattice_system(a: Column, b: Column, c: Column, al: Column, be: Column, ga: Column, tol: float = 1e-2) -> Column:
    """System from cell parameters by ordered rules. Rhombohedral cells fall to triclinic, as there is no trigonal rule."""
    same = lambda x, y: F.abs(x - y) < tol
    right = lambda x: F.abs(x - 90) < tol
    square = right(al) & right(be) & right(ga)
    missing = a.isNull() | b.isNull() | c.isNull() | al.isNull() | be.isNull() | ga.isNull()
    return (
        F.when(missing, F.lit(None)).when(square & same(a, b) & same(b, c), "cubic").when(square & same(a, b), "tetragonal").when(square, "orthorhombic")
        .when(same(a, b) & right(al) & right(be) & (F.abs(ga - 120) < tol), "hexagonal").when(right(al) & right(ga) & ~right(be), "monoclinic").otherwise("triclinic")
    )


def reduced_formula(counts: Column) -> Column:
    """Formula of array<struct<el,n>>: symbols in order, counts over their greatest common divisor."""
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"))), lambda s: s["a"])
    divisor = F.aggregate(F.transform(counts, lambda x: x["n"].cast("long")), F.lit(0).cast("long"), lambda a, n: gcd(a, n))
    return F.array_join(F.transform(F.array_sort(counts), lambda x: F.concat(x["el"], F.when(x["n"] / divisor == 1, "").otherwise((x["n"] / divisor).cast("long").cast("string")))), "")


#: Fixed value: what a second draw's seed is combined with.
SECOND_SEED = 0x9E3779B9


def row_seed(source: str, key: str, second: bool = False) -> Column:
    """A number that the names of a row's source and its key decide: their checksum, or for a second draw that with other bits."""
    seed = F.crc32(F.concat_ws(":", F.col(source).cast("string"), F.col(key).cast("string")))
    return seed.bitwiseXOR(F.lit(SECOND_SEED).cast("long")) if second else seed
