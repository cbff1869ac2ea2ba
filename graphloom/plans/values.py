"""How a variable's values are held: natively where their kind is known, else as term structs.

Kinds: iri, key (an IRI of a fixed beginning and a key column), int, dec, dbl, str, bool, dt, date, and
term, a struct (k: 1 IRI, 2 blank node, 3 literal; v: IRI, label or lexical form; d: datatype; l: language).
Null stands for unbound and for an error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.plans.algebra import XSD, Iri, Lit

TERM = "struct<k:int,v:string,d:string,l:string>"
STRING = XSD + "string"
DATATYPE = {"int": XSD + "integer", "dec": XSD + "decimal", "dbl": XSD + "double", "str": STRING, "bool": XSD + "boolean", "dt": XSD + "dateTime", "date": XSD + "date"}
INTEGERS = [XSD + t for t in "integer int long short byte nonNegativeInteger nonPositiveInteger positiveInteger negativeInteger unsignedInt unsignedLong unsignedShort unsignedByte".split()]
DECIMALS, DOUBLES = [XSD + "decimal"], [XSD + "double", XSD + "float"]
NUMERIC = {"int", "dec", "dbl"}
DEC = "decimal(38,12)"


@dataclass(frozen=True)
class Value:
    """kind, column, the fixed beginning of a key's IRI, whether it may be null, and whether a key is an integer."""

    kind: str
    col: Column
    prefix: str = ""
    maybe: bool = True
    integer: bool = False

    def to(self, col: Column) -> Value:
        return replace(self, col=col)


def divide(x: Column, y: Column) -> Column:
    """Quotient of two decimals to the 12 digits that DEC has; null by zero or beyond its range.

    Spark gives a quotient the digits that its operands' types leave, so the types are as narrow as the
    values allow.
    """
    narrow = F.try_divide(x.try_cast("decimal(26,12)"), y.try_cast("decimal(24,12)")).try_cast(DEC)
    whole = y.try_cast("decimal(19,0)")
    by_whole = F.try_divide(x.try_cast(DEC), whole).try_cast(DEC)
    return F.when(y == whole, by_whole).otherwise(F.coalesce(narrow, F.try_divide(x.try_cast(DEC), y.try_cast(DEC)).try_cast(DEC)))


def multiply(x: Column, y: Column) -> Column:
    """Product of two decimals to the 12 digits that DEC has, for the same reason by types as narrow as the values allow; null beyond its range."""
    ways = [("decimal(18,12)", "decimal(18,12)"), ("decimal(28,12)", "decimal(9,0)"), ("decimal(9,0)", "decimal(28,12)"), (DEC, DEC)]

    def cast(c: Column, t: str) -> Column:
        narrow = c.try_cast(t)
        return F.when(narrow == c, narrow) if t.endswith(",0)") else narrow

    return F.coalesce(*[F.try_multiply(cast(x, a), cast(y, b)).try_cast(DEC) for a, b in ways])


def null(kind: str = "void") -> Value:
    """An unbound value; of no kind of its own it takes that of what it meets."""
    types = {"int": "bigint", "dec": DEC, "dbl": "double", "bool": "boolean", "dt": "timestamp_ntz", "date": "date", "term": TERM}
    return Value(kind, F.lit(None).cast(types.get(kind, "string")))


def struct(k: int, v: Column, d: Column | str | None = None, l: Column | str | None = None) -> Column:
    def opt(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    return F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"), opt(d).alias("d"), opt(l).alias("l"))).cast(TERM)


def double_text(c: Column) -> Column:
    """XSD's canonical form of a double, such as 1.0E2."""
    exp = F.floor(F.log10(F.abs(c))).cast("int")
    mantissa = F.regexp_replace(F.format_string("%.15f", c / F.pow(F.lit(10.0), exp)), r"0+$", "")
    return (
        F.when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == float("-inf"), "-INF").when(c == 0, "0.0E0")
        .otherwise(F.concat(F.when(mantissa.endswith("."), F.concat(mantissa, F.lit("0"))).otherwise(mantissa), F.lit("E"), exp.cast("string")))
    )


def dt_text(c: Column) -> Column:
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")


def dec_text(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def text(v: Value) -> Column:
    """STR(): the IRI or the lexical form."""
    match v.kind:
        case "key":
            return F.concat(F.lit(v.prefix), v.col.cast("string"))
        case "dbl":
            return double_text(v.col)
        case "dt":
            return dt_text(v.col)
        case "dec":
            return dec_text(v.col)
        case "term":
            return F.when(v.col["k"] != 2, v.col["v"])
        case _:
            return v.col.cast("string")


def term(v: Value) -> Value:
    if v.kind == "term":
        return v
    if v.kind == "void":
        return null("term")
    if v.kind in ("iri", "key"):
        return Value("term", struct(1, text(v)), maybe=v.maybe)
    return Value("term", struct(3, text(v), DATATYPE[v.kind]), maybe=v.maybe)


def unify(a: Value, b: Value) -> tuple[Value, Value]:
    """Both in one form, in which equal terms are equal columns."""
    if "void" in (a.kind, b.kind) and a.kind != b.kind:
        return (Value(b.kind, null(b.kind).col, b.prefix), b) if a.kind == "void" else (a, Value(a.kind, null(a.kind).col, a.prefix))
    if a.kind == b.kind and a.kind != "key":
        return a, b
    if {a.kind, b.kind} <= {"iri", "key"}:
        if a.kind == b.kind == "key" and a.prefix == b.prefix:
            return a, b
        return Value("iri", text(a), maybe=a.maybe), Value("iri", text(b), maybe=b.maybe)
    return term(a), term(b)


def constant(t: Iri | Lit) -> Value:
    if isinstance(t, Iri):
        return Value("iri", F.lit(t.value), maybe=False)
    v, d = t.value, t.datatype
    try:
        if d == XSD + "integer":
            return Value("int", F.lit(int(v)).cast("bigint"), maybe=False)
        if d == XSD + "decimal":
            return Value("dec", F.lit(v).cast(DEC), maybe=False)
        if d == XSD + "double":
            return Value("dbl", F.lit(float(v.replace("INF", "inf"))), maybe=False)
    except ValueError:
        return term_constant(t)
    if d == XSD + "boolean" and v in ("true", "false", "0", "1"):
        return Value("bool", F.lit(v in ("true", "1")), maybe=False)
    if d == STRING:
        return Value("str", F.lit(v), maybe=False)
    if d == XSD + "dateTime" and not v.endswith("Z") and len(v) >= 19 and "+" not in v and v.count("-") == 2:
        return Value("dt", F.lit(v.replace("T", " ")).cast("timestamp_ntz"), maybe=False)
    if d == XSD + "date" and len(v) == 10:
        return Value("date", F.lit(v).cast("date"), maybe=False)
    return term_constant(t)


def term_constant(t: Iri | Lit) -> Value:
    """A constant exactly as it is written, for matching terms."""
    if isinstance(t, Iri):
        return Value("term", struct(1, F.lit(t.value)), maybe=False)
    return Value("term", struct(3, F.lit(t.value), t.datatype, t.lang), maybe=False)


def is_term(c: Column, t: Iri | Lit) -> Column:
    """Whether a term struct is a constant, by fields, which scans can be filtered by."""
    if isinstance(t, Iri):
        return (c["k"] == 1) & (c["v"] == t.value)
    return (c["k"] == 3) & (c["v"] == t.value) & (c["d"] == t.datatype) & (c["l"].isNull() if t.lang is None else c["l"] == t.lang)


# what a term struct is


def is_numeric(c: Column) -> Column:
    return c["d"].isin(*INTEGERS, *DECIMALS, *DOUBLES)


def number(v: Value) -> Column:
    """A value as a double, null if it is no number."""
    if v.kind in NUMERIC:
        return v.col.cast("double")
    if v.kind == "term":
        lex = F.regexp_replace(F.regexp_replace(v.col["v"], "^([+-]?)INF$", "$1Infinity"), "^[+]", "")
        return F.when(is_numeric(v.col), lex.try_cast("double"))
    return F.lit(None).cast("double")


def boolean(v: Value) -> Column:
    if v.kind == "bool":
        return v.col
    if v.kind == "term":
        return F.when(v.col["d"] == XSD + "boolean", F.when(v.col["v"].isin("true", "1"), True).when(v.col["v"].isin("false", "0"), False))
    return F.lit(None).cast("boolean")


def instant(v: Value) -> Column:
    """A dateTime or date for comparison; one without a zone counts as UTC."""
    if v.kind == "dt":
        return v.col.cast("timestamp")
    if v.kind == "date":
        return v.col.cast("timestamp")
    if v.kind == "term":
        return F.when(v.col["d"].isin(XSD + "dateTime", XSD + "date", XSD + "dateTimeStamp"), v.col["v"].try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def plain(v: Value) -> Column:
    """The text of a simple literal, null for anything else."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when((v.col["k"] == 3) & (v.col["d"] == STRING), v.col["v"])
    return F.lit(None).cast("string")


def string_arg(v: Value) -> Column:
    """The text of a string literal, with or without a language; null for anything else."""
    if v.kind == "str":
        return v.col
    if v.kind == "term":
        return F.when((v.col["k"] == 3) & ((v.col["d"] == STRING) | v.col["l"].isNotNull()), v.col["v"])
    return F.lit(None).cast("string")


def language(v: Value) -> Column:
    return F.coalesce(v.col["l"], F.lit("")) if v.kind == "term" else F.lit("")


def ebv(v: Value) -> Column:
    """Effective boolean value; null for an error."""
    match v.kind:
        case "bool":
            return v.col
        case "str":
            return F.length(v.col) > 0
        case "int" | "dec":
            return v.col != 0
        case "dbl":
            return (v.col != 0) & ~F.isnan(v.col)
        case "term":
            n = number(v)
            return F.coalesce(boolean(v), F.when(is_numeric(v.col), F.coalesce((n != 0) & ~F.isnan(n), F.lit(False))), F.length(string_arg(v)) > 0)
        case _:
            return F.lit(None).cast("boolean")
