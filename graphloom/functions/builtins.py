"""Expressions and functions of the query language as Spark columns; an error is null.

Every function stays inside the JVM. Where Spark's function differs from the language's, it is guarded:
see the notes beside each.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.algebra import RDF, XSD, Call, Exists, Iri, Lit, Var
from graphloom.plans.values import (
    DATATYPE, DEC, DOUBLES, INTEGERS, NUMERIC, STRING, TERM, Value, boolean, constant, divide, ebv, instant, is_numeric, language, multiply, null, number,
    plain, string_arg, struct, term, text, unify,
)



class Compiler:
    """Compiles expressions over the variables of a relation.

    exists: what turns an EXISTS into a column, given by the lowering; row: a column that tells rows apart.
    """

    def __init__(self, vars: dict[str, Value], exists: Callable[[Exists], Column] | None = None, base: str = "", now: datetime | None = None, row: Column | None = None, registry: dict[str, Callable] | None = None):
        self.vars, self.exists, self.base, self.row = vars, exists, base, row
        self.now = now or datetime.now(timezone.utc)
        self.registry = registry or {}

    def condition(self, e) -> Column:
        return ebv(self(e))

    def __call__(self, e) -> Value:
        match e:
            case Var(name):
                return self.vars.get(name, null())
            case Iri() | Lit():
                return constant(e)
            case Exists():
                if self.exists is None:
                    raise ValueError("EXISTS has no place here")
                return Value("bool", self.exists(e), maybe=False)
            case Call(name, args):
                return self.call(name, args)
        raise TypeError(f"no expression: {e!r}")

    def call(self, name: str, args: tuple) -> Value:
        if name == "BOUND":
            v = self.vars.get(args[0].name)
            return Value("bool", F.lit(False) if v is None else v.col.isNotNull(), maybe=False)
        if name in ("||", "&&"):
            a, b = (self.condition(x) for x in args)
            return Value("bool", a | b if name == "||" else a & b)
        if name == "!":
            return Value("bool", ~self.condition(args[0]))
        if name == "IF":
            return self.choose(args)
        if name == "COALESCE":
            return self.coalesce([self(a) for a in args])
        if name in ("IN", "NOT IN"):
            found = F.lit(False)
            for x in args[1:]:
                found = found | self.equal(self(args[0]), self(x))
            return Value("bool", found if name == "IN" else ~found)
        if name in ("REGEX", "REPLACE"):
            return self.match(name, args)
        if name == "=" and (years := self.years(*args)) is not None:
            return Value("bool", years)
        vs = [self(a) for a in args]
        if name in ("=", "!="):
            c = self.equal(*vs)
            return Value("bool", c if name == "=" else ~c)
        if name in ("<", "<=", ">", ">="):
            return Value("bool", self.order(name, *vs))
        if name in ("+", "-", "*", "/"):
            return self.arithmetic(name, *vs)
        if name in ("u+", "u-"):
            return self.arithmetic("-", Value("int", F.lit(0).cast("bigint")), vs[0]) if name == "u-" else vs[0]
        if "/" in name or ":" in name:
            return self.cast(name, vs)
        return getattr(self, "f_" + name.lower())(*vs)

    def match(self, name: str, args: tuple) -> Value:
        """REGEX and REPLACE; a pattern that can't be compiled is an error of the expression, not of the query."""
        flags = args[2 if name == "REGEX" else 3] if len(args) > (2 if name == "REGEX" else 3) else None
        fixed = all(isinstance(x, Lit) for x in (args[1], flags) if x is not None)
        if fixed and not _compiles(args[1].value, flags.value if flags is not None else ""):
            return null("bool" if name == "REGEX" else "str")
        vs = [self(a) for a in args]
        if not fixed:
            vs[1] = Value("str", _checked_rows(plain(vs[1])))
        return getattr(self, "f_" + name.lower())(*vs)

    def years(self, a, b) -> Column | None:
        """YEAR(?t) = 1994 as a range of times, which scans can be filtered by."""
        if isinstance(b, Call):
            a, b = b, a
        if not (isinstance(a, Call) and a.name == "YEAR" and isinstance(b, Lit) and b.datatype == XSD + "integer" and b.value.isdigit() and 0 < int(b.value) < 9999):
            return None
        v = self(a.args[0])
        if v.kind not in ("dt", "date"):
            return None
        first, after = (F.lit(f"{y:04d}-01-01").cast("timestamp_ntz" if v.kind == "dt" else "date") for y in (int(b.value), int(b.value) + 1))
        return (v.col >= first) & (v.col < after)

    # choices

    def alike(self, vs: list[Value]) -> list[Value]:
        head = vs[0]
        for v in vs[1:]:
            head, _ = unify(head, v)
        return [unify(head, v)[1] for v in vs]

    def choose(self, args: tuple) -> Value:
        c = self.condition(args[0])
        a, b = self.alike([self(args[1]), self(args[2])])
        return a.to(F.when(c.isNull(), None).when(c, a.col).otherwise(b.col))

    def coalesce(self, vs: list[Value]) -> Value:
        vs = self.alike(vs) if vs else [null()]
        return Value(vs[0].kind, F.coalesce(*[v.col for v in vs]), vs[0].prefix, all(v.maybe for v in vs))

    # comparison

    def equal(self, a: Value, b: Value) -> Column:
        if a.kind in NUMERIC and b.kind in NUMERIC:
            x, y = _numbers(a, b)
            return (x == y) & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double")) if "dbl" in (a.kind, b.kind) else x == y
        kinds = {a.kind, b.kind}
        if kinds <= {"dt", "date"}:
            return a.col == b.col
        if "term" not in kinds:
            if kinds <= {"iri", "key"} or len(kinds) == 1:
                for x, y in ((a, b), (b, a)):
                    if x.kind == "key" and y.kind == "iri":
                        return text(x) == y.col
                x, y = unify(a, b)
                return x.col == y.col
            # an IRI never equals a literal; literals of two known types can't be compared
            return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False)) if kinds & {"iri", "key"} else F.lit(None).cast("boolean")
        x, y = term(a).col, term(b).col
        same = (x["k"] == y["k"]) & (x["v"] == y["v"]) & x["d"].eqNullSafe(y["d"]) & F.lower(F.coalesce(x["l"], F.lit(""))).eqNullSafe(F.lower(F.coalesce(y["l"], F.lit(""))))
        n, m = number(a), number(b)
        return (
            F.when(x.isNull() | y.isNull(), None)
            .when((x["k"] != 3) | (y["k"] != 3), same)
            .when(n.isNotNull() & m.isNotNull(), (n == m) & ~F.isnan(n))
            .when(boolean(a).isNotNull() & boolean(b).isNotNull(), boolean(a) == boolean(b))
            .when(instant(a).isNotNull() & instant(b).isNotNull(), instant(a) == instant(b))
            .when(same, True)
            .when(string_arg(a).isNotNull() & string_arg(b).isNotNull(), False)
        )

    def order(self, op: str, a: Value, b: Value) -> Column:
        def rel(x: Column, y: Column) -> Column:
            return x < y if op == "<" else x <= y if op == "<=" else x > y if op == ">" else x >= y

        if a.kind in NUMERIC and b.kind in NUMERIC:
            x, y = _numbers(a, b)
            got = rel(x, y)
            return got & ~F.isnan(x.cast("double")) & ~F.isnan(y.cast("double")) if "dbl" in (a.kind, b.kind) else got
        if a.kind == b.kind and a.kind in ("str", "bool", "dt", "date"):
            return rel(a.col, b.col)
        if "term" not in (a.kind, b.kind):
            return rel(instant(a), instant(b)) if {a.kind, b.kind} <= {"dt", "date"} else F.lit(None).cast("boolean")
        n, m = number(a), number(b)
        return F.coalesce(F.when(~F.isnan(n) & ~F.isnan(m), rel(n, m)), rel(plain(a), plain(b)), rel(boolean(a), boolean(b)), rel(instant(a), instant(b)))

    # numbers

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        if a.kind == "term" or b.kind == "term":
            # the type of the result is that of the operands, known only by row
            x, y = number(a), number(b)
            c = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else F.try_divide(x, y)
            xa, yb = term(a).col, term(b).col
            ints = xa["d"].isin(*INTEGERS) & yb["d"].isin(*INTEGERS) & F.lit(op != "/")
            dbls = xa["d"].isin(*DOUBLES) | yb["d"].isin(*DOUBLES)
            shown = F.when(ints, c.try_cast("bigint").cast("string")).when(dbls, c.cast("string")).otherwise(text(Value("dec", c.try_cast(DEC))))
            kind = F.when(ints, XSD + "integer").when(dbls, XSD + "double").otherwise(XSD + "decimal")
            return Value("term", F.when(c.isNotNull(), struct(3, shown, kind)).cast(TERM))
        if not (a.kind in NUMERIC and b.kind in NUMERIC):
            return null("int")
        kind = "dbl" if "dbl" in (a.kind, b.kind) else "dec" if "dec" in (a.kind, b.kind) or op == "/" else "int"
        x, y = _numbers(a, b)
        if kind == "dbl":
            if op == "/":
                by_zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
                return Value("dbl", F.when(y == 0, F.when(x.isNotNull(), by_zero)).otherwise(F.try_divide(x, y)))
            return Value("dbl", x + y if op == "+" else x - y if op == "-" else x * y)
        if op == "/":
            return Value("dec", divide(x.cast("decimal(19,0)") if a.kind == "int" == b.kind else x, y.cast("decimal(19,0)") if b.kind == "int" == a.kind else y))
        if op == "*" and kind == "dec":
            return Value("dec", multiply(x, y))
        f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        return Value(kind, f(x, y).cast(DEC) if kind == "dec" else f(x, y))

    def numeric(self, v: Value, decimals: Callable[[Column], Column], doubles: Callable[[Column], Column], integers: Callable[[Column], Column] = lambda c: c) -> Value:
        """A function of one number, which keeps its type."""
        if v.kind == "int":
            return v.to(integers(v.col))
        if v.kind == "dec":
            return Value("dec", decimals(v.col).try_cast(DEC))
        if v.kind != "term":
            return Value("dbl", doubles(number(v)).cast("double"))
        d, n = v.col["d"], number(v)
        whole, decimal = d.isin(*INTEGERS), d == XSD + "decimal"
        shown = (
            F.when(whole, integers(v.col["v"].try_cast("bigint")).cast("string"))
            .when(decimal, text(Value("dec", decimals(v.col["v"].try_cast(DEC)).try_cast(DEC))))
            # bound by a lambda, since its text mentions the number many times
            .otherwise(F.element_at(F.transform(F.array(n), lambda x: text(Value("dbl", doubles(x)))), 1))
        )
        return Value("term", F.when(n.isNotNull(), struct(3, shown, F.when(whole, XSD + "integer").otherwise(d))).cast(TERM))

    def f_abs(self, v):
        return self.numeric(v, F.abs, F.abs, lambda c: F.when(c >= 0, c).otherwise(F.try_subtract(F.lit(0).cast("bigint"), c)))

    def f_ceil(self, v):
        return self.numeric(v, F.ceil, lambda c: _whole(c, F.ceil))

    def f_floor(self, v):
        return self.numeric(v, F.floor, lambda c: _whole(c, F.floor))

    def f_round(self, v):
        """Halves go up, also below 0."""
        return self.numeric(v, lambda c: F.floor(F.try_add(c, F.lit(0.5).cast("decimal(2,1)"))), lambda c: _whole(c, lambda x: F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)))

    # terms

    def f_str(self, v):
        return Value("str", text(v), maybe=v.maybe)

    def f_lang(self, v):
        return Value("str", F.when(v.col["k"] == 3, language(v)) if v.kind == "term" else null().col if v.kind in ("iri", "key") else F.when(v.col.isNotNull(), ""))

    def f_langmatches(self, a, b):
        x, y = F.lower(text(a)), F.lower(text(b))
        return Value("bool", F.when(y == "*", x != "").otherwise((x == y) | x.startswith(F.concat(y, F.lit("-")))))

    def f_datatype(self, v):
        if v.kind in ("iri", "key"):
            return null("iri")
        return Value("iri", F.when(v.col["k"] == 3, v.col["d"]) if v.kind == "term" else F.when(v.col.isNotNull(), DATATYPE[v.kind]))

    def f_iri(self, v):
        if v.kind in ("iri", "key"):
            return v
        c = F.when(v.col["k"] != 2, v.col["v"]) if v.kind == "term" else v.col.cast("string")
        return Value("iri", F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), c).otherwise(_resolved(self.base, c)))

    def f_bnode(self, *vs):
        """One node for a row and label."""
        row = self.row if self.row is not None else F.uuid()
        return Value("term", struct(2, F.sha2(F.concat_ws("|", row.cast("string"), *[plain(v) for v in vs]), 256)))

    def f_strdt(self, a, b):
        return Value("term", F.when(text(b).isNotNull(), struct(3, plain(a), text(b))).cast(TERM))

    def f_strlang(self, a, b):
        return Value("term", F.when(plain(b).isNotNull(), struct(3, plain(a), RDF + "langString", F.lower(plain(b)))).cast(TERM))

    def is_kind(self, v: Value, k: int) -> Value:
        own = 1 if v.kind in ("iri", "key") else 3
        return Value("bool", v.col["k"] == k if v.kind == "term" else F.when(v.col.isNotNull(), F.lit(own == k)))

    def f_isiri(self, v):
        return self.is_kind(v, 1)

    def f_isblank(self, v):
        return self.is_kind(v, 2)

    def f_isliteral(self, v):
        return self.is_kind(v, 3)

    def f_isnumeric(self, v):
        if v.kind == "term":
            return Value("bool", F.when(v.col.isNotNull(), F.coalesce(is_numeric(v.col) & number(v).isNotNull(), F.lit(False))))
        return Value("bool", F.when(v.col.isNotNull(), F.lit(v.kind in NUMERIC)))

    def f_sameterm(self, a, b):
        x, y = unify(a, b)
        return Value("bool", x.col == y.col)

    def f_uuid(self):
        return Value("iri", F.concat(F.lit("urn:uuid:"), F.uuid()))

    def f_struuid(self):
        return Value("str", F.uuid())

    def f_rand(self):
        return Value("dbl", F.rand())

    def f_now(self):
        return Value("dt", F.lit(self.now.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz"))

    # strings

    def like(self, v: Value, c: Column) -> Value:
        """A string with the language of another."""
        if v.kind != "term":
            return Value("str", c)
        return Value("term", struct(3, c, v.col["d"], v.col["l"]))

    def agree(self, a: Value, b: Value) -> Column:
        """Whether b may be an argument beside a: it has a's language or none."""
        return (language(b) == "") | (language(a) == language(b))

    def f_strlen(self, v):
        return Value("int", F.char_length(string_arg(v)).cast("bigint"))

    def f_substr(self, v, start, length=None):
        """Positions as XPath counts them: Spark takes 0 for 1 and negatives from the end."""
        s = string_arg(v)
        a = F.floor(number(start) + 0.5)
        b = F.char_length(s) + 1 if length is None else a + F.floor(number(length) + 0.5)
        begin = F.greatest(a, F.lit(1))
        return self.like(v, F.substring(s, begin.cast("int"), F.greatest(b - begin, F.lit(0)).cast("int")))

    def f_ucase(self, v):
        return self.like(v, F.upper(string_arg(v)))

    def f_lcase(self, v):
        return self.like(v, F.lower(string_arg(v)))

    def f_strstarts(self, a, b):
        return Value("bool", F.when(self.agree(a, b), string_arg(a).startswith(string_arg(b))))

    def f_strends(self, a, b):
        return Value("bool", F.when(self.agree(a, b), string_arg(a).endswith(string_arg(b))))

    def f_contains(self, a, b):
        return Value("bool", F.when(self.agree(a, b), string_arg(a).contains(string_arg(b))))

    def around(self, a: Value, b: Value, before: bool) -> Value:
        s, t = string_arg(a), string_arg(b)
        at = F.call_function("locate", t, s)
        cut = F.substring(s, F.lit(1), at - 1) if before else F.substring(s, at + F.char_length(t), F.char_length(s))
        empty = Value("str", F.lit(""))
        if a.kind != "term":
            return Value("str", F.when(self.agree(a, b), F.when(at > 0, cut).when(at == 0, "")))
        return Value("term", F.when(self.agree(a, b), F.when(at > 0, self.like(a, cut).col).when(at == 0, term(empty).col)).cast(TERM))

    def f_strbefore(self, a, b):
        return self.around(a, b, True)

    def f_strafter(self, a, b):
        return self.around(a, b, False)

    def f_encode_for_uri(self, v):
        """Spark's url_encode is that of forms: + for a blank, ~ encoded and * kept."""
        c = F.url_encode(string_arg(v))
        return Value("str", F.replace(F.replace(F.replace(c, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))

    def f_concat(self, *vs):
        joined = F.concat(*[string_arg(v) for v in vs]) if vs else F.lit("")
        if all(v.kind == "str" for v in vs):
            return Value("str", joined)
        same = F.lit(True)
        for v in vs[1:]:
            same = same & (language(v) == language(vs[0]))
        tagged = F.nullif(language(vs[0]), F.lit(""))
        return Value("term", F.when(same & tagged.isNotNull(), struct(3, joined, RDF + "langString", tagged)).otherwise(struct(3, joined, STRING)).cast(TERM))

    def pattern(self, p: Value, flags: Value | None) -> Column:
        c = plain(p)
        if flags is None:
            return c
        f = plain(flags)
        quoted = F.when(f.contains("q"), F.concat(F.lit("\\Q"), c, F.lit("\\E"))).otherwise(c)
        inline = F.regexp_replace(f, "[^ismx]", "")
        return F.when(f.rlike("^[ismxq]*$"), F.when(inline != "", F.concat(F.lit("(?"), inline, F.lit(")"), quoted)).otherwise(quoted))

    def f_regex(self, v, p, flags=None):
        return Value("bool", F.regexp_like(string_arg(v), self.pattern(p, flags)))

    def f_replace(self, v, p, r, flags=None):
        """A pattern that matches the empty string is an error."""
        pat = self.pattern(p, flags)
        return self.like(v, F.when(~F.regexp_like(F.lit(""), pat), F.regexp_replace(string_arg(v), pat, plain(r))))

    # dates: fields come from the lexical form, which keeps its zone

    def field(self, v: Value, name: str, group: str) -> Value:
        if v.kind in ("dt", "date"):
            return Value("int", getattr(F, name)(v.col).cast("bigint"))
        c = F.when(v.col["d"].isin(XSD + "dateTime", XSD + "date"), v.col["v"]) if v.kind == "term" else F.lit(None).cast("string")
        return Value("int", F.nullif(F.regexp_extract(c, group, 1), F.lit("")).try_cast("bigint"))

    def f_year(self, v):
        return self.field(v, "year", r"^(-?\d{4,})-")

    def f_month(self, v):
        return self.field(v, "month", r"^-?\d{4,}-(\d\d)")

    def f_day(self, v):
        return self.field(v, "day", r"^-?\d{4,}-\d\d-(\d\d)")

    def f_hours(self, v):
        return self.field(v, "hour", r"T(\d\d):")

    def f_minutes(self, v):
        return self.field(v, "minute", r"T\d\d:(\d\d)")

    def f_seconds(self, v):
        if v.kind == "dt":
            return Value("dec", F.date_format(v.col, "s.SSSSSS").cast(DEC))
        c = F.when(v.col["d"] == XSD + "dateTime", v.col["v"]) if v.kind == "term" else F.lit(None).cast("string")
        return Value("dec", F.nullif(F.regexp_extract(c, r"T\d\d:\d\d:(\d\d(?:\.\d+)?)", 1), F.lit("")).try_cast(DEC))

    def zone(self, v: Value) -> Column:
        c = v.col["v"] if v.kind == "term" else text(v)
        return F.when(c.rlike("^-?\\d{4,}-\\d\\d-\\d\\d"), F.regexp_extract(c, r"(Z|[+-]\d\d:\d\d)$", 1))

    def f_tz(self, v):
        return Value("str", self.zone(v))

    def f_timezone(self, v):
        z = self.zone(v)
        h, m = F.regexp_extract(z, r"[+-](\d\d)", 1).try_cast("int"), F.regexp_extract(z, r":(\d\d)$", 1).try_cast("int")
        parts = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""), F.when((h == 0) & (m == 0), "0S").otherwise(""))
        return Value("term", struct(3, F.when(z == "Z", "PT0S").when(z != "", parts), XSD + "dayTimeDuration"))

    # hashes

    def f_md5(self, v):
        return Value("str", F.md5(plain(v)))

    def f_sha1(self, v):
        return Value("str", F.sha1(plain(v)))

    def f_sha256(self, v):
        return Value("str", F.sha2(plain(v), 256))

    def f_sha384(self, v):
        return Value("str", F.sha2(plain(v), 384))

    def f_sha512(self, v):
        return Value("str", F.sha2(plain(v), 512))

    # casts and other functions named by an IRI

    def cast(self, name: str, vs: list[Value]) -> Value:
        if name in self.registry:
            return self.registry[name](*vs)
        v = vs[0] if len(vs) == 1 else null()
        lex = F.trim(text(v)) if v.kind not in ("iri", "key") else F.lit(None).cast("string")
        if v.kind == "term":
            lex = F.when(v.col["k"] == 3, F.trim(v.col["v"]))
        match name.removeprefix(XSD) if name.startswith(XSD) else None:
            case "string":
                return self.f_str(v)
            case "boolean":
                n = number(v)
                held = F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)) if v.kind in NUMERIC else F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)
                return Value("bool", v.col if v.kind == "bool" else held)
            case "integer" | "int" | "long" | "short" | "byte":
                if v.kind == "bool":
                    return Value("int", v.col.cast("bigint"))
                return Value("int", v.col.try_cast("bigint") if v.kind in NUMERIC else F.when(lex.rlike(r"^[+-]?\d+$"), lex.try_cast("bigint")))
            case "decimal":
                if v.kind in NUMERIC | {"bool"}:
                    return Value("dec", (v.col.cast("int") if v.kind == "bool" else v.col).try_cast(DEC))
                return Value("dec", F.when(lex.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), lex.try_cast(DEC)))
            case "double" | "float":
                if v.kind in NUMERIC | {"bool"}:
                    return Value("dbl", v.col.cast("double"))
                inf = F.regexp_replace(lex, "^([+-]?)INF$", "$1Infinity")
                return Value("dbl", F.when(lex.rlike(r"^([+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|INF)|NaN)$"), inf.try_cast("double")))
            case "dateTime":
                if v.kind in ("dt", "date"):
                    return Value("dt", v.col.cast("timestamp_ntz"))
                stamp = lex.rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?$")
                return Value("term", F.when(stamp & lex.try_cast("timestamp").isNotNull(), struct(3, lex, XSD + "dateTime")).cast(TERM))
            case "date":
                if v.kind in ("dt", "date"):
                    return Value("date", v.col.cast("date"))
                return Value("date", F.when(lex.rlike(r"^\d{4}-\d\d-\d\d"), F.substring(lex, 1, 10).try_cast("date")))
        return null()


def _resolved(base: str, c: Column) -> Column:
    """A relative reference against a fixed base: merged with its path, dot segments taken out. Without a base it stays as it is."""
    parts = urlsplit(base)
    if not parts.scheme:
        return c
    root = f"{parts.scheme}:" + (f"//{parts.netloc}" if parts.netloc else "")
    bare = root + parts.path + (f"?{parts.query}" if parts.query else "")
    path, tail = F.regexp_extract(c, "^([^?#]*)", 1), F.regexp_extract(c, "^[^?#]*(.*)$", 1)
    up = parts.path.rpartition("/")[0] + "/"
    segments = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(up), path)), "/")

    def step(out: Column, x: Column) -> Column:
        shorter = F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
        return F.when(x == "..", shorter).when(x == ".", out).otherwise(F.concat(out, F.array(x)))

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.element_at(segments, 1)), step)
    last = F.element_at(segments, -1)
    whole = F.concat(F.lit(root), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"), tail)
    return F.when(path.startswith("//"), F.concat(F.lit(f"{parts.scheme}:"), c)).when(path != "", whole).when(tail.startswith("?"), F.concat(F.lit(root + parts.path), tail)).otherwise(F.concat(F.lit(bare), tail))


def _whole(c: Column, f: Callable[[Column], Column]) -> Column:
    """A rounding that Spark does by way of bigint; doubles of 2^53 and more, INF and NaN are whole already."""
    return F.when(F.isnan(c) | (F.abs(c) >= float(1 << 53)), c).otherwise(f(c).cast("double"))


def _compiles(pattern: str, flags: str) -> bool:
    """Whether Java's regular expressions take a pattern, asked without a job."""
    if re.search("[^ismxq]", flags):
        return False
    try:
        SparkSession.active().sql("SELECT regexp_like('', :p)", args={"p": pattern if "q" not in flags else re.escape(pattern)}).collect()
    except Exception:  # noqa: BLE001
        return False
    return True


def _checked_rows(c: Column) -> Column:
    """Patterns that differ by row, null where they can't be compiled; the only function here that leaves the JVM."""

    @F.pandas_udf("string")
    def checked(patterns: pd.Series) -> pd.Series:
        ok: dict[str | None, str | None] = {}
        for p in patterns.unique():
            try:
                ok[p] = p if p is not None and re.compile(re.sub(r"\\[pP]\{\w+\}", "a", p)) else None
            except re.error:
                ok[p] = None
        return patterns.map(ok)

    return checked(c)


def _numbers(a: Value, b: Value) -> tuple[Column, Column]:
    if "dbl" in (a.kind, b.kind):
        return a.col.cast("double"), b.col.cast("double")
    if "dec" in (a.kind, b.kind):
        return a.col.cast(DEC), b.col.cast(DEC)
    return a.col, b.col


def sort_keys(v: Value, ascending: bool) -> list[Column]:
    """Columns that order values as the language does: unbound, blank nodes, IRIs, literals."""
    cols = [v.col]
    if v.kind == "key":
        cols = [text(v)]
    elif v.kind == "term":
        c = v.col
        rank = F.when(c.isNull(), 0).when(c["k"] == 2, 1).when(c["k"] == 1, 2).otherwise(3)
        cols = [rank, number(v), boolean(v), instant(v), c["v"], c["d"], c["l"]]
    return [c.asc_nulls_first() if ascending else c.desc_nulls_last() for c in cols]
