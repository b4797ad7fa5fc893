"""Expressions to Columns with a tri-state outcome: a value, undefined (an unbound variable) or an error."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Op, UnsupportedQueryError
from ..plans.relation import Relation, column
from . import terms as T

#: Operators and the number of their arguments.
ARITY = {
    **dict.fromkeys(("+", "-", "*", "/", "=", "!=", "<", "<=", ">", ">=", "&&", "||", "langmatches", "contains", "regex"), 2),
    **dict.fromkeys(("!", "lang", "str", "bound", T.INTEGER, T.DOUBLE), 1),
}


@dataclass
class Value:
    """kind: num (a double, of that datatype), bool, str (a plain literal's text), text (struct of text and language), term.

    undefined and error are null where that can't happen.
    """

    kind: str
    col: Column
    datatype: str = ""
    undefined: Column | None = None
    error: Column | None = None
    iri: bool = False

    def term(self) -> Column:
        if self.kind == "num":
            whole = (F.floor(self.col) == self.col) & (F.abs(self.col) < 1e15)
            if self.datatype == T.INTEGER:
                return T.literal(F.when(whole, self.col.cast("long").cast("string")).otherwise(self.col.cast("string")), self.datatype)
            return T.literal(self.col.cast("string"), self.datatype)
        if self.kind == "bool":
            return T.literal(self.col.cast("string"), T.BOOLEAN)
        if self.kind == "str":
            return T.literal(self.col)
        if self.kind == "text":
            return F.concat(F.lit('"'), self.col["lex"], F.lit('"@'), self.col["lang"])
        return self.col

    def text(self) -> Column:
        """Text of a literal; IRIs have none."""
        if self.kind == "str":
            return self.col
        if self.kind == "text":
            return self.col["lex"]
        if self.kind == "term":
            return T.lexical(self.col)
        return T.lexical(self.term())

    def number(self) -> Column:
        return self.col if self.kind == "num" else T.number(self.text())

    def not_literal(self) -> Column | None:
        if self.kind != "term":
            return None
        return F.lit(True) if self.iri else ~T.is_literal(self.col)

    def truth(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return self.col != 0
        if self.kind in ("str", "text"):
            return self.text() != "0"
        return T.truth(self.col)


def _any(*flags: Column | None) -> Column | None:
    found = [f for f in flags if f is not None]
    return reduce(lambda a, b: a | b, found) if found else None


def _outcome(args: list[Value], *own: Column | None) -> tuple[Column | None, Column | None]:
    """(undefined, error) of an operation: what comes first, argument by argument, decides."""
    undefined = error = None
    for a in args:
        if a.undefined is not None:
            undefined = _any(undefined, a.undefined if error is None else ~error & a.undefined)
        if a.error is not None:
            error = _any(error, a.error if undefined is None else ~undefined & a.error)
    for e in own:
        if e is not None:
            error = _any(error, e if undefined is None else ~undefined & F.coalesce(e, F.lit(False)))
    return undefined, error


class Compiler:
    """quirks: term identity for =, numeric < only, no error recovery in && and ||, filters that keep undefined rows, and the like."""

    def __init__(self, quirks: bool = False):
        self.quirks = quirks

    def check(self, e: object) -> None:
        """Operators and numbers of arguments, without any data."""
        if isinstance(e, Op):
            if e.name not in ARITY:
                raise UnsupportedQueryError(f"Unsupported operator: {e.name}.")
            if len(e.args) != ARITY[e.name]:
                raise UnsupportedQueryError(f"Invalid number of arguments for {e.name}: {len(e.args)} (expected: {ARITY[e.name]}).")
            if e.name == "bound" and not (isinstance(e.args[0], str) and e.args[0].startswith("?")):
                raise UnsupportedQueryError(f"BOUND expects a variable but got: {e.args[0]}")
            for a in e.args:
                self.check(a)
        elif e is not None and not isinstance(e, str):
            raise UnsupportedQueryError(f"Unsupported expression type: {type(e).__name__}.")

    def value(self, e: object, scope: Relation) -> Value:
        if e is None:
            return Value("str", F.lit(None).cast("string"), undefined=F.lit(True))
        if isinstance(e, Op):
            return self.operation(e, scope)
        if T.py_is_variable(e):
            return self.variable(e, scope)
        return self.constant(e)

    def variable(self, v: str, scope: Relation) -> Value:
        if v not in scope.encs:
            return Value("str", F.lit(None).cast("string"), undefined=F.lit(True))
        enc, c = scope.encs[v], column(v)
        undefined = c.isNull() if v in scope.maybe else None
        if enc.numeric:
            return Value("num", c.cast("double"), enc.datatype, undefined)
        if enc.kind == "text":
            return Value("text", c, undefined=undefined)
        if enc.kind == "literal" and enc.datatype == T.BOOLEAN:
            return Value("bool", c, undefined=undefined)
        if enc.kind == "literal" and enc.datatype in ("", T.STRING):
            return Value("str", c, undefined=undefined)
        return Value("term", enc.term(c), undefined=undefined, iri=enc.kind == "iri")

    def constant(self, t: str) -> Value:
        if not T.py_is_literal(t):
            return Value("term", F.lit(t), iri=True)
        lex, lang, dt = T.py_literal(t)
        if dt in T.NUMERIC:
            try:
                return Value("num", F.lit(float(lex)), dt)
            except ValueError:
                pass
        elif dt == T.BOOLEAN and lex in ("true", "false"):
            return Value("bool", F.lit(lex == "true"))
        elif not lang and dt in (None, T.STRING):
            return Value("str", F.lit(lex))
        return Value("term", F.lit(t))

    def operation(self, e: Op, scope: Relation) -> Value:
        self.check(e)
        name = e.name
        if name == "bound":
            v = e.args[0]
            return Value("bool", F.lit(v in scope.encs) if v not in scope.maybe else column(v).isNotNull())
        args = [self.value(a, scope) for a in e.args]
        a, b = args[0], args[-1]
        if name in ("+", "-", "*", "/"):
            return self.arithmetic(name, args)
        if name in ("=", "!="):
            undefined, error = _outcome(args)
            same = self.equal(a, b)
            return Value("bool", same if name == "=" else ~same, undefined=undefined, error=error)
        if name in ("<", "<=", ">", ">="):
            return self.compare(name, args)
        if name == "!":
            undefined, error = _outcome(args)
            return Value("bool", ~a.truth(), undefined=undefined, error=error)
        if name in ("&&", "||"):
            return self.logic(name, a, b)
        if name == "lang":
            undefined, error = _outcome(args, a.not_literal())
            lang = F.lower(a.col["lang"]) if a.kind == "text" else T.language(a.col) if a.kind == "term" else F.lit("")
            return Value("str", lang, undefined=undefined, error=error)
        if name == "langmatches":
            undefined, error = _outcome(args, a.not_literal(), b.not_literal())
            tag, want = F.lower(a.text()), F.lower(b.text())
            wild = want == "*"
            if not self.quirks:
                wild = wild & (tag != "")
            return Value("bool", (tag == want) | wild | tag.startswith(F.concat(want, F.lit("-"))), undefined=undefined, error=error)
        if name == "contains":
            undefined, error = _outcome(args, a.not_literal(), b.not_literal())
            return Value("bool", F.contains(a.text(), b.text()), undefined=undefined, error=error)
        if name == "regex":
            undefined, error = _outcome(args, b.not_literal())
            subject = a.text() if a.kind != "term" else F.when(T.is_literal(a.col), T.lexical(a.col)).otherwise(a.col)
            return Value("bool", F.regexp_like(subject, b.text()), undefined=undefined, error=error)
        if name == "str":
            undefined, error = _outcome(args)
            if a.kind != "term":
                return Value(a.kind, a.col, a.datatype, undefined, error)
            if a.iri:
                return Value("str", a.col, undefined=undefined, error=error)
            return Value("term", F.when(T.is_literal(a.col), a.col).otherwise(T.literal(a.col)), undefined=undefined, error=error)
        return self.cast(name, args)

    def arithmetic(self, name: str, args: list[Value]) -> Value:
        a, b = args
        x, y = a.number(), b.number()
        undefined, error = _outcome(args, a.not_literal(), b.not_literal())
        if name == "/":
            zero = F.when(F.isnan(x) | (x == 0), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
            out = F.when(y == 0, zero).otherwise(x / F.when(y == 0, 1.0).otherwise(y))
        else:
            out = {"+": x + y, "-": x - y, "*": x * y}[name]
        first = a.datatype or T.INTEGER
        both = T.INTEGER if a.datatype == b.datatype == T.INTEGER and name != "/" else T.DOUBLE
        return Value("num", out, first if self.quirks else both, undefined, error)

    def equal(self, a: Value, b: Value) -> Column:
        if not self.quirks:
            if a.kind == b.kind == "num":
                return a.col == b.col
            if "num" in (a.kind, b.kind):
                num, other = (a, b) if a.kind == "num" else (b, a)
                if other.kind != "term" or other.iri:
                    return F.lit(False)
                return T.is_numeric(other.col) & (other.number() == num.col)
        if a.kind == b.kind and a.kind in ("str", "bool"):
            return a.col == b.col
        same = a.term() == b.term()
        if not self.quirks and a.kind == b.kind == "term" and not (a.iri or b.iri):
            same = same | (T.is_numeric(a.col) & T.is_numeric(b.col) & (a.number() == b.number()))
        return same

    def compare(self, name: str, args: list[Value]) -> Value:
        a, b = args
        undefined, error = _outcome(args, a.not_literal(), b.not_literal())
        op = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[name]
        if a.kind == b.kind == "num":
            out = op(a.col, b.col) & ~F.isnan(a.col) & ~F.isnan(b.col)
        else:
            x, y = a.number(), b.number()
            out = op(x, y) & ~F.isnan(x) & ~F.isnan(y)
            if not self.quirks and "num" not in (a.kind, b.kind):
                like = a.text().rlike(T.NUMBER_LIKE) & b.text().rlike(T.NUMBER_LIKE)
                out = F.when(like, out).otherwise(op(a.text(), b.text()))
        return Value("bool", out, undefined=undefined, error=error)

    def logic(self, name: str, a: Value, b: Value) -> Value:
        x, y = a.truth(), b.truth()
        if self.quirks:
            undefined, error = _outcome([a, b])
            return Value("bool", x & y if name == "&&" else x | y, undefined=undefined, error=error)
        bad_a, bad_b = _any(a.undefined, a.error), _any(b.undefined, b.error)
        if bad_a is None and bad_b is None:
            return Value("bool", x & y if name == "&&" else x | y)
        no = F.lit(False)
        bad_a, bad_b = (no if bad_a is None else bad_a), (no if bad_b is None else bad_b)
        decides = (lambda bad, v: ~bad & ~v) if name == "&&" else (lambda bad, v: ~bad & v)
        settled = F.coalesce(decides(bad_a, x), no) | F.coalesce(decides(bad_b, y), no)
        out = F.when(settled, name == "||").otherwise(x & y if name == "&&" else x | y)
        return Value("bool", out, error=~settled & (bad_a | bad_b))

    def cast(self, name: str, args: list[Value]) -> Value:
        a = args[0]
        x = a.number() if a.kind != "bool" or self.quirks else a.col.cast("double")
        bad = None if a.kind in ("num", "bool") or self.quirks else F.isnan(x)
        undefined, error = _outcome(args, a.not_literal(), bad)
        if name == T.INTEGER:
            whole = F.floor(x) if self.quirks else F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
            return Value("num", F.when(F.isnan(x), float("nan")).otherwise(whole.cast("double")), T.INTEGER, undefined, error)
        return Value("num", F.round(x) if self.quirks else x, T.DOUBLE, undefined, error)

    def keep(self, e: object, scope: Relation) -> Column:
        """Whether a FILTER keeps a row: errors drop it; undefined drops it, with quirks keeps it."""
        v = self.value(e, scope)
        keep = v.truth()
        if v.undefined is not None:
            keep = F.when(v.undefined, self.quirks).otherwise(keep)
        if v.error is not None:
            keep = F.when(v.error, False).otherwise(keep)
        return keep


def evaluate(spark, e: object, bindings: dict[str, str] | None = None, quirks: bool = False) -> str | None:
    """An expression for one solution given as terms: a term, or None when undefined; an error raises ValueError."""
    from ..plans.relation import TERM, unit

    scope = unit(spark)
    bindings = bindings or {}
    scope = Relation(scope.df.select(*[F.lit(t).alias(v) for v, t in bindings.items()]) if bindings else scope.df, dict.fromkeys(bindings, TERM))
    compiler = Compiler(quirks)
    compiler.check(e)
    v = compiler.value(e, scope)
    no = F.lit(False)
    row = scope.df.select(v.term().alias("term"), (no if v.undefined is None else v.undefined).alias("u"), (no if v.error is None else v.error).alias("e")).first()
    if row["e"] and not row["u"]:
        raise ValueError("the expression has no value")
    return None if row["u"] else row["term"]
