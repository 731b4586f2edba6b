"""The part of JavaScript that record expressions use, compiled to columns.

Literals, arithmetic, comparison, ``&& || !``, ``?:``, methods of text and Math, ``num``, ``bin``,
``parseInt``, ``parseFloat``, ``new RegExp(..).test(..)`` and ``if``/``return``. Anything else is rejected with a message.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .values import BOOL, INT, NUM, TEXT, ExpressionError, Value, common, lit
from .variables import Context

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_$][\w$]*)|(?P<op>===|!==|==|!=|<=|>=|&&|\|\||\?\?|\*\*|[-+*/%<>!?:().,;{}\[\]]))""")
LEVELS = [["??"], ["||"], ["&&"], ["==", "!=", "===", "!=="], ["<", ">", "<=", ">="], ["+", "-"], ["*", "/", "%"], ["**"]]
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
INFINITY = float("inf")


def tokens(src: str) -> list[tuple[str, str]]:
    out, at = [], 0
    src = src.rstrip()
    while at < len(src):
        m = TOKEN.match(src, at)
        if not m:
            raise ExpressionError(f"can't read expression at: {src[at : at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class Compiler:
    def __init__(self, ctx: Context, src: str) -> None:
        self.ctx, self.src, self.toks, self.at = ctx, src, tokens(src), 0

    def peek(self) -> str | None:
        return self.toks[self.at][1] if self.at < len(self.toks) and self.toks[self.at][0] != "str" else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.toks):
            raise ExpressionError(f"expression ends too early: {self.src!r}")
        t = self.toks[self.at]
        if want is not None and (t[0] == "str" or t[1] != want):
            raise ExpressionError(f"expected {want!r} before {t[1]!r} in {self.src!r}")
        self.at += 1
        return t

    def skip(self, op: str) -> bool:
        if self.peek() == op:
            self.at += 1
            return True
        return False

    def program(self) -> Value:
        if any(t == ("name", "return") for t in self.toks):
            v = self.statements()
        else:
            v = self.expression()
            self.skip(";")
        if self.at < len(self.toks):
            raise ExpressionError(f"can't read {self.toks[self.at][1]!r} in {self.src!r}")
        return v

    def statements(self) -> Value:
        """Statements up to the end or a closing brace; each path ends in a return or is undefined."""
        while self.skip(";"):
            pass
        if self.at >= len(self.toks) or self.peek() == "}":
            return lit(None)
        if self.skip("return"):
            v = self.expression()
            while self.skip(";"):
                pass
            while self.at < len(self.toks) and self.peek() != "}":
                self.statements()  # never reached; must be readable all the same
            return v
        if self.skip("if"):
            self.take("(")
            cond = self.expression()
            self.take(")")
            then = self.block()
            if self.skip("else"):
                other = self.block()
                while self.skip(";"):
                    pass
            else:
                other = self.statements()
            return choose(cond, then, other)
        raise ExpressionError(f"only if and return are understood: {self.src!r}")

    def block(self) -> Value:
        if self.skip("{"):
            v = self.statements()
            self.take("}")
            return v
        if self.peek() == "if":
            return self.statements()
        self.take("return")
        v = self.expression()
        self.skip(";")
        return v

    def expression(self) -> Value:
        cond = self.binary(0)
        if self.skip("?"):
            a = self.expression()
            self.take(":")
            return choose(cond, a, self.expression())
        return cond

    def binary(self, level: int) -> Value:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while (op := self.peek()) in LEVELS[level]:
            self.at += 1
            left = operate(op, left, self.binary(level + 1))
        return left

    def unary(self) -> Value:
        if self.skip("!"):
            return Value(~self.unary().truth(), BOOL)
        if self.skip("-"):
            v = self.unary()
            if v.kind == INT:
                return Value(-v.col, INT, const=None if v.const is None else -v.const)
            return Value(-v.number(), NUM, const=None if not isinstance(v.const, float) else -v.const)
        if self.skip("+"):
            return Value(self.unary().number(), NUM)
        return self.postfix()

    def args(self) -> list[Value]:
        out: list[Value] = []
        while not self.skip(")"):
            if out:
                self.take(",")
            out.append(self.expression())
        return out

    def postfix(self) -> Value:
        kind, t = self.take()
        if kind == "num":
            v = lit(float(t) if re.search(r"[.eE]", t) else int(t))
        elif kind == "str":
            v = lit(re.sub(r"\\(.)", lambda m: ESCAPES.get(m.group(1), m.group(1)), t[1:-1], flags=re.S))
        elif t == "(":
            v = self.expression()
            self.take(")")
            if isinstance(v, Value) and v.kind == "regex" and self.peek() == ".":
                pass
        elif kind == "name":
            v = self.name(t)
        else:
            raise ExpressionError(f"can't read {t!r} in {self.src!r}")
        while self.skip("."):
            method = self.take()[1]
            v = member(v, method, self.args() if self.skip("(") else None)
        return v

    def name(self, t: str) -> Value:
        if t in ("true", "false"):
            return lit(t == "true")
        if t in ("undefined", "null"):
            return lit(None)
        if t in ("NaN", "Infinity"):
            return lit(float(t.lower().replace("infinity", "inf")))
        if t == "Math":
            self.take(".")
            f = self.take()[1]
            return math(f, self.args() if self.skip("(") else None)
        if t == "new":
            t = self.take()[1]
        if t == "RegExp":
            self.take("(")
            (pattern, *_) = self.args()
            if pattern.const is None:
                raise ExpressionError("RegExp takes a literal")
            return Value(F.lit(pattern.const), "regex", const=pattern.const)
        if self.ctx.known(t):
            return self.ctx.call(t, self.args() if self.skip("(") else [])
        if t in ("parseFloat", "parseInt", "Number", "String", "isNaN", "Boolean"):
            self.take("(")
            (x, *_) = self.args()
            if t == "parseFloat":
                return Value(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(x.text(), F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(float("nan"))), NUM)
            if t == "parseInt":
                return Value(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(x.text(), F.lit("")), r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("double"), F.lit(float("nan"))), NUM)
            if t == "Number":
                return Value(x.number(), NUM)
            if t == "isNaN":
                return Value(F.isnan(x.number()), BOOL)
            return Value(x.truth(), BOOL) if t == "Boolean" else Value(x.printed(), TEXT)
        raise ExpressionError(f"unknown name {t!r} in {self.src!r}")


def choose(cond: Value, a: Value, b: Value) -> Value:
    x, y, kind = common(a, b) if _defined(a) and _defined(b) else (a.col, b.col, (a if _defined(a) else b).kind)
    if not _defined(a) and _defined(b):
        x = F.lit(None).cast(_sql(b.kind))
    if not _defined(b) and _defined(a):
        y = F.lit(None).cast(_sql(a.kind))
    return Value(F.when(cond.truth(), x).otherwise(y), kind, a.width if a.width is not None else b.width)


def _defined(v: Value) -> bool:
    return not (v.kind == TEXT and v.const is None and str(v.col) in ("Column<'CAST(NULL AS STRING)'>", "Column<'NULL'>"))


def _sql(kind: str) -> str:
    return {TEXT: "string", INT: "bigint", NUM: "double", BOOL: "boolean"}.get(kind, "double")


def operate(op: str, a: Value, b: Value) -> Value:
    if op == "??":
        x, y, kind = common(a, b)
        return Value(F.coalesce(x, y), kind)
    if op in ("&&", "||"):
        if a.kind == BOOL and b.kind == BOOL:
            return Value(a.truth() & b.truth() if op == "&&" else a.truth() | b.truth(), BOOL)
        x, y, kind = common(a, b)
        return Value(F.when(a.truth(), y if op == "&&" else x).otherwise(x if op == "&&" else y), kind)
    if op in ("===", "!==", "==", "!="):
        if not _defined(a) or not _defined(b):
            eq = b.col.isNull() if not _defined(a) else a.col.isNull()
        elif a.kind == b.kind or {a.kind, b.kind} <= {INT, NUM}:
            x, y, _ = common(a, b)
            eq = F.coalesce(x == y, F.lit(False))
        elif len(op) == 3:
            eq = F.lit(False)
        else:
            eq = F.coalesce(a.number() == b.number(), F.lit(False)) & ~F.isnan(a.number())
        return Value(~eq if op[0] == "!" else eq, BOOL)
    if op in ("<", ">", "<=", ">="):
        if a.kind == b.kind == TEXT:
            x, y, ok = a.col, b.col, F.lit(True)
        else:
            x, y = a.number(), b.number()
            ok = ~F.isnan(x) & ~F.isnan(y)
        cmp = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        return Value(F.coalesce(ok & cmp, F.lit(False)), BOOL)
    if op == "+" and TEXT in (a.kind, b.kind):
        # an undefined number stays one: undefined + 1 is not a number
        other = b if a.kind == TEXT else a
        joined = F.concat(a.printed(), b.printed())
        if other.kind == TEXT:
            return Value(joined, TEXT)
        text = a if a.kind == TEXT else b
        return Value(F.when(text.col.isNull(), F.lit("NaN")).otherwise(joined), TEXT)
    if a.kind == b.kind == INT and op in "+-*":
        return Value({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], INT)
    x, y = a.number(), b.number()
    if op == "/":
        zero = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, INFINITY).otherwise(-INFINITY)
        return Value(F.when(y == 0, zero).otherwise(x / F.when(y == 0, 1.0).otherwise(y)), NUM)
    if op == "%":
        return Value(F.when(y == 0, float("nan")).otherwise(x % F.when(y == 0, 1.0).otherwise(y)), NUM)
    if op == "**":
        return Value(F.pow(x, y), NUM)
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], NUM)


def _index(v: Value, length) -> object:
    i = v.number().cast("int")
    return F.least(length, F.when(i < 0, F.greatest(F.lit(0), length + i)).otherwise(i))


def member(v: Value, method: str, args: list[Value] | None) -> Value:
    if v.kind == "regex":
        if method != "test" or not args:
            raise ExpressionError("only test() of a RegExp is understood")
        return Value(F.coalesce(args[0].text().rlike(v.const), F.lit(False)), BOOL)
    t = v.text()
    n = F.length(t)
    if method == "length" and args is None:
        return Value(n.cast("bigint"), INT)
    if args is None:
        raise ExpressionError(f"unknown property {method!r}")
    if method == "toString":
        return Value(v.printed(), TEXT)
    if method in ("toUpperCase", "toLowerCase"):
        return Value(F.upper(t) if method == "toUpperCase" else F.lower(t), TEXT)
    if method in ("startsWith", "endsWith", "includes"):
        return Value(F.coalesce({"startsWith": F.startswith, "endsWith": F.endswith, "includes": F.contains}[method](t, args[0].text()), F.lit(False)), BOOL)
    if method == "trim":
        return Value(F.trim(t), TEXT)
    if method == "indexOf":
        return Value((F.locate(args[0].const, t) - 1).cast("bigint"), INT)
    if method == "charAt":
        return Value(F.substr(t, args[0].number().cast("int") + 1, F.lit(1)), TEXT)
    if method == "slice":
        s, e = _index(args[0], n), _index(args[1], n) if len(args) > 1 else n
        return Value(F.substr(t, s + 1, F.greatest(F.lit(0), e - s)), TEXT)
    if method == "substring":
        clip = lambda a: F.greatest(F.lit(0), F.least(n, a.number().cast("int")))
        s, e = clip(args[0]), clip(args[1]) if len(args) > 1 else n
        return Value(F.substr(t, F.least(s, e) + 1, F.abs(e - s)), TEXT)
    if method == "replace":
        return Value(F.regexp_replace(t, "(?s)^(.*?)" + re.escape(args[0].const) + "(.*)$", "$1" + args[1].const.replace("\\", "\\\\").replace("$", "\\$") + "$2"), TEXT)
    if method == "toFixed":
        return Value(F.format_string(f"%.{args[0].const if args else 0}f", v.number()), TEXT)
    raise ExpressionError(f"unknown method {method!r}")


def math(f: str, args: list[Value] | None) -> Value:
    if args is None:
        consts = {"PI": 3.141592653589793, "E": 2.718281828459045}
        if f in consts:
            return lit(consts[f])
        raise ExpressionError(f"unknown constant Math.{f}")
    x = [a.number() for a in args]
    fs = {"abs": F.abs, "sqrt": F.sqrt, "log10": F.log10, "log2": F.log2, "log": lambda c: F.log(c), "exp": F.exp, "sign": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan}
    if f in ("floor", "ceil", "round", "trunc"):
        g = {"floor": F.floor, "ceil": F.ceil, "round": lambda c: F.floor(c + 0.5), "trunc": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))}[f]
        return Value(F.when(F.isnan(x[0]), x[0]).otherwise(g(x[0]).cast("double")), NUM)
    if f in fs:
        return Value(fs[f](x[0]), NUM)
    if f == "pow":
        return Value(F.pow(x[0], x[1]), NUM)
    if f in ("min", "max"):
        return Value((F.least if f == "min" else F.greatest)(*x) if len(x) > 1 else x[0], NUM)
    raise ExpressionError(f"unknown function Math.{f}")


def compile_js(ctx: Context, src: str) -> Value:
    return Compiler(ctx, src).program()


def compile_filter(ctx: Context, src: str) -> Value:
    v = compile_js(ctx, src)
    if v.kind != BOOL:
        raise ExpressionError(f"a filter must be boolean, this is {v.kind}: {src!r}")
    return v
