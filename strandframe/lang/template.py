"""Text with ``{variable}``, ``{function(argument)}`` and ``{expression}`` parts, compiled to one column."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .js import compile_js
from .values import TEXT, ExpressionError, Value, lit
from .variables import Context

CALL = re.compile(r"\s*([A-Za-z_]\w*)\s*\((.*)\)\s*", re.S)


def split_list(text: str, sep: str = ",") -> list[str]:
    """Parts at commas that stand outside brackets and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "({[":
            depth += 1
        elif c in ")}]":
            depth -= 1
        elif c == sep and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def as_call(ctx: Context, text: str) -> re.Match | None:
    """The match of a single call of a known function: its first bracket closes at the end."""
    m = CALL.fullmatch(text)
    if not m or not ctx.known(m.group(1)):
        return None
    depth, quote = 0, ""
    for i, c in enumerate(t := text.rstrip()):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth and i < len(t) - 1:
                return None
    return m


def _argument(ctx: Context, text: str) -> Value:
    """A literal, a known variable or function, or bare text, which is a string."""
    t = text.strip()
    if t[:1] in "\"'" and t[:1] == t[-1:] and len(t) > 1:
        return lit(t[1:-1])
    if re.fullmatch(r"[+-]?\d+", t):
        return lit(int(t))
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+[eE][+-]?\d+)", t):
        return lit(float(t))
    if t in ("true", "false"):
        return lit(t == "true")
    if ctx.known(t):
        return ctx.call(t, [])
    if m := as_call(ctx, t):
        return call(ctx, m)
    return lit(t) if re.fullmatch(r"[\w .|:-]*", t) else compile_js(ctx, t)


def call(ctx: Context, m: re.Match) -> Value:
    args = split_list(m.group(2)) if m.group(2).strip() else []
    return ctx.call(m.group(1), [_argument(ctx, a) for a in args])


def part(ctx: Context, text: str) -> Value:
    t = text.strip()
    if t.startswith("file:"):
        with open(t.removeprefix("file:")) as f:
            return compile_js(ctx, f.read())
    if ctx.known(t):
        return ctx.call(t, [])
    if m := as_call(ctx, t):
        try:
            return call(ctx, m)
        except ExpressionError:
            if not re.search(r"[-+*/<>=!?&|'\"(]", m.group(2)):
                raise
    return compile_js(ctx, t)


def pieces(text: str) -> list[tuple[bool, str]]:
    """(is code, text) parts; a brace that isn't closed is an error, a literal brace can't be written."""
    out, at = [], 0
    while (i := text.find("{", at)) >= 0:
        if i > at:
            out.append((False, text[at:i]))
        depth, quote, j = 0, "", i
        while j < len(text):
            c = text[j]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    break
            j += 1
        if j == len(text):
            raise ExpressionError(f"a brace isn't closed: {text!r}")
        out.append((True, text[i + 1 : j]))
        at = j + 1
    if at < len(text):
        out.append((False, text[at:]))
    return out


def compile_template(ctx: Context, text: str, raw: bool = False) -> Value:
    """A template of one part keeps its type, others are text. ``raw``: a bare variable or call needs no braces."""
    if raw and "{" not in text:
        t = text.strip()
        if ctx.known(t) or as_call(ctx, t):
            return part(ctx, t)
        return lit(text)
    ps = pieces(text)
    if len(ps) == 1 and ps[0][0]:
        return part(ctx, ps[0][1])
    if not ps:
        return lit("")
    return Value(F.concat(*(part(ctx, t).printed() if code else F.lit(t) for code, t in ps)), TEXT)


def compile_keys(ctx: Context, keys: str | list[str]) -> list[Value]:
    """A list of keys, parted by commas; each must hold a variable."""
    out = []
    for k in split_list(keys) if isinstance(keys, str) else keys:
        v = compile_template(ctx, k, raw=True)
        if v.const is not None:
            raise ExpressionError(f"a key without any variable: {k!r}")
        out.append(v)
    return out
