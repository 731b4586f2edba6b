"""Scripts of functions and constants that expressions may use: ``function f(a, b) { ... }`` and ``const x = ...;``.

A function is compiled anew at each call, with its parameters standing for the columns of the arguments, so it stays one
Catalyst expression.
"""

from __future__ import annotations

import copy
import re

from .js import compile_js
from .values import ExpressionError, Value
from .variables import Context

FUNCTION = re.compile(r"\s*function\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*\{")
CONSTANT = re.compile(r"\s*(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*([^;]+);")


def _closing(text: str, at: int) -> int:
    """The place behind the brace that closes the one before ``at``."""
    depth, quote = 1, ""
    while at < len(text):
        c = text[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return at + 1
        at += 1
    raise ExpressionError("a function's brace isn't closed")


def define(ctx: Context, source: str) -> Context:
    """``ctx`` with the functions and constants of a script."""
    text = re.sub(r"/\*.*?\*/|(?m:^\s*//.*$)", "", source, flags=re.S)
    at = 0
    while text[at:].strip():
        if m := FUNCTION.match(text, at):
            end = _closing(text, m.end())
            names = [p.strip() for p in m.group(2).split(",") if p.strip()]
            ctx.extra[m.group(1)] = _function(m.group(1), names, text[m.end() : end - 1])
            at = end
        elif m := CONSTANT.match(text, at):
            value = m.group(2)
            ctx.extra[m.group(1)] = lambda c, value=value: compile_js(c, value)
            at = m.end()
        else:
            raise ExpressionError(f"a script has functions and constants alone: {text[at : at + 60].strip()!r}")
    return ctx


def _function(name: str, names: list[str], body: str):
    def call(ctx: Context, *args: Value) -> Value:
        if len(args) != len(names):
            raise ExpressionError(f"{name} takes {len(names)} arguments, not {len(args)}")
        own = copy.copy(ctx)
        own.extra = {**{k: v for k, v in ctx.extra.items() if k != name}, **{n: lambda c, v=v: v for n, v in zip(names, args)}}
        return compile_js(own, body)

    return call


def load(ctx: Context, spec: str) -> Context:
    """``ctx`` with a script: its text, or ``file:`` and its path."""
    if spec.startswith("file:"):
        with open(spec.removeprefix("file:")) as f:
            spec = f.read()
    return define(ctx, spec)
