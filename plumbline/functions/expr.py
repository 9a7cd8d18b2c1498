"""Derived-quantity expressions: a small closed tree with JSON form, SQL text, and symbolic partial derivatives."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.numeric import lit


@dataclass(frozen=True)
class Expr:
    """op is one of const, var, add, sub, mul, neg, ssum, mean; args are sub-expressions, value the constant or name.

    ``ssum`` is a constant plus scaled terms (scales in ``value[1:]``) and may be empty; ``mean`` needs a term.
    """

    op: str
    args: tuple[Expr, ...] = ()
    value: object = None

    def __post_init__(self):
        arity = {"const": 0, "var": 0, "add": 2, "sub": 2, "mul": 2, "neg": 1}
        if self.op not in arity and self.op not in ("ssum", "mean"):
            raise ValueError(f"unknown operation {self.op}")
        if self.op in arity and len(self.args) != arity[self.op] or self.op == "mean" and not self.args:
            raise ValueError(f"{self.op} has {len(self.args)} terms")

    def __add__(self, o: Expr) -> Expr:
        return Expr("add", (self, o))

    def __sub__(self, o: Expr) -> Expr:
        return Expr("sub", (self, o))

    def __mul__(self, o: Expr) -> Expr:
        return Expr("mul", (self, o))

    def __neg__(self) -> Expr:
        return Expr("neg", (self,))

    def variables(self) -> list[str]:
        own = {self.value} if self.op == "var" else set()
        return sorted(own.union(*(a.variables() for a in self.args)))

    def sql(self) -> str:
        a = [x.sql() for x in self.args]
        match self.op:
            case "const":
                return lit(float(self.value))
            case "var":
                return str(self.value)
            case "add" | "sub" | "mul":
                return f"({a[0]} {dict(add='+', sub='-', mul='*')[self.op]} {a[1]})"
            case "neg":
                return f"(-{a[0]})"
            case "ssum":
                return "(" + " + ".join([lit(self.value[0]), *(f"{lit(c)} * {t}" for c, t in zip(self.value[1:], a, strict=True))]) + ")"
            case _:
                return f"(({' + '.join(a)}) / {lit(len(a))})"

    def partial(self, name: str) -> Expr:
        """The derivative with respect to one variable."""
        d = [x.partial(name) for x in self.args]
        match self.op:
            case "const":
                return const(0.0)
            case "var":
                return const(1.0 if self.value == name else 0.0)
            case "mul":
                return _plus(_times(d[0], self.args[1]), _times(self.args[0], d[1]))
            case "add":
                return _plus(d[0], d[1])
            case "sub":
                return _plus(d[0], _times(const(-1.0), d[1]))
            case "neg":
                return _times(const(-1.0), d[0])
            case "ssum":
                return Expr("ssum", tuple(d), (0.0, *self.value[1:]))
            case _:
                return Expr("mean", tuple(d))

    def terms(self) -> list[tuple[float, tuple[str, ...]]]:
        """The expression as a sum of products: (coefficient, variables), equal products taken together."""
        a = [x.terms() for x in self.args]
        scaled = lambda ts, c: [(c * k, v) for k, v in ts]
        match self.op:
            case "const":
                out = [(float(self.value), ())]
            case "var":
                out = [(1.0, (str(self.value),))]
            case "mul":
                out = [(x * y, tuple(sorted(v + w))) for x, v in a[0] for y, w in a[1]]
            case "neg":
                out = scaled(a[0], -1.0)
            case "sub":
                out = a[0] + scaled(a[1], -1.0)
            case "ssum":
                out = [(float(self.value[0]), ()), *(t for c, ts in zip(self.value[1:], a, strict=True) for t in scaled(ts, float(c)))]
            case _:
                out = [t for ts in a for t in scaled(ts, 1.0 / len(a) if self.op == "mean" else 1.0)]
        joint: dict[tuple[str, ...], float] = {}
        for c, v in out:
            joint[v] = joint.get(v, 0.0) + c
        return [(c, v) for v, c in sorted(joint.items()) if c != 0.0 or not v]

    def column(self) -> Column:
        return F.expr(self.sql())

    def to_json(self) -> str:
        return json.dumps(self._object(), sort_keys=True, separators=(",", ":"))

    def _object(self) -> dict:
        return {"op": self.op} | ({"args": [a._object() for a in self.args]} if self.args else {}) | ({} if self.value is None else {"value": self.value})

    @staticmethod
    def from_json(text: str) -> Expr:
        def build(o: dict) -> Expr:
            if set(o) - {"op", "args", "value"}:
                raise ValueError(f"unknown fields {sorted(set(o) - {'op', 'args', 'value'})}")
            v = o.get("value")
            return Expr(o["op"], tuple(build(a) for a in o.get("args", [])), tuple(v) if isinstance(v, list) else v)

        return build(json.loads(text))


def const(x: float) -> Expr:
    return Expr("const", (), float(x))


def var(name: str) -> Expr:
    return Expr("var", (), name)


def scaled_sum(terms: list[tuple[float, Expr]], constant: float = 0.0) -> Expr:
    return Expr("ssum", tuple(t for _, t in terms), (float(constant), *(float(c) for c, _ in terms)))


def mean(*terms: Expr) -> Expr:
    return Expr("mean", terms)


def _is(e: Expr, x: float) -> bool:
    return e.op == "const" and e.value == x


def _plus(a: Expr, b: Expr) -> Expr:
    return b if _is(a, 0.0) else a if _is(b, 0.0) else a + b


def _times(a: Expr, b: Expr) -> Expr:
    return const(0.0) if _is(a, 0.0) or _is(b, 0.0) else b if _is(a, 1.0) else a if _is(b, 1.0) else a * b
