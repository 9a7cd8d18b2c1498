"""Dual numbers as pairs of Columns: a value and its derivative along one direction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dual:
    val: Column
    eps: Column

    @staticmethod
    def lift(x) -> Dual:
        """A dual as it is; a Column or number with no derivative."""
        return x if isinstance(x, Dual) else Dual(x if isinstance(x, Column) else F.lit(float(x)), F.lit(0.0))

    def _chain(self, val: Column, slope: Column) -> Dual:
        return Dual(val, slope * self.eps)

    def __add__(self, o) -> Dual:
        o = Dual.lift(o)
        return Dual(self.val + o.val, self.eps + o.eps)

    __radd__ = __add__

    def __neg__(self) -> Dual:
        return Dual(-self.val, -self.eps)

    def __sub__(self, o) -> Dual:
        return self + -Dual.lift(o)

    def __rsub__(self, o) -> Dual:
        return Dual.lift(o) - self

    def __mul__(self, o) -> Dual:
        o = Dual.lift(o)
        return Dual(self.val * o.val, self.eps * o.val + self.val * o.eps)

    __rmul__ = __mul__

    def __truediv__(self, o) -> Dual:
        o = Dual.lift(o)
        return Dual(self.val / o.val, (self.eps * o.val - self.val * o.eps) / (o.val * o.val))

    def __rtruediv__(self, o) -> Dual:
        return Dual.lift(o) / self

    def __pow__(self, k: float) -> Dual:
        return self._chain(self.val**k, k * self.val ** (k - 1))

    def sqrt(self) -> Dual:
        root = F.sqrt(self.val)
        return self._chain(root, 0.5 / root)

    def exp(self) -> Dual:
        return self._chain(F.exp(self.val), F.exp(self.val))

    def log(self) -> Dual:
        return self._chain(F.log(self.val), 1 / self.val)

    def sin(self) -> Dual:
        return self._chain(F.sin(self.val), F.cos(self.val))

    def cos(self) -> Dual:
        return self._chain(F.cos(self.val), -F.sin(self.val))

    def erf(self) -> Dual:
        from plumbline.functions.numeric import normal_cdf

        return self._chain(2 * normal_cdf(self.val * 2**0.5) - 1, F.lit(2 / 3.141592653589793**0.5) * F.exp(-self.val * self.val))


def along(x: Column, direction: float = 1.0) -> Dual:
    """A variable, with its part of the direction."""
    return Dual(x, F.lit(float(direction)))


def total(terms: list[Dual]) -> Dual:
    out = Dual.lift(0.0)
    for t in terms:
        out = out + t
    return out
