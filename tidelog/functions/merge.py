"""Merge operators by name.

An operator folds operands, oldest first, on an optional base value. Commutative ones also
give a reducing aggregate, so Spark can aggregate partially before the shuffle; the others
fold a sorted array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MergeOperator:
    name: str
    fold: Callable[[Column, Column], Column]  # (base or null, array of operands) -> value
    reduces: Callable[[Column], Column] | None = None  # aggregate of operands
    combine: Callable[[Column, Column], Column] | None = None  # (base or null, aggregate or null) -> value
    last_wins: bool = False  # only the newest operand counts


def _wrap(x: Column) -> Column:
    """Wrap-around as of unsigned 64-bit addition, as decimal."""
    return F.pmod(x.cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")).cast("decimal(20,0)")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(38,0)")).cast("decimal(38,0)"))


def uint64add() -> MergeOperator:
    """Base plus the sum of operands, modulo 2^64; a missing base counts as 0."""
    zero = F.lit(0).cast("decimal(38,0)")
    return MergeOperator(
        "uint64add",
        lambda base, xs: _wrap(F.coalesce(base.cast("decimal(38,0)"), zero) + _sum(xs)),
        lambda x: F.sum(x.cast("decimal(20,0)")),
        lambda base, s: F.when(base.isNotNull() | s.isNotNull(), _wrap(F.coalesce(base.cast("decimal(38,0)"), zero) + F.coalesce(s.cast("decimal(38,0)"), zero))),
    )


def maximum() -> MergeOperator:
    """The greatest of base and operands (bytewise for binary and strings)."""
    return MergeOperator("max", lambda base, xs: F.array_max(F.concat(F.array(base), xs)), F.max, lambda base, m: F.greatest(base, m))


def put() -> MergeOperator:
    """The last operand, or the base if there is none."""
    return MergeOperator("put", lambda base, xs: F.coalesce(F.get(xs, F.size(xs) - 1), base), last_wins=True)


def stringappend(delimiter: str = ",") -> MergeOperator:
    """Base and operands joined by a delimiter."""
    return MergeOperator("stringappend", lambda base, xs: F.array_join(F.concat(F.array(base.cast("string")), F.transform(xs, lambda x: x.cast("string"))), delimiter))


def sortlist() -> MergeOperator:
    """Comma lists of integers merged into one sorted list, repeats kept; the base is not read if there are operands."""
    numbers = lambda xs: F.flatten(F.transform(xs, lambda x: F.transform(F.split(x.cast("string"), ","), lambda n: n.cast("long"))))
    return MergeOperator("sortlist", lambda base, xs: F.when(F.size(xs) == 0, base.cast("string")).otherwise(F.array_join(F.transform(F.array_sort(numbers(xs)), lambda n: n.cast("string")), ",")))


def bitxor() -> MergeOperator:
    """Exclusive or of whole numbers (for byte strings see scalars.xor_bytes)."""
    return MergeOperator(
        "bytesxor", lambda base, xs: F.aggregate(xs, F.coalesce(base, F.lit(0).cast("long")), lambda a, x: a.bitwiseXOR(x)), F.bit_xor,
        lambda base, m: F.when(base.isNotNull() | m.isNotNull(), F.coalesce(base, F.lit(0)).bitwiseXOR(F.coalesce(m, F.lit(0)))),
    )


def user(name: str, step: Callable[[Column, Column], Column]) -> MergeOperator:
    """A user's associative operator: step(existing, operand), the first value being taken as it is."""

    def fold(base: Column, xs: Column) -> Column:
        every = F.filter(F.concat(F.array(base), xs), lambda x: x.isNotNull())
        return F.aggregate(F.slice(every, 2, F.greatest(F.size(every), F.lit(1))), F.get(every, 0), step)

    return MergeOperator(name, fold)


REGISTRY: dict[str, Callable[[], MergeOperator]] = {
    "uint64add": uint64add, "max": maximum, "put": put, "put_v1": put, "stringappend": stringappend, "stringappendtest": stringappend, "sortlist": sortlist, "bytesxor": bitxor,
}


def by_name(name: str) -> MergeOperator:
    if name not in REGISTRY:
        raise ValueError(f"no merge operator {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]()
