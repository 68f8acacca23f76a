"""Column names of tables that callers own: any characters, and any name that an operator adds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name as SQL reads it: dots and backticks are part of it."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def source(docs: DataFrame, name: str) -> Column:
    """A column of ``docs`` by its name, or by a path into a struct where no column has that name."""
    return named(name) if name in docs.columns else F.col(name)


def fresh(name: str, taken: list[str]) -> str:
    """The name, or with as many underscores after it as make it none of ``taken`` (capitals don't count)."""
    others = {t.lower() for t in taken}
    while name.lower() in others:
        name += "_"
    return name


@dataclass(frozen=True)
class Carried:
    """Columns to carry through a function over Arrow batches: there they are c0, c1, ..., afterwards they have their names."""

    columns: list[Column]
    inner: list[str]
    names: list[str]


def carried(docs: DataFrame, carry: list[str] | None, added: list[str]) -> Carried:
    """The columns to carry (all by default); one named like an added column gets an underscore after its name."""
    wanted = docs.columns if carry is None else carry
    taken = {a.lower() for a in added}
    names = [fresh(c, [*added, *(x for x in wanted if x != c)]) if c.lower() in taken else c for c in wanted]
    inner = [f"c{k}" for k in range(len(wanted))]
    return Carried([named(c).alias(i) for c, i in zip(wanted, inner, strict=True)], inner, names)
