"""Nested structs to columns with dotted names, and back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType


def leaves(schema: StructType, above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """Path and type of every field that is no struct, in order."""
    for field in schema.fields:
        path = (*above, field.name)
        if isinstance(field.dataType, StructType):
            yield from leaves(field.dataType, path)
        else:
            yield path, field.dataType


def _at(path: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{p.replace('`', '``')}`" for p in path))


def flat(rows: DataFrame) -> DataFrame:
    """A column for every leaf, named by its path with dots; below a null struct they are null."""
    return rows.select(*[_at(path).alias(".".join(path)) for path, _ in leaves(rows.schema)])


def nest(rows: DataFrame) -> DataFrame:
    """Columns whose names have dots as structs; what shares a first part is one struct, at the place of its first column."""

    def build(paths: list[tuple[tuple[str, ...], Column]]) -> list[Column]:
        heads = dict.fromkeys(p[0] for p, _ in paths)
        out = []
        for head in heads:
            below = [(p[1:], c) for p, c in paths if p[0] == head]
            if any(not p for p, _ in below) and len(below) > 1:
                raise ValueError(f"{head} is both a value and a branch")
            out.append((below[0][1] if not below[0][0] else F.struct(*build(below))).alias(head))
        return out

    return rows.select(*build([(tuple(c.split(".")), _at((c,))) for c in rows.columns]))


def metrics(rows: DataFrame, prefix: str = "", keep: tuple[str, ...] | None = None) -> DataFrame:
    """metric, value of every number of a one-row document, by its dotted name; nulls are left out, as is what isn't in ``keep``."""
    names = [".".join(p) for p, kind in leaves(rows.schema) if isinstance(kind, NumericType)]
    names = [n for n in names if keep is None or n in keep]
    wide = rows.select(*[_at(tuple(n.split("."))).cast("double").alias(f"{prefix}{n}") for n in names])
    quoted = [F.col(f"`{prefix}{n}`") for n in names]
    return wide.unpivot([], quoted, "metric", "value").where("value is not null")
