"""Structured questions over declared entities, compiled to DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silthouse.functions.text import number

OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "contains", "in", "between", "is_null", "not_null")
MOST_VALUES = 200


class SemanticError(ValueError):
    """A question that the model can't answer."""


@dataclass(frozen=True)
class Dimension:
    name: str
    column: str
    kind: str = "text"  # text, number or date
    groupable: bool = True


@dataclass(frozen=True)
class Enrich:
    """A dimension table: its fields are grouping keys by way of a key column."""

    name: str
    table: str
    on: str
    key: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    dimensions: tuple[Dimension, ...]
    enrich: tuple[Enrich, ...] = ()

    def dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.name == name:
                return d
        raise SemanticError(f"{self.name} has no {name}; it has {', '.join(d.name for d in self.dimensions)}")


@dataclass
class Question:
    entity: str
    measures: list[str] = field(default_factory=lambda: ["count"])
    dimensions: list[str] = field(default_factory=list)
    filters: list[tuple] = field(default_factory=list)
    enrich: list[str] = field(default_factory=list)  # "name.field"
    order: str | None = None
    descending: bool = True
    limit: int | None = None


def _filter(d: Dimension, op: str, value) -> Column:
    c = F.col(d.column)
    if op not in OPERATORS:
        raise SemanticError(f"unknown operator {op}")
    if op in ("is_null", "not_null"):
        empty = F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
        return empty if op == "is_null" else ~empty
    if op in (">", "<", ">=", "<=", "between"):
        if d.kind == "text":
            raise SemanticError(f"{d.name} is text, which has no ranges")
        c = number(c).cast("double") if d.kind == "number" else c.cast("date")
        put = (lambda v: F.lit(float(v))) if d.kind == "number" else (lambda v: F.lit(str(v)).cast("date"))
        if op == "between":
            if not isinstance(value, (list, tuple)) or len(value) != 2:
                raise SemanticError("between takes two values")
            return c.between(put(value[0]), put(value[1]))
        return {">": c > put(value), "<": c < put(value), ">=": c >= put(value), "<=": c <= put(value)}[op]
    text = F.trim(c.cast("string"))
    if op == "contains":
        return text.ilike(f"%{value}%")
    if op == "in":
        if len(value) > MOST_VALUES:
            raise SemanticError(f"at most {MOST_VALUES} values")
        return text.isin([str(v).strip() for v in value])
    if d.kind == "number":
        equal = number(c).cast("double") == float(value)
    elif d.kind == "date":
        equal = c.cast("date") == F.lit(str(value)).cast("date")
    else:
        equal = text == str(value).strip()
    return equal if op == "=" else ~F.coalesce(equal, F.lit(False))


def _measure(entity: Entity, m: str) -> Column:
    if m == "count":
        return F.count(F.lit(1)).alias("count")
    how, _, name = m.partition(":")
    d = entity.dimension(name)
    if how not in ("sum", "avg", "min", "max"):
        raise SemanticError(f"unknown measure {m}")
    if how in ("sum", "avg") and d.kind != "number":
        raise SemanticError(f"{name} is no number")
    value = number(F.col(d.column)) if d.kind == "number" else F.col(d.column)
    found = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how](value)
    return (found.cast("double") if d.kind == "number" else found).alias(f"{how}_{name}")


def validate(model: dict[str, Entity], q: Question) -> Entity:
    """The entity of a question, if everything that it names is there."""
    if q.entity not in model:
        raise SemanticError(f"no entity {q.entity}")
    entity = model[q.entity]
    for name in q.dimensions:
        if not entity.dimension(name).groupable:
            raise SemanticError(f"{name} can't be grouped by")
    for name in q.enrich:
        own, _, f = name.partition(".")
        if not any(e.name == own and f in e.fields for e in entity.enrich):
            raise SemanticError(f"{q.entity} has no {name}")
    for name, op, *value in q.filters:
        _filter(entity.dimension(name), op, value[0] if value else None)
    for m in q.measures:
        _measure(entity, m)
    return entity


def compiled(model: dict[str, Entity], tables: dict[str, DataFrame], q: Question) -> DataFrame:
    """The plan of a question: filters, enriching joins with small dimensions, one grouping."""
    entity = validate(model, q)
    rows = tables[entity.table]
    tests = [_filter(entity.dimension(name), op, value[0] if value else None) for name, op, *value in q.filters]
    rows = rows.filter(reduce(and_, tests, F.lit(True)))
    keys = [(F.trunc(d.column, "month") if d.kind == "date" else F.col(d.column)).alias(d.name) for d in map(entity.dimension, q.dimensions)]
    for e in {n.partition(".")[0] for n in q.enrich}:
        own = next(x for x in entity.enrich if x.name == e)
        fields = [n.partition(".")[2] for n in q.enrich if n.startswith(f"{e}.")]
        small = tables[own.table].select(F.col(own.key).alias(f"_{e}"), *(F.col(f).alias(f"{e}_{f}") for f in fields))
        rows = rows.join(small, rows[own.on] == small[f"_{e}"], "left")
        keys += [F.col(f"{e}_{f}") for f in fields]
    measures = [_measure(entity, m) for m in q.measures]
    out = rows.groupBy(*keys).agg(*measures) if keys else rows.agg(*measures)
    if keys:
        order = q.order if q.order in out.columns else q.measures[0].replace(":", "_")
        down = q.descending if q.order in out.columns else True
        out = out.orderBy(F.col(order).desc_nulls_last() if down else F.col(order).asc_nulls_last(), *(F.col(c) for c in out.columns if c != order))
    return out.limit(q.limit) if q.limit else out


def cross(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two aggregates with one row for each key, side by side: grouped before the join, so that nothing is counted twice."""
    return a.join(b, key, "full_outer")


def explain(q: Question) -> str:
    """The question as a sentence."""
    parts = [f"{', '.join(m.replace(':', ' of ') for m in q.measures)} of {q.entity}"]
    if q.dimensions or q.enrich:
        parts.append(f"by {', '.join([*q.dimensions, *q.enrich])}")
    if q.filters:
        parts.append("where " + " and ".join(f"{n} {o} {v[0] if v else ''}".strip() for n, o, *v in q.filters))
    return " ".join(parts)
