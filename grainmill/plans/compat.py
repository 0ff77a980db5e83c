"""Queries of the small grammar as DataFrames, with the compatible results: 32-bit sums,
truncated averages, no row for aggregates over nothing, join keys of mixed type by digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators import relational as rel
from grainmill.plans.grammar import Call, Literal, Name, Op, Select, SqlError, Star
from grainmill.sources.catalog import Catalog


def value(df: DataFrame, expr: object) -> Column:
    """A column or literal."""
    if isinstance(expr, Name):
        return rel.column(df, expr.name)
    if isinstance(expr, Literal):
        return F.lit(expr.value)
    raise SqlError(f"not a value: {expr}")


def predicate(df: DataFrame, expr: object) -> Column:
    """A condition."""
    if not isinstance(expr, Op):
        raise SqlError(f"not a condition: {expr}")
    if expr.sign in ("AND", "OR", "NOT"):
        parts = [predicate(df, e) for e in expr.operands]
        made = ~parts[0] if expr.sign == "NOT" else parts[0]
        for part in parts[1:]:
            made = made & part if expr.sign == "AND" else made | part
        return made
    a, b = (value(df, e) for e in expr.operands)
    return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[expr.sign]


def relation(catalog: Catalog, query: Select) -> DataFrame:
    """FROM, JOIN and WHERE."""
    df = rel.scan(catalog.table(query.source.table), query.source.alias)
    for source, on in query.joins:
        right = rel.scan(catalog.table(source.table), source.alias)
        if not isinstance(on, Op) or on.sign != "=":
            raise SqlError("ON takes one equality")
        keys = [e.name if isinstance(e, Name) else value(df, e) for e in on.operands]
        df = rel.join_on(df, right, *keys)
    return df if query.where is None else rel.where(df, predicate(df, query.where))


def name_of(expr: object, alias: str | None) -> str:
    """Output name: the alias, the bare column, the aggregate's name, or ``?``."""
    return alias or (expr.name.rpartition(".")[2] if isinstance(expr, Name) else expr.function if isinstance(expr, Call) else "?")


def _sorted(df: DataFrame, order: list[tuple[object, bool]]) -> DataFrame:
    keys = [(e.name if isinstance(e, Name) else value(df, e), up) for e, up in order if not isinstance(e, Literal)]
    return rel.order_by(df, keys) if keys else df


def planned(catalog: Catalog, query: Select) -> DataFrame:
    """The query's DataFrame."""
    df = relation(catalog, query)
    calls = [e for e, _ in query.items if isinstance(e, Call)]
    if calls or query.group_by:
        return _grouped(df, query)
    if len(query.items) == 1 and isinstance(query.items[0][0], Star):
        return _sorted(df, query.order_by)
    aliases = {alias: e for e, alias in query.items if alias}
    order = []
    for key, up in query.order_by:  # an alias may be sorted by where no column has its name
        if isinstance(key, Name) and key.name in aliases:
            try:
                rel.resolve(df, key.name)
            except ValueError:
                key = aliases[key.name]
        order.append((key, up))
    df = _sorted(df, order)
    items: list[tuple[Column, str]] = []
    for expr, alias in query.items:
        if isinstance(expr, Star):
            items += [(F.col(f"`{c}`"), c) for c in df.columns]
        else:
            items.append((value(df, expr), name_of(expr, alias)))
    return rel.project(df, items)


def _grouped(df: DataFrame, query: Select) -> DataFrame:
    keys = [k.name for k in query.group_by]
    places = [rel.resolve(df, k) for k in keys]
    aggregates, shown = [], []
    for expr, alias in query.items:
        if isinstance(expr, Call):
            argument = None if isinstance(expr.argument, Star) else value(df, expr.argument)
            shown.append((f"a{len(aggregates)}", name_of(expr, alias)))
            aggregates.append(rel.Aggregate(expr.function, argument, f"a{len(aggregates)}"))
        elif isinstance(expr, Name) and rel.resolve(df, expr.name) in places:
            shown.append((f"k{places.index(rel.resolve(df, expr.name))}", name_of(expr, alias)))
        else:
            raise SqlError(f"MISSING_AGGREGATION: {name_of(expr, None)} is neither grouped nor aggregated")
    out = rel.aggregate(df, keys, aggregates, compat=True)
    out = out.toDF(*[f"k{i}" for i in range(len(keys))], *[a.name for a in aggregates])
    order = []
    for expr, up in query.order_by:
        if isinstance(expr, Literal):
            continue
        if isinstance(expr, Call):
            argument = next((f"a{calls}" for calls, e in enumerate(e for e, _ in query.items if isinstance(e, Call)) if e == expr), None)
            if argument is None:
                raise SqlError("ORDER BY takes aggregates of the SELECT list")
            order.append((F.col(argument), up))
            continue
        named = [c for c, name in shown if name == expr.name]
        if named:
            order.append((F.col(named[0]), up))
        else:
            order.append((F.col(f"k{places.index(rel.resolve(df, expr.name))}"), up))
    if order:
        out = rel.order_by(out, order)
    return rel.project(out, [(F.col(c), name) for c, name in shown])
