"""Semantic queries: named dimensions and metrics become one DataFrame plan.

Every metric is aggregated at the grain of its own entity, and only aggregates of different
entities are put side by side, so no metric is multiplied by another entity's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panel360.functions import div0
from panel360.plans.semantic_model import (
    COMPANIONS,
    MODEL,
    Dimension,
    Entity,
    Measure,
    Metric,
    SemanticModel,
)
from panel360.sources.literals import inline_rows

TERM_SCHEMA = T.StructType([T.StructField(name, T.StringType())
                            for name in ("term", "kind", "entity", "name")])


class SemanticError(ValueError):
    """An unknown or ambiguous name, or a dimension below the grain of a metric."""


def _entity(model: SemanticModel, name: str) -> Entity:
    return next(e for e in model.entities if e.name == name)


def _pick(items: Sequence[Any], name: str, kind: str):
    """An item by `entity.name`, by name, or by a synonym that is not ambiguous."""
    entity, _, bare = name.rpartition(".")
    exact = [i for i in items if i.name == bare and entity in ("", i.entity)]
    if not exact:
        exact = [i for i in items if bare.lower() in [s.lower() for s in i.synonyms]
                 and entity in ("", i.entity)]
    if len(exact) != 1:
        raise SemanticError(f"{'ambiguous' if exact else 'unknown'} {kind} {name!r}")
    return exact[0]


def _one_to_one(model: SemanticModel, child: str) -> bool:
    return any(r.child == child and _entity(model, child).primary_key == r.key
               for r in model.relationships)


def dimension(model: SemanticModel, name: str) -> Dimension:
    """A dimension by name. A parent's key may be asked for through a child in a one-to-one
    relationship (`risk.patient_id`)."""
    entity, _, bare = name.rpartition(".")
    if entity and _one_to_one(model, entity) and bare == _entity(model, entity).primary_key:
        parent = next(r.parent for r in model.relationships if r.child == entity)
        return _pick(model.dimensions, f"{parent}.{bare}", "dimension")
    return _pick(model.dimensions, name, "dimension")


def metric(model: SemanticModel, name: str) -> Metric:
    return _pick(model.metrics, name, "metric")


def _reachable(model: SemanticModel, entity: str) -> set[str]:
    """Entities whose dimensions an entity's metrics can be cut by: itself, its parent, and the
    one-to-one partners of that parent."""
    parents = {r.parent for r in model.relationships if r.child == entity} or {entity}
    partners = {r.child for r in model.relationships
                if r.parent in parents and _one_to_one(model, r.child)}
    return {entity} | parents | partners


def _whole(measure: Measure) -> Column:
    value = F.expr(measure.sql)
    return {"sum": F.sum, "count": F.count, "distinct": F.count_distinct}[measure.kind](value)


def _value(m: Metric, parts: Mapping[Measure, Column]) -> Column:
    top = parts[m.numerator]
    if m.denominator is None:
        return top
    bottom = parts[m.denominator]
    if m.zero_safe:
        return div0(top, bottom)
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def _values(wanted: Any) -> list:
    return list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]


# Entities whose metrics can be read off one row per patient: patients, their one score and their
# open gaps, which that row counts.
ONE_PASS, GAP_COUNT = ("patient", "risk", "gaps"), "open_gap_rows"


def _one_pass_result(model: SemanticModel, wide: DataFrame, metrics: Sequence[Metric],
                     dims: Sequence[Dimension], where: Sequence[tuple[Dimension, Any]]) -> DataFrame:
    """Metrics of several entities from one scan of `wide`, which has a row per patient: its key is
    unique, so a distinct count of it is a plain count, and gap rows are counted in a column."""
    used = {d.name: d for d in [*dims, *[d for d, _ in where]]}.values()
    rows = wide.withColumns({d.name: F.expr(d.sql) for d in used}) if used else wide
    for d, wanted in where:
        rows = rows.filter(F.col(d.name).isin(_values(wanted)))
    measures = list(dict.fromkeys((m.entity, x) for m in metrics
                                  for x in (m.numerator, m.denominator) if x))

    def whole(entity: str, x: Measure) -> Column:
        if entity == "gaps":  # a group without gap rows has no value
            total = F.sum(GAP_COUNT) if x.kind == "count" else F.count_if(F.col(GAP_COUNT) > 0)
            return F.nullif(total, F.lit(0).cast("long"))
        return (F.sum if x.kind == "sum" else F.count)(F.expr(x.sql))

    summed = rows.groupBy(*[d.name for d in dims]).agg(
        *[whole(*x).alias(f"_m{i}") for i, x in enumerate(measures)])
    place = {x: F.col(f"_m{i}") for i, x in enumerate(measures)}
    return summed.select(*[d.name for d in dims], *[_value(m, {
        x: place[m.entity, x] for x in (m.numerator, m.denominator) if x}).alias(m.name)
        for m in metrics])


def _fits_one_pass(tables: Mapping[str, DataFrame], metrics: Sequence[Metric],
                   dims: Sequence[Dimension]) -> bool:
    """Whether a wide table is at hand, attributes are all a patient's own, and every gap measure is a
    count of rows or of patients."""
    return ("patient_wide" in tables and all(d.entity in ("patient", "risk") for d in dims)
            and all(x.when is None and (x.kind == "count" or x.kind == "distinct" and
                                        x.expr == "patient_id")
                    for m in metrics if m.entity == "gaps" for x in (m.numerator, m.denominator) if x)
            and all(x.expr == "patient_id" for m in metrics if m.entity != "gaps"
                    for x in (m.numerator, m.denominator) if x and x.kind == "distinct"))


def _entity_result(model: SemanticModel, tables: Mapping[str, DataFrame], entity: Entity,
                   metrics: Sequence[Metric], dims: Sequence[Dimension],
                   where: Sequence[tuple[Dimension, Any]]) -> DataFrame:
    key = next((r.key for r in model.relationships if r.child == entity.name), entity.primary_key)
    used = {d.name: d for d in [*dims, *[d for d, _ in where]]}.values()
    carried = set(entity.carries) & set(tables[entity.table].columns)
    own = [d for d in used if d.entity == entity.name or d.name in carried]
    # The parent's key is a column of the entity itself, as are the attributes it carries.
    outer = [d for d in used if d not in own and d.name != key]
    measures = list(dict.fromkeys(x for m in metrics for x in (m.numerator, m.denominator) if x))
    rows = tables[entity.table]
    by = [d.name for d in dims]

    def admit(df: DataFrame) -> DataFrame:
        for d, wanted in where:
            df = df.filter(F.col(d.name).isin(_values(wanted)))
        return df

    # Derived columns are named apart from the table's own ones.
    own_columns = {d.name: F.expr(d.sql) for d in own}
    if not outer:
        kept = admit(rows.withColumns(own_columns) if own_columns else rows)
        parts = {x: F.col(f"_m{i}") for i, x in enumerate(measures)}
        summed = kept.groupBy(*by).agg(*[_whole(x).alias(f"_m{i}")
                                         for i, x in enumerate(measures)])
        return summed.select(*by, *[_value(m, parts).alias(m.name) for m in metrics])

    # Attributes: the parent's and its partners' dimensions, one row per key.
    attributes = None
    for name in sorted({d.entity for d in outer}):
        side = tables[_entity(model, name).table].select(
            key, *[F.expr(d.sql).alias(d.name) for d in outer if d.entity == name])
        attributes = side if attributes is None else attributes.join(side, key, "left")
    asked_outside = [d for d, _ in where if d in outer]
    if asked_outside:
        # A condition on an attribute keeps the facts of admitted keys only, before any sub-total.
        admitted = attributes
        for d, wanted in where:
            if d in outer:
                admitted = admitted.filter(F.col(d.name).isin(_values(wanted)))
        rows = rows.join(admitted.select(key), key, "left_semi")
    # Sub-totals per key first. A distinct count keeps its key in the grouping, so it stays exact.
    keyed = [x.expr for x in measures if x.kind == "distinct" and x.expr != key]
    groups = list(dict.fromkeys([key, *[d.name for d in own], *keyed]))
    partial, final = [], {}
    for i, x in enumerate(measures):
        name = f"_m{i}"
        if x.kind == "distinct":
            held = F.expr(x.when) if x.when else F.lit(True)
            partial.append(F.bool_or(held).alias(name))
            final[x] = F.count_distinct(F.when(F.col(name), F.col(x.expr)))
        else:
            partial.append(_whole(x).alias(name))
            final[x] = F.sum(name)
    subtotals = (rows.withColumns(own_columns) if own_columns else rows).groupBy(*groups).agg(
        *partial)
    joined = admit(subtotals.join(attributes, key, "left"))
    summed = joined.groupBy(*by).agg(*[final[x].alias(f"_t{i}") for i, x in enumerate(measures)])
    parts = {x: F.col(f"_t{i}") for i, x in enumerate(measures)}
    return summed.select(*by, *[_value(m, parts).alias(m.name) for m in metrics])


def with_companions(dimensions: Sequence[str], metrics: Sequence[str] = ()) -> list[str]:
    """The dimensions, plus those that must accompany them."""
    names = list(dimensions)
    bare = {n.rpartition(".")[2] for n in names}
    for name in [*bare, *[m.rpartition(".")[2] for m in metrics]]:
        extra, grain = COMPANIONS.get(name, (None, None))
        if extra and extra not in bare and (grain is None or grain in bare):
            names.append(extra)
            bare.add(extra)
    return names


def semantic_query(tables: Mapping[str, DataFrame], dimensions: Sequence[str],
                   metrics: Sequence[str], where: Mapping[str, Any] | None = None,
                   order_by: Sequence[tuple[str, str]] = (), limit: int | None = None,
                   companions: bool = False, model: SemanticModel = MODEL) -> DataFrame:
    """Metrics by dimensions.

    `where` maps dimension names to a value or a list of values and is applied before aggregation.
    Results of several entities are merged by adding them to one table and grouping it by the
    dimensions: NULL dimension values meet, and an entity without rows for a group gives NULL.
    """
    if companions:
        dimensions = with_companions(dimensions, metrics)
    dims = list({d.name: d for d in (dimension(model, n) for n in dimensions)}.values())
    asked = [metric(model, n) for n in metrics]
    if not asked:
        raise SemanticError("at least one metric is required")
    conditions = [(dimension(model, n), v) for n, v in (where or {}).items()]
    results = []
    for name in dict.fromkeys(m.entity for m in asked):
        reachable = _reachable(model, name)
        for d in [*dims, *[d for d, _ in conditions]]:
            if d.entity not in reachable:
                raise SemanticError(f"{d.entity}.{d.name} is below the grain of {name} metrics")
    together = [m for m in asked if m.entity in ONE_PASS]
    if not _fits_one_pass(tables, together, [*dims, *[d for d, _ in conditions]]):
        together = []
    if together:
        results.append(_one_pass_result(model, tables["patient_wide"], together, dims, conditions))
    for name in dict.fromkeys(m.entity for m in asked if m not in together):
        results.append(_entity_result(model, tables, _entity(model, name),
                                      [m for m in asked if m.entity == name], dims, conditions))
    merged = results[0]
    if len(results) > 1:
        for more in results[1:]:
            merged = merged.unionByName(more, allowMissingColumns=True)
        merged = merged.groupBy(*[d.name for d in dims]).agg(
            *[F.max(m.name).alias(m.name) for m in asked])
    merged = merged.select(*[d.name for d in dims], *[m.name for m in asked])
    if order_by:
        merged = merged.orderBy(*[F.desc_nulls_last(n) if way == "desc" else F.asc_nulls_last(n)
                                  for n, way in order_by])
    return merged if limit is None else merged.limit(limit)


def normalise(term: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(term, r"[ \t\n]+", " ")))


def term_table(spark: SparkSession, model: SemanticModel = MODEL) -> DataFrame:
    """Every name and synonym with what it stands for; an ambiguous term has several rows."""
    rows = [(term.lower(), kind, item.entity, item.name)
            for kind, items in (("dimension", model.dimensions), ("metric", model.metrics))
            for item in items
            for term in dict.fromkeys((item.name, item.name.replace("_", " "), *item.synonyms))]
    rows += [(term.lower(), "entity", e.name, e.name)
             for e in model.entities for term in dict.fromkeys((e.name, *e.synonyms))]
    return inline_rows(spark, TERM_SCHEMA, sorted(set(rows)))


def resolve_terms(terms: DataFrame, table: DataFrame, column: str = "term") -> DataFrame:
    """User terms with the names they resolve to; unknown terms have NULL names."""
    asked = terms.withColumn("_norm", normalise(F.col(column)))
    known = table.select(F.col("term").alias("_norm"), "kind", "entity", "name")
    return asked.join(known, "_norm", "left").drop("_norm")
