"""Checks a database would enforce, as jobs that report what breaks them."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from roundledger.schemas import (
    REFERENCES,
    SCHEMAS,
    TABLE_NAMES,
    UNIQUE_KEYS,
    Reference,
    Tables,
    required_columns,
)

# Fixed value: the longest text the old table format holds.
OLD_TEXT_LIMIT = 100


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, rows) of keys held by several rows; a NULL in a key never collides."""
    complete = df.select(*keys).na.drop("any")
    return complete.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def unique_violations(tables: Tables) -> DataFrame:
    """(tableName, repeatedKeys, rows) over the natural keys; zeros included."""
    return _union(
        [_repeats(table, tables[table], *keys) for table, keys in UNIQUE_KEYS.items()]
    )


def primary_key_violations(tables: Tables) -> DataFrame:
    """(tableName, repeatedKeys, rows, nullKeys) over the ``id`` columns."""
    parts = []
    for table, df in tables.items():
        # NULL ids form one group of their own, so one pass finds both faults.
        groups = df.groupBy("id").agg(F.count("*").alias("rows"))
        repeated = F.col("id").isNotNull() & (F.col("rows") > 1)
        parts.append(
            groups.agg(
                F.count(F.when(repeated, 1)).alias("repeatedKeys"),
                F.coalesce(F.sum(F.when(repeated, F.col("rows"))), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("rows"))), F.lit(0))
                .alias("nullKeys"),
            ).select(F.lit(TABLE_NAMES[table]).alias("tableName"), "*")
        )
    return _union(parts)


def _repeats(table: str, df: DataFrame, *keys: str) -> DataFrame:
    return (
        repeated_keys(df, *keys)
        .agg(
            F.count("*").alias("repeatedKeys"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        )
        .select(F.lit(TABLE_NAMES[table]).alias("tableName"), "*")
    )


def missing_required(tables: Tables) -> DataFrame:
    """(tableName, columnName, nulls) of each required column; one pass per table."""
    parts = []
    for table, df in tables.items():
        columns = required_columns(table)
        counts = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
        parts.append(
            counts.unpivot([], columns, "columnName", "nulls").select(
                F.lit(TABLE_NAMES[table]).alias("tableName"), "columnName", "nulls"
            )
        )
    return _union(parts)


def _held_keys(tables: Tables, reference: Reference) -> DataFrame:
    """(key) of every reference that is set."""
    key = F.col(reference.column).cast("bigint").alias("key")
    return tables[reference.child].select(key).filter(F.col("key").isNotNull())


def references_held(tables: Tables, only: Sequence[Reference] = REFERENCES) -> DataFrame:
    """(relation, key, rows): how often each foreign key value occurs."""
    counts = [
        _held_keys(tables, reference)
        .groupBy("key")
        .agg(F.count("*").alias("rows"))
        .select(F.lit(reference.label).alias("relation"), "key", "rows")
        for reference in only
    ]
    nothing = tables.match.sparkSession.createDataFrame([], "relation string, key bigint, rows bigint")
    return _union(counts) if counts else nothing


def orphan_references(tables: Tables) -> DataFrame:
    """(relation, key, rows) of the references to rows that do not exist."""
    parents = dict.fromkeys(reference.parent for reference in REFERENCES)
    return _union([_orphans_of(tables, parent) for parent in parents])


def _orphans_of(tables: Tables, parent: str) -> DataFrame:
    """Orphans among all references to one parent table.

    They are counted per key first, one counter per relation. That leaves one
    row per key, however many rows share it, already laid out for the join
    with the parent.
    """
    references = [r for r in REFERENCES if r.parent == parent]
    held = _union(
        [_held_keys(tables, r).withColumn("relation", F.lit(i)) for i, r in enumerate(references)]
    )
    counted = held.groupBy("key").agg(
        *(
            F.count(F.when(F.col("relation") == i, 1)).alias(r.label)
            for i, r in enumerate(references)
        )
    )
    existing = tables[parent].select(F.col("id").cast("bigint").alias("key"))
    labels = [r.label for r in references]
    return (
        counted.join(existing, "key", "left_anti")
        .select("key", F.inline(_labelled(labels)))
        .filter("rows > 0")
        .select("relation", "key", "rows")
    )


def _labelled(labels: Sequence[str]) -> Column:
    """The counter columns named ``labels`` as an array of (relation, rows)."""
    return F.array(
        *(
            F.struct(F.lit(label).alias("relation"), F.col(f"`{label}`").alias("rows"))
            for label in labels
        )
    )


def overlong_text(df: DataFrame, *columns: str, limit: int = OLD_TEXT_LIMIT) -> DataFrame:
    """Rows with a text the old format could not hold."""
    return df.filter(reduce(lambda a, b: a | b, (F.length(c) > limit for c in columns)))


def principals_per_season(season: DataFrame, ml_model_season: DataFrame) -> DataFrame:
    """(year, principals, isValid): at most one principal model may serve a season."""
    counts = ml_model_season.groupBy("seasonId").agg(
        F.count(F.when(F.col("isPrincipal"), 1)).alias("principals")
    )
    principals = F.coalesce("principals", F.lit(0))
    return (
        season.select(F.col("id").alias("seasonId"), "year")
        .join(counts, "seasonId", "left")
        .select("year", principals.alias("principals"), (principals <= 1).alias("isValid"))
    )


def repeated_predictions(prediction: DataFrame) -> DataFrame:
    """(matchId, mlModelId, rows) where a model predicted a match several times."""
    return repeated_keys(prediction, "matchId", "mlModelId")


def negative_margins(match: DataFrame) -> DataFrame:
    """Matches whose margin is below zero; error metrics assume there are none."""
    return match.filter(F.col("margin") < 0)


def require_empty(violations: DataFrame, what: str) -> None:
    """Fail the job when there is any violation."""
    found = violations.take(1)
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


def require_sound(tables: Tables) -> None:
    """Fail unless keys, required values, references and margins hold.

    One job per kind of rule; the first rule broken is reported.
    """
    require_empty(
        primary_key_violations(tables).filter("repeatedKeys > 0 OR nullKeys > 0"), "primary keys"
    )
    require_empty(unique_violations(tables).filter("repeatedKeys > 0"), "unique keys")
    require_empty(missing_required(tables).filter("nulls > 0"), "required values")
    require_empty(orphan_references(tables), "references")
    require_empty(negative_margins(tables.match), "margins")


def row_rules(table: str) -> dict[str, Column]:
    """What no row of a table may break, as aggregates that count the rows that do."""
    required = required_columns(table) if table in SCHEMAS else ()
    rules = {f"{c} is required": F.col(c).isNull() for c in required}
    if table == "match":
        rules["margin is negative"] = F.col("margin") < 0
    return {rule: F.count(F.when(broken, 1)).alias(rule) for rule, broken in rules.items()}


def watched(df: DataFrame, table: str) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows, and those that break a rule, as it is written.

    No further pass is needed: the counts come with the write's own tasks.
    """
    observation = Observation()
    rows = F.count("*").alias("rows")
    return df.observe(observation, rows, *row_rules(table).values()), observation


def require_watched(observation: Observation, table: str) -> int:
    """The number of rows that were written; fails where one broke a rule."""
    counts = dict(observation.get)
    rows = counts.pop("rows")
    for rule, broken in counts.items():
        if broken:
            raise ValueError(f"{TABLE_NAMES[table]}: {rule} ({broken} rows)")
    return rows


def require_unique(tables: Tables, changed: Iterable[str], natural: bool = True) -> None:
    """Fail unless the keys of some tables are unique: a keyed aggregate for each.

    Without ``natural`` only their ``id`` is looked at.
    """
    for table in changed:
        for keys in (("id",), UNIQUE_KEYS.get(table) if natural else None):
            if keys:
                repeated = repeated_keys(tables[table], *keys)
                require_empty(repeated, f"{TABLE_NAMES[table]} repeats {', '.join(keys)}")


def require_references(tables: Tables, changed: Collection[str]) -> None:
    """Fail unless references to and from some tables resolve: an aggregate for each parent."""
    parents = dict.fromkeys(
        r.parent for r in REFERENCES if r.parent in changed or r.child in changed
    )
    for parent in parents:
        require_empty(_orphans_of(tables, parent), "references without a row")


def require_rows_fit(rows: DataFrame, table: str, tables: Tables) -> None:
    """Fail unless new ``rows`` of a table have the parents and keys they need.

    Their keys must be new, among themselves and to the table; what they refer
    to must exist. Only the new rows are counted, so an append stays small.
    """
    existing = tables[table]
    for keys in (("id",), UNIQUE_KEYS.get(table)):
        if keys:
            require_empty(repeated_keys(rows, *keys), f"{TABLE_NAMES[table]} rows repeat {keys}")
            known = existing.select(*keys).join(rows.select(*keys), list(keys), "left_semi")
            require_empty(known, f"{TABLE_NAMES[table]} has {keys}")
    for reference in REFERENCES:
        if reference.child == table:
            held = _held_keys(tables.swap(**{table: rows}), reference).distinct()
            parents = tables[reference.parent].select(F.col("id").cast("bigint").alias("key"))
            require_empty(held.join(parents, "key", "left_anti"), f"{reference.label} without a row")
    if table == "match":
        require_empty(negative_margins(rows), "margins")
