"""Deletes and key changes carried through to the rows that refer to them.

None of these writes: each returns the tables as they are afterwards. Equal
keys are joined without hints, so a short list of keys is broadcast while a
long one is shuffled, with hot keys split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundledger.operators.quality import references_held, require_empty
from roundledger.schemas import REFERENCES, Tables


def _keys(df: DataFrame, column: str = "id") -> DataFrame:
    return df.select(F.col(column).alias("deletedId")).na.drop().distinct()


def _without(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return df.join(keys, df[column] == keys["deletedId"], "left_anti")


def _emptied(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    kept = F.when(F.col("deletedId").isNull(), F.col(column))
    joined = df.join(keys, df[column] == keys["deletedId"], "left")
    return _with_reference(joined, df.columns, column, kept)


_RULES = {"cascade": _without, "set null": _emptied}


def _delete(tables: Tables, parent: str, deleted: DataFrame, rules: tuple[str, ...]) -> Tables:
    keys = _keys(deleted)
    changed = {parent: _without(tables[parent], "id", keys)}
    for reference in REFERENCES:
        if reference.parent == parent and reference.on_delete in rules:
            child = changed.get(reference.child, tables[reference.child])
            changed[reference.child] = _RULES[reference.on_delete](child, reference.column, keys)
    return tables.swap(**changed)


def delete_cascade(tables: Tables, parent: str, deleted: DataFrame) -> Tables:
    """Remove rows (by ``id``) and everything that belongs to them."""
    return _delete(tables, parent, deleted, ("cascade",))


def delete_set_null(tables: Tables, parent: str, deleted: DataFrame) -> Tables:
    """Remove rows (by ``id``) and empty the optional references to them."""
    return _delete(tables, parent, deleted, ("set null",))


def restricting_references(tables: Tables, parent: str, deleted: DataFrame) -> DataFrame:
    """(relation, key, rows) that forbid the deletion of rows (by ``id``)."""
    restricting = [r for r in REFERENCES if r.parent == parent and r.on_delete == "restrict"]
    held = references_held(tables, restricting)
    keys = _keys(deleted)
    return held.join(keys, held["key"] == keys["deletedId"], "left_semi")


def delete_rows(tables: Tables, parent: str, deleted: DataFrame) -> Tables:
    """Delete rows by all three rules; fails while a required reference holds one."""
    require_empty(restricting_references(tables, parent, deleted), f"{parent} still in use")
    return delete_unrestricted(tables, parent, deleted)


def delete_unrestricted(tables: Tables, parent: str, deleted: DataFrame) -> Tables:
    """Delete rows nothing requires: what belongs to them goes, other references are emptied."""
    return _delete(tables, parent, deleted, ("cascade", "set null"))


def remap_keys(tables: Tables, parent: str, key_map: DataFrame) -> Tables:
    """Change keys by ``key_map`` (oldId, newId) in the parent and in every child.

    A map that sends one key to two places fails the job.
    """
    new_key = F.when(F.min("newId") == F.max("newId"), F.max("newId")).otherwise(
        F.raise_error(F.concat(F.lit("key mapped twice: "), F.col("oldId").cast("string")))
    )
    keys = key_map.groupBy("oldId").agg(new_key.alias("mappedId"))
    changed = {parent: _remapped(tables[parent], "id", keys)}
    for reference in REFERENCES:
        if reference.parent == parent:
            child = changed.get(reference.child, tables[reference.child])
            changed[reference.child] = _remapped(child, reference.column, keys)
    return tables.swap(**changed)


def _remapped(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    joined = df.join(keys, df[column] == keys["oldId"], "left")
    value = F.coalesce(F.col("mappedId"), F.col(column)).cast(df.schema[column].dataType)
    return _with_reference(joined, df.columns, column, value)


def _with_reference(df: DataFrame, columns: list[str], column: str, value: Column) -> DataFrame:
    return df.select(*(value.alias(c) if c == column else F.col(c) for c in columns))
