"""Names to ids: alias indexes that resolve to exactly one id or refuse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from closeline.functions import text as T


EXCESS = {T.name_variants: T.excess_team_readings, T.player_variants: T.excess_player_readings}


def _each(rows: DataFrame, *columns: str, forms: Column) -> DataFrame:
    """A row per reading. Spark puts a filter on the length below an inner explode, which works the readings out twice more."""
    return rows.select(*columns, F.explode_outer(forms).alias("form")).filter("form is not null")


def alias_index(named: DataFrame, name: str, ident: str, scope: Sequence[str] = (), variants: Callable[[str], Column] = T.name_variants) -> DataFrame:
    """Alias to id. Only the extremes of the ids of an alias are kept, never the list:
    an alias shared by millions of ids costs one row."""
    forms = _each(named.withColumn("id", F.col(ident)), *scope, "id", forms=variants(name))
    index = forms.groupBy(*scope, "form").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return index


def resolve(rows: DataFrame, key: str, name: str, index: DataFrame, scope: Sequence[str] = (), variants: Callable[[str], Column] = T.name_variants) -> DataFrame:
    """Add ``resolved_id`` and ``resolution`` to rows whose key is unique within its scope.

    One, many, none; or ``too many readings`` where not all readings of the name were
    looked up, so that one hit would not be proof.
    """
    forms = _each(rows, *scope, key, forms=variants(name))
    hits = forms.join(index, [*scope, "form"]).groupBy(*scope, key).agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    joined = rows.join(hits, [*scope, key], "left")
    state = F.when(F.col("__lo").isNull(), "none").when(F.col("__lo") == F.col("__hi"), "one").otherwise("many")
    if variants in EXCESS:
        state = F.when(EXCESS[variants](name), "too many readings").otherwise(state)
    return joined.select(*rows.columns, F.when(state == "one", F.col("__lo")).alias("resolved_id"), state.alias("resolution"))


player_forms = T.player_forms


def resolve_ordered(rows: DataFrame, key: str, spellings: Column, index: DataFrame) -> DataFrame:
    """First spelling that resolves wins; an id claimed by two rows becomes null."""
    tried = rows.select(key, F.posexplode(spellings).alias("pos", "form"))
    hit = tried.join(index.filter("lo = hi"), "form").groupBy(key).agg(F.min_by("lo", "pos").alias("resolved_id"))
    claims = hit.groupBy("resolved_id").agg(F.count("*").alias("claims"))
    settled = hit.join(claims, "resolved_id").select(key, F.when(F.col("claims") == 1, F.col("resolved_id")).alias("resolved_id"), "claims")
    return rows.join(settled, key, "left")
