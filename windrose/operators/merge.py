"""Key-based merges as functions from old and new rows to the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], combine: dict[str, Column] | None = None) -> DataFrame:
    """New rows replace old ones; ``combine`` gives other rules in terms of old.x and new.x. Both have unique keys."""
    a, b = old.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    hit = F.col("new.__is")
    rules = combine or {}
    out = [F.coalesce(f"old.{k}", f"new.{k}").alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            both = rules.get(c, F.col(f"new.{c}"))
            out.append(F.when(hit & F.col("old.__is"), both).when(hit, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
    return a.withColumn("__is", F.lit(True)).alias("old").join(b.withColumn("__is", F.lit(True)).alias("new"), on, "full_outer").select(*out)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    from .latest import top_per_key

    return top_per_key(df, keys, order)


def retain(df: DataFrame, group: list[str], time: str, keep: str) -> DataFrame:
    """Rows no older than ``keep`` before their group's newest."""
    last = df.groupBy(*group).agg(F.max(time).alias("__last"))
    return df.join(last, group).where(F.col(time) >= F.col("__last") - F.expr(f"interval {keep}")).drop("__last")


def merge_text_unless_named(old: DataFrame, new: DataFrame, keys: list[str], raw: str, station: str) -> DataFrame:
    """New rows replace old ones only where the stored raw text does not name the station."""
    keep = F.coalesce(F.contains(F.col(f"old.{raw}"), F.col(f"old.{station}")), F.lit(False))
    return upsert(old, new, keys, {c: F.when(keep, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in old.columns if c not in keys})


def merge_event(old: DataFrame, new: DataFrame, keys: list[str], arrays: list[str], first: list[str], texts: list[str], separator: str = "\n\n") -> DataFrame:
    """Arrays are united, ``first`` keeps the old value where there is one, texts are joined; other columns are the new row's."""
    both = lambda c: (F.col(f"old.{c}"), F.col(f"new.{c}"))
    united = lambda c: F.array_sort(F.array_union(*[F.coalesce(x, F.array().cast("array<string>")) for x in both(c)]))
    rules = {c: united(c) for c in arrays} | {c: F.coalesce(*both(c)) for c in first} | {c: F.concat_ws(separator, *both(c)) for c in texts}
    return upsert(old, new, keys, rules)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """New values replace old ones but for nulls in ``columns``."""
    return upsert(old, new, keys, {c: F.coalesce(f"new.{c}", f"old.{c}") for c in columns})


def update_from(rows: DataFrame, news: DataFrame, keys: list[str], columns: list[str], order: list[Column]) -> DataFrame:
    """``columns`` of rows from the first row of ``news`` by ``order`` with the same keys; rows without one stay."""
    from .latest import top_per_key

    found = top_per_key(news, keys, order).select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    return rows.join(found, keys, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def reactivate(stored: DataFrame, feed: DataFrame, keys: list[str], active: str = "active") -> DataFrame:
    """Stored rows are active if, and only if, the feed has them; its further rows are added."""
    seen = feed.select(*keys).distinct().withColumn("__seen", F.lit(True))
    kept = stored.join(seen, keys, "left").withColumn(active, F.coalesce("__seen", F.lit(False))).drop("__seen")
    return kept.unionByName(feed.join(stored.select(*keys), keys, "left_anti").withColumn(active, F.lit(True)).select(*kept.columns))


def expire(rows: DataFrame, ends: str, as_of: Column, active: str = "active") -> DataFrame:
    """Rows whose end is past are no longer active; those without an end stay."""
    return rows.withColumn(active, F.col(active) & F.coalesce(F.col(ends) >= as_of, F.lit(True)))


#: What ends an event, and what only changes it.
ENDING, CHANGING = ("CAN", "EXP", "UPG"), ("CON", "EXT", "EXA", "EXB", "COR")


def event_states(reports: DataFrame, keys: list[str], order: list[str], ends: str = "ends", zones: str = "zones") -> DataFrame:
    """(keys, active, ends, zones, last_action) of each event after all its reports, in order.

    A cancellation or expiry ends an event; an upgrade ends it and enters it anew; a change of an unknown event enters it. The
    last end that a report names holds, and zones of all reports are united.
    """
    place = F.struct(*order)
    return reports.groupBy(*keys).agg(
        F.max_by("action", place).isin("CAN", "EXP").alias("__over"), F.max_by(ends, F.when(F.col(ends).isNotNull(), place)).alias(ends),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(zones)))).alias(zones), F.max_by("action", place).alias("last_action"),
    ).select(*keys, (~F.col("__over")).alias("active"), ends, zones, "last_action")


def cooled(alerts: DataFrame, keys: list[str], time: str, minutes: int = 15) -> DataFrame:
    """The alerts that go out: none within ``minutes`` of the last that did. A pause as long starts a new, independent row of them."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(time)
    fresh = F.coalesce(at - F.lag(at).over(w) >= minutes * 60_000_000, F.lit(True))
    rows = alerts.select(*keys, time).distinct().withColumn("__new", fresh.cast("int")).withColumn("__row", F.sum("__new").over(w))
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0))
    step = lambda s, x: F.when(F.size(s) == 0, F.array(x)).when(x >= F.element_at(s, -1) + wait, F.concat(s, F.array(x))).otherwise(s)
    kind = alerts.schema[time].dataType.simpleString()
    sent = rows.groupBy(*keys, "__row").agg(F.array_sort(F.collect_list(time)).alias("__all"))
    return sent.select(*keys, F.explode(F.aggregate("__all", F.array().cast(f"array<{kind}>"), step)).alias(time))


def after_pause(alerts: DataFrame, keys: list[str], time: str, minutes: int = 15) -> DataFrame:
    """The alerts with no other of equal keys within ``minutes`` before, sent or not: of a row without such a pause only the first. Missing times come last and each by itself."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(F.col(time).asc_nulls_last())
    return alerts.select(*keys, time).withColumn("__fresh", F.coalesce(at - F.lag(at).over(w) >= minutes * 60_000_000, F.lit(True))).where("__fresh").drop("__fresh")
