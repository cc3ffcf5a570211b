"""Active warnings from their texts: states of events, their polygons or those of their zones, motion and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import reports
from .merge import event_states
from .polygons import meeting

KEYS = ["office", "phenomenon", "significance", "number", "year"]
#: What comes first.
SIGNIFICANCE, PHENOMENA = ("W", "A"), ("TO", "SV", "EW", "FF", "FL")


def reported(products: DataFrame, text: str = "text", issued: str = "issued", number: str = "product") -> DataFrame:
    """A row for each event code of each product (text, issued, product): the event's key, what it reports, and its segment's zones, ring and motion."""
    codes = products.select(F.col(issued).alias("issued"), F.col(number).alias("product"), F.posexplode(reports.events_of(F.col(text))).alias("at", "e"))
    year = F.year(F.coalesce("e.begins", "issued")).alias("year")
    segment = F.col("e.segment")
    return codes.select(
        *[F.col(f"e.{c}") for c in KEYS[:4]], year, "issued", "product", "at", "e.action", "e.begins", "e.ends",
        reports.zones(segment).alias("zones"), reports.warning_ring(segment).alias("ring"), reports.storm_track(segment).alias("motion"),
    )


def _rank(column: str, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(column)), F.lit(0)), F.lit(len(order) + 1)).cast("int")


def active_warnings(rows: DataFrame, zones: DataFrame, as_of: Column, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(key, begins, ends, zones, rings, from_zones, motion, last_action, rank) of each event that is active at a time.

    rows: as ``reported`` gives them; zones: (zone, rings). Reports after ``as_of`` don't count, and that filter is on the time of issue, so it prunes. An event is active after its
    last report unless that ends it, and until the last end that was named. Its shape is the first ring that was given, else all rings of its zones; an event with
    neither goes. Of several motions the last holds. ``rank`` orders warnings before watches before others, then by kind. box: west, south, east, north, over the antimeridian
    where west is above east; shapes must meet it.
    """
    known = rows.where(F.col("issued") <= as_of)
    order = ["issued", "product", "at"]
    place = F.struct(*order)
    now = event_states(known, KEYS, order).where("active").where(F.coalesce(F.col("ends") > as_of, F.lit(True)))
    shapes = known.groupBy(*KEYS).agg(F.min("begins").alias("begins"), F.min_by("ring", F.when(F.col("ring").isNotNull(), place)).alias("ring"), F.max_by("motion", F.when(F.col("motion").isNotNull(), place)).alias("motion"))
    events = now.join(shapes, KEYS).withColumn("__id", F.xxhash64(*KEYS))
    by_zone = events.where("ring is null").select(*KEYS, F.explode("zones").alias("zone")).join(zones.select("zone", F.explode("rings").alias("r")), "zone")
    joined = by_zone.groupBy(*KEYS).agg(F.array_sort(F.collect_set("r")).alias("zone_rings"))
    shaped = events.join(joined, KEYS, "left").withColumn("rings", F.when(F.col("ring").isNotNull(), F.array("ring")).otherwise(F.col("zone_rings"))).where("rings is not null")
    if box is not None:
        west, south, east, north = box
        if south >= north:
            raise ValueError("south must be below north")
        # steps of at most a third of the box, so that a wide one goes the right way around
        width = (east - west) % 360 or 360
        along = [west + width * i / 4 for i in range(5)]
        corners = [(x, south) for x in along] + [(x, north) for x in along[::-1]] + [(west, south)]
        ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in corners])
        frame = shaped.sparkSession.range(1).select(F.lit(0).alias("g_id"), F.array(ring).alias("rings"))
        near = meeting(shaped.select(F.struct(*KEYS).alias("g_id"), "rings"), frame).select("left.*")
        shaped = shaped.join(near, KEYS, "left_semi")
    rank = (_rank("significance", SIGNIFICANCE) * 10 + _rank("phenomenon", PHENOMENA)).alias("rank")
    return shaped.select(*KEYS, "begins", "ends", "zones", "rings", F.col("ring").isNull().alias("from_zones"), "motion", "last_action", rank)
