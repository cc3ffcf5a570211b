"""Quality rules by robust multivariate outliers. DataFrame functions only.

Statistics of each text become a vector of four transformed rates. For each language and source a
minimum-covariance-determinant estimate is found by concentration steps: from each of three starts,
again and again the mean and covariance of the ``SUBSET`` share of rows that are nearest; the estimate of least determinant is taken.
A group of fewer than ``LEAST`` documents is judged by the estimate of its whole language, and if that has fewer too,
by the one of the whole corpus; both come from the same steps over all their documents, and only where a small group needs them.
A document is rejected if its squared Mahalanobis distance, scaled to the median that the chi-square law with 4
degrees of freedom has, exceeds ``CUTOFF``. Documents that fail the base rules are rejected and in no estimate.

Estimates are sums by group that combine before the shuffle, over the statistics only; the texts are read once and never shuffled.

Cases: a null text has no words and fails; null language or source are groups of their own; only in a corpus of fewer than ``LEAST``
documents that pass the base rules is there no estimate, and they are kept; a statistic that
doesn't vary has ``FLOOR`` as its deviation; an empty table gives no rows; repeated rows count each.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: 0.9999 quantile and median of the chi-square law with 4 degrees of freedom.
CUTOFF, MEDIAN = 23.51, 3.357
SUBSET, STEPS, LEAST = 0.75, 3, 30
#: Width of a group (0 language and source, 1 language, 2 all), and its language and source as far as they count.
KEYS, FOUND = ("g", "g0", "g1"), ("h", "h0", "h1")
#: Least deviations of the four transformed rates.
FLOOR = (0.08, 0.5, 0.5, 0.5)
_P = range(4)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(docs: DataFrame, text: str = "text", gram: int = 5) -> DataFrame:
    """``docs`` without the text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    keep = [c for c in docs.columns if c not in (text, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: without(x, BLANKS) != "")
    a = docs.select(
        *keep,
        F.transform(F.filter(F.split(raw, SPACE), lambda x: x != ""), lambda x: F.xxhash64(x)).alias("__words"),
        F.length(without(raw, BLANKS)).cast("long").alias("word_chars"),
        (F.length(raw) - F.length(without(raw, SYMBOLS))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    words, n = F.col("__words"), F.size("__words")
    window = F.transform(F.sequence(F.lit(0), n - gram), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]))
    b = a.select(
        *keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= gram, window).alias("__windows"),
    )
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    c = b.withColumn("__sorted", F.when(again, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    order = F.col("__sorted")

    def twice(s: Column, j: Column) -> Column:
        before, after = F.get(order, j - 1)["h"] == s["h"], F.get(order, j + 1)["h"] == s["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    places = F.array_sort(F.transform(F.filter(order, twice), lambda s: s["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-gram).alias("last")),
        lambda s, x: F.struct((s["n"] + F.least(F.lit(gram), x - s["last"])).alias("n"), x.alias("last")),
    )["n"]
    return c.withColumn("n_repeat_words", F.coalesce(F.when(order.isNotNull(), covered), F.lit(0).cast("long"))).drop("__sorted")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed rates."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars), F.log1p(100 * F.col("n_dup_lines") / words), F.log1p(100 * F.col("n_repeat_words") / words)]


def distance() -> Column:
    """Squared distance of x0..x3 from m0..m3 by the triangle l00..l33."""
    solved: list[Column] = []
    for i in _P:
        rest = F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * solved[k] for k in range(i)), F.lit(0.0))
        solved.append(rest / F.col(f"l{i}{i}"))
    return sum((y * y for y in solved), F.lit(0.0))


def same(left: DataFrame, right: DataFrame, a: tuple[str, ...] = KEYS, b: tuple[str, ...] = FOUND) -> Column:
    return reduce(and_, (left[x].eqNullSafe(right[y]) for x, y in zip(a, b)))


def named(df: DataFrame, *others: str) -> DataFrame:
    """The keys of a group under the names that a join with its rows needs."""
    return df.select(*[F.col(x).alias(y) for x, y in zip(KEYS, FOUND)], *others)


def scopes(rows: DataFrame) -> DataFrame:
    """For each language l0 and source l1: ``by``, the group that judges its rows, and ``fits``, those whose estimates its rows enter."""
    sizes = rows.groupBy(F.col("g0").alias("l0"), F.col("g1").alias("l1")).agg(F.count_if(~F.col("base_failed")).alias("n"))
    langs = sizes.groupBy(F.col("l0").alias("m0")).agg(F.sum("n").alias("m"), F.bool_or(F.col("n") < LEAST).alias("short"))
    everything = langs.agg(F.coalesce(F.bool_or(F.col("short") & (F.col("m") < LEAST)), F.lit(False)).alias("wide"))
    t = sizes.join(langs, sizes["l0"].eqNullSafe(langs["m0"])).crossJoin(F.broadcast(everything))
    none = F.lit(None).cast("string")
    group = lambda g, g0, g1: F.struct(F.lit(g).alias("g"), g0.cast("string").alias("g0"), g1.cast("string").alias("g1"))
    own, lang, whole = group(0, F.col("l0"), F.col("l1")), group(1, F.col("l0"), none), group(2, none, none)
    enough, enough_lang = F.col("n") >= LEAST, F.col("m") >= LEAST
    fits = F.array(F.when(enough, own), F.when(F.col("short") & enough_lang, lang), F.when(F.col("wide"), whole))
    return t.select("l0", "l1", F.when(enough, own).when(enough_lang, lang).otherwise(whole).alias("by"), F.filter(fits, lambda x: x.isNotNull()).alias("fits"))


def quantile(x: Column, share: float) -> Column:
    """An exact quantile of non-negative values on a fixed grid (steps of a thousandth): the same however rows are dealt to tasks."""
    return F.expm1(F.percentile(F.round(F.log1p(x), 3), share))


def located(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with ``d2``, their squared distance by each estimate of their group (null without one)."""
    return rows.join(estimates, same(rows, estimates), "left").withColumn("d2", distance()).drop(*FOUND)


def estimate(rows: DataFrame) -> DataFrame:
    """Mean and triangle of each group and start ``s``."""
    sums = [F.avg(f"x{i}").alias(f"m{i}") for i in _P]
    products = [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in _P for j in range(i + 1)]
    found = rows.groupBy(*KEYS, "s").agg(*sums, *products)
    low = {(i, j): F.col(f"c{i}{j}") + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0)) for i in _P for j in range(i + 1)}
    tri = []
    for i in _P:
        for j in range(i + 1):
            rest = low[i, j] - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            found = found.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
            tri.append(f"l{i}{j}")
    return named(found, "s", *[f"m{i}" for i in _P], *tri)


def medians(rows: DataFrame) -> DataFrame:
    """Start 0: medians and scaled absolute deviations of each group."""
    mids = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), *[quantile(F.col(f"x{i}"), 0.5).alias(f"m{i}") for i in _P]).where(F.col("n") >= LEAST)
    mids = named(mids, *[f"m{i}" for i in _P])
    away = rows.join(mids, same(rows, mids)).groupBy(*FOUND).agg(*[F.first(f"m{i}").alias(f"m{i}") for i in _P], *[quantile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"a{i}") for i in _P])
    tri = [(F.greatest(1.4826 * F.col(f"a{i}"), F.lit(FLOOR[i])) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in _P for j in range(i + 1)]
    return away.select(*FOUND, F.lit(0).alias("s"), *[f"m{i}" for i in _P], *tri)


def concentrated(rows: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """The estimates of the ``share`` of rows that are nearest by each estimate."""
    near = located(rows, now)
    radius = named(near.groupBy(*KEYS, "s").agg(quantile(F.col("d2"), share).alias("radius")), F.col("s").alias("t"), "radius")
    inner = near.join(radius, same(near, radius) & (near["s"] == radius["t"])).where("d2 <= radius")
    return estimate(inner.select(*KEYS, "s", *[f"x{i}" for i in _P]))


def starts(rows: DataFrame) -> DataFrame:
    """Three estimates of each group: by medians, by all rows, and by the half of rows nearest to the medians."""
    first = materialize(medians(rows))
    judged = rows.join(first.select(*FOUND), same(rows, first), "left_semi")
    every = estimate(judged.withColumn("s", F.lit(1)))
    half = concentrated(rows.join(first.select(*FOUND), same(rows, first), "left_semi"), first, 0.5).withColumn("s", F.lit(2))
    return first.unionByName(every).unionByName(half)


def least_determinant(estimates: DataFrame) -> DataFrame:
    """Of each group, the estimate whose covariance has the least determinant; the first of equal ones."""
    log_det = F.round(sum((F.log(f"l{i}{i}") for i in _P), F.lit(0.0)), 9)
    rest = [c for c in estimates.columns if c not in (*FOUND, "s")]
    return estimates.groupBy(*FOUND).agg(F.min(F.struct(log_det.alias("det"), "s", *rest)).alias("best")).select(*FOUND, *[f"best.{c}" for c in rest])


def quality_outliers(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``docs`` without the text, with the statistics, base_failed, distance (null without an estimate) and kept; columns of these names are replaced."""
    # further columns travel in a struct, so that their names meet none of this module's
    packed = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text], F.lit(0).alias("none")).alias("__row"), F.col(text).alias("text"), *[F.col(g).alias(n) for g, n in zip(groups, ("g0", "g1"))])
    judged = _judged(packed)
    own = [c for c in judged.columns if c != "__row"]
    back = [F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c != text and c not in own]
    return judged.select(*back, *own)


def _judged(docs: DataFrame) -> DataFrame:
    """(__row, statistics, base_failed, distance, kept) of rows (__row, text, g0, g1)."""
    table = materialize(statistics(docs, "text").withColumn("base_failed", base_failed()))
    rows = table.select("*", *[x.alias(f"x{i}") for i, x in enumerate(vector())])
    by = materialize(scopes(rows))
    rows = rows.join(by, same(rows, by, KEYS[1:], ("l0", "l1"))).drop("g0", "g1", "l0", "l1")
    x = [f"x{i}" for i in _P]
    used = materialize(rows.where(~F.col("base_failed")).select(F.explode("fits").alias("fit"), *x).select("fit.*", *x))
    now = materialize(starts(used))
    for _ in range(STEPS):
        now = materialize(concentrated(used, now, SUBSET).where("s is not null"))
    now = least_determinant(now)
    middle = located(used, now).groupBy(*KEYS).agg(quantile(F.col("d2"), 0.5).alias("middle"))
    scale = now.join(middle, same(middle, now)).drop(*KEYS)
    out = located(rows.select("*", "by.*"), scale).withColumn("distance", F.round(F.col("d2") * MEDIAN / F.greatest(F.col("middle"), F.lit(MEDIAN)), 6))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return out.withColumn("kept", kept).select(*[c for c in table.columns if c not in ("g0", "g1")], "distance", "kept")
