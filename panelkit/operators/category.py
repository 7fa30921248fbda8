"""Category-split analysis (gender of events and athletes).

Generic over column names: an event table with (time, entity, athlete,
event keys, medal, team flag, event name) and a person table with a category
(sex).  Counts are conditional sums in one aggregation; distinct athletes
are counted by deduplicating (time, athlete) keys first, which Spark
aggregates partially before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .. import dims
from ..functions.semantics import div, safe_corr, pair_count


def prepare_events(events: DataFrame, bio: DataFrame, *, athlete: str, sex: str, medal: str,
                   team: str, edition: str | None = None, contains: str | None = None,
                   y0: int | None = None, y1: int | None = None, time: str = "year") -> DataFrame:
    """G1: optional edition filter (A17), team flag from bool or text 'true',
    athlete sex from the bio table mapped to labels (unknown when absent),
    ``has_medal`` = medal non-null and non-blank."""
    e = events
    if edition and contains:
        e = e.filter(F.lower(F.col(edition)).contains(contains.lower()))
    if y0 is not None and y1 is not None:
        e = e.filter(F.col(time).between(y0, y1))
    b = bio.select(F.col(athlete).alias("__a"), F.col(sex).alias("__sex"))
    m = F.create_map(*[x for k, v in dims.ATHLETE_SEX_LABELS.items() for x in (F.lit(k), F.lit(v))])
    j = e.join(b, F.col(athlete) == F.col("__a"), "left")
    team_flag = F.lower(F.trim(F.col(team).cast("string"))) == "true"
    return (j.withColumn("is_team", F.coalesce(team_flag, F.lit(False)))
            .withColumn("athlete_sex", F.coalesce(m[F.col("__sex")], F.lit(dims.ATHLETE_SEX_UNKNOWN)))
            .withColumn("has_medal", F.col(medal).isNotNull() & (F.trim(F.col(medal)) != ""))
            .drop("__a", "__sex"))


def event_gender(name: str, rules: Sequence[tuple[str, str]] | None = None,
                 default: str | None = None) -> F.Column:
    """First matching regex (on lower-cased text) wins; otherwise default."""
    rules = rules or dims.EVENT_GENDER_RULES
    t = F.lower(F.col(name).cast("string"))
    out = None
    for label, pattern in rules:
        cond = t.rlike(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default or dims.EVENT_GENDER_DEFAULT))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long crosstab (a, b, n)."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def medal_units(df: DataFrame, team: str, team_keys: Sequence[str], has_medal: str = "has_medal") -> DataFrame:
    """Medal rows; individual rows kept, team rows distinct on ``team_keys``."""
    m = df.filter(F.col(has_medal))
    ind = m.filter(~F.col(team)).select(*team_keys)
    tm = m.filter(F.col(team)).select(*team_keys).distinct()
    return ind.unionByName(tm)


def medals_by_category(units: DataFrame, keys: Sequence[str], cat: str, female: str, male: str,
                       mixed: str) -> DataFrame:
    """Per key, counts of female / male / mixed units (0 when none), total,
    female share F/(F+M) (NULL when 0), gap F-M and male share."""
    a = units.groupBy(*keys).agg(F.count_if(F.col(cat) == female).alias("medals_f"),
                                 F.count_if(F.col(cat) == male).alias("medals_m"),
                                 F.count_if(F.col(cat) == mixed).alias("medals_mixed"),
                                 F.count(F.lit(1)).alias("medals_tot"))
    fm = F.col("medals_f") + F.col("medals_m")
    return a.withColumns({"share_f": div("medals_f", fm), "gap_fm": F.col("medals_f") - F.col("medals_m"),
                          "share_m": div("medals_m", fm)})


def reconcile(ours: DataFrame, official: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Inner join; Pearson r and mean absolute difference (one row)."""
    j = ours.select(*keys, a).join(official.select(*keys, b), list(keys), "inner")
    return j.agg(safe_corr(a, b).alias("r"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mean_abs_diff"),
                 pair_count(a, b).alias("n"))


def participants_by_category(df: DataFrame, time: str, athlete: str, cat: str,
                             known: Sequence[str]) -> DataFrame:
    """Distinct (time, athlete) with a known category; counts and share over the known total."""
    d = df.filter(F.col(cat).isin(list(known))).select(time, athlete, cat).distinct()
    a = d.groupBy(time, cat).agg(F.count(F.lit(1)).alias("athletes"))
    return a.withColumn("share", div("athletes", F.sum("athletes").over(Window.partitionBy(time))))


def share_comparison(athlete_share: DataFrame, medal_share: DataFrame, time: str) -> DataFrame:
    """Athlete share and medal share stacked with a measure label."""
    a = athlete_share.select(time, F.lit("atlete").alias("misura"), F.col("share"))
    m = medal_share.select(time, F.lit("medaglie").alias("misura"), F.col("share"))
    return a.unionByName(m)


def yield_per_100(medals_long: DataFrame, athletes_long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """100 x medals / athletes per key (long)."""
    j = medals_long.join(athletes_long, list(keys), "inner")
    return j.withColumn("yield_100", 100 * div("medals", "athletes"))


def entity_share(mbg: DataFrame, entity: str, min_fm: int, names: DataFrame | None = None,
                 name_col: str = "name", time: str = "year") -> DataFrame:
    """Whole-period female share per entity with F+M >= min_fm; name =
    last non-null name by time, else the code."""
    a = mbg.groupBy(entity).agg(F.sum("medals_f").alias("medals_f"), F.sum("medals_m").alias("medals_m"))
    a = a.withColumn("fm", F.col("medals_f") + F.col("medals_m")).filter(F.col("fm") >= min_fm)
    a = a.withColumn("share_f", div("medals_f", "fm"))
    if names is not None:
        nm = names.groupBy(entity).agg(F.max_by(name_col, F.when(F.col(name_col).isNotNull(), F.col(time)))
                                       .alias("__n"))
        a = a.join(nm, entity, "left").withColumn("name", F.coalesce("__n", F.col(entity).cast("string"))).drop("__n")
    return a


def period_shift(mbg: DataFrame, entity: str, time: str, split: int, min_fm: int,
                 labels: tuple[str, str]) -> DataFrame:
    """Female share in the early (<= split) vs late period; both periods
    need F+M >= min_fm; delta = late - early."""
    p = F.when(F.col(time) <= split, labels[0]).otherwise(labels[1])
    a = mbg.withColumn("period", p).groupBy(entity, "period").agg(
        F.sum("medals_f").alias("f"), F.sum("medals_m").alias("m"))
    a = a.withColumn("fm", F.col("f") + F.col("m")).withColumn("share", div("f", "fm"))
    e = a.filter(F.col("period") == labels[0]).select(entity, F.col("share").alias("share_early"),
                                                         F.col("fm").alias("fm_early"))
    late = a.filter(F.col("period") == labels[1]).select(entity, F.col("share").alias("share_late"),
                                                           F.col("fm").alias("fm_late"))
    j = e.join(late, entity).filter((F.col("fm_early") >= min_fm) & (F.col("fm_late") >= min_fm))
    return j.withColumn("delta", F.col("share_late") - F.col("share_early"))


def zero_filled_panel(indicators: DataFrame, mbg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Indicator rows left-joined to category medal counts, absent -> 0,
    share NULL when F+M = 0."""
    cols = ["medals_f", "medals_m", "medals_mixed", "medals_tot"]
    j = indicators.join(mbg.select(*keys, *cols), list(keys), "left")
    j = j.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in cols})
    return j.withColumn("share_f", div("medals_f", F.col("medals_f") + F.col("medals_m")))


def delegation_panel(events: DataFrame, mbg: DataFrame, *, time: str, entity: str, athlete: str,
                     cat: str, female: str, male: str, bio_names: DataFrame | None = None,
                     name_col: str = "country") -> DataFrame:
    """Distinct athletes by (time, entity, category incl. unknown);
    athlete share F over F+M+unknown; full outer join with medal counts;
    success index = medal share / athlete share; name = modal trimmed bio
    name, else the code."""
    d = events.select(time, entity, athlete, cat).distinct()
    a = d.groupBy(time, entity).agg(F.count_if(F.col(cat) == female).alias("athletes_f"),
                                    F.count_if(F.col(cat) == male).alias("athletes_m"),
                                    F.count(F.lit(1)).alias("athletes_tot"))
    a = a.withColumn("athlete_share_f", div("athletes_f", "athletes_tot"))
    j = a.join(mbg.select(time, entity, "medals_f", "medals_m", "medals_tot", "share_f"), [time, entity], "full")
    j = j.withColumn("success_index", div("share_f", "athlete_share_f"))
    if bio_names is not None:
        nm = bio_names.groupBy(entity).agg(F.mode(F.trim(F.col(name_col)), deterministic=True).alias("__n"))
        j = j.join(nm, entity, "left").withColumn("name", F.coalesce("__n", F.col(entity).cast("string"))).drop("__n")
    return j


def global_trend(mbg: DataFrame, time: str) -> DataFrame:
    """Yearly sums, shares recomputed from the sums, long (time, measure, value)."""
    a = mbg.groupBy(time).agg(F.sum("medals_f").alias("f"), F.sum("medals_m").alias("m"),
                              F.sum("medals_mixed").alias("mixed"), F.sum("medals_tot").alias("tot"))
    a = a.withColumns({"share_f": div("f", F.col("f") + F.col("m")),
                       "share_m": div("m", F.col("f") + F.col("m"))})
    cols = ["f", "m", "mixed", "tot", "share_f", "share_m"]
    return a.select(time, *[F.col(c).cast("double") for c in cols]).unpivot([time], cols, "measure", "value")


def recent_entities(mbg: DataFrame, entity: str, time: str, from_time: int, top: int = 15,
                    min_total: int = 5, athletes: DataFrame | None = None) -> DataFrame:
    """The ``top`` entities of recent_totals() by total (ties by code)."""
    r = recent_totals(mbg, entity, time, from_time, min_total, athletes)
    return r.orderBy(F.desc("medals_tot"), F.asc(entity)).limit(top)


def recent_totals(mbg: DataFrame, entity: str, time: str, from_time: int, min_total: int = 5,
                  athletes: DataFrame | None = None) -> DataFrame:
    """Sums from ``from_time`` of every entity; female / male share; flag
    ``min_total`` subset; optional athlete share -> index."""
    r = mbg.filter(F.col(time) >= from_time).groupBy(entity).agg(
        F.sum("medals_f").alias("medals_f"), F.sum("medals_m").alias("medals_m"),
        F.sum("medals_tot").alias("medals_tot"))
    r = r.withColumns({"share_f": div("medals_f", F.col("medals_f") + F.col("medals_m")),
                       "above_min": F.col("medals_tot") >= min_total})
    if athletes is not None:
        at = athletes.filter(F.col(time) >= from_time).groupBy(entity).agg(
            div(F.sum("athletes_f"), F.sum("athletes_tot")).alias("athlete_share_f"))
        r = r.join(at, entity, "left").withColumn("success_index", div("share_f", "athlete_share_f"))
    return r


def specialists(panel: DataFrame, entity: str, index: str, total: str, min_total: int = 10,
                top: int = 15) -> DataFrame:
    """Total >= min_total, finite index, top by index (ties by code)."""
    return (panel.filter((F.col(total) >= min_total) & F.col(index).isNotNull())
            .orderBy(F.desc(index), F.asc(entity)).limit(top))


def share_heat(mbg: DataFrame, entity: str, time: str, top: int = 12) -> DataFrame:
    """For the top entities by female medals, rows with medals > 0; NULL share -> 0."""
    t = mbg.groupBy(entity).agg(F.sum("medals_f").alias("__f")).orderBy(F.desc("__f"), F.asc(entity)).limit(top)
    h = mbg.join(t.select(entity), entity, "left_semi").filter(F.col("medals_tot") > 0)
    return h.select(entity, time, F.coalesce(F.col("share_f"), F.lit(0.0)).alias("share_f"))


def headline_facts(trend: DataFrame, shares: DataFrame, diffs: DataFrame, time: str,
                   entity: str) -> DataFrame:
    """One row of headline numbers: first / last year female share, top
    entity by share, largest absolute correlation difference."""
    t = trend.filter(F.col("measure") == "share_f").agg(
        F.min_by("value", time).alias("first_share_f"), F.max_by("value", time).alias("last_share_f"),
        F.min(time).alias("first_year"), F.max(time).alias("last_year"))
    s = shares.agg(F.max_by(entity, F.struct("share_f", F.col(entity))).alias("top_entity"),
                   F.max("share_f").alias("top_share_f"))
    dd = diffs.agg(F.max_by("indicator", F.struct(F.abs("diff"), "indicator")).alias("largest_diff_indicator"),
                   F.max(F.abs("diff")).alias("largest_abs_diff"))
    row = {**t.first().asDict(), **s.first().asDict(), **dd.first().asDict()}  # three one-row aggregates
    schema = ", ".join(f"{k} {dict(t.dtypes + s.dtypes + dd.dtypes)[k]}" for k in row)
    return trend.sparkSession.createDataFrame([tuple(row.values())], schema)
