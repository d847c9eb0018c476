"""Preprocessing plan: every reference table of a monitored fact, written as artefacts."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from driftline.functions.expr import without_nan
from driftline.operators import baseline, catalogue, daily, quality, relations, sequence, threshold, trend
from driftline.operators.catalogue import ColumnRules
from driftline.plans.loading import Loaded, load, load_training
from driftline.schema import Roles
from driftline.sources.readers import summary_text
from driftline.sources.writers import save_table
from driftline.store import stages


@dataclass(frozen=True)
class PreprocessOptions:
    """What the plan has to know about the measures.

    ``pairs``: (measure, label) to learn thresholds for; with relation tables only the fallback, to which ``verified`` and
    ``alarm_only`` pairs are added where the tables say nothing about a measure.
    ``scanned``: measures and labels of the candidate scan; ``flatline``: sensors checked
    for stuck values. Both default to all of the roles.
    """

    pairs: Sequence[tuple[str, str]]
    verified: Sequence[tuple[str, str]] = ()
    alarm_only: Sequence[tuple[str, str]] = ()
    rises_is_bad: Mapping[str, bool] = field(default_factory=dict)
    two_sided: Sequence[str] = ()
    recompute_target: Sequence[str] = ()
    constants: Mapping[str, float] = field(default_factory=dict)
    averaged: Sequence[str] = ()
    zero_implausible: Sequence[str] = ()
    expected: Mapping[str, int] = field(default_factory=dict)
    rules: ColumnRules = ColumnRules()
    scanned: tuple[Sequence[str], Sequence[str]] | None = None
    flatline: Sequence[str] | None = None
    permutations: int = 40
    min_labels: int | None = None
    consistency: tuple[str, str] | None = None  # two columns that must move together; "-y": against each other


def preprocess(
    df: DataFrame,
    roles: Roles,
    options: PreprocessOptions,
    folder: str,
    training: DataFrame | None = None,
    directions: DataFrame | None = None,
    relation_tables: tuple[DataFrame | None, DataFrame | None] | None = None,
) -> dict[str, str]:
    """Write all tables below ``folder`` and return their paths.

    ``relation_tables``: interface and tier table, each None if it cannot be read; without them the pairs are those of
    the options.

    Tables that later steps read again are read from where they were written, so nothing
    is computed twice; intermediate tables are removed at the end.
    """
    with stages(df.sparkSession):
        return _preprocess(without_nan(df), roles, options, folder, None if training is None else without_nan(training), directions, relation_tables)


def preprocess_raw(
    raw: DataFrame,
    roles: Roles,
    options: PreprocessOptions,
    folder: str,
    kinds: Mapping[str, str],
    *,
    time_format: str | None = None,
    features: Callable[[DataFrame], DataFrame] | None = None,
    expected_rows: int | None = None,
    training: Callable[[], Loaded] | None = None,
    directions: DataFrame | None = None,
    relation_tables: tuple[DataFrame | None, DataFrame | None] | None = None,
) -> dict[str, str]:
    """The whole plan from a raw table: typed reading, rejects, normal flag and derived features first (``plans.loading``).

    Saves the rejected rows, the reasons and, if there is one, the warning about the training table beside the others.
    """
    with stages(raw.sparkSession):
        loaded = load(raw, roles, kinds, time_format=time_format, features=features, expected_rows=expected_rows)
        extra, warning = load_training(training)
        notes = raw.sparkSession.createDataFrame([(loaded.rows, loaded.rejected, warning)], "rows long, rejected long, training_warning string")
        paths = {name: save_table(table, folder, name) for name, table in
                 (("rejects", loaded.rejects), ("reject_reasons", loaded.report), ("load_notes", notes))}
        return paths | preprocess(loaded.fact, roles, options, folder, extra, directions, relation_tables)


def _preprocess(df, roles, options, folder, training, directions, relation_tables) -> dict[str, str]:
    spark = df.sparkSession
    paths: dict[str, str] = {}

    def save(name: str, table: DataFrame) -> DataFrame:
        paths[name] = save_table(table, folder, name)
        return spark.read.parquet(paths[name])

    report = quality.key_report(df, roles)
    if options.expected:
        quality.expect(report, options.expected)
    together = check_consistency(df, *options.consistency) if options.consistency else None

    normal, ok = df.filter(roles.normal), df.filter(roles.ok)
    stats = save("stratum_stats", baseline.override_targets(
        baseline.stratum_stats(normal, roles.stratum, roles.measures), roles.limits))
    save("stratum_stats_by_entity", baseline.override_targets(
        baseline.stratum_stats(normal, roles.series, roles.measures), roles.limits))
    series = save("daily_series", daily.daily_series(df, stats, roles))
    trends = save("trends", trend.trend_table(series, [roles.entity, "column"]))
    save("daily_rates", daily.daily_rates(df, roles, options.averaged or roles.measures, roles.labels))

    faults = save("faults", quality.missing_and_zero(df, df.columns, options.zero_implausible))
    sensors = replace(roles, measures=tuple(options.flatline or roles.measures))
    flat = save("flatlines", sequence.flatline_counts(df, sensors))
    continuous = [m for m in roles.measures if m not in options.rules.counts]
    spread = baseline.dispersion_continuous(normal, roles.stratum, continuous)
    if roles.labels:
        spread = spread.unionByName(baseline.dispersion_binary(df, roles.stratum, roles.labels))
    if options.rules.counts:
        spread = spread.unionByName(baseline.dispersion_count(df, roles.stratum, options.rules.counts))
    columns = save("columns", catalogue.classification(
        catalogue.taxonomy(spark, df.columns, roles, options.rules), spread, trend.column_summary(trends),
        faults, flat.select("column", "flatline_count"), options.rules, roles, df.count()))

    ab = None
    if options.rises_is_bad:
        ab = baseline.baseline_a(ok, roles.stratum, options.rises_is_bad, roles.limits)
    if options.two_sided:
        two = baseline.baseline_b(ok, roles.stratum, options.two_sided, roles.limits, options.recompute_target)
        ab = two if ab is None else ab.unionByName(two, allowMissingColumns=True)
    if ab is not None:
        save("baseline_ab", ab)
    if options.constants:
        save("baseline_e", baseline.baseline_e(ok, options.constants))

    pairs = list(options.pairs)
    if relation_tables is not None:
        listed = lambda p: spark.createDataFrame(list(p), "factor string, defect string")
        pairing = save("pairing", relations.pairing_in_use(
            *relation_tables, listed(options.pairs), listed(options.verified), listed(options.alarm_only)))
        known = {*roles.measures}, {*roles.labels}
        found = sorted((r["factor"], r["defect"]) for r in pairing.collect())  # names of measures and labels
        pairs = [(c, d) for c, d in found if c in known[0] and d in known[1]]
    if pairs:
        scan_measures, scan_labels = options.scanned or (roles.measures, roles.labels)
        candidates = save("candidates", threshold.candidate_scan(
            df, roles.stratum, scan_measures, scan_labels, pairs, options.permutations))
        assigned = spark.createDataFrame(pairs, "column string, label string")
        save("findings", threshold.scan_findings(candidates, assigned))
        minimum = {} if options.min_labels is None else {"min_labels": options.min_labels}
        learned = threshold.routed_thresholds(df, df if training is None else training, roles.stratum, pairs, **minimum)
        if directions is not None:
            learned = threshold.agreeing(learned, directions)
        learned = save("thresholds", learned)
        save("zone_rates", daily.zone_rate_daily(df, learned, roles))
        save("entry_rates", trend.entry_rate_baseline(df, learned, roles))

    included = [r["column"] for r in columns.filter("include_in_downstream_default").orderBy("position").collect()]
    rules, counts = options.rules, {r["subsystem"]: r["count"] for r in columns.groupBy("subsystem").count().orderBy("subsystem").collect()}
    text = summary_text(report, {
        "included_columns": json.dumps(included, ensure_ascii=False), "include_in_downstream_default_columns": included,
        "policy": "flag_only", "subsystem_column_counts": counts,
        "excluded_columns": [*rules.excluded_ids, *rules.excluded_measures], "excluded_labels": list(rules.excluded_labels),
        "pending_review_columns": dict(rules.pending),
    } | ({} if together is None else {"consistency": {"columns": list(options.consistency), "spearman_r": together}}))
    paths["summary"] = save_table(text, folder, "summary", fmt="json")
    return paths


def check_consistency(df: DataFrame, x: str, y: str, least: float = 0.5) -> float:
    """Rank correlation of two columns that must move together, against each other if ``y`` begins with a minus; raises if
    they do not."""
    from driftline.operators.explore import spearman_pairs

    name, sign = y.removeprefix("-"), -1 if y.startswith("-") else 1
    r = spearman_pairs(df, [(x, name)], {"all": "true"}).first()["spearman_r"]
    if r is None or sign * r <= least:
        raise ValueError(f"{x} and {y} should move together, rank correlation is {None if r is None else sign * r}")
    return sign * r
