"""Exploration: correlations, associations, stratified effects, histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftline.functions.expr import no_nan
from driftline.operators.ordered import running
from driftline.operators.quantiles import average_ranks, unpivot
from driftline.store import lookup, written


def effect_ranking(
    df: DataFrame, strata: Sequence[str], features: Mapping[str, Sequence[str]], min_pos: int = 3, min_neg: int = 10
) -> DataFrame:
    """Standardised mean difference of positives and negatives inside strata, averaged with
    the number of positives as weight. ``features``: label -> measures.

    One aggregation over the wide fact serves every label and measure.
    """
    df = df.dropna(subset=list(strata))
    labels = sorted(features)
    used = sorted({m for ms in features.values() for m in ms})
    aggs = [F.stddev_samp(m).alias(f"s_{m}") for m in used]
    for d in labels:
        for tag, want in (("p", 1), ("n", 0)):
            aggs.append(F.count_if(F.col(d) == want).alias(f"{tag}_{d}"))
            aggs += [F.avg(F.when(F.col(d) == want, F.col(m))).alias(f"{tag}m_{d}_{m}") for m in features[d]]
    cells = [
        F.struct(
            F.lit(d).alias("label"), F.lit(m).alias("feature"),
            F.col(f"p_{d}").alias("w"), F.col(f"n_{d}").alias("neg"), F.col(f"s_{m}").alias("s"),
            (F.col(f"pm_{d}_{m}") - F.col(f"nm_{d}_{m}")).alias("gap"),
        )
        for d in labels for m in features[d]
    ]
    long = df.groupBy(*strata).agg(*aggs).select(F.inline(F.array(*cells)))
    kept = long.filter((F.col("w") >= min_pos) & (F.col("neg") >= min_neg) & (F.col("s") > 0))
    effect = F.sum(F.col("gap") / F.col("s") * F.col("w")) / F.sum("w")
    return kept.groupBy("label", "feature").agg(
        effect.alias("weighted_effect"), F.abs(effect).alias("absolute_effect"),
        F.count(F.lit(1)).alias("valid_strata"),
    )


#: Columns of at most so many different values (by estimate) meet their ranks by broadcast.
FEW_VALUES = 20_000
#: Most columns of the rank matrix that are joined one by one; the plan of the long form does not grow with them.
FEW_COLUMNS = 12


def _many_valued(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns with too many values for a broadcast; one number a column reaches the driver, and only the plan depends on it."""
    if not columns:
        return set()
    row = df.agg(*[F.approx_count_distinct(F.col(c).cast("double"), 0.02).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c for c, n in zip(columns, row) if n > FEW_VALUES}


def _with_ranks(df: DataFrame, ranks: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``df`` (``_v_<i>``: the columns as doubles) with ``<name>_<i>`` from ``ranks`` (column, value, names), if there is a value."""
    for i, c in enumerate(columns):
        own = ranks.filter(F.col("column") == c).select(F.col("value").alias(f"_v_{i}"), *[F.col(n).alias(f"{n}_{i}") for n in names])
        df = df.join(F.broadcast(own), f"_v_{i}", "left")
    return df


def spearman_pairs(
    df: DataFrame, pairs: Sequence[tuple[str, str]], populations: Mapping[str, str], *, limit: int | None = None
) -> DataFrame:
    """Spearman r of listed pairs for every population (name -> SQL predicate).

    Rows with a null on either side of a pair are dropped before ranking. A pair with a side of few values needs no
    shuffle of rows: that side's ranks are joined in place and summed per value of the other side, whose own ranks
    come from the same counted values. Pairs of two many-valued sides count their equal (x, y) rows.
    """
    pairs = list(dict.fromkeys(pairs))
    many = _many_valued(df, sorted({c for p in pairs for c in p}))
    inside = [p for p in pairs if not many.issuperset(p)]
    across = [p for p in pairs if many.issuperset(p)]
    out = [_pairs_in_place(df, inside, many, populations, limit)] if inside else []
    out += [_pairs_joined(df, across, populations, limit)] if across or not inside else []
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _pairs_in_place(
    df: DataFrame, pairs: Sequence[tuple[str, str]], many: set[str], populations: Mapping[str, str], limit: int | None
) -> DataFrame:
    """Sums per value of one side (the key) of the other side's ranks, all populations and pairs of a key side by side."""
    turned = [(y, x, x, y) if y in many else (x, y, x, y) for x, y in pairs]  # key, ranked, and the pair as given
    keys, ranked = (sorted({t[i] for t in turned}) for i in (0, 1))
    names = list(populations)
    columns = sorted({*keys, *ranked})
    value = {c: F.col(f"_c_{i}") for i, c in enumerate(columns)}
    base = df.select(*[F.expr(t).alias(f"_p_{i}") for i, t in enumerate(populations.values())],
                     *[F.col(c).cast("double").alias(f"_c_{i}") for i, c in enumerate(columns)])

    # ranks of a ranked value among the rows of a population that have the key
    seen = [(p, k) for p in range(len(names)) for k in range(len(keys))]
    flags = [(F.col(f"_p_{p}") & value[keys[k]].isNotNull()).alias(f"_f_{i}") for i, (p, k) in enumerate(seen)]
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), value[c].alias("value")) for c in ranked]))
    long = base.select(*flags, cells).filter("value is not null")
    counts = written(long.groupBy("column", "value").agg(*[F.count_if(f"_f_{i}").alias(f"n{i}") for i in range(len(seen))]))
    upto = running(counts, ["column"], ["value"], {f"_u{i}": ("sum", f"n{i}") for i in range(len(seen))}, limit=limit)
    whole = Window.partitionBy("column")
    centred = [(F.col(f"_u{i}") - (F.col(f"n{i}") - 1) / 2.0 - (F.max(f"_u{i}").over(whole) + 1) / 2.0).alias(f"rank{i}") for i in range(len(seen))]
    ranks = written(upto.select("column", "value", *[f"n{i}" for i in range(len(seen))], *centred))
    spread = ranks.groupBy("column").agg(*[F.sum(F.col(f"n{i}") * F.col(f"rank{i}") * F.col(f"rank{i}")).alias(f"bb{i}") for i in range(len(seen))])

    # per key and value: rows and ranks of each (population, ranked) the key is paired with
    wide = _with_ranks(base.withColumns({f"_v_{i}": value[c] for i, c in enumerate(ranked)}), ranks, ranked, [f"rank{i}" for i in range(len(seen))])
    listed = {k: [(p, t) for p in range(len(names)) for t in turned if t[0] == k] for k in keys}
    slots = range(max(map(len, listed.values())))
    rows = []
    for j, k in enumerate(keys):
        here = [F.when(F.col(f"_p_{p}"), F.col(f"rank{seen.index((p, j))}_{ranked.index(t[1])}")) for p, t in listed[k]]
        here += [F.lit(None).cast("double")] * (len(slots) - len(here))
        rows.append(F.struct(F.lit(k).alias("key"), value[k].alias("value"), *[c.alias(f"s{i}") for i, c in zip(slots, here)]))
    summed = wide.select(F.inline(F.array(*rows))).filter("value is not null").groupBy("key", "value").agg(
        *[F.count(f"s{i}").alias(f"n{i}") for i in slots], *[F.sum(f"s{i}").alias(f"s{i}") for i in slots])
    summed = written(summed)
    sizes = lookup(summed.groupBy("key").agg(*[F.sum(f"n{i}").alias(f"all{i}") for i in slots]))
    placed = running(summed, ["key"], ["value"], {f"_u{i}": ("sum", f"n{i}") for i in slots}, limit=limit).join(sizes, "key")
    own = [F.col(f"_u{i}") - (F.col(f"n{i}") - 1) / 2.0 - (F.col(f"all{i}") + 1) / 2.0 for i in slots]
    sums = placed.groupBy("key").agg(
        *[F.sum(F.col(f"n{i}") * own[i] * own[i]).alias(f"aa{i}") for i in slots],
        *[F.sum(F.col(f"s{i}") * own[i]).alias(f"ab{i}") for i in slots], *[F.sum(f"n{i}").alias(f"rows{i}") for i in slots])
    found = [
        F.when(F.col("key") == k, F.array(*[
            F.struct(F.lit(names[p]).alias("population"), F.lit(t[2]).alias("x_name"), F.lit(t[3]).alias("y_name"), F.lit(t[1]).alias("column"),
                     F.lit(seen.index((p, j))).alias("at"), F.col(f"rows{i}").alias("n_rows"), F.col(f"aa{i}").alias("aa"), F.col(f"ab{i}").alias("ab"))
            for i, (p, t) in enumerate(listed[k])]))
        for j, k in enumerate(keys)
    ]
    flat = sums.select(F.inline(F.coalesce(*found))).filter("n_rows > 0").join(F.broadcast(spread), "column")
    bb = F.element_at(F.array(*[F.col(f"bb{i}") for i in range(len(seen))]), F.col("at") + 1)
    r = F.when((F.col("aa") > 0) & (bb > 0), F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(bb))
    return flat.select("population", "x_name", "y_name", "n_rows", r.alias("spearman_r"))


def _pairs_joined(df: DataFrame, pairs: Sequence[tuple[str, str]], populations: Mapping[str, str], limit: int | None) -> DataFrame:
    """Equal (x, y) rows are counted first, the ranks come from ordered value counts."""
    cells = [F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"),
                      F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in pairs]
    scopes = F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in populations.items()])
    spread = df.select(F.explode(F.filter(scopes, lambda s: s.isNotNull())).alias("population"), F.array(*cells).alias("_c"))
    long = spread.select("population", F.inline("_c")).filter("x is not null and y is not null")
    part = ["population", "x_name", "y_name"]
    joint = long.groupBy(*part, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    rx = average_ranks(long.withColumn("value", F.col("x")), part, limit=limit)
    ry = average_ranks(long.withColumn("value", F.col("y")), part, limit=limit)
    ranked = joint.join(
        rx.select(*part, F.col("value").alias("x"), F.col("rank").alias("rx"), "size"), [*part, "x"]
    ).join(ry.select(*part, F.col("value").alias("y"), F.col("rank").alias("ry")), [*part, "y"])
    mid = (F.col("size") + 1) / 2.0
    a, b, w = F.col("rx") - mid, F.col("ry") - mid, F.col("w")
    sums = ranked.groupBy(*part).agg(
        F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w).alias("n_rows")
    )
    r = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb")))
    return sums.select(*part, "n_rows", r.alias("spearman_r"))


def spearman_matrix(df: DataFrame, columns: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """Upper triangle of the rank correlation matrix, four decimals.

    Each column is ranked once over all its values; a pair uses the rows where both are present. If there are few
    columns, those of few values meet their ranks by broadcast, in the row; a single column of many values is then counted with the sums of these
    ranks per value. Otherwise values meet their ranks in long form and come back as one row of ranks
    each, two shuffles of the fact whatever the number of columns. Pairs are summed by matrix products within a
    partition.
    """
    many = _many_valued(df, columns) if 2 <= len(columns) <= FEW_COLUMNS else set(columns)
    parts = _matrix_in_place(df, columns, many, limit) if len(many) < 2 <= len(columns) else _matrix_joined(df, columns, limit)
    total = parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in _SUMS])
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    va, vb = F.col("aa") - a * a / n, F.col("bb") - b * b / n
    r = F.when((n > 1) & (va > 0) & (vb > 0), (F.col("ab") - a * b / n) / F.sqrt(va) / F.sqrt(vb))
    name = F.array(*[F.lit(c) for c in columns])
    found = total.select(F.get(name, F.col("i")).alias("variable_1"), F.get(name, F.col("j")).alias("variable_2"), F.round(r, 4).alias("spearman_r"))
    return found.filter("spearman_r is not null").withColumn("absolute_r", F.abs("spearman_r"))


_SUMS = ("n", "a", "b", "aa", "bb", "ab")
_PAIR_SUMS = "i int, j int, " + ", ".join(f"{k} double" for k in _SUMS)


def _pair_sums(value: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
    """Sums of all pairs of columns over the rows of a batch: ``there`` is one where a rank is present, ``value`` zero elsewhere."""
    square = value * value
    sums = [there.T @ there, value.T @ there, there.T @ value, square.T @ there, there.T @ square, value.T @ value]
    i, j = np.triu_indices(value.shape[1], 1)
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(x[i, j]) for x in sums)], names=["i", "j", *_SUMS])


def _centred(ranks: DataFrame) -> DataFrame:
    return ranks.select("column", "value", (F.col("rank") - (F.col("size") + 1) / 2.0).alias("rank"))


def _matrix_in_place(df: DataFrame, columns: Sequence[str], many: set[str], limit: int | None) -> DataFrame:
    """(i, j) -> sums, with at most one column of many values."""
    at = {c: i for i, c in enumerate(columns)}
    few = [c for c in columns if c not in many]
    base = df.select(*[no_nan(F.col(c).cast("double")).alias(f"_c_{i}") for i, c in enumerate(columns)])
    long = unpivot(base.toDF(*columns).select(*few), [], few)
    ranks = written(_centred(average_ranks(long, ["column"], limit=limit)))
    wide = _with_ranks(base.withColumns({f"_v_{i}": F.col(f"_c_{at[c]}") for i, c in enumerate(few)}), ranks, few, ["rank"])
    width = len(columns)
    place = [at[c] for c in few]

    def products(batches):
        for batch in batches:
            value, there = np.zeros((batch.num_rows, width)), np.zeros((batch.num_rows, width))
            for i, column in zip(place, batch.columns):
                there[:, i] = np.asarray(pc.is_valid(column))
                value[:, i] = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)
            yield _pair_sums(value, there)

    parts = wide.select(*[f"rank_{i}" for i in range(len(few))]).mapInArrow(products, _PAIR_SUMS)
    for big in many:
        own = f"_c_{at[big]}"
        counted = wide.filter(F.col(own).isNotNull()).groupBy(F.col(own).alias("value")).agg(
            F.count(F.lit(1)).alias("rows"), *[F.count(f"rank_{i}").alias(f"n{i}") for i in range(len(few))],
            *[F.sum(f"rank_{i}").alias(f"s{i}") for i in range(len(few))], *[F.sum(F.col(f"rank_{i}") * F.col(f"rank_{i}")).alias(f"q{i}") for i in range(len(few))])
        counted = written(counted.withColumn("column", F.lit(big)))
        size = lookup(counted.groupBy("column").agg(F.sum("rows").alias("size")))
        ranked = running(counted, ["column"], ["value"], {"_upto": ("sum", "rows")}, limit=limit).join(size, "column")
        mine = F.col("_upto") - (F.col("rows") - 1) / 2.0 - (F.col("size") + 1) / 2.0
        sums = ranked.agg(*[
            F.struct(F.sum(f"n{i}").cast("double").alias("n"), F.sum(mine * F.col(f"n{i}")).alias("a"), F.sum(f"s{i}").alias("b"),
                     F.sum(mine * mine * F.col(f"n{i}")).alias("aa"), F.sum(f"q{i}").alias("bb"), F.sum(mine * F.col(f"s{i}")).alias("ab")).alias(f"p{i}")
            for i in range(len(few))])
        cells = []
        for i, c in enumerate(few):
            turn = dict(zip(_SUMS, ("n", "b", "a", "bb", "aa", "ab") if at[c] < at[big] else _SUMS))
            one, other = sorted((at[c], at[big]))
            cells.append(F.struct(F.lit(one).alias("i"), F.lit(other).alias("j"), *[F.col(f"p{i}.{turn[k]}").alias(k) for k in _SUMS]))
        if cells:
            # the products hold zeros for this column
            parts = parts.filter((F.col("i") != at[big]) & (F.col("j") != at[big])).unionByName(sums.select(F.inline(F.array(*cells))))
    return parts


def _matrix_joined(df: DataFrame, columns: Sequence[str], limit: int | None) -> DataFrame:
    """(i, j) -> sums, for any columns."""
    at = {c: i for i, c in enumerate(columns)}
    base = written(df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).cast("double").alias(c) for c in columns]))
    long = unpivot(base, ["_row"], columns)
    ranks = average_ranks(long.select("column", "value"), ["column"], limit=limit)
    place = F.element_at(F.create_map(*[x for c, i in at.items() for x in (F.lit(c), F.lit(i))]), F.col("column"))
    rows = long.join(lookup(_centred(ranks)), ["column", "value"]).groupBy("_row").agg(F.collect_list(F.struct(place.alias("i"), "rank")).alias("r"))
    size = len(columns)

    def products(batches):
        for batch in batches:
            lists = batch.column("r")
            n, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
            row, column = np.repeat(np.arange(len(n)), n), flat.field("i").to_numpy()
            value, there = np.zeros((len(n), size)), np.zeros((len(n), size))
            value[row, column], there[row, column] = flat.field("rank").to_numpy(), 1.0
            yield _pair_sums(value, there)

    return rows.select("r").mapInArrow(products, _PAIR_SUMS)


def process_pairs(pairs: DataFrame, results: Sequence[str]) -> DataFrame:
    """Pairs without a result variable on either side."""
    return pairs.filter(~F.col("variable_1").isin(list(results)) & ~F.col("variable_2").isin(list(results)))


def cramers_v(df: DataFrame, categories: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Association of every category with every outcome, from one counting pass.

    chi2 = n (sum o^2 / (row total * column total) - 1), so empty cells need not exist.
    """
    cells = [
        F.struct(F.lit(c).alias("category"), F.lit(o).alias("outcome"),
                 F.col(c).cast("string").alias("a"), F.col(o).cast("string").alias("b"))
        for c in categories for o in outcomes
    ]
    pair = ["category", "outcome"]
    counts = df.select(F.inline(F.array(*cells))).filter("a is not null and b is not null").groupBy(*pair, "a", "b").agg(
        F.count(F.lit(1)).alias("o")
    )
    counts = lookup(counts)
    rows = counts.groupBy(*pair, "a").agg(F.sum("o").alias("r"))
    cols = counts.groupBy(*pair, "b").agg(F.sum("o").alias("c"))
    joined = counts.join(rows, [*pair, "a"]).join(cols, [*pair, "b"])
    share = joined.groupBy(*pair).agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o") * 1.0 / F.col("r") * F.col("o") / F.col("c")).alias("q"),
        F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"),
    )
    v = F.when(
        F.least("na", "nb") >= 2,
        F.sqrt(F.try_divide(F.greatest(F.col("q") - 1, F.lit(0.0)), F.least("na", "nb") - 1)),
    )
    return share.select(*pair, v.alias("cramers_v"))


def histogram(df: DataFrame, measures: Sequence[str], normal: str, bins: int = 32, digits: int = 5) -> DataFrame:
    """Equal-width bins over the full range, counted for normal and other rows.

    The last edge belongs to the last bin; a constant column gets a range of one around it.
    """
    ends = df.agg(*[f(m).alias(f"{n}_{m}") for m in measures for n, f in (("lo", F.min), ("hi", F.max))])
    long = unpivot(df.withColumn("_normal", F.expr(normal)), ["_normal"], measures)
    cells = []
    for m in measures:
        flat = F.col(f"lo_{m}") == F.col(f"hi_{m}")
        half = F.when(flat, 0.5).otherwise(0.0)
        cells.append(F.struct(F.lit(m).alias("column"), (F.col(f"lo_{m}") - half).alias("lo"), (F.col(f"hi_{m}") + half).alias("hi")))
    edges = ends.select(F.inline(F.array(*cells)))
    joined = long.join(F.broadcast(edges), "column")
    slot = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counted = joined.withColumn("bin", F.least(slot, F.lit(bins - 1)).cast("int")).groupBy("column", "bin").agg(
        F.count_if(F.col("_normal")).alias("normal_rows"),
        F.count_if(~F.coalesce(F.col("_normal"), F.lit(False))).alias("other_rows"),
    )
    slots = edges.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return slots.join(counted, ["column", "bin"], "left").select(
        "column", "bin", F.round(F.col("lo") + F.col("bin") * width, digits).alias("edge"),
        F.coalesce("normal_rows", F.lit(0)).alias("normal_rows"),
        F.coalesce("other_rows", F.lit(0)).alias("other_rows"),
    )


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows in the given order."""
    return df.orderBy(*order).limit(n)
