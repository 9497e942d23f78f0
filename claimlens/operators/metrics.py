"""Scorer evaluation on ``(label, score)``.

Curves are built on distinct scores: rows are first counted by score, and the running counts of
those go through ``running_counts``, which sorts by range over all tasks and adds the totals of
the earlier ranges.  Ranks of rows number the rows of one score likewise, by ranges of the key.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import materialise
from .rules import unpivot


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    n, pos = (F.sum(weight), F.sum(F.col(weight) * F.col(label))) if weight else (F.count("*"), F.sum(label))
    return df.groupBy(*by, F.col(score).alias("s")).agg(n.cast("long").alias("n"), pos.cast("long").alias("pos"))


def running_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int = 64, weight: str | None = None) -> DataFrame:
    """Per distinct score: rows and positives at or above it (``n_ge, pos_ge``), and in total; rows
    count ``weight`` times if it is given.

    Buckets hold about equally many distinct scores, however these are spread; a window runs within
    each, and the totals of the higher buckets (at most ``buckets`` rows a group) are added.  Where the
    borders lie does not change the result, but they depend on the order in which sketches are merged, so they are
    written once: a score lies in the same bucket wherever it is read.
    """
    counts = materialise(score_counts(df, label, score, by, weight), "scores")
    borders = F.percentile_approx("s", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000)
    span = materialise(counts.groupBy(*by).agg(borders.alias("_borders"), F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all")), "borders")
    counts = counts.join(span, list(by)) if by else counts.join(F.broadcast(span))
    counts = counts.withColumn("_b", F.size(F.filter("_borders", lambda x: x <= F.col("s")))).drop("_borders")
    totals = counts.groupBy(*by, "_b").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_on"), F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_op"))
    inside = Window.partitionBy(*by, "_b").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.join(offsets, [*by, "_b"])  # at most ``buckets`` rows of each group
    return out.select(*by, "s", "n", "pos", (F.sum("n").over(inside) + F.col("_on")).alias("n_ge"), (F.sum("pos").over(inside) + F.col("_op")).alias("pos_ge"), "n_all", "pos_all")


def exact_percentiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Linearly interpolated percentiles of each group, one column for each share (``p0, p1, ..``).

    The values next to a rank are picked from the running counts, so no task holds the distinct values of a
    group.  Null values do not count; a group of nulls only is left out.
    """
    names = list(names or [f"p{i}" for i in range(len(shares))])
    run = running_counts(df.where(F.col(column).isNotNull()).withColumn("_none", F.lit(0)), "_none", column, by)
    below, upto = F.col("n_all") - F.col("n_ge"), F.col("n_all") - F.col("n_ge") + F.col("n")
    picked = []
    for name, share in zip(names, shares):
        rank = F.lit(share) * (F.col("n_all") - 1)
        for end, r in (("low", F.floor(rank)), ("high", F.ceil(rank))):
            picked.append(F.max(F.when((below <= r) & (r < upto), F.col("s").cast("double"))).alias(f"_{name}_{end}"))
    found = run.groupBy(*by).agg(F.max("n_all").alias("_n"), *picked).where("_n is not null")
    rank = lambda share: F.lit(share) * (F.col("_n") - 1)
    inside = [(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * (rank(q) - F.floor(rank(q)))).alias(n) for n, q in zip(names, shares)]
    return found.select(*by, *inside)


def even_percentiles(df: DataFrame, column: str, steps: int, by: Sequence[str]) -> DataFrame:
    """The ``steps + 1`` percentiles 0, 1 / steps, .. of each group as the array ``q``, interpolated as in
    ``exact_percentiles``; each distinct value meets only the percentiles next to its ranks."""
    run = running_counts(df.where(F.col(column).isNotNull()).withColumn("_none", F.lit(0)), "_none", column, by)
    below, upto = F.col("n_all") - F.col("n_ge"), F.col("n_all") - F.col("n_ge") + F.col("n")
    gap = F.greatest(F.col("n_all") - 1, F.lit(1)) / F.lit(steps)
    first, last = F.greatest(F.floor((below - 1) / gap), F.lit(0)), F.when(F.col("n_all") == 1, steps).otherwise(F.least(F.ceil(upto / gap), F.lit(steps)))
    near = run.select(*by, "s", below.alias("_from"), upto.alias("_to"), "n_all", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("i"))
    rank = F.col("i") / F.lit(float(steps)) * (F.col("n_all") - 1)
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("s").cast("double")))
    ends = near.groupBy(*by, "i", "n_all").agg(at(F.floor(rank)).alias("low"), at(F.ceil(rank)).alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (rank - F.floor(rank))
    return ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"]).alias("q"))


def confusion(label: str, flagged: Column) -> list[Column]:
    y = F.col(label)
    return [F.count_if(flagged & (y == 1)).alias("tp"), F.count_if(flagged & (y == 0)).alias("fp"), F.count_if(~flagged & (y == 1)).alias("fn"), F.count_if(~flagged & (y == 0)).alias("tn")]


def _rates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return df.select(*by, "tp", "fp", "fn", "tn", safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"), safe_ratio(5 * p * r, 4 * p + r).alias("f2"), safe_ratio(fp, fp + tn).alias("fpr"), safe_ratio(tp + fp, tp + fp + fn + tn).alias("flag_rate"))


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and their rates at a threshold; 0/0 is 0."""
    return _rates(df.groupBy(*by).agg(*confusion(label, F.col(score) >= threshold)), by)


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """ROC-AUC (ties count half), average precision over distinct thresholds (no interpolation)
    and Brier score (scores clipped to 0..1)."""
    run = running_counts(df, label, score, by, weight=weight)
    n, pos, neg = F.col("n").cast("double"), F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    above = (F.col("pos_ge") - F.col("pos")).cast("double")  # positives strictly above
    auc = F.sum(neg * (above + pos / 2)) / F.max(F.col("pos_all").cast("double") * (F.col("n_all") - F.col("pos_all")))
    ap = F.sum(pos / F.col("pos_all") * F.col("pos_ge") / F.col("n_ge"))
    curve = run.groupBy(*by).agg(auc.alias("roc_auc"), ap.alias("pr_auc"))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    w = F.col(weight) if weight else F.lit(1)
    brier = df.groupBy(*by).agg((F.sum(w * F.pow(clipped - F.col(label), F.lit(2.0))) / F.sum(w)).alias("brier"))
    return curve.join(brier, list(by)) if by else curve.join(F.broadcast(brier))


def recall_at_precision(df: DataFrame, label: str, score: str, least: float, by: Sequence[str] = ()) -> DataFrame:
    run = running_counts(df, label, score, by)
    ok = F.col("pos_ge") / F.col("n_ge") >= least
    return run.groupBy(*by).agg(F.coalesce(F.max(F.when(ok, F.col("pos_ge") / F.col("pos_all"))), F.lit(0.0)).alias("recall"))


MOST_TIES = 100_000  # rows of one score that one task may number
MOST_HELD = 250_000  # rows of a bootstrap that one task holds as a hash table


def _ties(df: DataFrame, key: str, score: str, by: Sequence[str], buckets: int = 64) -> DataFrame:
    """``_tie``: the number of each row among those of its score and group, by the numeric ``key``.

    The rows of a score that more than ``MOST_TIES`` have are numbered within ``buckets`` ranges of the key, and the counts
    of the lower ranges are added.  Such scores are fewer than the rows over ``MOST_TIES``.
    """
    group = [*by, score]
    crowded = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_TIES)
    borders = F.percentile_approx(key, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000)
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group])
    cuts = df.alias("d").join(F.broadcast(crowded).alias("c"), same("d", "c"), "left_semi").groupBy(*group).agg(borders.alias("_borders"))
    cuts = materialise(cuts, "cuts")  # another merge of the sketches would cut elsewhere
    rows = df.alias("d").join(F.broadcast(cuts).alias("c"), same("d", "c"), "left").select("d.*", F.coalesce(F.size(F.filter("c._borders", lambda x: x < F.col(f"d.{key}"))), F.lit(0)).alias("_range"))
    rows = rows.withColumn("_range", F.greatest("_range", F.lit(0)))  # no borders: one range
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(key))
    lower = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    offsets = offsets.select(*group, "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"))
    met = rows.withColumn("_i", inside).alias("r").join(offsets.alias("o"), same("r", "o") & (F.col("r._range") == F.col("o._range")))
    return met.select("r.*", "o._lower").withColumn("_tie", F.col("_i") + F.col("_lower")).drop("_i", "_range", "_lower")


def _numbered(df: DataFrame, key: str, score: str, by: Sequence[str], descending: bool = True) -> DataFrame:
    """Row number by score within each group (ties by key), from running counts of distinct scores."""
    counts = running_counts(df.withColumn("_one", F.lit(0)), "_one", score, by)
    before = F.col("n_ge") - F.col("n") if descending else F.col("n_all") - F.col("n_ge")
    counts = counts.select(*by, F.col("s").alias(score), before.alias("_before"), F.col("n_all").alias("_all"))
    return _ties(df, key, score, by).join(counts, [*by, score]).withColumn("_rank", F.col("_before") + F.col("_tie")).drop("_before", "_tie")


def precision_at_top(df: DataFrame, key: str, label: str, score: str, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    """Precision among the top ``max(1, round half to even(fraction * n))`` rows."""
    ranked = _numbered(df, key, score, by)
    k = F.greatest(F.lit(1), F.bround(fraction * F.col("_all")))
    return ranked.where(F.col("_rank") <= k).groupBy(*by).agg(F.count("*").alias("k"), F.avg(label).alias("precision"))


def cost_threshold(df: DataFrame, label: str, score: str, ratio: float, steps: int = 400, by: Sequence[str] = ()) -> DataFrame:
    """For each group the threshold of least ``ratio * FN + FP`` among ``steps + 1`` quantiles and one above all
    scores; ties go to the higher.  Also the Bayes threshold 1 / (1 + ratio)."""
    by, df = list(by) or ["_all"], df if by else df.withColumn("_all", F.lit(1))
    q = even_percentiles(df, score, steps, by).select(*by, F.array_sort(F.array_distinct(F.concat("q", F.array(F.lit(1 + 1e-9))))).alias("q"))
    # each distinct score counts for the candidates up to it: its place among them, then sums from the top
    placed = score_counts(df, label, score, by).join(q, by).select(*by, "n", "pos", F.size(F.filter("q", lambda t: t <= F.col("s"))).alias("k"))
    sums = placed.groupBy(*by, "k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    grid = q.select(*by, F.posexplode("q").alias("i", "t")).select(*by, (F.col("i") + 1).alias("k"), "t").join(sums, [*by, "k"], "left").fillna(0, ["n", "pos"])
    whole = Window.partitionBy(*by)  # at most steps + 2 rows
    above = whole.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({"flagged": F.sum("n").over(above), "tp": F.sum("pos").over(above), "all": F.sum("pos").over(whole)})
    cost = ratio * (F.col("all") - F.col("tp")) + F.col("flagged") - F.col("tp")
    best = grid.select(*by, cost.alias("cost"), F.col("t").alias("threshold")).groupBy(*by).agg(F.min(F.struct("cost", (-F.col("threshold")).alias("less"))).alias("m"))
    return best.select(*[c for c in by if c != "_all"], (-F.col("m.less")).alias("threshold"), F.col("m.cost").alias("cost"), F.lit(1 / (1 + ratio)).alias("bayes"))


def capacity_threshold(df: DataFrame, score: str, fraction: float, by: Sequence[str] = ()) -> DataFrame:
    return exact_percentiles(df, score, [1 - fraction], by, ["threshold"])


def reliability_table(df: DataFrame, key: str, label: str, score: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Bins of the first-come rank: greatest(ceil((r - 1) * bins / (n - 1)), 1) - 1."""
    ranked = _numbered(df, key, score, by, descending=False)
    bin_ = F.greatest(F.ceil((F.col("_rank") - 1) * bins / F.greatest(F.col("_all") - 1, F.lit(1))), F.lit(1)) - 1
    out = ranked.groupBy(*by, bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.sum(label).cast("long").alias("positives"))
    low, high = C.wilson(F.col("positives"), F.col("n"))
    return out.select(*by, "bin", "n", "mean_score", (F.col("positives") / F.col("n")).alias("observed"), low.alias("ci_low"), high.alias("ci_high"))


def lift_table(df: DataFrame, key: str, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Deciles floor(r0 * 10 / n) + 1 by descending score, with lift and cumulative recall."""
    ranked = _numbered(df, key, score, by)
    decile = (F.floor((F.col("_rank") - 1) * 10 / F.col("_all")) + 1).cast("long")
    out = ranked.groupBy(*by, decile.alias("decile")).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"), F.min(score).alias("min_score"))
    part = Window.partitionBy(*by)  # ten rows a group
    total, rows = F.sum("positives").over(part), F.sum("n").over(part)
    run = F.sum("positives").over(part.orderBy("decile"))
    rate = F.col("positives") / F.col("n")
    return out.select(*by, "decile", "n", "positives", "min_score", rate.alias("rate"), (rate / (total / rows)).alias("lift"), (run / total).alias("cum_recall"))


def group_metrics(df: DataFrame, groups: Sequence[str], label: str, score: str, threshold: float) -> DataFrame:
    """Per attribute and value: confusion counts, recall (null without positives), precision
    (0 without flags), false-positive and flag rates; one aggregate for all attributes."""
    long = unpivot(df, groups, [label, score], "attribute", "value", "string")
    out = long.groupBy("attribute", "value").agg(*confusion(label, F.col(score) >= threshold))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return out.select("attribute", "value", n.alias("n"), (tp + fn).alias("positives"), F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"), safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(fp, fp + tn).alias("fpr"), ((tp + fp) / n).alias("flag_rate"))


def worst_segments(groups: DataFrame, k: int = 8, least: int = 50) -> tuple[DataFrame, DataFrame]:
    big = groups.where(F.col("n") >= least)
    return big.where("positives > 0").orderBy("recall", "attribute", "value").limit(k), big.orderBy(F.desc("fpr"), "attribute", "value").limit(k)


def bootstrap_sample(df: DataFrame, key: str, label: str, replicates: int, seed: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """Rows of each group ``by`` with a ``replicate`` and a ``weight``: how often a class-stratified resample draws them.

    Draw i of replicate r in a class of n rows takes the row floor(u * n) + 1, with u from
    md5(seed, r, class, i): the same on every engine and whatever the partitioning.
    """
    from .model import stratum_numbers

    strata = [*by, label]
    rows = stratum_numbers(df, key, strata)
    sizes = rows.select(*strata, "_row", "_size")
    draws = sizes.select(*strata, "_size", F.col("_row").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replicate", label, "i")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    taken = draws.select(*strata, "replicate", (F.floor(u * F.col("_size")) + 1).alias("_row")).groupBy(*strata, "replicate", "_row").agg(F.count("*").alias("weight"))
    return rows.drop("_size").join(taken, [*strata, "_row"]).drop("_row")


def bootstrap_cells(df: DataFrame, key: str, label: str, cells: Sequence[str], replicates: int, seed: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """The draws of ``bootstrap_sample`` as counts: ``by, label, cells, replicate, weight`` of the distinct ``cells`` that are drawn.

    The numbered rows are written once, with one ``_place`` for all strata.  A draw is a place and a replicate; it meets its row in a hash
    table of at most about ``MOST_HELD`` rows and is counted by cell in that task, so draws are shuffled once and never sorted.
    """
    from .model import stratum_numbers

    strata = [*by, label]
    own = materialise(df.select(key, *strata, *cells), "rows")
    numbered = materialise(stratum_numbers(own, key, strata).drop(key), "numbered")
    ends = Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)  # a row for each stratum
    sizes = numbered.groupBy(*strata).agg(F.max("_size").alias("_size")).withColumn("_start", F.coalesce(F.sum("_size").over(ends), F.lit(0)))
    placed = numbered.drop("_size").join(F.broadcast(sizes), strata)
    draws = placed.select(label, "_row", "_size", "_start", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replicate", label, "_row")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    draws = draws.select((F.col("_start") + F.floor(u * F.col("_size")) + 1).alias("_place"), "replicate")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // MOST_HELD))
    rows = placed.select((F.col("_start") + F.col("_row")).alias("_place"), *strata, *cells).repartition(parts, "_place")
    met = draws.repartition(parts, "_place").join(rows.hint("shuffle_hash"), "_place")
    return met.groupBy(*strata, *cells, "replicate").agg(F.count("*").alias("weight"))


def _multinomial(n, counts: np.ndarray, *seed) -> np.ndarray:
    """How often each cell is drawn in ``n`` draws with shares as ``counts``; the seed alone decides."""
    return np.random.default_rng([zlib.crc32(repr(s).encode()) for s in seed]).multinomial(int(n), counts / counts.sum())


def bootstrap_counts(df: DataFrame, label: str, scores: Sequence[str], replicates: int, seed: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """A class-stratified resample by its counts: ``by, label, scores, replicate, weight`` of the distinct scores that are drawn.

    A replicate costs the distinct scores and not the rows.  These are counted once and dealt into ranges by their hash; the rows of a class are split over
    the ranges by one multinomial draw for each replicate (a row for each range), and those of a range over its scores by another, in the range's
    task.  The seed, class, range and replicate decide each draw, so any partitioning gives the same counts.
    """
    strata, scores = [*by, label], list(scores)
    cells = df.groupBy(*strata, *scores).agg(F.count("*").alias("_m"))
    each = max(1000, 2_000_000 // replicates)  # cells of a range, whose draws one task holds
    ranges = -(-cells.count() // each) or 1
    cells = cells.withColumn("_b", F.pmod(F.xxhash64(*scores), F.lit(ranges)).cast("int"))
    kind = lambda c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    named = ", ".join(kind(c) for c in strata)

    def over_ranges(key, rows):
        rows = rows.sort_values("_b", ignore_index=True)
        drawn = [_multinomial(rows["_m"].sum(), rows["_m"].to_numpy(float), seed, key, "ranges", r) for r in range(1, replicates + 1)]
        return pd.DataFrame({c: rows[c] for c in strata} | {"_b": rows["_b"], "_drawn": list(np.array(drawn).T)})

    def over_scores(key, rows, drawn):
        if not len(rows) or not len(drawn):
            return pd.DataFrame({c: [] for c in [*strata, *scores, "replicate", "weight"]})
        rows, out = rows.sort_values(scores, ignore_index=True), []
        for r, n in enumerate(drawn["_drawn"].iloc[0], 1):
            weight = _multinomial(n, rows["_m"].to_numpy(float), seed, key, r)
            hit = np.flatnonzero(weight)
            out.append(rows.loc[hit, [*strata, *scores]].assign(replicate=r, weight=weight[hit]))
        return pd.concat(out, ignore_index=True)

    split = cells.groupBy(*strata, "_b").agg(F.sum("_m").alias("_m")).groupBy(*strata).applyInPandas(over_ranges, f"{named}, _b int, _drawn array<long>")
    group = [*strata, "_b"]
    shape = f"{named}, {', '.join(kind(c) for c in scores)}, replicate int, weight long"
    return cells.groupBy(*group).cogroup(split.groupBy(*group)).applyInPandas(over_scores, shape)


def _resample(df: DataFrame, key: str, label: str, scores: Sequence[str], replicates: int, seed: str, by: Sequence[str], draw: str) -> DataFrame:
    """``rows`` draws rows by md5, which SQL can follow; ``scores`` draws counts of distinct scores, for large tables."""
    return bootstrap_counts(df, label, scores, replicates, seed, by) if draw == "scores" else bootstrap_cells(df, key, label, scores, replicates, seed, by)


def bootstrap_rate_ci(df: DataFrame, key: str, label: str, score: str, threshold: float, replicates: int = 50, seed: str = "b", by: Sequence[str] = (), draw: str = "rows") -> DataFrame:
    """Percentile intervals of recall and precision at a fixed threshold, for each group."""
    hit, y, w = F.col(score) >= threshold, F.col(label) == 1, F.col("weight")
    if draw == "rows":  # a row counts by whether it is flagged
        df, score, hit = df.withColumn("_hit", hit), "_hit", F.col("_hit")
    sample = _resample(df, key, label, [score], replicates, seed, by, draw)
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    per = sample.groupBy(*by, "replicate").agg(total(hit & y).alias("tp"), total(hit & ~y).alias("fp"), total(~hit & y).alias("fn"))
    per = per.select(*by, safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
    out = per.groupBy(*by).agg(*[F.percentile(m, q).alias(f"{m}_{n}") for m in ("recall", "precision") for n, q in (("low", 0.025), ("high", 0.975))])
    return out


def metrics_with_ci(df: DataFrame, key: str, label: str, score: str, threshold: float, replicates: int = 50, seed: str = "b", by: Sequence[str] = (), draw: str = "rows") -> DataFrame:
    """Every metric of each group with its value and percentile interval: ``by, metric, value, low, high``.
    The threshold is held fixed; replicates go through the same operators as one more group, and all are counted by score and written once."""
    names = ("accuracy", "precision", "recall", "f1", "f2", "fpr", "flag_rate", "roc_auc", "pr_auc", "brier")
    used = [*by, label, score, "replicate", "weight"]
    whole = df.groupBy(*by, label, score).agg(F.count("*").alias("weight")).withColumn("replicate", F.lit(0))
    sample = materialise(_resample(df, key, label, [score], replicates, seed, by, draw).select(*used).unionByName(whole.select(*used)), "sample")
    group = [*by, "replicate"]
    flagged, y, w = F.col(score) >= threshold, F.col(label) == 1, F.col("weight")
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0))
    rates = _rates(sample.groupBy(*group).agg(total(flagged & y).alias("tp"), total(flagged & ~y).alias("fp"), total(~flagged & y).alias("fn"), total(~flagged & ~y).alias("tn")), group)
    both = rates.join(ranking_metrics(sample, label, score, group, "weight"), group)
    long = unpivot(both, names, group, "metric", "x", "double")
    drawn = F.when(F.col("replicate") > 0, F.col("x"))
    return long.groupBy(*by, "metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("x"))).alias("value"), F.percentile(drawn, 0.025).alias("low"), F.percentile(drawn, 0.975).alias("high"))


def success_criterion(intervals: DataFrame, base_rate: DataFrame, flag_rate: str, by: Sequence[str], times: float = 2.0) -> DataFrame:
    """Whether a scorer is clearly better than chance: the lower bound of precision exceeds ``times`` the base rate
    and that of recall ``times`` the flag rate."""
    met = intervals.join(base_rate, list(by))
    good, caught = F.col("precision_low") > times * F.col("base_rate"), F.col("recall_low") > times * F.col(flag_rate)
    return met.select(*by, good.alias("precision_ok"), caught.alias("recall_ok"), (good & caught).alias("success"))


def paired_bootstrap(df: DataFrame, key: str, label: str, score_a: str, score_b: str, threshold: float, replicates: int = 50, seed: str = "b", by: Sequence[str] = (), draw: str = "rows") -> DataFrame:
    """Interval of the recall of b less that of a on the same resamples of each group."""
    w, flagged = F.col("weight"), lambda s: F.col(s) >= threshold
    if draw == "rows":  # a row counts by which score flags it
        df, score_a, score_b, flagged = df.withColumns({"_flag_a": flagged(score_a), "_flag_b": flagged(score_b)}), "_flag_a", "_flag_b", F.col
    sample = _resample(df.where(F.col(label) == 1), key, label, [score_a, score_b], replicates, seed, by, draw)
    share = lambda s: F.sum(F.when(flagged(s), w).otherwise(0)) / F.sum(w)
    per = sample.groupBy(*by, "replicate").agg((share(score_b) - share(score_a)).alias("d"))
    return per.groupBy(*by).agg(F.avg("d").alias("mean_diff"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))


def comparison(df: DataFrame, label: str, scores: Sequence[str], fraction: float) -> DataFrame:
    """Each score column at the threshold that flags about the same fraction."""
    long = unpivot(df, scores, [label], "model", "p", "double")
    cut = capacity_threshold(long, "p", fraction, ["model"])
    at = long.join(F.broadcast(cut), "model")
    return _rates(at.groupBy("model").agg(*confusion(label, F.col("p") >= F.col("threshold"))), ["model"])
