"""Steps that must give whole and steady results on large tables."""

import random

import pytest
from pyspark.sql import functions as F

from claimlens.operators import metrics, model, similar
from claimlens.plans import claims_queries, scoring_queries, verification_queries  # noqa: F401
from claimlens.plans.registry import ORACLES, QUERIES

from .helpers import assert_same


def shake_sketches(monkeypatch):
    """Sketches that come out a little different each time they are computed, as those of many tasks do."""
    sketch = F.percentile_approx
    shaken = F.udf(lambda borders: sorted(b + random.uniform(-40, 40) for b in borders), "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: shaken(sketch(*a)))


def test_borders_of_ranges_are_the_same_wherever_they_are_read(spark, monkeypatch):
    df = spark.range(5000).select("id", F.lit("g").alias("g"), (F.col("id") % 1000).cast("double").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    shake_sketches(monkeypatch)
    for _ in range(3):
        run = metrics.running_counts(df, "y", "s", ["g"])
        assert {r.s: r.n_ge for r in run.collect()} == {float(s): 5 * (1000 - s) for s in range(1000)}
    assert round(metrics.exact_percentiles(df, "s", [0.8], ["g"], ["p"]).first().p, 6) == 799.2  # between ranks 3999 (799) and 4000 (800)


def test_numbers_within_a_crowded_score_and_nearest_gaps_with_shaken_borders(spark, monkeypatch):
    df = spark.range(3000).select("id", F.lit("g").alias("g"), F.lit(0.5).alias("s"))
    shake_sketches(monkeypatch)
    monkeypatch.setattr(metrics, "MOST_TIES", 1000)
    assert {r.id: r._tie for r in metrics._ties(df, "id", "s", ["g"]).collect()} == {i: i + 1 for i in range(3000)}
    points, held = df.select("g", (F.col("id") + 0.25).alias("x")), df.where("id % 7 = 0").select("g", F.col("id").cast("double").alias("x"))
    want = {i + 0.25: min(abs(i + 0.25 - h) for h in (i - i % 7, i - i % 7 + 7) if h < 3000) for i in range(3000)}
    assert {r.x: r.gap for r in similar.nearest_gap(points, held, "g", "x").where("x % 1 > 0").collect()} == want


def test_gower_search_compares_no_blocks_of_all_rows(spark, sf_dir, duck, monkeypatch):
    def all_pairs(*_):
        raise AssertionError("every query meets every row")

    monkeypatch.setattr(similar, "blocks", all_pairs)
    assert_same(QUERIES["f02_gower"](spark, sf_dir), duck, ORACLES["f02_gower"])


def test_grounding_of_scores_that_end_in_a_half(spark, sf_dir, tmp_path):
    import os
    import shutil

    import duckdb

    for name in ("customer", "nation", "lineitem"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (list_extract([2250, 9250, 35750, 37250, 72500, 142500, 282500, 287500, 250250, 250750, 75, 725, 2325], o_orderkey // 10 % 13 + 1)::DOUBLE AS o_totalprice) FROM '{sf_dir}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    for name in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{tmp_path}/{name}'")
    for name in ("j11_grounding", "g05_recall_at_precision"):
        assert_same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])


def test_draws_are_counted_by_cell_without_a_sort(spark):
    df = spark.range(900).select(F.col("id"), (F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 11 / 10).alias("s"))
    cells = metrics.bootstrap_cells(df, "id", "y", ["s"], 7, by=["g"])
    want = metrics.bootstrap_sample(df, "id", "y", 7, by=["g"]).groupBy("g", "y", "s", "replicate").agg(F.sum("weight").alias("weight"))
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, want.collect()))
    assert "SortMergeJoin" not in cells._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    """Names of the shuffle files on disk."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffled_files_go_with_the_table_they_were_for(spark):
    import time

    from claimlens.sources.shared import materialise

    wide = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("x")).repartition(7, "x")
    before = shuffled(spark)
    assert materialise(wide, "wide").count() == 20_000
    for _ in range(50):  # deleted by a thread of its own
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before


def test_copies_of_a_vector_do_not_multiply_comparisons(spark):
    rows = spark.range(2400).select((F.col("id") * 7 % 2400).alias("id"), F.array((F.col("id") % 5 + 1).cast("double"), (F.col("id") % 3).cast("double"), F.lit(1.0)).alias("v"))
    tally = []
    got = similar.similar_claims(rows.where("id % 100 = 0"), rows, "id", "v", 3, tally=tally)
    every = {r.id: [x / sum(y * y for y in r.v) ** 0.5 for x in r.v] for r in rows.collect()}
    order = lambda q: sorted((-round(sum(a * b for a, b in zip(every[q], v)), 9), i) for i, v in every.items() if i != q)[:3]
    assert sorted((r.query, r["rank"], r.neighbour) for r in got.collect()) == sorted((q, k, i) for q in every if q % 100 == 0 for k, (_, i) in enumerate(order(q), 1))
    assert sum(tally) <= 24 * 15 * 4  # queries by distinct vectors by k + 1


def test_queries_in_lots_find_the_same(spark, monkeypatch):
    rows = spark.range(600).select("id", F.array(*[F.sin(F.col("id") * 7 + i) for i in range(6)]).alias("v"))
    whole, tables, write = similar.similar_claims(rows.where("id % 2 = 0"), rows, "id", "v", 4), [], similar.materialise
    monkeypatch.setattr(similar, "materialise", lambda df, name: tables.append(name) or write(df, name))
    lots = similar.similar_claims(rows.where("id % 2 = 0"), rows, "id", "v", 4, pivots=4, block=16, most_rows=1)
    assert tables.count("near") > 4  # both rounds in several lots
    assert sorted(map(tuple, lots.collect())) == sorted(map(tuple, whole.collect()))


def test_chain_joins_written_sources(spark, sf_dir):
    """Each source is shuffled once for the last join; what lies behind it has been written, and its shuffles are gone."""
    for name in ("j13_chain", "j08_facts", "l08_sources"):
        assert QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8


def counted(df):
    """``df``, and how many of its rows are computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


FITS = {
    "data_mix": lambda df, valid: model.data_mix(df, valid, [(0.0, 1.0, True), (1.0, 0.5, True)], "id", "split", "y", ["a"], ["x"], "logistic"),
    "utility_experiment": lambda df, valid: model.utility_experiment(df, valid, [("real", 0.0, 1.0, True), ("both", 1.0, 1.0, True)], "id", "split", "y", ["a"], ["x"]),
    "utility_seeds": lambda df, valid: model.utility_seeds(df, valid, [("real", 0.0, 1.0, True), ("both", 1.0, 1.0, True)], "id", "split", "y", ["a"], ["x"], seeds=(1, 2), masks={"both": model.F.col("x") > 0.1}, replicates=3),
    "compare_families": lambda df, valid: model.compare_families(df, valid, ["a"], ["x"], "y", "id", ("logistic", "forest")),
    "adversarial_validation": lambda df, _: model.adversarial_validation(df, "id", "split", "real_train", "synthetic", ["a"], ["x"], 2),
    "adversarial_drop_top": lambda df, _: model.adversarial_drop_top(df, "id", "split", "real_train", "synthetic", ["a"], ["x"], ["x"], 1, 2),
    "calibrate": lambda df, _: model.calibrate(df, "id", "y", "x", 2)[0],
    "calibration_report": lambda df, _: model.calibration_report(df, "id", "y", "x", 2),
}


@pytest.mark.parametrize("name", FITS)
def test_fits_compute_what_they_are_given_once(spark, name):
    rows = [(i, "real_train" if i % 3 else "synthetic", int(i % 4 == 0), min(0.9, (i * 37 % 10) / 20 + 0.3 * (i % 4 == 0)), "ab"[i % 2]) for i in range(240)]
    given = spark.createDataFrame(rows, "id int, split string, y int, x double, a string")
    (df, seen), (valid, seen_valid) = counted(given), counted(given)
    assert FITS[name](df, valid).count() > 0
    # numbering within strata reads its rows twice, for the sizes and for the rows
    assert seen.value <= 480 and seen_valid.value <= 240


@pytest.mark.parametrize("name", ["i08_clause_types", "i08_clause_checks", "i03_reference_lookup"])
def test_no_task_gathers_the_claims_of_a_policy_type(spark, sf_dir, duck, name):
    """Few policy types hold all claims, so neither are claims shuffled by them nor broadcast themselves."""
    key = {"i08_clause_types": "BasePolicy", "i08_clause_checks": "segment", "i03_reference_lookup": "coverage"}[name]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    try:
        for small in ("-1", before):
            spark.conf.set(limit, small)
            df = QUERIES[name](spark, sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in plan.splitlines() if "Join [" in x and f"Join [{key}#" in x]
            assert len(joins) == 1 and "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0], plan
            assert_same(df, duck, ORACLES[name])
    finally:
        spark.conf.set(limit, before)
