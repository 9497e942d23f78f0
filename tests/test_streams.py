"""Keyed tables and streams: replayed, broken-off and late batches against one run over all rows."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens import schema as S
from claimlens.operators import investigate, similar
from claimlens.streaming import jobs
from claimlens.streaming.store import KeyedTable, insert, upsert

from .test_operators import VALID

ROW = "id long, value string"


def content(table):
    return {r.id: r.value for r in table.read().collect()}


def test_keyed_table_replays_and_broken_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, ROW, ["id"], 8)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), ROW)
    assert content(table) == {} and table.committed() == (0, {}, {})
    first = rows((1, "a"), (2, "b"), (2, "b"), (None, "n"))
    assert table.update(0, first, insert(["id"]), "s")
    assert not table.update(0, rows((9, "never")), insert(["id"]), "s")  # the batch again, after its commit
    assert content(table) == {1: "a", 2: "b", None: "n"} and table.read().count() == 3
    # another stream counts its own batches, and keys are still added once
    assert table.update(0, rows((1, "other"), (3, "c")), insert(["id"]), "second")
    assert content(table) == {1: "a", 2: "b", 3: "c", None: "n"}

    # broken off between the data and the log: nothing is seen, and the batch run again gives each row once
    def breaks(old, new):
        insert(["id"])(old, new).withColumns({"bucket": table.bucket(), "version": F.lit(table.committed()[0] + 1)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{path}/data")
        raise RuntimeError("broken off")

    more = rows(*[(i, "x") for i in range(4, 40)])
    with pytest.raises(RuntimeError):
        table.update(1, more, breaks, "s")
    assert table.read().count() == 4
    assert table.update(1, more, insert(["id"]), "s") and table.read().count() == 40
    assert table.update(2, rows((5, "new"), (77, "y")), upsert(["id"]), "s")
    assert content(table)[5] == "new" and content(table)[77] == "y" and table.read().count() == 41
    # a merge may empty buckets
    assert table.update(3, more, lambda old, new: old.where("false"), "s")
    assert table.read(table.touched(more)).count() == 0


def test_files_read_stay_constant_over_many_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ROW, ["id"], 16)
    read = []
    for n in range(20):
        rows = spark.createDataFrame([(n, "v"), (1000 + n, "w")], ROW)
        mine = table.read(table.touched(rows))
        read.append(len(mine.inputFiles()))
        table.update(n, rows, insert(["id"]))
    assert max(read) <= 2 and table.read().count() == 40
    folders = list((tmp_path / "t" / "data").glob("bucket=*/version=*"))
    assert len(folders) <= 2 * 16 and len(list((tmp_path / "t" / "log").glob("version=*"))) == 2


CLAIMS = T.StructType([*S.CLAIMS.fields, T.StructField("entity", T.StringType()), T.StructField("day", T.DateType())])


def arriving(n=36, seed=4):
    rng, first = random.Random(seed), datetime.date(2001, 1, 1)
    out = []
    for i in range(n):
        past = rng.choice(["none", "1", "2 to 4", "more than 4"])
        out.append({**VALID, "PolicyNumber": i, "Age": rng.choice([0, 30, 47, 60]), "PastNumberOfClaims": past, "entity": rng.choice(["a", "b", "c", None]), "day": str(first + datetime.timedelta(rng.randint(0, 500)))})
    return out


def evidence(spark, similar_too=False):
    reference = spark.createDataFrame([(1000 + i, [1.0, i / 10], i % 3 == 0) for i in range(30)], "PolicyNumber long, v array<double>, y boolean").withColumn("y", F.col("y").cast("int"))
    terms = spark.createDataFrame([(i, [("1", None, None, 400, None, None, 2)]) for i in range(0, 36, 2)], "PolicyNumber long, versions array<struct<version:string,effective_from:date,effective_to:date,deductible:bigint,conditions:array<struct<id:string,requires:map<string,array<string>>>>,exclusions:array<struct<id:string,when:map<string,array<string>>>>,max_months:bigint>>")

    def of(claims, history):
        near = None
        if similar_too:
            asked = claims.select("PolicyNumber", F.array(F.lit(1.0), F.col("Age") / 50).alias("v"))
            near = similar.neighbour_summary(similar.similar_claims(asked, reference, "PolicyNumber", "v", 5), reference, "PolicyNumber", "y", 0.1).withColumnRenamed("query", "PolicyNumber")
        scores = claims.select("PolicyNumber", (F.col("Age") / 100).alias("p"))
        return investigate.gather_evidence(claims, "PolicyNumber", scores, terms, history, "entity", "day", "old_id", "old_date", near, None, ["Fault"], years=1.0, high=0.5, medium=0.4)

    return of


def as_frame(spark, rows):
    return spark.read.schema(CLAIMS).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 2))


def at_once(spark, rows, similar_too=False):
    claims = as_frame(spark, rows)
    history = claims.select(F.col("PolicyNumber").alias("old_id"), "entity", F.col("day").alias("old_date"))
    return sorted(map(str, investigate.recommend(evidence(spark, similar_too)(claims, history), "PolicyNumber").collect()))


def test_batches_in_any_order_give_the_rows_of_one_run(spark, tmp_path):
    rows = arriving()
    want = at_once(spark, rows)
    parts = [rows[0:12], rows[12:24], rows[24:36]]
    job = jobs.Investigation(spark, CLAIMS, evidence(spark), str(tmp_path / "t"), "PolicyNumber", "entity", "day", 1.0, buckets=4)
    for number, i in enumerate((2, 0, 1)):
        job.process(as_frame(spark, parts[i]), number)
        job.process(as_frame(spark, parts[i]), number)  # again
    assert sorted(map(str, job.out.read().collect())) == want


def test_investigation_of_a_file_stream_and_a_broken_batch(spark, tmp_path, monkeypatch):
    rows = arriving(16, 9)
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    job = jobs.Investigation(spark, CLAIMS, evidence(spark, True), str(tmp_path / "t"), "PolicyNumber", "entity", "day", 1.0, buckets=4)
    with monkeypatch.context() as m:  # the state is committed, the recommendations are not
        m.setattr(KeyedTable, "update", lambda self, *a, update=KeyedTable.update: update(self, *a) if self is job.state else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            job.process(as_frame(spark, rows), 0, str(tmp_path / "cp"))
    assert job.state.read().count() == sum(r["entity"] is not None for r in rows) and job.out.read().count() == 0
    job.start(str(source), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(str, job.out.read().collect())) == at_once(spark, rows, True)


def test_late_claims_are_counted_and_old_ones_leave_the_state(spark, tmp_path):
    day = lambda n: str(datetime.date(2000, 1, 1) + datetime.timedelta(n))
    claim = lambda i, n: {**VALID, "PolicyNumber": i, "entity": "a", "day": day(n)}
    job = jobs.Investigation(spark, CLAIMS, evidence(spark), str(tmp_path / "t"), "PolicyNumber", "entity", "day", 1.0, lateness=30, buckets=2)
    for number, part in enumerate(([claim(1, 0), claim(2, 100)], [claim(3, 1000), claim(4, 980)], [claim(5, 990), claim(6, 900), claim(7, 1010)])):
        job.process(as_frame(spark, part), number)
    found = {r.PolicyNumber: r.n_previous for r in job.out.read().collect()}
    assert found == {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 7: 3}  # 3 is worked out again when 5 arrives
    assert job.clock.read().first().late == 1
    assert {r.PolicyNumber for r in job.state.read().collect()} == {3, 4, 5, 7}
