"""Structured Streaming jobs: triage of arriving claims, and their reviews."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate, investigate, rules, triage
from ..sources.shared import discard, materialise
from .store import KeyedTable, insert, upsert

REVIEW = "review_id long, run_id string, decision string, reason string"
RECOMMENDATION = "decision string, flag_category string, fraud_probability double, risk_band string, investigation_status string, completeness double, reason_codes string, conflicts string, missing string"
INVESTIGATION = RECOMMENDATION + ", facts string, rationale string, n_previous long, previous string"


def append_once(batch: DataFrame, table: KeyedTable, number: int, stream: str = "") -> bool:
    """Add the rows whose keys the table does not hold yet; a batch that runs twice adds them once, and reads the
    buckets of its own keys only."""
    return table.update(number, batch, insert(table.keys), stream)


def sink(spark: SparkSession, path: str, key: str, kind: str, columns: str = RECOMMENDATION) -> KeyedTable:
    """The table of recommendations at ``path``; ``kind`` is the type of the key."""
    return KeyedTable(spark, path, f"{key} {kind}, {columns}", [key])


def reviews(spark: SparkSession, path: str) -> KeyedTable:
    """The audit table, in buckets by run, so that the reviews of a run lie together."""
    return KeyedTable(spark, path, f"{REVIEW}, status string, overrides boolean", ["run_id"])


def stream_triage(spark: SparkSession, source: str, schema: T.StructType, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "PolicyNumber", context: Sequence[tuple[DataFrame, Sequence[str]]] = ()):
    """JSON claims in ``source`` to recommendations in the table at ``path``: rules, flags and score are stateless
    columns of the stream; each batch is added once.

    ``context`` holds static tables (policy, history, neighbours) with the columns they are joined by; each has one row a
    key at most, and a claim without one keeps nulls.  ``stream_investigations`` derives all of these.
    """
    stream = spark.readStream.schema(schema).json(source)
    checked = rules.run_rules(stream)
    rows = checked.withColumns({"blocking": rules.blocking_failures(checked), "warning_flags": F.size(F.filter(rules.fired_flags(), lambda f: f["severity"] == "warning")).cast("long")})
    for table, by in context:
        rows = rows.join(table, list(by), "left")
    out = sink(spark, path, key, schema[key].dataType.simpleString())

    def each(batch: DataFrame, number: int) -> None:
        append_once(triage.triage(score(batch), key), out, number, checkpoint)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Investigation:
    """Triage of arriving claims with their history derived from the claims themselves.

    The state is a table of all claims within reach, in buckets by entity.  A batch adds its claims there and then works out again every claim of
    these entities whose window of earlier claims has changed: its own, and those up to ``years`` after a new one.  So the recommendations are those
    of one run over all claims, in whatever order they arrive.

    With ``lateness`` (days) a claim that lies further behind the latest date of the batches before is late: it is kept out and counted.  Claims that can
    then be in no window any more leave the state when their bucket is next written.
    ``evidence(claims, history)`` gives the evidence of some claims (``investigate.gather_evidence`` with everything else bound).
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, evidence: Callable[[DataFrame, DataFrame], DataFrame], path: str, key: str, entity: str, on_date: str, years: float = 3.0, lateness: int | None = None, buckets: int = 64, required: Sequence[str] = investigate.REQUIRED):
        self.spark, self.evidence, self.key, self.entity, self.on_date, self.required = spark, evidence, key, entity, on_date, required
        self.days, self.lateness = int(365.25 * years), lateness
        self.schema = schema
        self.state = KeyedTable(spark, f"{path}/state", schema, [entity], buckets)
        self.out = KeyedTable(spark, f"{path}/recommendations", f"{key} {schema[key].dataType.simpleString()}, {INVESTIGATION}", [key], buckets)
        self.clock = KeyedTable(spark, f"{path}/clock", "id int, latest date, late long", ["id"], 1)

    def process(self, batch: DataFrame, number: int, stream: str = "") -> None:
        """One batch; run again, wherever it broke off, it ends in the same tables: the clock is set last."""
        if self.clock.has(number, stream):
            return
        seen = self.clock.read().first()
        bound = None if self.lateness is None or seen is None or seen.latest is None else F.date_sub(F.lit(seen.latest), self.lateness)
        rows = materialise(batch.select(*self.schema.names), "batch")
        on_time = rows if bound is None else rows.where(F.col(self.on_date).isNull() | (F.col(self.on_date) >= bound))
        keep = lambda df: df if bound is None else df.where(F.col(self.on_date).isNull() | (F.col(self.on_date) >= F.date_sub(bound, self.days)))
        once = insert([self.key])  # the first arrival of a claim counts
        linked = on_time.where(F.col(self.entity).isNotNull())  # others have no history and are nobody's
        self.state.update(number, linked, lambda old, new: keep(once(old, new)), stream)
        known = materialise(self.state.read(self.state.touched(linked)).join(on_time.select(self.entity).distinct(), self.entity, "left_semi").select(*self.schema.names), "known")
        entity, day = F.col(self.entity), F.col(self.on_date)
        fresh = on_time.select(F.col(self.key).alias("_k"), entity.alias("_e"), day.alias("_d"))
        span = fresh.groupBy("_e", "_d").agg(F.lit(1).alias("_one"))
        hit = known.join(span, (entity == F.col("_e")) & (day > F.col("_d")) & (day <= F.date_add("_d", self.days)), "left_semi").select(self.key)
        wanted = hit.union(fresh.select("_k")).distinct()
        mine = known.unionByName(on_time.where(entity.isNull())).join(wanted, self.key, "left_semi").dropDuplicates([self.key])
        history = known.select(F.col(self.key).alias("old_id"), self.entity, F.col(self.on_date).alias("old_date"))
        found = materialise(investigate.recommend(self.evidence(mine, history), self.key, self.required).select(*self.out.schema.names), "recommended")
        late = rows.count() - on_time.count()
        latest = on_time.agg(F.max(self.on_date)).first()[0]
        self.out.update(number, found, upsert([self.key]), stream)
        past = [d for d in (seen.latest if seen else None, latest) if d is not None]
        self.clock.update(number, self.spark.createDataFrame([(0, max(past, default=None), (seen.late if seen else 0) + late)], self.clock.schema), upsert(["id"]), stream)
        for table in (rows, known, found):
            discard(table)

    def start(self, source: str, checkpoint: str, files: int = 1000):
        """Read JSON claims from a folder, ``files`` at a time, until none is left."""
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files).json(source)
        return stream.writeStream.foreachBatch(lambda batch, number: self.process(batch, number, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_reviews(spark: SparkSession, source: str, recommendations: str, path: str, checkpoint: str):
    """Reviews to the audit table: the first valid review of each run over all batches."""
    stream = spark.readStream.schema(REVIEW).json(source)
    audit = reviews(spark, path)

    def each(batch: DataFrame, number: int) -> None:
        if audit.has(number, checkpoint):
            return
        rows = materialise(batch, "reviews")
        done = audit.read(audit.touched(rows)).where("status = 'accepted'").select("run_id")
        judged = evaluate.accept_reviews(rows, spark.read.parquet(recommendations), done)
        audit.update(number, judged.select(*audit.schema.names), insert(["review_id"]), checkpoint)
        discard(rows)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
