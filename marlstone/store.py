"""One object over a write log in Parquet: put, get, delete, purge and what can be derived from the log."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions.checkpoint import durable
from marlstone.operators import confidence, provenance, reasoning, store, trust
from marlstone.plans import retrieval

LOG = "seq bigint, path string, value string, owner string, type string, confidence double, refs array<string>, ttl string, updated_at double, metadata map<string,string>, v array<double>, gone boolean"


class KnowledgeStore:
    """Writes append a file to the log; every read is a query over it. ``put_all`` is the bulk way in."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._next = None

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], LOG)
            raise

    def _seq(self, n: int) -> int:
        if self._next is None:
            self._next = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        first, self._next = self._next, self._next + n
        return first

    def put_all(self, rows: DataFrame) -> None:
        """Rows of the log's columns; refused ones raise. ``seq`` must be over all that was written before."""
        bad = store.refused(rows).where(F.col("problem").isNotNull()).select("path", "problem").first()
        if bad:
            raise ValueError(f"{bad.path!r}: {bad.problem}")
        rows.write.mode("append").parquet(self.folder)

    def put(self, path: str, value: str, owner: str, type: str = "fact", confidence: float = 1.0, refs=(), ttl: str = "session", metadata=None, v=None, now: float | None = None) -> int:
        seq = self._seq(1)
        at = time.time() if now is None else now
        self.put_all(self.spark.createDataFrame([(seq, path, value, owner, type, float(confidence), list(refs), ttl, float(at), metadata or {}, v, False)], LOG))
        return seq

    def writes(self) -> DataFrame:
        """The log without what was deleted since it was written."""
        log = self.log()
        return store.without_deleted(log.where(~F.col("gone")), log.where("gone").select("path", "seq"))

    def current(self) -> DataFrame:
        return store.latest(self.writes())

    def delete(self, *paths: str, now: float | None = None) -> None:
        first = self._seq(len(paths))
        at = time.time() if now is None else now
        self.spark.createDataFrame([(first + i, p, "", "", "fact", 0.0, [], "session", float(at), {}, None, True) for i, p in enumerate(paths)], LOG).write.mode("append").parquet(self.folder)

    def _purge(self, *ttls: str) -> DataFrame:
        """Writes a tombstone for each path of some lifetimes, in the executors; the paths are a query over the log."""
        gone = durable(self.current().where(F.col("ttl").isin(*ttls)).select("path"))
        n = gone.count()
        if n:
            first, at = self._seq(n), time.time()
            rows = gone.select(F.lit(first).cast("bigint").alias("seq"), "path")  # one number serves all: they are of different paths
            blank = {"value": F.lit(""), "owner": F.lit(""), "type": F.lit("fact"), "confidence": F.lit(0.0), "refs": F.array().cast("array<string>"), "ttl": F.lit("session"), "updated_at": F.lit(at), "metadata": F.expr("cast(map() as map<string,string>)"), "v": F.lit(None).cast("array<double>"), "gone": F.lit(True)}
            rows.withColumns(blank).write.mode("append").parquet(self.folder)
        return gone.orderBy("path")

    def clear_turn(self) -> DataFrame:
        return self._purge("turn")

    def clear_session(self) -> DataFrame:
        return self._purge("turn", "session")

    def get(self, scope: str = "**", budget: int = 2000, query: list[float] | None = None, owner: str | None = None, kind: str | None = None, now: float | None = None, **choice) -> DataFrame:
        """The ranked, budgeted read; ``choice`` is what ``retrieval.get`` takes besides (text, rerank, weights, diversity)."""
        return retrieval.get(self.current(), scope, budget, query, owner, kind, now, **choice)

    def retrieve(self, path: str) -> DataFrame:
        return store.latest(self.writes().where(F.col("path") == path))

    def exists(self, path: str) -> bool:
        return not self.retrieve(path).isEmpty()

    def contradictions(self) -> DataFrame:
        return reasoning.contradictions(self.writes())

    def gaps(self) -> DataFrame:
        return reasoning.gaps(self.writes())

    def confidences(self) -> DataFrame:
        return confidence.states(confidence.evidence(self.writes()))

    def trust_report(self) -> DataFrame:
        return trust.fold(reasoning.cross_agent(self.writes()))

    def lineage(self, path: str) -> DataFrame:
        """Versions behind a path, newest first, at most twenty."""
        nodes = provenance.nodes(self.writes())
        edges = nodes.select(F.col("seq").alias("child"), F.explode("parents").alias("parent"))
        start = nodes.where(F.col("path") == path).agg(F.max("seq").alias("start")).where("start IS NOT NULL")
        return provenance.walk(edges, start).join(nodes, F.col("node") == F.col("seq")).orderBy("depth", F.desc("seq")).limit(20)

    def status(self) -> DataFrame:
        return self.current().agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("owner").alias("owners"), F.count_distinct(C.prefix(F.col("path"))).alias("prefixes"))

    @staticmethod
    def new_id() -> str:
        return uuid.uuid4().hex[:12]
