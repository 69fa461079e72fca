"""A store of labelled examples for nearest-neighbour classification, and profiles on disk.

A store is a table; adding and removing give a new store.  Nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.constants import COMPACT_PROFILE_SCHEMA_VERSION, KNN_SCHEMA_VERSION, PROFILE_SCHEMA_VERSION
from tidewave.functions import columns as C
from tidewave.operators import vectors as V


@dataclass(frozen=True)
class KnnStore:
    """Examples (id, label, embedding of length 1, place in order of insertion), neighbours to consider and the greatest distance."""

    examples: DataFrame
    k: int = 5
    max_distance: float = 2.0
    next_id: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, k: int = 5, max_distance: float = 2.0, label: str = "string") -> KnnStore:
        return cls(spark.createDataFrame([], f"id string, label {label}, embedding array<double>, place long"), k, max_distance)

    def add(self, rows: DataFrame, order: str) -> KnnStore:
        """Rows (label, embedding, perhaps id) in the order of the number ``order``; those without an id get e0, e1, ..., numbered over the store's life."""
        given = F.col("id") if "id" in rows.columns else F.lit(None).cast("string")
        new = V.numbered(rows.select(given.alias("id"), "label", C.l2_normalize(F.col("embedding")).alias("embedding"), F.col(order).alias("_o")), "_o", "_n")
        new = V.numbered(new.withColumn("_u", F.when(F.col("id").isNull(), F.col("_o"))), "_u", "_m")
        base = self.examples.agg(F.coalesce(F.max("place"), F.lit(-1))).head()[0] + 1
        fresh = new.where("id is null").count()
        named = F.coalesce("id", F.concat(F.lit("e"), (F.col("_m") + self.next_id).cast("string")))
        return replace(self, examples=self.examples.unionByName(new.select(named.alias("id"), "label", "embedding", (F.col("_n") + base).alias("place"))), next_id=self.next_id + fresh)

    def remove(self, *ids: str) -> KnnStore:
        return replace(self, examples=self.examples.where(~F.col("id").isin(*ids)))

    def remove_label(self, label) -> KnnStore:
        return replace(self, examples=self.examples.where(~F.col("label").eqNullSafe(F.lit(label))))

    def labels(self) -> DataFrame:
        """(label, place, n) in order of insertion."""
        return self.examples.groupBy("label").agg(F.min("place").alias("place"), F.count("*").alias("n")).orderBy("place")

    def prototypes(self) -> DataFrame:
        return V.prototypes(self.examples)

    def predict(self, queries: DataFrame) -> DataFrame:
        """(id, label, confidence) of queries (vec_id, embedding); an empty store gives null and 0."""
        # places below 0: no query is an example
        examples = self.examples.select((F.col("place") - (1 << 62)).alias("vec_id"), "label", F.lit(0).alias("fold"), "embedding")
        found = V.neighbours(queries.select("vec_id", F.lit(0).alias("fold"), "embedding"), examples, self.k, self.max_distance)
        return queries.select(F.col("vec_id").alias("id")).join(V.vote(found), "id", "left").select("id", "label", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))

    def save(self, path: str) -> None:
        """A snapshot: examples with the version and k in columns."""
        self.examples.select("*", F.lit(KNN_SCHEMA_VERSION).alias("schema_version"), F.lit(self.k).alias("k")).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, max_distance: float = 2.0) -> KnnStore:
        rows = spark.read.parquet(path)
        _checked(rows, "schema_version", KNN_SCHEMA_VERSION)
        n, k = rows.agg(F.count("*"), F.max("k")).head()
        return cls(rows.drop("schema_version", "k"), k or 5, max_distance, n)


def _checked(rows: DataFrame, column: str, version: int) -> None:
    if rows.where(~F.col(column).eqNullSafe(F.lit(version))).head(1):
        raise ValueError(f"unknown {column}; {version} is known")


def save_profiles(profiles: DataFrame, path: str, compact: bool = False) -> None:
    """Profiles (any columns) with their version; ``compact`` marks tables whose arrays are float16 bits."""
    version = {"compact_version": F.lit(COMPACT_PROFILE_SCHEMA_VERSION)} if compact else {}
    profiles.withColumns({"schema_version": F.lit(PROFILE_SCHEMA_VERSION)} | version).write.mode("overwrite").parquet(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profiles of a table; another version is an error."""
    rows = spark.read.parquet(path)
    _checked(rows, "schema_version", PROFILE_SCHEMA_VERSION)
    if "compact_version" in rows.columns:
        _checked(rows, "compact_version", COMPACT_PROFILE_SCHEMA_VERSION)
    return rows.drop("schema_version", "compact_version")


def calibrate(profiles: DataFrame, verdicts: DataFrame, key: str, rate: float = 0.5) -> DataFrame:
    """``profiles`` (key, watch, anomalous, revision, calibrations) after verdicts (key, at, verdict, score), in order of at.

    Each verdict adds 1 to the revision and a record (verdict, score, watch, anomalous, at); a null score is the threshold watch of the time.
    A profile's verdicts are what users gave one by one: they are one row.
    """
    from tidewave.operators.windows import calibrated

    record = "array<struct<verdict:string,score:double,watch:double,anomalous:double,at:bigint>>"
    given = verdicts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "verdict", "score"))).alias("given"))

    def step(s, v):
        score = F.coalesce(v["score"], s["watch"])
        now = calibrated(s["watch"], s["anomalous"], v["verdict"], score, rate)
        one = F.array(F.struct(v["verdict"].alias("verdict"), score.alias("score"), now["watch"].alias("watch"), now["anomalous"].alias("anomalous"), v["at"].alias("at")))
        return F.struct(now["watch"].alias("watch"), now["anomalous"].alias("anomalous"), F.concat(s["records"], one).alias("records"))

    first = F.struct(F.col("watch").cast("double").alias("watch"), F.col("anomalous").cast("double").alias("anomalous"), F.array().cast(record).alias("records"))
    none = F.array().cast("array<struct<at:bigint,verdict:string,score:double>>")
    out = profiles.join(given, key, "left").withColumn("x", F.aggregate(F.coalesce("given", none), first, step))
    return out.withColumns({"watch": F.col("x.watch"), "anomalous": F.col("x.anomalous"), "revision": F.col("revision") + F.coalesce(F.size("x.records"), F.lit(0)), "calibrations": F.concat("calibrations", "x.records")}).drop("x", "given")
