"""Run-log storage and dimension maintenance.

The store is a set of Parquet tables.  A table with ``run_id`` is partitioned
by it, so per-run reads prune partitions and a purge removes whole folders.
Every append is one batch (the reference commits one row at a time) under a
batch name, which is the innermost partition: writing a batch again replaces
its own files and nothing else, so a failed or retried append leaves no
second copy.  Streaming micro-batches use the same layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..util import bounded_broadcast

RUN_TABLES = ("run", "sub_run", "simulation", "round", "round_acquired_variant",
              "round_top_variant", "last_round_score")
DERIVED_TABLES = ("round_moments", "run_metrics")      # of a run as well, kept by ``plans.metrics_store``
TABLES = (*RUN_TABLES, *DERIVED_TABLES, "dataset", "variant_assay", "variant_assay_activity")
BATCH = "batch"


class RunLogStore:
    """The stored tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in TABLES:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def append(self, name: str, df: DataFrame, batch: str):
        """Add rows as batch ``batch``; the same batch written again replaces itself.

        A batch written again must cover the runs it covered before: where a
        stored run of the batch is missing in ``df``, nothing is written.
        """
        by = [c for c in ("run_id",) if c in df.columns]
        if by and self._exists(self.path(name)):
            # partition columns only; runs are a configuration table, so their ids fit the driver
            stored = self.spark.read.parquet(self.path(name)).where(F.col(BATCH) == batch).select("run_id").distinct()
            before = {r["run_id"] for r in stored.collect()}
            left_out = before - {r["run_id"] for r in df.select("run_id").distinct().collect()} if before else set()
            if left_out:
                raise ValueError(f"batch {batch!r} of {name} already holds runs that the new rows leave out: {sorted(map(str, left_out))}")
        self._write(df, self.path(name), by, batch)

    @staticmethod
    def _write(df: DataFrame, path: str, by: list[str], batch: str):
        (df.withColumn(BATCH, F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*by, BATCH).parquet(path))

    def replace(self, name: str, df: DataFrame):
        """The table's new content, which may be computed from its present one.

        It is written beside the table first; only then do two renames put it
        in the table's place.  A write that fails leaves the table as it was;
        a break between the renames leaves it beside its place, from where the
        next reader or writer puts it back.
        """
        path = self.path(name)
        self._restore(path)
        by = [c for c in ("run_id",) if c in df.columns]
        self._drop(f"{path}.new")
        self._write(df, f"{path}.new", by, "all")
        if self._exists(path):
            self._rename(path, f"{path}.old")
        self._rename(f"{path}.new", path)
        self._drop(f"{path}.old")

    def _restore(self, path: str):
        """Puts back what a broken ``replace`` set aside."""
        if self._exists(f"{path}.old"):
            if self._exists(path):
                self._drop(f"{path}.old")
            else:
                self._rename(f"{path}.old", path)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _rename(self, path: str, to: str):
        p, fs = self._fs(path)
        if not fs.rename(p, self._fs(to)[0]):
            raise OSError(f"could not rename {path} to {to}")

    def _drop(self, path: str):
        p, fs = self._fs(path)
        fs.delete(p, True)

    def purge(self, keep: DataFrame):
        """U4: remove all rows of runs that are not in ``keep`` (run_id), by
        deleting the runs' folders; a purge that broke off is just run again.
        Runs are a configuration table, so their ids fit the driver."""
        keep_ids = {r["run_id"] for r in keep.select("run_id").distinct().collect()}
        for name in (*RUN_TABLES, *DERIVED_TABLES):
            if not self._exists(self.path(name)):
                continue
            stored = self.spark.read.parquet(self.path(name)).select("run_id").distinct().collect()
            for r in stored:
                if r["run_id"] not in keep_ids:
                    value = "__HIVE_DEFAULT_PARTITION__" if r["run_id"] is None else r["run_id"]
                    self._drop(f"{self.path(name)}/run_id={value}")

    def read_runs(self, name: str, runs: DataFrame) -> DataFrame:
        """Rows of the given runs (a DataFrame of run ids): a semi join on the
        partition column, which Spark turns into runtime partition pruning."""
        return self.read(name).join(bounded_broadcast(runs.select("run_id").distinct()), "run_id", "left_semi")

    def read(self, name: str, run_ids=None) -> DataFrame:
        self._restore(self.path(name))
        df = self.spark.read.parquet(self.path(name)).drop(BATCH)
        if run_ids is not None:
            df = df.filter(F.col("run_id").isin(list(run_ids)))
        return df


def upsert_dataset(dim: DataFrame, updates: DataFrame) -> DataFrame:
    """Dataset dimension upsert by name — new names are inserted with
    gene_symbol defaulting to the name; existing rows get the update's WT
    fields, NULLs included."""
    u = updates.select("name", F.col("gene_symbol").alias("u_gene"), F.col("wt_sequence").alias("u_seq"),
                       F.col("wt_assay_score").alias("u_score"), F.lit(True).alias("u"))
    j = dim.join(u, "name", "full")
    new = lambda value, old: F.when(F.col("u"), F.col(value)).otherwise(F.col(old)).alias(old)
    return j.select("name", F.coalesce("gene_symbol", "u_gene", "name").alias("gene_symbol"),
                    new("u_seq", "wt_sequence"), new("u_score", "wt_assay_score"))


def append_activity(existing: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Bulk append of assay activities; columns absent from the new rows
    become NULL (``unionByName(allowMissingColumns=True)``)."""
    return existing.unionByName(new_rows, allowMissingColumns=True)


def append_assay_header(existing: DataFrame, header: DataFrame) -> DataFrame:
    """Add variant-assay header rows, insert time defaulting to now."""
    h = header
    if "insert_ts" not in h.columns:
        h = h.withColumn("insert_ts", F.lit(None).cast("timestamp"))
    h = h.withColumn("insert_ts", F.coalesce(F.col("insert_ts"), F.current_timestamp()))
    return existing.unionByName(h, allowMissingColumns=True)


def variant_assay(header: DataFrame, activity: DataFrame, assay_type: str | None = None,
                  assay_subtype: str | None = None) -> DataFrame:
    """Assay header ⋈ activity on (assay_source, protein_symbol) with
    optional type/subtype predicates (added only when given)."""
    j = activity.join(header.drop("insert_ts"), ["assay_source", "protein_symbol"])
    if assay_type is not None:
        j = j.filter(F.col("assay_type") == assay_type)
    if assay_subtype is not None:
        j = j.filter(F.col("assay_subtype") == assay_subtype)
    return j


GRID_SCHEMA = T.StructType([
    T.StructField("learners", T.ArrayType(T.StringType())),
    T.StructField("strategies", T.ArrayType(T.StringType())),
])


def expand_grid(configs: DataFrame, json_col: str = "config") -> DataFrame:
    """Learner × strategy grid per configuration row — two explodes of
    the parsed arrays (a per-row product, not a join)."""
    p = configs.withColumn("_cfg", F.from_json(F.col(json_col), GRID_SCHEMA))
    return (p.withColumn("learner", F.explode("_cfg.learners"))
            .withColumn("strategy", F.explode("_cfg.strategies"))
            .drop("_cfg"))
