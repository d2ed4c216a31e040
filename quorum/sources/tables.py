"""Scans, sinks and stores.

Tables are read with pinned schemas where the layout is known; file
existence and emptiness are checked through Spark itself (no local file
system calls), so the same code works on any Hadoop-compatible store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from quorum.operators.prep import coerce_numeric

RESULTS_SCHEMA = ("model_name string, split string, threshold_type string, threshold double, precision double, "
                  "recall double, f1_score double, accuracy double, cost double, tp long, fp long, tn long, fn long, "
                  "is_base_model boolean, cost_total double")
CONFUSION_SCHEMA = "model_name string, split string, threshold_type string, tp long, fp long, tn long, fn long, " \
                   "total_samples long"
SUMMARY_SCHEMA = RESULTS_SCHEMA + ", total_samples long"
SWEEP_SCHEMA = "model_name string, threshold double, cost double, accuracy double, f1_score double"
#: Result files that are loaded together; predictions may come besides.
RESULT_FILES = {"model_metrics": RESULTS_SCHEMA, "confusion_matrices": CONFUSION_SCHEMA, "model_summary": SUMMARY_SCHEMA,
                "sweep": SWEEP_SCHEMA}
PREDICTIONS_SCHEMA = "model_name string, kind string, id string, score double"
SWEEP_ARRAYS = "map<string, struct<thresholds: array<double>, costs: array<double>, accuracies: array<double>, " \
               "f1_scores: array<double>>>"


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None,
               header: bool = True) -> DataFrame:
    """Read a table; missing path -> FileNotFoundError, no rows (or zero bytes) -> ValueError."""
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", header).option("inferSchema", schema is None)
    try:
        df = reader.load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"no table at {path}") from e
        raise
    if not df.columns or df.isEmpty():
        raise ValueError(f"the table at {path} has no rows")
    return df


def scan_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows (column discovery); the schema alone usually suffices."""
    return df.limit(n)


def scan_untyped(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV read with every column as text, for P11 type inference."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write with a header and no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def scan_result_csvs(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Load the result files together; all of them must exist (all-or-nothing)."""
    return {name: scan_table(spark, f"{base}/{name}", "csv", schema) for name, schema in RESULT_FILES.items()}


def scan_predictions_csv(spark: SparkSession, base: str) -> DataFrame | None:
    """The stored predictions, or None if there are none."""
    try:
        return scan_table(spark, f"{base}/predictions", "csv", PREDICTIONS_SCHEMA)
    except (FileNotFoundError, ValueError):
        return None


def write_sweep_json(sweep: DataFrame, path: str) -> None:
    """Write a sweep in the nested form {model: {thresholds: [...], costs: [...], ...}} (one document)."""
    per_model = sweep.groupBy("model_name").agg(
        F.array_sort(F.collect_list(F.struct("threshold", "cost", "accuracy", "f1_score"))).alias("_p"))
    doc = per_model.agg(F.map_from_entries(F.collect_list(F.struct(
        "model_name", F.struct(F.col("_p.threshold").alias("thresholds"), F.col("_p.cost").alias("costs"),
                               F.col("_p.accuracy").alias("accuracies"),
                               F.col("_p.f1_score").alias("f1_scores"))))).alias("sweep"))
    doc.select(F.to_json("sweep").alias("value")).write.mode("overwrite").text(path)


def scan_sweep_json(spark: SparkSession, path: str) -> DataFrame:
    """Map model -> struct of arrays, exploded into (model_name, threshold, cost, accuracy, f1_score)."""
    raw = spark.read.text(path).select(F.from_json("value", SWEEP_ARRAYS).alias("m"))
    per_model = raw.select(F.explode("m").alias("model_name", "s"))
    z = per_model.select("model_name", F.explode(F.arrays_zip(
        F.col("s.thresholds").alias("threshold"), F.col("s.costs").alias("cost"),
        F.col("s.accuracies").alias("accuracy"), F.col("s.f1_scores").alias("f1_score"))).alias("p"))
    return z.select("model_name", "p.threshold", "p.cost", "p.accuracy", "p.f1_score")


def run_datasets(results: DataFrame) -> dict[str, DataFrame]:
    """The record sets of a run's results: metrics, confusion counts, and both together with their total."""
    counts = ["tp", "fp", "tn", "fn"]
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    keys = ["model_name", "split", "threshold_type"]
    return {"model_metrics": results, "confusion_matrices": results.select(*keys, *counts, total.alias("total_samples")),
            "model_summary": results.withColumn("total_samples", total)}


def write_metrics_json(results: DataFrame, path: str, counts_as_text: bool = True) -> None:
    """Write the stored-run document, one array of records for each of ``run_datasets``; counts as text like the stored file.

    The document holds a few rows per model and split, in one JSON object.
    """
    texts = ("tp", "fp", "tn", "fn", "total_samples") if counts_as_text else ()
    arrays = []
    for name, rec in run_datasets(results).items():
        cells = [F.col(c).cast("string").alias(c) if c in texts else F.col(c) for c in rec.columns]
        arrays.append(rec.agg(F.collect_list(F.struct(*cells)).alias(name)).withColumn("_k", F.lit(1)))
    doc = reduce(lambda a, b: a.join(b, "_k"), arrays).drop("_k")
    doc.coalesce(1).write.mode("overwrite").json(path)


def scan_metrics_json(spark: SparkSession, path: str, dataset: str = "model_metrics") -> DataFrame:
    """One record array of the nested document -> rows, with P12 numeric coercion."""
    doc = spark.read.option("multiLine", True).json(path)
    rows = doc.select(F.inline(dataset))
    return coerce_numeric(rows, metric_cols=("threshold", "precision", "recall", "f1_score", "accuracy", "cost",
                                             "cost_total"))


MANIFEST_SCHEMA = "commit long, token string, run_id string, name string, version string, schema string"


class ResultsStore:
    """Results of runs, whose datasets change together or not at all.

    Every save writes its datasets to new folders, one a version, and then
    publishes them by one file of the manifest: a commit with all datasets of
    the run. Readers take each run's newest commit, so a save that fails on the
    way leaves the old run as it was. A replaced version is deleted one commit
    later, so that frames loaded before a save can still be read after it;
    ``vacuum`` deletes everything that no run's newest commit names, also what
    failed saves left. Of two writers of one run the later commit stands, whole.
    The base folder must be shared storage on a cluster.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.base}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)  # nothing is stored yet

    def _current(self) -> DataFrame:
        """(run_id, name, version, schema) of every run's newest commit."""
        rows = self._manifest()
        newest = rows.groupBy("run_id").agg(F.max(F.struct("commit", "token")).alias("_at")) \
            .select("run_id", "_at.commit", "_at.token")
        return rows.join(newest, ["run_id", "commit", "token"]).filter("name is not null").select("run_id", "name", "version", "schema")

    def _path(self, name: str, version: str) -> str:
        return f"{self.base}/data/{name}/{version}"

    def _write(self, run_id: str, datasets: dict[str, DataFrame]) -> list[tuple]:
        """Write new versions of the datasets; their entries (name, version, schema), which nobody sees yet."""
        version, entries = uuid.uuid4().hex, []
        for name, df in datasets.items():
            out = df.withColumn("run_id", F.lit(run_id))
            out.write.parquet(self._path(name, version))
            entries.append((name, version, out.schema.json()))
        return entries

    def _publish(self, runs: dict[str, list[tuple]]) -> None:
        """One commit: the entries of each run, written as one file, which appears as a whole."""
        commit = (self._manifest().agg(F.max("commit")).first()[0] or 0) + 1
        token = uuid.uuid4().hex
        rows = [(commit, token, run_id, *entry) for run_id, entries in runs.items() for entry in entries or [(None, None, None)]]
        self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.base}/manifest")
        for run_id in runs:
            self._drop_replaced(run_id)

    def _drop_replaced(self, run_id: str) -> None:
        """Delete the versions that the commit before the last one replaced."""
        mine = self._manifest().filter(F.col("run_id") == run_id)
        last = [r[0] for r in mine.select("commit").distinct().orderBy(F.col("commit").desc()).limit(3).collect()]
        if len(last) == 3:
            rows = mine.filter(F.col("commit").isin(last) & F.col("name").isNotNull()).collect()
            live = {(r["name"], r["version"]) for r in rows if r["commit"] != last[2]}
            for name, version in {(r["name"], r["version"]) for r in rows} - live:
                self._delete(self._path(name, version))

    def _folder(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        folder, files = self._folder(path)
        files.delete(folder, True)

    def _children(self, path: str) -> list[str]:
        folder, files = self._folder(path)
        return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []

    def save(self, run_id: str, datasets: dict[str, DataFrame]) -> None:
        """Replace these datasets of the run, all of them or, if one fails, none; its other datasets and other runs stay."""
        entries = self._write(run_id, datasets)
        rest = self._current().filter((F.col("run_id") == run_id) & ~F.col("name").isin(list(datasets))).collect()
        self._publish({run_id: entries + [(r["name"], r["version"], r["schema"]) for r in rest]})

    def load(self, name: str, run_id: str | None = None) -> DataFrame:
        """A dataset of one run or of all; empty, with its last schema, if no such run holds it any more."""
        rows = self._current().filter(F.col("name") == name)
        if run_id is not None:
            rows = rows.filter(F.col("run_id") == run_id)
        paths = [self._path(name, r["version"]) for r in rows.select("version").distinct().collect()]
        if paths:
            return self.spark.read.option("mergeSchema", True).parquet(*paths)
        last = self._manifest().filter(F.col("name") == name).agg(F.max_by("schema", "commit")).first()[0]
        if last is None:
            raise ValueError(f"the store holds no dataset {name}")
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(last)))

    def append(self, run_id: str, name: str, df: DataFrame) -> None:
        """Add rows to a dataset of the run."""
        entries = self._write(run_id, {name: df})
        rest = self._current().filter(F.col("run_id") == run_id).collect()
        self._publish({run_id: entries + [(r["name"], r["version"], r["schema"]) for r in rest]})

    def save_results(self, run_id: str, results: DataFrame, **others: DataFrame) -> None:
        """Store a run: its results as ``run_datasets`` and other datasets (sweep, predictions, labels) by name."""
        self.save(run_id, run_datasets(results) | others)

    def replace_models(self, run_id: str, datasets: dict[str, DataFrame], models: Sequence[str]) -> None:
        """Put the rows of ``datasets`` in the place of a run's rows of ``models``, in all of them at once; doing it
        twice leaves the same rows."""
        held = {r["name"] for r in self._current().filter(F.col("run_id") == run_id).select("name").distinct().collect()}
        others = ~F.col("model_name").isin(list(models))
        self.save(run_id, {
            name: self.load(name, run_id).drop("run_id").filter(others).unionByName(df, allowMissingColumns=True)
            if name in held else df for name, df in datasets.items()})

    def clear(self, name: str) -> None:
        """Drop a dataset from every run, in one commit."""
        runs: dict[str, list[tuple]] = {}
        rows = self._current()
        with_it = rows.filter(F.col("name") == name).select("run_id").distinct()
        for r in rows.join(with_it, "run_id").collect():
            runs.setdefault(r["run_id"], []).extend([(r["name"], r["version"], r["schema"])] if r["name"] != name else [])
        if runs:
            self._publish(runs)

    def vacuum(self) -> None:
        """Delete every version that no run's newest commit names; not while a save or an old frame is in use."""
        live = {(r["name"], r["version"]) for r in self._current().select("name", "version").collect()}
        for name in self._children(f"{self.base}/data"):
            for version in self._children(f"{self.base}/data/{name}"):
                if (name, version) not in live:
                    self._delete(self._path(name, version))


def feature_contract(df: DataFrame, features: Sequence[str], encoded: Sequence[str] = (),
                     id_col: str | None = None, filters: dict | None = None) -> DataFrame:
    """(position, name, alias f{i}, dtype, is_encoded, sample, filters) — the frozen
    feature order of a trained model; ``sample`` comes from the row with the smallest id."""
    first = df.orderBy(id_col).limit(1) if id_col else df.limit(1)
    sample = first.select(F.array(*[F.col(c).cast("string") for c in features]).alias("_s"))
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.lit(f"f{i}").alias("alias"),
                              F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                              F.lit(c in encoded).alias("is_encoded"), F.col("_s")[i].alias("sample"))
                     for i, c in enumerate(features)])
    out = sample.select(F.inline(rows))
    return out.withColumn("filters", F.lit(str(sorted((filters or {}).items()))))


def contract_problems(contract: DataFrame, df: DataFrame) -> list[str]:
    """What in ``df`` breaks the contract: missing names, other types, another order (a few rows per feature)."""
    need = [(r["name"], r["dtype"]) for r in contract.orderBy("position").select("name", "dtype").collect()]
    have = dict(df.dtypes)
    out = [f"{n} is missing" for n, _ in need if n not in have]
    out += [f"{n} is {have[n]}, not {t}" for n, t in need if n in have and have[n] != t]
    order = [c for c in df.columns if c in dict(need)]
    if not out and order != [n for n, _ in need]:
        out.append(f"the order is {order}")
    return out
