"""The corpus store: a folder of Parquet tables per run, and a manifest that names the runs that count.

A build writes its own folder only and then puts a manifest with the next number beside the last one; that step is a
rename that fails if the number is taken, so two builds at once can't lose each other's run. What readers see is the
manifest with the highest number. Appending or purging a run costs what that run holds, however large the corpus is.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.plans.rules import Issue

TABLES = ("documents", "paragraphs", "sentences", "tokens")
RUNS = "run_id string, started_at string, finished_at string, status string, source_locator string, note string, summary_json string"


def _now() -> str:
    return dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


class Conflict(OSError):
    """Another build took the manifest's number again and again."""


class Store:
    """A corpus at ``path``, in any file system that Spark reaches."""

    TRIES = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._hadoop = jvm, jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop(path).getFileSystem(self._conf)

    # ------------------------------------------------------------ manifests
    def _versions(self) -> list[int]:
        at = self._hadoop(f"{self.path}/manifests")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self) -> tuple[int, list[dict]]:
        """Number and runs of the newest manifest; 0 and none if there is none."""
        for _ in range(self.TRIES):
            found = self._versions()
            if not found:
                return 0, []
            try:
                stream = self._fs.open(self._hadoop(f"{self.path}/manifests/{found[-1]:012d}.json"))
            except Exception:  # a newer one came and this one went
                continue
            try:
                return found[-1], json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["runs"]
            finally:
                stream.close()
        raise Conflict(f"can't read the manifest of {self.path}")

    def _commit(self, change) -> list[dict]:
        """Put ``change(runs)`` in the place of the runs; from the newest ones again if another build was faster."""
        for _ in range(self.TRIES):
            version, runs = self._manifest()
            now = change(runs)
            temporary = self._hadoop(f"{self.path}/manifests/.{uuid.uuid4().hex}")
            out = self._fs.create(temporary, False)
            out.write(bytearray(json.dumps({"runs": now}).encode()))
            out.close()
            try:  # this rename doesn't replace
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, self._hadoop(f"{self.path}/manifests/{version + 1:012d}.json"), self._no_options())
            except Exception:
                self._fs.delete(temporary, False)
                if self._versions()[-1:] == [version]:
                    raise
                continue
            for v in self._versions()[:-2]:  # one older stays for those who read it just now
                self._fs.delete(self._hadoop(f"{self.path}/manifests/{v:012d}.json"), False)
            return now
        raise Conflict(f"other builds keep changing {self.path}")

    def _no_options(self):
        return self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def exists(self) -> bool:
        return bool(self._versions())

    def runs(self) -> list[str]:
        return [r["id"] for r in self._manifest()[1]]

    def table(self, name: str) -> DataFrame:
        """``documents``, ``paragraphs``, ``sentences``, ``tokens`` or ``runs`` of all runs."""
        runs = self.runs()
        if not runs:
            raise FileNotFoundError(f"{self.path} has no runs")
        return self.spark.read.parquet(*(f"{self.path}/runs/{r}/{name}" for r in runs))

    # ------------------------------------------------------------ runs
    def build(self, documents: DataFrame, source: str = "", fresh: bool = False, tables: bool = False, inside_brackets: bool = False, tokenize=None, note: str = "", report: str | None = None) -> tuple[str | None, list[Issue]]:
        """Add documents (``category1, category2, raw_text``, optionally ``document_id``) as one run.

        Earlier runs stay unless ``fresh``. Documents without ids are numbered in order of their text hash after the
        largest id so far, which the manifest has (two builds at once would number alike: give ids then). The run is
        complete before the manifest names it; if anything fails, its folder goes, and the report, if asked for, says
        why. Returns the run's id.
        """
        run, started = uuid.uuid4().hex, _now()
        target = f"{self.path}/runs/{run}"
        try:
            first = 0 if fresh else max((r["last_document"] for r in self._manifest()[1]), default=0)
            docs = self._documents(documents, first, f"{target}/_staged")
            docs.withColumn("run_id", F.lit(run)).write.parquet(f"{target}/documents")
            docs = self.spark.read.parquet(f"{target}/documents")
            self._fs.delete(self._hadoop(f"{target}/_staged"), True)
            paragraphs = ingest.paragraphs_frame(docs, tables)
            sentences = ingest.with_document_numbers(ingest.sentences_frame(paragraphs, inside_brackets)).drop("paragraph_no", "is_table_paragraph")
            for name, frame in (("paragraphs", paragraphs), ("sentences", sentences)):
                frame.withColumn("run_id", F.lit(run)).write.parquet(f"{target}/{name}")
            written = self.spark.read.parquet(f"{target}/sentences").join(self.spark.read.parquet(f"{target}/paragraphs").select("paragraph_id", "is_table_paragraph"), "paragraph_id")
            tokens = ingest.tokens_frame(written) if tokenize is None else ingest.custom_tokens(written, tokenize)
            tokens.drop("is_table_paragraph").withColumn("run_id", F.lit(run)).write.parquet(f"{target}/tokens")
            made = {n: self.spark.read.parquet(f"{target}/{n}") for n in TABLES}
            summary = {r.counter: r.value for r in ingest.corpus_stats(*(made[n] for n in TABLES)).collect()}
            row = (run, started, _now(), "succeeded", source, note, json.dumps(summary, sort_keys=True))
            self.spark.createDataFrame([row], RUNS).write.parquet(f"{target}/runs")
            entry = {"id": run, "last_document": docs.agg(F.max("document_id")).first()[0] or 0}
            gone: list[str] = []

            def change(runs: list[dict]) -> list[dict]:
                gone[:] = [r["id"] for r in runs] if fresh else []
                return [entry] if fresh else [*runs, entry]

            self._commit(change)
        except Exception as e:
            self._fs.delete(self._hadoop(target), True)
            issue = Issue("build_failed", "error", str(e), "ingest")
            if report:
                write_json(report, {"status": "failed", "started_at": started, "issues": [vars(issue)]})
            return None, [issue]
        for r in gone:
            self._fs.delete(self._hadoop(f"{self.path}/runs/{r}"), True)
        if report:
            write_json(report, {"status": "succeeded", "run_id": run, "summary": summary, "issues": []})
        return run, []

    def _numbered(self, documents: DataFrame, first: int, staged: str) -> DataFrame:
        """Ids in order of text hash: numbered inside ranges, plus the sizes of the ranges before (a row for each range)."""
        order = ["h", "category1", "category2"]
        hashed = documents.withColumn("h", F.sha2(F.coalesce("raw_text", F.lit("")), 256))
        hashed.repartitionByRange("h").withColumn("part", F.spark_partition_id()).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        number = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before") + first
        return rows.join(before, "part").withColumn("document_id", number.cast("long"))

    def _documents(self, documents: DataFrame, first: int, staged: str) -> DataFrame:
        text = F.coalesce("raw_text", F.lit(""))
        if "document_id" not in documents.columns:
            documents = self._numbered(documents, first, staged)
        return documents.select(
            "document_id", "category1", "category2", text.alias("raw_text"), F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("long").alias("char_count"),
            F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("line_count"),
        )

    def purge(self, run: str) -> None:
        """Remove a run: it leaves the manifest, then its folder goes. An unknown run is no error."""
        self._commit(lambda runs: [r for r in runs if r["id"] != run])
        self._fs.delete(self._hadoop(f"{self.path}/runs/{run}"), True)

    def vacuum(self) -> list[str]:
        """Remove folders of runs that no manifest names, as a driver that was killed while it built leaves them. No build
        may be under way."""
        at, named = self._hadoop(f"{self.path}/runs"), set(self.runs())
        left = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        for r in left:
            if r not in named:
                self._fs.delete(self._hadoop(f"{self.path}/runs/{r}"), True)
        return [r for r in left if r not in named]


def write_json(path: str, value: object) -> None:
    """Write beside the place, then move there."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(temporary, path)
