"""Publishing tables: immutable ones, per-run artifacts, runtime views, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str) -> None:
    """Write once; a second publication under the path is an error."""
    df.write.mode("errorifexists").parquet(path)


def artifacts(cases: DataFrame, path: str) -> None:
    """Case results as JSON lines by run and repetition."""
    cases.write.mode("errorifexists").partitionBy("run_id", "repetition").json(path)


def manifest(files: DataFrame) -> DataFrame:
    """One row: the digest of sorted `path NUL sha256` lines of (path, sha256)."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], F.lit(chr(0)), x["sha256"], F.lit("\n")))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("register_id"), F.count(F.lit(1)).alias("files"))


def runtime_view(questions: DataFrame) -> DataFrame:
    """What a system under test may see: no gold columns."""
    return questions.drop(*[c for c in questions.columns if c.startswith("gold_")])
