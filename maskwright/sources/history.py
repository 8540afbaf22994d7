"""An append-only history of a run's steps that survives its death.

Each step's rows are written to a folder of their own; then one small file, created
if it does not exist, commits the step by naming that folder.  Readers take only what
is committed, so a run that dies between the two loses none that was committed and
repeats none: it goes on with the first step that is not.

Defined cases: an unknown history has no rows and begins at step 0; a step committed
twice, by two runs at once, is an error for the second; a step without rows is a step.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RunHistory:
    """Steps below ``path``; all rows have the columns of ``schema``."""

    spark: SparkSession
    path: str
    schema: str

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return jvm, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> dict[int, str]:
        """Step -> folder of its rows."""
        _, path, files = self._files()
        if not files.exists(path):
            return {}
        # one small file a step; they are few
        lines = self.spark.read.text(f"{self.path}/commits").collect()
        found = [json.loads(r["value"]) for r in lines if r["value"]]
        return {f["step"]: f["folder"] for f in found}

    def next_step(self) -> int:
        """The first step that is not committed."""
        done = self.committed()
        step = 0
        while step in done:
            step += 1
        return step

    def rows(self) -> DataFrame:
        """``step`` and the rows of all committed steps."""
        done = self.committed()
        out = self.spark.createDataFrame([], f"step long, {self.schema}")
        for step, folder in sorted(done.items()):
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").withColumn("step", F.lit(step).cast("long")))
        return out

    def write(self, step: int, rows: DataFrame) -> str:
        """Write the rows of a step, not yet committed; the folder that ``commit`` takes."""
        folder = f"steps/{step}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, step: int, folder: str) -> None:
        """Make a step's rows part of the history."""
        jvm, path, files = self._files()
        try:
            out = files.create(jvm.org.apache.hadoop.fs.Path(path, f"{step:08d}"), False)
        except Exception as error:
            raise PySparkException(f"step {step} is committed already") from error
        out.write(bytearray(json.dumps({"step": step, "folder": folder}).encode() + b"\n"))
        out.close()

    def run(self, steps: int, make: Callable[[int], DataFrame]) -> int:
        """Do the steps that are missing up to ``steps``; how many were done now."""
        done = 0
        for step in range(self.next_step(), steps):
            self.commit(step, self.write(step, make(step)))
            done += 1
        return done
