"""A chain of named steps over Parquet tables that goes on where an earlier run stopped."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


class Steps:
    """Each step is a function of the frames of steps that it names; its table is kept under the work folder.

    A step whose table has Spark's success marker is read, not run. A step that fails ends the run; its
    unfinished table is overwritten next time. force: steps to run anew, with all that need them.
    """

    def __init__(self, spark: SparkSession, work_dir: str) -> None:
        self.spark, self.dir, self.steps = spark, work_dir.rstrip("/"), {}

    def add(self, name: str, f: Callable[..., DataFrame], *needs: str) -> Steps:
        missing = [n for n in needs if n not in self.steps]
        if missing:
            raise ValueError(f"step {name} needs {missing}")
        self.steps[name] = (f, needs)
        return self

    def done(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def run(self, force: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        frames: dict[str, DataFrame] = {}
        anew = set(force)
        for name, (f, needs) in self.steps.items():
            if name not in anew and not anew & set(needs) and self.done(name):
                log.info("step %s is done", name)
            else:
                anew.add(name)
                log.info("step %s runs", name)
                f(*[frames[n] for n in needs]).write.mode("overwrite").parquet(f"{self.dir}/{name}")
            frames[name] = self.spark.read.parquet(f"{self.dir}/{name}")
        return frames
