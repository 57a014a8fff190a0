"""Transform jobs: a query, then stages of Python transformers, then a sink.

A stream task gets batches of rows (mapInPandas), a batch task the whole set; rows are lists with a header row first and the
key as first value.  Jobs run on threads of the driver; the work itself is Spark's.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .functions.timeutil import now_ns
from .functions.udf import _rows, _value_type, plain
from .operators.common import numbered
from .plans.errors import StatementError

# The states of a job.
STATES = ("unknown", "finished", "created", "running", "failing", "failed", "closing", "closed")
BATCH_ROWS = 50


def _shape(header: list, rows: list[list]) -> T.StructType:
    def kind(i):
        return _value_type(next((r[i] for r in rows if r[i] is not None), ""))

    return T.StructType([T.StructField(str(h), kind(i)) for i, h in enumerate(header)])


def apply_transformer(df: DataFrame, make, flow: str, batch_rows: int = BATCH_ROWS, shape: str | None = None) -> DataFrame:
    """Run transform([header, *rows]) over df.  shape declares the output (names and Spark types); else it is found on a few rows, by a job of its own."""
    header = list(df.columns)
    if shape:
        shape = T._parse_datatype_string(shape)
    else:
        probe = make().transform([header, *[list(r) for r in df.limit(batch_rows).collect()]])
        shape = _shape(probe[0], probe[1:])

    def table(pdf: pd.DataFrame, f: Any) -> pd.DataFrame:
        pdf.columns = header
        got = f.transform([header, *_rows(pdf)])
        return pd.DataFrame(got[1:], columns=[str(h) for h in got[0]])

    if flow == "stream":

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f = make()
            for pdf in batches:
                for k in range(0, len(pdf), batch_rows):
                    yield table(pdf.iloc[k : k + batch_rows], f)

        return plain(df, header).mapInPandas(run, shape)
    ordered = lambda pdf: table(pdf.sort_values("c0") if header[0] == "key" else pdf, make())
    return plain(df, header).groupBy().applyInPandas(ordered, shape)


class Jobs:
    def __init__(self, session):
        self.session, self.jobs, self.lock = session, {}, threading.Lock()

    def check(self, tasks: list[dict]) -> None:
        if not tasks or tasks[0].get("kind") != "sql":
            raise StatementError("the first task of a job must be a query")
        last = tasks[0]["sql"][-1].strip().lower() if tasks[0].get("sql") else ""
        if not last.startswith(("select", "show")):
            raise StatementError("the last statement of the first task must be SELECT or SHOW")
        if any(t.get("kind") != "python" for t in tasks[1:]):
            raise StatementError("the tasks after the first must be Python")

    def build(self, tasks: list[dict]) -> DataFrame:
        self.check(tasks)
        for text in tasks[0]["sql"]:
            df = self.session.execute(text, by_key=True)  # transformers see rows in their order
        for t in tasks[1:]:
            task = self.session.functions.get(t["name"])
            df = task.native(df) if task.native else apply_transformer(df, task.make, t.get("flow", "stream"), shape=task.returns)
        return df

    def commit(self, tasks: list[dict], sink: str = "log", path: str = "") -> int:
        """Start a job; sink is log (rows are printed), file (CSV is appended at path) or engine (series transform.*)."""
        self.check(tasks)
        with self.lock:
            number = len(self.jobs) + 1
            self.jobs[number] = {"state": "created", "error": None}

        def run():
            job = self.jobs[number]
            job["state"] = "running"
            context = self.session.spark.sparkContext
            context.setJobGroup(f"lodestrand-{number}", "transform job", interruptOnCancel=True)
            try:
                df = self.build(tasks)
                if sink == "file":
                    df.write.mode("append").option("header", True).csv(path)
                elif sink == "engine":
                    self.session.register(numbered(df.drop("key"), "key", now_ns()), "transform")
                else:
                    df.show()
                job["state"] = "closed" if job["state"] == "closing" else "finished"
            except Exception as e:  # a job's failure is its state
                job["error"] = str(e)
                job["state"] = "closed" if job["state"] == "closing" else "failed"

        thread = threading.Thread(target=run, daemon=True)
        self.jobs[number]["thread"] = thread
        thread.start()
        return number

    def commit_file(self, file: str) -> int:
        """A job as JSON, or as YAML where a reader of it is installed."""
        text = Path(file).read_text()
        try:
            spec = json.loads(text)
        except ValueError:
            import yaml

            spec = yaml.safe_load(text)
        tasks = []
        for t in spec["taskList"]:
            kind = "sql" if "sqlList" in t else "python"
            if kind == "python" and t.get("pyTaskName") not in self.session.functions.by_name:
                self.session.functions.register("transform", t["className"], t["scriptPath"], t["pyTaskName"])
            tasks.append({"kind": kind, "sql": t.get("sqlList"), "name": t.get("pyTaskName"), "flow": t.get("dataFlowType", "stream")})
        return self.commit(tasks, {"file": "file", "log": "log"}.get(spec.get("exportType", "log").lower(), "engine"), spec.get("exportFile", ""))

    def wait(self, job: int, seconds: float | None = None) -> str:
        self.jobs[job]["thread"].join(seconds)
        return self.status(job)

    def status(self, job: int) -> str:
        return self.jobs[job]["state"] if job in self.jobs else "unknown"

    def cancel(self, job: int) -> None:
        if self.status(job) in ("created", "running"):
            self.jobs[job]["state"] = "closing"
            self.session.spark.sparkContext.cancelJobGroup(f"lodestrand-{job}")

    def in_state(self, state: str) -> list[int]:
        return [n for n, j in self.jobs.items() if j["state"] == state]
