from __future__ import annotations

import subprocess
import sys
import textwrap

import pytest

from millrace.jobs import history
from millrace.operators import joblog
from millrace.sources import eventlog

JOB = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").appName("logged job")
    .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3")
    .config("spark.sql.adaptive.enabled", "false")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", sys.argv[1])
    .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", sys.argv[2])
    .getOrCreate())
spark.range(0, 1000, 1, 4).selectExpr("id % 7 AS k").groupBy("k").count().collect()
print(spark.sparkContext.applicationId)
spark.stop()
"""


@pytest.fixture(scope="module", params=["false", "true"])
def logged(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    program = folder.parent / f"job_{request.param}.py"
    program.write_text(textwrap.dedent(JOB))
    done = subprocess.run(
        [sys.executable, str(program), str(folder), request.param], capture_output=True, text=True, timeout=300, check=True
    )
    return str(folder), done.stdout.strip().splitlines()[-1]


def test_real_event_log(spark, logged):
    folder, app = logged
    events = eventlog.read_event_log(spark, folder)
    [application] = joblog.applications(events).collect()
    assert (application.app, application.name, application.finished) == (app, "logged job", True)
    assert application.duration_ms == application.ended - application.started > 0

    stages = {r.stage: r for r in joblog.stages(events).collect()}
    assert {r.app for r in stages.values()} == {app}
    assert sorted(r.n_tasks for r in stages.values()) == [3, 4]
    assert sum(r.shuffle_write_bytes for r in stages.values()) == sum(r.shuffle_read_bytes for r in stages.values()) > 0
    assert all(r.n_failed == 0 for r in stages.values())

    for r in joblog.task_skew(events).collect():
        assert r.n_tasks == stages[r.stage].n_tasks
        assert r.longest_ms >= r.median_ms


def test_unfinished_application(spark, tmp_path):
    start = '{"Event":"SparkListenerApplicationStart","App Name":"n","App ID":"app-1","Timestamp":5}\n'
    (tmp_path / "app-1.inprogress").write_text(start)
    [row] = joblog.applications(eventlog.read_event_log(spark, str(tmp_path))).collect()
    assert tuple(row) == ("app-1", "n", 5, None, None, False)


def test_history_job(spark, logged, tmp_path):
    folder, app = logged
    history.run(spark, history.options(["--logs", folder, "--out", str(tmp_path / "out")]))
    assert spark.read.parquet(str(tmp_path / "out" / "applications")).first().app == app
    assert spark.read.parquet(str(tmp_path / "out" / "stages")).count() == 2
