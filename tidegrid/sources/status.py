"""What Spark itself knows of the running application, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EXECUTORS = "executor string, active boolean, cores int, failed_tasks long, completed_tasks long, task_ms long, gc_ms long, input_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, storage_bytes long, max_storage_bytes long"
_STAGES = "stage int, attempt int, status string, name string, tasks int, completed_tasks int, failed_tasks int, run_ms long, cpu_ns long, input_rows long, input_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, spilled_bytes long"


def executors(spark: SparkSession) -> DataFrame:
    """One row for each executor, the driver among them."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    rows = []
    for i in range(found.size()):
        e = found.apply(i)
        rows.append((e.id(), e.isActive(), e.totalCores(), e.failedTasks(), e.completedTasks(), e.totalDuration(), e.totalGCTime(), e.totalInputBytes(), e.totalShuffleRead(), e.totalShuffleWrite(), e.memoryUsed(), e.maxMemory()))
    return spark.createDataFrame(rows, _EXECUTORS)


def stages(spark: SparkSession, group: str | None = None) -> DataFrame:
    """One row for each attempt of each stage that Spark still remembers, or of those of a job group."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()  # what has ended is known
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    found = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    wanted = None
    if group is not None:
        tracker = sc.statusTracker()
        wanted = {s for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])}
    rows = []
    for i in range(found.size()):
        s = found.apply(i)
        if wanted is None or s.stageId() in wanted:
            spilled = s.memoryBytesSpilled() + s.diskBytesSpilled()
            rows.append((s.stageId(), s.attemptId(), s.status().toString(), s.name(), s.numTasks(), s.numCompleteTasks(), s.numFailedTasks(), s.executorRunTime(), s.executorCpuTime(), s.inputRecords(), s.inputBytes(), s.shuffleReadBytes(), s.shuffleWriteBytes(), spilled))
    return spark.createDataFrame(rows, _STAGES)
