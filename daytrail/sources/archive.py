"""Weekly archive of the fact tables: five tables at once, with a manifest, recoverable at any point.

A week's archive holds batches, one for each run that found files: `archive/week=<start>/batch=<n>`. A run
1. lists the week's files of all tables and writes the list, the plan, which from then on is what the batch moves;
2. copies the rows of these files into the batch, over whatever an earlier try left there;
3. commits the batch by renaming its folder, which one step of the file system does: readers see all tables of it or none;
4. deletes the files of the plan, and marks the batch as done.
A run first finishes a batch that was left: without a commit it copies again, with one it deletes what is left of the plan. Rows that
come late make another batch. Between 3 and 4 rows are in both places; `read_archive` and the live tables are not to be added up then,
and `unfinished` tells.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from daytrail.schemas import FACT_COLUMNS
from daytrail.sources.dated import DAY_COLUMN, FACT_TIMES, day_files, fact_ddl, read_days, write_days
from daytrail.sources.tables import remove_path, table_exists

PLAN_DDL = "fact STRING, day DATE, file STRING"


def _store(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _batches(spark: SparkSession, week: str) -> dict[int, str]:
    """State of each batch by its folders: `open` (planned), `full` (committed) or `done`."""
    if not table_exists(spark, week):
        return {}
    store, path = _store(spark, week)
    states: dict[int, str] = {}
    for status in store.listStatus(path):
        name, _, number = status.getPath().getName().partition("=")
        if name in ("open", "batch"):
            done = name == "batch" and table_exists(spark, f"{week}/batch={number}/_done")
            states[int(number)] = "done" if done else "full" if name == "batch" else "open"
    return states


def _plan(spark: SparkSession, facts: str, week: str, start: dt.date, number: int) -> bool:
    """Write the list of the week's files; False if there are none."""
    days = [start + dt.timedelta(days=i) for i in range(7)]
    rows = [(fact, day, file) for fact in FACT_COLUMNS for day, held in day_files(spark, f"{facts}/{fact}").items() if day in days for file in held]
    if not rows:
        return False
    spark.createDataFrame(rows, PLAN_DDL).coalesce(1).write.mode("overwrite").parquet(f"{week}/open={number}/_plan")
    return True


def _planned(spark: SparkSession, folder: str) -> list:
    """The plan of a batch; a batch without a whole plan has none."""
    if not table_exists(spark, f"{folder}/_plan/_SUCCESS"):
        return []
    return spark.read.schema(PLAN_DDL).parquet(f"{folder}/_plan").collect()  # files of one week


def _copy(spark: SparkSession, facts: str, folder: str, plan: list) -> None:
    for fact in FACT_COLUMNS:
        files = [r.file for r in plan if r.fact == fact]
        if files:
            rows = spark.read.schema(fact_ddl(fact)).option("basePath", f"{facts}/{fact}").parquet(*files)
            remove_path(spark, f"{folder}/{fact}")
            write_days(rows.select(*FACT_COLUMNS[fact]), f"{folder}/{fact}", FACT_TIMES[fact])


def _commit(spark: SparkSession, week: str, number: int) -> None:
    store, source = _store(spark, f"{week}/open={number}")
    if not store.rename(source, _store(spark, f"{week}/batch={number}")[1]):
        raise OSError(f"batch {number} of {week} cannot be committed")


def _delete(spark: SparkSession, facts: str, plan: list) -> None:
    """Delete the files of the plan: days as folders where nothing has come since, else one by one."""
    for fact in FACT_COLUMNS:
        now = day_files(spark, f"{facts}/{fact}")
        for day in {r.day for r in plan if r.fact == fact}:
            files = {r.file for r in plan if (r.fact, r.day) == (fact, day)}
            if set(now.get(day, [])) <= files:
                remove_path(spark, f"{facts}/{fact}/{DAY_COLUMN}={day}")
            else:
                for file in files:
                    remove_path(spark, file)


def _finish(spark: SparkSession, week: str, number: int) -> None:
    store, path = _store(spark, f"{week}/batch={number}/_done")
    store.create(path, True).close()


def unfinished(spark: SparkSession, archive: str, week_start: dt.date | str) -> list[int]:
    """Batches of a week that a run has left before its end."""
    return sorted(n for n, state in _batches(spark, f"{archive}/week={week_start}").items() if state != "done")


def archive_facts(spark: SparkSession, facts: str, archive: str, week_start: dt.date | str) -> int:
    """Move a week's rows of all fact tables to the archive; returns the number of batches the week has then. One writer at a time."""
    start = dt.date.fromisoformat(str(week_start))
    week = f"{archive}/week={start}"

    def move(number: int, state: str) -> None:
        if state == "open":
            plan = _planned(spark, f"{week}/open={number}")
            if not plan:  # it was left before it had a plan, and nothing was moved
                remove_path(spark, f"{week}/open={number}")
                return
            _copy(spark, facts, f"{week}/open={number}", plan)
            _commit(spark, week, number)
        _delete(spark, facts, _planned(spark, f"{week}/batch={number}"))
        _finish(spark, week, number)

    states = _batches(spark, week)
    for number, state in sorted(states.items()):
        if state != "done":
            move(number, state)
    number = max(states, default=0) + 1
    if _plan(spark, facts, week, start, number):
        move(number, "open")
    return len(_batches(spark, week))


def read_archive(spark: SparkSession, archive: str, week_start: dt.date | str) -> dict[str, DataFrame]:
    """The fact tables of a week's committed batches."""
    week = f"{archive}/week={week_start}"
    numbers = sorted(n for n, state in _batches(spark, week).items() if state != "open")
    out = {}
    for fact in FACT_COLUMNS:
        parts = [read_days(spark, f"{week}/batch={n}/{fact}", fact_ddl(fact)) for n in numbers] or [read_days(spark, f"{week}/none", fact_ddl(fact))]
        out[fact] = parts[0]
        for part in parts[1:]:
            out[fact] = out[fact].unionByName(part)
    return out
