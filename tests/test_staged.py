"""Replacement by staging and rename: a job that reads what it replaces, failures in between, and recovery."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nutrilake.sources import staged

SCHEMA = "id long, t string"
ROWS = [(1, "a"), (2, None), (4, ' "x", y\nz '), (5, "\\")]


def rows_at(spark, path):
    """Rows in order; an empty text comes back as null."""
    return sorted(map(tuple, staged.read_csv(spark, path, SCHEMA).collect()), key=lambda r: r[0])


def test_a_job_replaces_what_it_reads(spark, tmp_path):
    path = f"{tmp_path}/table"
    staged.replace_csv(spark.createDataFrame([*ROWS, (9, "")], SCHEMA).repartition(3), path)
    assert rows_at(spark, path) == [*ROWS, (9, None)]
    for _ in range(2):
        staged.replace_csv(staged.read_csv(spark, path, SCHEMA).withColumn("id", F.col("id") + 10), path)
    assert rows_at(spark, path) == [(i + 20, t) for i, t in ROWS] + [(29, None)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["table"]


def test_a_failed_job_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    staged.replace_csv(spark.createDataFrame(ROWS, SCHEMA), path)
    with pytest.raises(PySparkException):
        staged.replace_csv(staged.read_csv(spark, path, SCHEMA).withColumn("t", F.raise_error(F.lit("broken")).cast("string")), path)
    assert rows_at(spark, path) == ROWS and sorted(p.name for p in tmp_path.iterdir()) == ["table"]


@pytest.mark.parametrize("dies_before", [1, 2, 3])
def test_recovery(spark, tmp_path, monkeypatch, dies_before):
    """The job dies before the first rename, between the two, and before the old version is removed."""
    path, steps = f"{tmp_path}/table", []
    staged.replace_csv(spark.createDataFrame(ROWS, SCHEMA), path)

    def step(action):
        def run(*given):
            steps.append(given)
            if len(steps) == dies_before:
                raise KeyboardInterrupt
            return action(*given)
        return run
    with monkeypatch.context() as patch:
        patch.setattr(staged, "rename", step(staged.rename))
        patch.setattr(staged, "delete", step(staged.delete))
        with pytest.raises(KeyboardInterrupt):
            staged.replace_csv(spark.createDataFrame([(9, "new")], SCHEMA), path)
    assert rows_at(spark, path) == ([(9, "new")] if dies_before == 3 else ROWS)
    staged.replace_csv(spark.createDataFrame([(8, "next")], SCHEMA), path)
    assert rows_at(spark, path) == [(8, "next")] and not staged.exists(spark, path + staged.OLD)


def test_tables_are_kept_or_replaced_whole(spark, monkeypatch):
    name = "kept_or_replaced"
    one, two = spark.range(3), spark.range(5)
    try:
        assert staged.materialize_table(spark, name, lambda: one).count() == 3
        assert staged.materialize_table(spark, name, lambda: two).count() == 3
        assert staged.materialize_table(spark, name, lambda: two, force=True).count() == 5
        # A replacement computed from the table itself, and one that fails on the way.
        assert staged.materialize_table(spark, name, lambda: spark.table(name).where("id > 0"), force=True).count() == 4
        with pytest.raises(PySparkException):
            staged.materialize_table(spark, name, lambda: spark.range(2).where(F.raise_error(F.lit("broken")).isNull()), force=True)
        assert spark.table(name).count() == 4
        # Dead between the renames: the old version is under its second name.
        spark.sql(f"ALTER TABLE {name} RENAME TO {name + staged.OLD}")
        assert staged.materialize_table(spark, name, lambda: two).count() == 4
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(name) and t.name != name]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
