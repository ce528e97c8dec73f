"""Intermediate tables go where the session says."""

from pathlib import Path

from tenderloom import session


class Named:
    """A session stand-in that only knows its settings."""

    def __init__(self, spark, folder):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)})
        self.sparkContext = spark.sparkContext


def test_named_folder_wins(spark, tmp_path):
    assert session.shared_folder(Named(spark, str(tmp_path))) == str(tmp_path)


def test_local_folder_is_stable(spark):
    assert session.shared_folder(Named(spark, None)) == session.shared_folder(Named(spark, None))


def test_written_table_keeps_rows_and_plan_is_one_scan(spark):
    df = session.cut_lineage(spark.range(10).selectExpr("id", "struct(id as a, array(id) as b) as s"))
    assert df.count() == 10 and df.schema["s"].dataType.names == ["a", "b"]
    assert all(Path(f.replace("file:", "")).name for f in df.inputFiles())


def test_recorded_tables_can_be_removed(spark):
    with session.recorded_tables() as paths:
        df = session.cut_lineage(spark.range(3))
    session.cut_lineage(spark.range(2))
    assert len(paths) == 1 and df.count() == 3
    session.remove_tables(spark, paths)
    assert not Path(paths[0]).exists()
