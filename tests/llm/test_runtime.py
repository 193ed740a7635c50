import pytest
from pyspark.sql import functions as F

from foliospark.llm import runtime as R


class Elsewhere:
    """A session of a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda name, default: default)

    class sparkContext:
        master = "spark://host:7077"

        class _jsc:
            class sc:
                class getCheckpointDir:
                    isDefined = staticmethod(lambda: False)


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        R.shared_dir(Elsewhere)
    made = []
    monkeypatch.setattr(Elsewhere.sparkContext, "master", "local[2]")
    monkeypatch.setattr(Elsewhere.sparkContext, "setCheckpointDir", made.append, raising=False)
    assert R.shared_dir(Elsewhere) == made[0]


def test_tables_can_be_discarded(spark):
    R.discard_all(spark)
    a, b = R.materialize(spark.range(5)), R.materialize(spark.range(7).selectExpr("id as a", "null as b"))
    assert a.count() == 5 and b.count() == 7
    R.discard(a)
    with pytest.raises(Exception):
        a.count()
    assert R.discard_all(spark) == 1 and R.discard_all(spark) == 0


def test_the_session_stays_as_it_is(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = R.map_arrow(spark.range(0, 9000, 1, 1), lambda batches: (b for b in batches), "id long")
    assert sizes.count() == 9000 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_columns_by_name_whatever_else_bears_it(spark):
    df = spark.range(2).select(F.lit(1).alias("Text"), F.lit(2).alias("text"), F.lit(3).alias("text"), F.lit(4).alias("a.b"))
    n = R.Numbered(df)
    assert n.place("text") == 1 and n.place("TEXT") == 0 and n.place("a.b") == 3
    assert n.restored(n.df.select(n.row().alias("row"))).columns == df.columns
    assert [tuple(x) for x in R.only(df, t="text", b="a.b").collect()] == [(2, 4)] * 2
    with pytest.raises(ValueError):
        n.place("other")
