"""Sessions whose tasks stay small, and the queries that run in them."""
from conftest import SMALL
from marketloom.plans import catalog, registry
from marketloom.session import TASK_BYTES, TASK_ROWS, bounded_tasks

NAMED = ["function_calls", "khop_undirected", "graph_roundtrip", "typed_neighbors", "edge_dedup_first", "edge_dedup_conf"]


def test_partitions_grow_with_the_rows_and_the_given_session_stays(spark):
    before = spark.conf.getAll
    own = bounded_tasks(spark, 100 * TASK_ROWS)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) == 100
    assert int(own.conf.get("spark.sql.files.maxPartitionBytes")) <= TASK_BYTES
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert spark.conf.getAll == before


def test_smaller_limits_of_the_given_session_stay(spark):
    given = spark.newSession()
    given.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    given.conf.set("spark.sql.shuffle.partitions", "7")
    own = bounded_tasks(given, 10)
    assert own.conf.get("spark.sql.files.maxPartitionBytes") == str(1 << 20)
    assert own.conf.get("spark.sql.shuffle.partitions") == "7"


def test_a_task_reads_a_bounded_split(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(6_000_000).selectExpr("id", "xxhash64(id) AS h").coalesce(1).write.option("parquet.block.size", 2 << 20).parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet"))
    given = spark.newSession()
    given.conf.set("spark.sql.files.minPartitionNum", "1")
    assert bounded_tasks(given, 10).read.parquet(path).rdd.getNumPartitions() >= size / TASK_BYTES


def test_the_named_queries_run_in_bounded_tasks(spark):
    assert set(NAMED) <= registry.BOUNDED
    for name in ("edge_dedup_first", "typed_neighbors"):
        frame = catalog.spark_queries()[name](spark, SMALL)
        assert int(frame.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")) <= TASK_BYTES
