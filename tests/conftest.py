import os
import sys

import pytest

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare():
    """Holds a Spark result against DuckDB SQL over tables given as Arrow."""
    import duckdb

    def plain(v):
        if isinstance(v, float):
            return None if v != v else int(v) if v == int(v) else round(v, 6)
        return v

    def run(df, sql, tables):
        con = duckdb.connect()
        for name, value in tables.items():
            con.register(name, value) if not isinstance(value, str) else con.sql(f"create view {name} as select * from '{value}'")
        other = con.sql(sql)
        names = sorted(other.columns)
        assert sorted(df.columns) == names
        key = lambda rows: sorted(repr([plain(v) for v in r]) for r in rows)
        assert key(tuple(r[n] for n in names) for r in df.collect()) == key(other.select(", ".join(f'"{n}"' for n in names)).fetchall())

    return run
