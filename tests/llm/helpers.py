"""Small tables with the awkward rows that every operator has to handle."""

import os

import duckdb
import pandas as pd
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
EXTRA = ["id", "t", "node", "size", "copies", "kept", "salt", "h", "n", "row", "k", "component_id", "sequence_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    long = " ".join(f"word{i % 5000}" for i in range(40_000))
    rows = [
        (1, base, "en", "a", 100), (2, base.upper(), "en", "a", 100), (3, base + " phi", "en", "b", 104), (4, None, "en", "b", None),
        (5, "", None, None, 0), (6, "  \n\t ", "de", None, 5), (7, "one", "de", "c", 3), (8, "ONE", "de", "c", 3),
        (9, "one two three", "fr", None, 13), (10, long, "en", "a", len(long)), (11, "12345 !!! 67890", "en", "d", 15),
        (12, "çé été où" * 30, "fr", "d", 270), (12, "çé été où" * 30, "fr", "d", 270), (13, "a" * 500, "en", "a", 500),
        (14, long + " more", "en", "a", len(long) + 5), (15, "x y " * 300, None, "e", None), (-3, base + " chi psi omega", "en", "b", 120),
        (None, "no identifier here at all", "en", "a", 25), (16, base[: len(base) // 2] + " " + base, "en", "f", None),
    ]
    return [r for r in rows]


def edge_docs(spark, rows=None):
    """The rows with further columns whose names operators use inside."""
    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    for k, name in enumerate(EXTRA):
        df = df.withColumn(name, F.lit(k))
    return df


def duck(tables):
    """A DuckDB connection with pandas tables as views."""
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"{name}_data", frame)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_data")
    return con


def duck_dir(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(df, con, sql):
    """Rows of a query and of its SQL, as sorted tuples by column name."""
    got = df.toPandas()
    want = con.execute(sql).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names

    def rows(frame):
        plain = (tuple(None if v is None or v is pd.NA or v != v else v for v in r) for r in frame[names].astype(object).itertuples(index=False))
        return sorted(plain, key=lambda r: tuple((v is not None, v) for v in r))

    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b
