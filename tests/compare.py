"""Spark result against SQL result, row for row and independent of order."""

import glob
import os

import duckdb


def connect(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def _kinds(types):
    short = {"bigint": "int", "double": "float", "string": "str", "varchar": "str"}
    return [short.get(str(t).lower(), str(t).lower()) for t in types]


def compare(df, connection, sql):
    """Raise unless names, types and rows agree; returns the number of rows."""
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    sql_types = dict(zip(names, _kinds(column[1] for column in cursor.description)))
    spark_types = dict(zip(df.columns, _kinds(kind for _, kind in df.dtypes)))
    expected = _rows(cursor.fetchall(), names)
    found = _rows([tuple(row) for row in df.collect()], df.columns)
    assert len(found) == len(expected), (len(found), len(expected))
    different = [pair for pair in zip(found, expected) if pair[0] != pair[1]]
    assert not different, f"{len(different)} rows differ, first {different[0]}"
    assert spark_types == sql_types, (spark_types, sql_types)
    return len(found)
