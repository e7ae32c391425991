"""Compare a Spark result with a SQL result, without regard to row or column order."""

import math


def _value(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v + 0.0
    if isinstance(v, dict):
        return tuple(sorted((str(k), _value(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _value(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(table, key=repr)


def register_tables(connection, folder, names):
    for name in names:
        connection.execute(f"create or replace view {name} as select * from '{folder}/{name}.parquet'")


def differences(df, connection, sql):
    """An empty list when both results hold the same rows, else a few lines on what differs."""
    relation = connection.execute(sql)
    sql_names = [d[0] for d in relation.description]
    sql_rows = _rows(sql_names, relation.fetchall())
    spark_rows = _rows(df.columns, df.collect())
    found = []
    if sorted(df.columns) != sorted(sql_names):
        found.append(f"columns: {sorted(df.columns)} and {sorted(sql_names)}")
    if len(spark_rows) != len(sql_rows):
        found.append(f"rows: {len(spark_rows)} and {len(sql_rows)}")
    wrong = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0][0]} and {wrong[0][1]}")
    return found
