"""Comparing a Spark result with an SQL result as bags of rows."""

from collections import Counter

from pandas import NA


def canonical(df):
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is NA or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return Counter(tuple(map(one, r)) for r in df.astype(object).itertuples(index=False))


def same(spark_df, sql_df):
    assert sorted(spark_df.columns) == sorted(sql_df.columns)
    a, b = canonical(spark_df.toPandas()), canonical(sql_df)
    assert a == b, f"spark only {list((a - b).items())[:3]}, sql only {list((b - a).items())[:3]}"
