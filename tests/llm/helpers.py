"""Documents with all that can go wrong, and comparisons."""

import duckdb

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, tokens string, toxic int, score int, words int, gone int, `left` int, lines int, key int, i int, t int, h string, l int, kept int, "
    "round_trip int, ids int, `a.b` int, `Text_` string, low int, now int, was int"
)
EXTRA = len(CLASH.split(",")) - 5


def docs(spark, texts, first=0):
    """A row for each text; a text may also be (id, text)."""
    rows = [x if isinstance(x, tuple) else (first + k, x) for k, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)


def clashing(spark, texts):
    rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
    extra = ["x" if "string" in c else 1 for c in CLASH.split(",")[5:]]
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, *extra) for i, t in rows], CLASH)


def plain(rows):
    def one(v):
        if isinstance(v, (list, tuple)):
            return tuple(map(one, v))
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        pandas = table.toPandas()  # noqa: F841 - read by name
        con.execute(f"create table {name} as select * from pandas")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(got.fetchall())
