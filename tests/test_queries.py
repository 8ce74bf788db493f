"""Every registered query against its SQL, run by DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from assetloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(found):
    return sorted(repr(tuple(map(plain, r))) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    got = df.collect()
    assert got
    if name not in catalog.ORACLE_SQL:
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([[r[n] for n in names] for r in got]) == rows(want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


def test_driver_contract():
    import __spark_entry__ as entry

    assert catalog.QUERIES.items() <= entry.queries().items() and catalog.ORACLE_SQL.items() <= entry.oracle_sql().items()
    assert os.path.exists(entry.__file__)


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """Texts without characters or with an unknown length, with and without labels, beside plain ones."""
    to = tmp_path_factory.mktemp("odd")
    texts = [("", 0), ("abc", 0), (None, 0), (None, 300), ("a b c", None), (None, None), ("abc. " * 60, 300), ("12 ab", 5)]
    docs = [(100 * labelled + i, t, ["en", "de"][i % 2], "s" if i % 3 else "r", n) for labelled in (0, 1) for i, (t, n) in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(100 + i, i % 2, int(i == 6)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{to}/{t}.parquet/*.parquet'")
    return str(to), con


@pytest.mark.parametrize("name", "accept_all_ready batch_summary batch_summary_total build_summary cards_order eval_by_category eval_by_verdict eval_summary labelling_stats report_order threshold_sweep verdict_filter verdict_routing".split())
def test_texts_without_characters(spark, odd_texts, name):
    path, con = odd_texts
    df = catalog.QUERIES[name](spark, path)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in df.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert rows(df.collect()) == rows(want) and want
