"""The registered queries against their SQL on small tables with the cases that the driver's tables lack."""

import duckdb
import pytest

from lintharbor.llm import queries

PAGES = [
    (1, "https://free.org/a", '<head><LINK rel="canonical" href="https://bad.net/x"></head>'), (2, "https://other.org/b", "<meta http-equiv=refresh content='0; url=https://free.org/a'>"),
    (3, "https://bad.net/x", None), (4, "HTTPS://Good.ORG/c", "<link rel=canonical href='//bad.net/y'>"), (5, "https://good.org/fr/d", "<link href=/c?a&amp;b rel=canonical>"), (6, "https://bad.net/y", "é🙂"),
    (7, "https://a.example.net/en/x", "é🙂"), (8, "https://a.example.net/", "é🙂"), (9, "no scheme", ""), (10, None, ""), (11, "https://good.org/c?a&b#top", "last"), (12, "https://example.com/de/?#", "last"),
]


@pytest.fixture(scope="module")
def tables(spark, documents, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = {d: t[:40_000] if t else t for d, t in documents if d is not None}  # the SQL of op2 takes the square of a text's words
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(docs[9].split()[-60:])), (2, docs[8]), (3, "one two"), (4, None), (5, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i * 10, [float(i % 7) / 8, -0.3 * (i % 3), 1.0]) for i in range(60)] + [(50, None), (3001, [float("nan"), 0.0, 1.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_against_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    out, said = queries.QUERIES[name](spark, tables), con.sql(queries.SQL[name])
    columns = sorted(said.columns)
    assert sorted(out.columns) == columns
    picked = ", ".join(columns)
    assert sorted(map(tuple, out.select(*columns).collect()), key=repr) == sorted(said.project(picked).fetchall(), key=repr)
