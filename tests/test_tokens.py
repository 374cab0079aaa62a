import duckdb
from oracle import rows

from veilmill import catalogue

TEXTS = [
    "One word\na.b@mail1.example.com\nmore", "\n\nc@d.org", "x\r\n<e@f.net>,", "(g@h.io).\u2028", "\u2028i@j.com.\u2028", "k\u0085l@m.com!\u0085", "n\x0bo@p.org\x0bq", "\f(r@s.net)\f",
    "t,u@v.com;w x@y.org", "z@a.com", "\U0001d11e\nb@c.com", "word " * 50 + "\nd@e.com\n", "", None,
]


def test_tokens_are_those_of_sql_beside_line_ends(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = rows(catalogue.QUERIES["token_expand"](spark, str(tmp_path)).toPandas())
    assert found == rows(con.execute(catalogue.ORACLES["token_expand"]).df())
    assert (0, "a.b@mail1.example.com", "a.b@mail1.example.com") in [(a, c, b) for a, b, c in found[1]]
