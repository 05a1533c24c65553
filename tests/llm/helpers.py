import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def same(frame, sql: str, sf: str = SF) -> bool:
    """Whether a DataFrame has the rows of the SQL over the tables of sf."""
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    found = db.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    order = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    return order(frame.select(names).collect()) == order(found.fetchall())


def odd_documents(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, and columns whose names clash with ours."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(12_000))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "one two three", "fr", None), (4, long, "en", "a"), (4, long, "en", "a"), (5, " \n\t ", "de", ""), (6, "12 ?? --", "de", "b"), (None, None, None, None), (7, "xy" * 700, "es", "b")]
    frame = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    clashing = ["host", "text_key", "set_id", "n_grams", "hits", "count", "label", "salt", "rank", "kept", "score", "held_out", "words", "key", "mini", "body"]
    return frame.selectExpr("*", *[f"'x' as {c}" for c in clashing])
