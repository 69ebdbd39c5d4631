import duckdb
import pytest

import lectern.plans  # noqa: F401
from lectern.plans import catalogue

WORK = [
    (0, "spoken", "en"), (1, "spoken", "en"), (2, "spoken", "de"),  # what is spoken in one language isn't pending in another
    (4, "two", "en"), (5, "two", "fr"), (7, "two", "fr"),  # a text pending in two languages has two keys
    (8, "one", None), (10, "other", None), (11, "other", None),
    (13, 'tab\t"quote" \\ slash\nline\rreturn', "en"), (14, "é日", 'a"b\\'), (16, "", "en"), (None, "no id", "en"),
]


@pytest.mark.parametrize(
    "rows",
    [WORK, [*WORK, (17, None, "en")], [*WORK, (18, None, "en")], [(1, "a", "en"), (2, None, "en"), (4, None, "de"), (5, "a", None)], []],
    ids=["plain", "null pending", "null spoken", "nothing spoken", "empty"],
)
def test_dup_text_cache_is_its_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        asked = con.execute(catalogue.ORACLE["dup_text_cache"]).fetchall()
    own = [tuple(r) for r in catalogue.QUERIES["dup_text_cache"](spark, str(tmp_path)).collect()]
    assert sorted(own, key=str) == sorted(asked, key=str)
