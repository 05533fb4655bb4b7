import pytest

from larkspur.llm.queries import QUERIES, SQL
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), FOLDER, SQL[name])


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs
    for name, stage in p.STAGES:
        out = stage(spark, rows, FOLDER)
        if name != p.STAGES[-1][0]:
            assert sorted(out.dtypes) == sorted(docs.dtypes)
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name.split()[0]}")
        rows = spark.read.parquet(path)
    assert 0 < rows.count() <= docs.count()
    got, want = (sorted(map(str, (r.doc_id for r in df.collect()))) for df in (p.run(spark, FOLDER), rows))
    assert got == want
