"""Every registered query against its SQL, on the smallest tables."""

import pytest

from kasumi.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    held = duckdb.connect()
    for name in TABLES:
        held.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return held


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return list(frame.columns), sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(sql.execute(registry.ORACLES[name]).df())
    else:
        assert len(got)


#: Texts of more bytes than a tokenizer takes at once: many lines, and a long line, with contacts in front and behind; without words; none.
LONG = ["a@b.cd\n" + "line | of (words)\n" * 3_000 + "then c@d.ef, (a@b.cd) and a@b.cd", "a@b.cd " + "é(x)" * 20_000 + " c@d.ef | a@b.cd", "\n" * 50_000 + "a@b.cd", " \n ", "", None, "short (a@b.cd)"]


@pytest.mark.parametrize("name", ["expanded_masks", "original_spans", "prepared_bodies"])
def test_long_texts(spark, name, tmp_path):
    held = pytest.importorskip("duckdb").connect()
    spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(held.execute(registry.ORACLES[name]).df())


#: Addresses with brackets in and around them, by ids that are missing or occur twice.
BRACED = [(1, "a}b{c@d.ef (x}@y.zz)\n| {u@v.ww | (p)q}r@s.tt |\n|---|\n}@k.ll"), (1, "a} b@c.dd"), (2, "f{ }g@h.ii[j{}@k.ll]"), (2, "no braces (a@b.cc)"), (None, "l}m@n.oo and a@b.cc"), (3, "{}")]


def test_addresses_with_brackets(spark, tmp_path):
    held = pytest.importorskip("duckdb").connect()
    spark.createDataFrame(BRACED, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = [tuple(r) for r in registry.QUERIES["original_spans"](spark, str(tmp_path)).collect()]
    assert (1, 0, 10, "a}b{c@d.ef") in found
    assert sorted(found, key=repr) == sorted(held.execute(registry.ORACLES["original_spans"]).fetchall(), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "masked_text"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
