"""The registered queries against their SQL, and the pipeline against its operators."""

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.decontamination import find_contamination
from plumbline.llm.near_duplicates import find_near_duplicates
from plumbline.llm.quality_rules import judge_quality
from plumbline.llm.runtime import materialise, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_says_what_its_sql_says(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(map(str, map(tuple, df.select(*columns).collect())))
    assert found == sorted(map(str, db.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({queries.ORACLES[name]}) q").fetchall()))


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    bench = table(spark, SF, "benchmark")
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, SF), "test-stage")
        if name == "quality rules":
            assert ids(after) == ids(judge_quality(docs).where("kept"))
        elif name == "near duplicates":
            assert ids(after) == ids(find_near_duplicates(docs).where("kept"))
        elif name == "benchmark decontamination":
            assert ids(after) == ids(find_contamination(docs, bench).where("not contaminated"))
        elif name == "secret scan":
            assert ids(after) == ids(docs)
            assert after.where("text like '%[SECRET]%'").count() == docs.where(r"text rlike 'token = \"[0-9a-f]{40}\"'").count()
        else:
            assert sorted({r[0] for r in after.select("doc_id").collect()}) == ids(docs)
            break
        assert after.columns == docs.columns
        docs = after


def test_stages_take_awkward_rows(spark):
    """Nulls in any column, empty and repeated rows, ids that repeat, clashing extra columns, no rows at all."""
    text = " ".join(f"the word{i} of and to line{i} in is" for i in range(12))
    rows = [(1, text, "en", None, None, "a", 1), (1, text, "en", None, None, "a", 1), (1, None, None, None, 3, None, None), (None, text + " end", None, "s", 1, "b", 2), (None, None, None, None, None, None, None), (2, "", "en", "s", 0, "c", 3), (3, "x " * 40_000, "en", "s", 1, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, row long")
    for name, stage in corpus_pipeline.STAGES:
        for table_ in (docs, docs.limit(0)):
            after = materialise(stage(spark, table_, SF), "test-stage")
            last = name == "best-fit packing"
            assert last or after.columns == docs.columns, name
            if table_ is docs and name in ("benchmark decontamination", "secret scan"):
                assert sorted(map(str, after.collect())) == sorted(map(str, docs.collect())), name
            elif table_ is docs and name == "near duplicates":
                # the copy goes, and so does the text that is all but the same
                assert sorted(map(str, after.select("doc_id", "kept").collect())) == sorted(map(str, docs.distinct().where("kept is null or kept <> 'b'").select("doc_id", "kept").collect()))
            elif table_ is docs and last:
                assert after.where("piece = 0").count() == len(rows)
            elif table_ is not docs:
                assert after.count() == 0, name
