"""Registered queries against their SQL on the smallest tables: the corpus chain end to end."""

import duckdb
import pytest

import __spark_entry__ as driver

SF = "/root/testdata/sf0.001"
NAMES = ["sentence_dedup", "token_type_counts", "lexicon_curate_keep", "encode_tokens", "score_mkn3", "next_word_backoff", "reserved_caps", "next_word_merge", "eval_by_source", "personal_merge", "scored_union", "policy_grid"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "conversations", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = driver.queries()[name](spark, SF)
    cur = con.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(show(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(show(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_entry(spark):
    assert {"word", "next", "n", "rank"} == set(driver.entry(spark).columns)
    assert set(driver.oracle_sql()) <= set(driver.queries())
