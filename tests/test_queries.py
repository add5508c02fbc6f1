"""A few registered queries against their SQL on the smallest tables, and the contract of the registry."""

from pathlib import Path

import duckdb
import pytest

from pressgrain.plans import ORACLES, QUERIES

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="tables not present")
SAMPLE = ("scan_articles", "merge_articles_discovery", "receipt_disjunctive_join", "agenda_rank", "source_budget", "pair_confusion", "segment_sentences", "pair_features", "frame_items", "state_machine", "text_statistics")


def norm(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for f in Path(BASE).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[key](spark, BASE)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(ORACLES[key])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
