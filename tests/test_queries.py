"""Every query of the library against its SQL twin, and those without one against what they must keep."""

import os

import numpy as np
import pandas as pd
import pytest

from clipweave.plans.catalog import QUERIES, SQL

from .conftest import SF, plain


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["optimal_match_event", "optimal_match_semantic", "greedy_match_gated"])
def test_matches_are_one_to_one(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) and not got.duplicated(["key", "ref_id"]).any() and not got.duplicated(["key", "gen_id"]).any()


def test_unmatched_and_merge(spark):
    assert QUERIES["unmatched_both_sides"](spark, SF).count() > 0
    merged = QUERIES["semantic_adjacent_merge"](spark, SF).toPandas()
    assert (merged.e > merged.s).all() and merged.n.sum() > 0


def test_windowed_counts_of_many_unordered_files(spark, duck, tmp_path):
    """More files than a micro-batch takes, with the newest days in the first ones: no row may count as late."""
    ev = duck.execute("select * from events").df().sample(frac=1, random_state=1)
    ev = pd.concat([ev.nlargest(len(ev) // 4, "ts"), ev]).drop_duplicates("event_id")
    (tmp_path / "events.parquet").mkdir()
    for i, at in enumerate(np.array_split(np.arange(len(ev)), 40)):
        ev.iloc[at].to_parquet(tmp_path / "events.parquet" / f"{i:02d}.parquet", index=False, coerce_timestamps="us")
        os.utime(tmp_path / "events.parquet" / f"{i:02d}.parquet", (1.7e9 + i, 1.7e9 + i))
    got = QUERIES["stream_windowed_counts"](spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(duck.execute(SQL["stream_windowed_counts"]).df())


def test_event_total_has_the_relation_score(spark):
    part = lambda name, c: QUERIES[name](spark, SF).toPandas().set_index("key")[c]
    got = QUERIES["s_event_end_to_end"](spark, SF).toPandas().set_index("key")
    ega, erel, ecr = (part(n, c).reindex(got.index) for n, c in (("ega_weighted_mean", "ega"), ("allen_affinity_score", "erel"), ("ecr_f1", "ecr")))
    want = 0.2 * ega.fillna(0) + np.where(erel.notna(), 0.2 * erel.fillna(0) + 0.6 * ecr, 0.8 * ecr)
    assert (got.erel_valid == erel.notna()).all() and got.erel_valid.any() and not got.erel_valid.all()
    assert erel.nunique() > 2 and np.abs(got.s_event - want).max() < 2e-4
