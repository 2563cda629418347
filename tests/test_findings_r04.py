"""Cases from the findings of round 4."""

import pandas as pd

from clipweave.plans.catalog import QUERIES

from .test_findings_r03 import both


def parts(keys, brand, kind, size):
    return pd.DataFrame({"p_partkey": pd.array(keys, "Int64"), "p_name": "x", "p_brand": brand, "p_type": kind, "p_size": pd.array(size, "Int32")})


def test_pairs_of_split_signatures_are_those_of_the_sql(spark, tmp_path):
    """a signature of many splits and tiles, small ones, keys given twice, nulls anywhere, negative sizes; each pair once."""
    one = parts([7 * k % 1009 for k in range(900)], "Brand#1", "T", [k % 13 for k in range(900)])
    odd = parts([5, 5, 6, 7, None, 8, 9, 10, 11, 5000], "Brand#2", ["T", "T", "T", "T", "T", None, "U", "U", "U", "V"], [3, 3, -4, 2, 1, 2, None, 6, 0, 1])
    got, want = both(spark, tmp_path, "entity_match_score", part=pd.concat([one, odd, odd.assign(p_brand=None)]))
    assert got == want and len(got) > 350_000 and len(set(got)) < len(got)


def test_pairs_of_a_large_signature_take_little_disk(spark, tmp_path):
    """rows in tiles, so that a page of either column repeats itself; in the order of one part's partners it holds a new number for each row."""
    n = 4_000
    parts([6 * k + k % 5 for k in range(n)], "Brand#1", "T", [k % 2 * 7 for k in range(n)]).to_parquet(tmp_path / "part.parquet", index=False)
    QUERIES["entity_match_score"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    rows = n * (n - 1) // 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.4 * rows
