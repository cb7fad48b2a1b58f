import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomset import session
from loomset.operators import unify
from loomset.operators.vocabulary import united


@pytest.mark.parametrize("size", [3, 200])
def test_united_sets_small_and_large_vocabulary(spark, size):
    rng = random.Random(size)
    rows = [(rng.randint(0, 9), f"v{rng.randint(0, size)}" if rng.random() < 0.9 else None) for _ in range(2000)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    want = {}
    for k, v in rows:
        want.setdefault(k, set()).update([v] if v else [])
    got = united(df, ["k"], {"s": F.col("v")}, [F.count(F.lit(1)).alias("n")]).collect()
    assert {r["k"]: r["s"] for r in got} == {k: sorted(v) for k, v in want.items()} and sum(r["n"] for r in got) == len(rows)


def test_set_ids_are_free_of_order_and_of_size(spark):
    rows = [("g", "s", f"m{i}") for i in range(12_000)] + [("h", "s", "a"), ("h", "t", "b")]
    df = lambda r: spark.createDataFrame(r, "group string, source string, member_id string")
    ids = lambda d: {r["group"]: r["set_id"] for r in unify.set_ids(d, "IP").collect()}
    one, two = ids(df(rows)), ids(df(rows[::-1]))
    assert one == two and len(set(one.values())) == 2
    text = "|".join(f"s:{m}" for m in sorted(f"m{i}" for i in range(12_000)))
    assert one["g"] == "IP" + hashlib.sha1(text.encode()).hexdigest()[:10].upper()


def test_checkpoint_folder_is_taken_from_the_session(spark):
    folder = session.checkpoint_folder(spark)
    assert folder and session.checkpoint_folder(spark) == folder
    assert session.cut(spark.range(3)).count() == 3 and session.cut(spark.range(0)).count() == 0


def test_entry_and_oracle_keys(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and "fdr" in df.columns
