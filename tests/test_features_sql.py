"""Similarities and pair features against their DuckDB SQL: random strings for each similarity, the queries on the test tables."""

import random

import duckdb
import pandas as pd
import pytest

from kinlode.functions import similarity
from kinlode.plans import features_sql
from tests.test_normaliser_sql import compare

WORDS = ["tin", "drum", "canal", "toys", "kites", "ostrava", "quux", "bb", "a", "1", "42", "aaa"]
KINDS = {"ratio": features_sql.ratio, "token_sort": features_sql.token_sort, "token_set": features_sql.token_set, "partial": features_sql.partial}


def strings(seed):
    rng = random.Random(seed)
    out = ["", "a", "tin drum", "drum tin", "x" * 126]
    for _ in range(150):
        text = " ".join(rng.choices(WORDS, k=rng.randint(1, 6)))
        out += [text, "".join(c for c in text if rng.random() > 0.15).strip()]
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_similarity(kind):
    given = pd.DataFrame({"a": strings(1), "b": strings(2)}).drop_duplicates()
    con = duckdb.connect()
    con.register("given", given)
    rows = con.execute(f"WITH {KINDS[kind]('s', 'SELECT a, b FROM given')} SELECT a, b, v FROM s").fetchall()
    assert len(rows) == len(given)
    one = getattr(similarity, kind)
    for a, b, v in rows:
        assert v == pytest.approx(one(a, b), abs=1e-9), (a, b)


@pytest.mark.parametrize("name", ["ratio_family", "pair_features_rules", "neighbour_features"])
def test_same_as_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name)
