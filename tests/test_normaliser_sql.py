"""The normaliser's queries against their DuckDB SQL, on the test tables and on odd texts of our own."""

import duckdb
import pytest

from kinlode.plans import queries

NAMED, SITED = ("names_full", "name_forms", "names_text", "segmenter", "fold_text"), ("addresses_full", "address_forms", "addresses_text")
ODD = [
    None, "", "   ", "L.L.C.", "Ostrava Kites l.l.c., (P.V.T.) a.b.c.d.e.f.g x.y.z1", "M/S Tin & Drum+Sons #12 No. 9", "The", "the limited", "T1n Drum 12345 b00k", "kites f / k / a canal d/b/a toys llc",
    "www.tin-drum.co.in", " aka quux gmbh", "it's d’Or `x`", "ÉCOLE Straße çà", "a.b. c.d", "tindrumcom", "S.A. S.A. Toys toys", "+", "x & y & x",
    "null, 12 Elm, <null>", "P.O. Box 007, p o box 1", "Apt.No 12-B/3.4 x-y.z", "12th Floor, 0, 00, a007b00c", "N/A, none, Elm Rd., , Saint No. 4", "1st 2nd-3rd 4th/5", "C/O Near Opp. Main, n° 5 # 6", "12 rue d'Ulm, ter, bis 4",
]


def compare(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
    return len(columns)


@pytest.mark.parametrize("name", NAMED + SITED)
def test_same_as_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name)


@pytest.mark.parametrize("name", ["names_text", "addresses_text", "fold_text"])
def test_odd_texts(spark, tmp_path, name):
    places = ["us", " France ", "INDIA", None]
    rows = [(i, t, places[i % 4]) for i, t in enumerate(ODD * 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").toPandas().to_parquet(tmp_path / "documents.parquet")
    assert compare(spark, str(tmp_path), name)
