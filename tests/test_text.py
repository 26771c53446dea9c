"""Names, addresses, scripts and tokens: cases of our own, and a few fixed values that pin the agreed behaviour."""

import pytest
from pyspark.sql import functions as F

from kinlode.functions import addresses, conventions, names, script, tokens


@pytest.fixture(scope="module")
def named(spark):
    def run(texts, vocab=None):
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, business_name string")
        if vocab:
            vocab = names.vocabulary(spark.createDataFrame(list(vocab.items()), "word string, c long"))
        return names.normalize_names(frame, vocab=vocab).orderBy("i").collect()

    return run


@pytest.mark.parametrize("form", sorted({"llc", "limited", "gmbh", "sarl", "incorporated", "pvtltd"}))
def test_legal_form_in_any_place_and_case(named, form):
    stem = "Quillon Marsh Bakery"
    written = [f"{stem} {form}", f"{stem} ({form.upper()})", f"{stem}  [{form.title()}]", f"{form} {stem}", f"{stem}, {'.'.join(form) if len(form) < 5 else form}."]
    rows = named(written)
    assert {r.name_core for r in rows} == {"quillon marsh bakery"} and {r.legal for r in rows} == {conventions.LEGAL_FORMS[form]}


def test_names_keep_what_tells_them_apart(named):
    want = {"Tin Drum Cinema": "tin drum cinema", "T1n Drum C1nema": "tln drum clnema", "~~ Zoë's   Kites ~~": "zoes kites", "Kites Kites Ostrava": "kites ostrava", "": "", "The Limited": "limited"}
    assert [r.name_core for r in named(list(want))] == list(want.values())


# Names in two Brahmic scripts, and words that sound alike.
SPOKEN = {"बेस्ट फूड्स": "best phuds", "ശക്തി": "shakti"}
ALIKE = [("private", "praivet", "1613"), ("limited", "limittad", "453"), ("global", "kulopal", "2414")]


def test_script(named):
    for text, latin in SPOKEN.items():
        assert script.transliterate(text) == script.fold_text(text) == latin
        assert named([text])[0].is_indic and named([text])[0].name_core == latin
    assert script.transliterate("plain é") == "plain é" and script.fold_text("Ǆ Ñandú Ｗide ﬂag") == "dz nandu wide flag"
    assert script.transliterate("क") == "k" and script.transliterate("कम") == "kam" and script.transliterate("क्म") == "km" and script.transliterate("१२") == "12"


def test_letters_have_one_sound_in_all_blocks():
    """The first consonant of each of the nine blocks, and its dotted form, by the tables."""
    for block in range(9):
        assert script.transliterate(chr(0x900 + 0x80 * block + 0x15)) == conventions.CONSONANTS[0x15]
    assert script.transliterate("\u0915\u093c") == conventions.DOTTED["k"]


def test_phonetic(spark):
    words = [w for a, b, _ in ALIKE for w in (a, b)] + ["2077", "", "eau", "echo"]
    keys = [r.k for r in spark.createDataFrame([(w,) for w in words], "w string").select(names.phonetic_key(F.col("w")).alias("k")).collect()]
    assert keys == [k for _, _, k in ALIKE for _ in range(2)] + ["2077", "", "0", "02"]


def test_alias_and_domain(named):
    for sign in ("fka", "F/K/A", "d/b/a", "aka", "formerly known as"):
        row = named([f"Ostrava Kites {sign} Canal Toys LLC"])[0]
        assert (row.name_core, row.name_alias, row.legal) == ("ostrava kites", "canal toys", "llc")
    rows = named(["tindrumcinema.com", "ostravakitesandtoyscom", "Laredo.Com", "not a domain"])
    assert [r.is_domain for r in rows] == [True, True, True, False] and [r.name_core for r in rows][::2] == ["tindrumcinema", "laredo"]


def test_segmenter(named):
    seen = {"canal": 9, "toys": 4, "ostrava": 30, "cinema": 2, "kites": 6}
    rows = named(["canaltoys", "OSTRAVAKITESGMBH", "canalquux", "ostrava cinema", "kites"], seen)
    assert [r.name_core for r in rows] == ["canal toys", "ostrava kites", "canalquux", "ostrava cinema", "kites"] and rows[1].legal == "gmbh"


def test_addresses():
    p = addresses.parse_address
    a, b = p("88 Tolver Avenue, Pemberly, OR", "US"), p("PEMBERLY, 88 TOLVER AVE, OREGON", "US")
    assert sorted(a[0].split()) == sorted(b[0].split()) and a[1] == b[1] == "or"
    for state, code in (("New Mexico", "nm"), ("nm", "nm"), ("District of Columbia", "dc")):
        assert p(f"4 Elm Court, Tolver, {state}", "US")[:2] == (f"4 elm ct tolver {code}", code)
    assert p("4 Elm Court, null, Tolver, TX", "US")[0] == "4 elm ct tolver tx" and p("", "US")[4] and not p("x", "US")[4]
    assert p("Plot 9, Orissa", "India")[1] == p("Plot 9, Odisha", "India")[1] == "od"
    assert p("3 R. du Moulin, Lille, Hauts-de-France", "France")[:2] == ("3 rue moulin lille hdf", "hdf")
    assert "rue" not in p("3 R Moulin", "India")[0].split() and p("3 Elm Road, Tolver", "Nowhere")[:2] == ("3 elm rd tolver", "")
    assert p("K070 Elm Rd, TX", "US")[3] == "k70" and p("0 Elm Rd", "US")[3] == "0"


def test_tokens(spark):
    frame = spark.createDataFrame([(1, 1, "US", "quillon marsh bakery", "tin drum", "88 tolver ave pemberly or", "or")], "row_id long, source int, country string, name_core string, name_alias string, addr_norm string, state string")
    r = tokens.with_tokens(frame).first()
    assert r.name == ["quillon", "marsh", "bakery", "tin", "drum"] and sorted(r.addrw) == ["ave", "pemberly", "tolver"] and r.addrc == ["88"] and r.street == ["88|tolver"]
    assert {"=quillonmarshbakery", "marsh quillon", "bakery marsh", "drum tin"} <= set(r.nb) and sorted(r.ca) == ["88|ave", "88|pemberly", "88|tolver"]
    assert {"quill", "marsh", "baker"} <= set(r.pref) and len(r.pa) == len(r.phon) * 3
