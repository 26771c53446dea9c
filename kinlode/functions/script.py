"""Folding of Unicode text: compatibility forms, Brahmic scripts to Latin, accents, case."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlode.functions import conventions as C

INDIC = "[ऀ-ൿ]"


_NASAL = "\x00"


def _sounds(text: str) -> list[tuple[str, str]]:
    """(kind, Latin) of each sign: consonant, matra (replaces the inherent vowel), kill (removes it), dot (changes the
    consonant before), inner (a sound inside a word), outer (the word ends before it) or join (silent)."""
    out = []
    for ch in text:
        code = ord(ch)
        place = (code - 0x900) % 0x80 if 0x900 <= code < 0xD80 else None
        if code in C.SPECIAL:
            out.append(("inner", C.SPECIAL[code]))
        elif place is None:
            out.append(("join", "") if ch in "‌‍" else ("outer", ch))
        elif place in C.CONSONANTS:
            out.append(("consonant", C.CONSONANTS[place]))
        elif place == 0x3C:
            out.append(("dot", ""))
        elif place in C.DEPENDENT:
            out.append(("matra", C.DEPENDENT[place]))
        elif place == 0x4D:
            out.append(("kill", ""))
        elif place in C.INDEPENDENT:
            out.append(("inner", C.INDEPENDENT[place]))
        elif place in (1, 2):
            out.append(("inner", _NASAL))
        elif place == 3:
            out.append(("inner", "h"))
        elif 0x66 <= place <= 0x6F:
            out.append(("outer", str(place - 0x66)))
        elif place in (0x64, 0x65):
            out.append(("outer", " "))
        else:
            out.append(("join", ""))
    return out


def transliterate(text: str) -> str:
    """Brahmic letters as Latin, the rest unchanged. The vowel inherent in a consonant is heard unless a vowel sign or a
    virama follows or the word ends."""
    if not re.search(INDIC, text):
        return text
    for old, new in C.DIGRAPHS.items():
        text = text.replace(old, new)
    out: list[str] = []
    bare = False
    for kind, latin in _sounds(text):
        if kind == "join":
            continue
        if kind == "dot":
            if out and out[-1] in C.DOTTED:
                out[-1] = C.DOTTED[out[-1]]
            continue
        if bare and kind in ("consonant", "inner"):
            out.append("a")
        if latin or kind == "inner":
            out.append(latin)
        bare = kind == "consonant"
    return re.sub(f"{_NASAL}(?=[pbm])", "m", "".join(out)).replace(_NASAL, "n")


def fold_text(text: str) -> str:
    text = transliterate(unicodedata.normalize("NFKC", text))
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(T.StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else fold_text(t), na_action="ignore")


def fold(text: Column) -> Column:
    """Lower case without accents, in Latin letters; null is empty. Plain ASCII passes the worker as it is."""
    return F.lower(_fold(F.coalesce(text, F.lit(""))))


def has_indic(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(INDIC)
