"""Postal addresses by comma component: canonical words, numbers, unit codes and the state."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlode.functions import conventions as C
from kinlode.functions.script import fold_text

# Patterns of addresses, in the order in which they apply.
BEFORE = [(r"<\s*null\s*>|\bnull\b|\bn\s*/\s*a\b|\bnone\b", " "), (r"\bp\s*\.?\s*o\s*\.?\s*box\b|\bpob\b", " pobox "), (r"\b([a-z]{1,5})\s*\.\s*no\b\.?", r"\1 "), (r"\bno\.|n°|#", " ")]
TOKEN = re.compile(r"[a-z0-9]+(?:[-/.][a-z0-9]+)*")
ORDINAL = re.compile(r"(\d+)(?:st|nd|rd|th)")
_BEFORE = [(re.compile(p), r) for p, r in BEFORE]
_ZEROS, _PUNCT = re.compile(r"(?<!\d)0+(?=\d)"), re.compile(r"[-/.]")
SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in ("addr_norm", "state", "nums", "codes")), T.StructField("addr_empty", T.BooleanType())])


class _Component:
    def __init__(self, text: str, words: dict[str, str]):
        self.norm, self.nums, self.codes, self.raw = [], [], [], []
        for token in TOKEN.findall(text):
            ordinal = ORDINAL.fullmatch(token)
            if ordinal or any(map(str.isdigit, token)):
                plain = ordinal[1] if ordinal else _PUNCT.sub("", token)
                code = _ZEROS.sub("", plain)
                self.codes.append(code)
                self.norm.append(code)
                self.nums += [_ZEROS.sub("", d) for d in re.findall(r"\d+", token)]
                continue
            for word in re.split("[-/]", token.replace(".", "")):
                if word:
                    self.raw.append(word)
                    if word not in C.ADDRESS_STOP and (canonical := words.get(word, word)):
                        self.norm.append(canonical)


def parse_address(raw: str | None, country: str | None) -> tuple[str, str, str, str, bool]:
    """(norm, state, nums, codes, empty). The first component that is a state as a whole and has no number gives the state
    and is replaced by its code."""
    text = fold_text(raw or "")
    for pattern, new in _BEFORE:
        text = pattern.sub(new, text)
    where = (country or "").strip().lower()
    words, states = C.ADDRESS_WORDS | C.COUNTRY_WORDS.get(where, {}), C.STATES.get(where, {})
    norm, nums, codes, state = [], [], [], ""
    for part in (_Component(x, words) for x in text.split(",")):
        nums += part.nums
        codes += part.codes
        found = "" if state or part.codes else states.get(" ".join(part.raw), "")
        norm += [found] if found else part.norm
        state = state or found
    return " ".join(norm), state, " ".join(nums), " ".join(codes), not norm


@F.pandas_udf(SCHEMA)
def _parse(raw: pd.Series, country: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_address(a, c) for a, c in zip(raw, country, strict=True)], columns=SCHEMA.names)


def normalize_addresses(df: DataFrame, column: str = "business_address", country: str = "country") -> DataFrame:
    """Adds addr_norm, state, nums, codes, addr_empty."""
    return df.withColumn("_a", _parse(F.coalesce(F.col(column), F.lit("")), F.coalesce(F.col(country), F.lit("")))).select("*", "_a.*").drop("_a")
