"""Blocking tokens of normalised records: ten kinds, from the words of the name and of the address."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlode.functions.names import joined, phonetic_key, words

TYPES = ("name", "phon", "pref", "addrw", "addrc", "street", "pa", "ca", "nb", "pb")


def _pairs(tokens: Column) -> Column:
    """Neighbouring words, each pair sorted."""
    both = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: joined(F.array_sort(F.array(a, b))))
    return F.when(F.size(tokens) > 1, both).otherwise(F.array().cast("array<string>"))


def _cross(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit("|"), b))))


def _whole(tokens: Column, sep: str) -> Column:
    return F.when(F.size(tokens) > 0, F.array(F.concat(F.lit("="), F.array_join(tokens, sep)))).otherwise(F.array().cast("array<string>"))


def with_tokens(records: DataFrame) -> DataFrame:
    """Adds an array column for each type."""
    digit = lambda t: t.rlike("[0-9]")
    keys = lambda c: F.transform(c, phonetic_key)
    distinct = lambda c: F.array_sort(F.array_distinct(c))
    core, alias, address = words(F.col("name_core")), words(F.col("name_alias")), words(F.col("addr_norm"))
    out = records.withColumns({"_core": core, "_alias": alias, "_addr": address}).withColumn("name", F.array_union("_core", F.filter("_alias", lambda w: ~F.array_contains("_core", w))))
    compact = F.array_join("_core", "")
    state_at = F.array_position("_addr", F.col("state"))
    plain = F.filter(F.transform("_addr", lambda t, i: F.when(~digit(t) & ((i + 1 != state_at) | (F.col("state") == "")), t)), lambda t: t.isNotNull())
    after = lambda i: F.get(F.col("_addr"), i + 1)
    street = F.filter(F.transform("_addr", lambda t, i: F.when(digit(t) & after(i).isNotNull() & ~digit(after(i)), F.concat(t, F.lit("|"), after(i)))), lambda t: t.isNotNull())
    out = out.withColumns({
        "phon": distinct(keys(F.filter("name", lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$")))),
        "pref": distinct(F.concat(F.transform(F.filter("name", lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5)), F.when(F.length(compact) >= 5, F.array(F.substring(compact, 1, 5))).otherwise(F.array().cast("array<string>")))),
        "addrw": distinct(plain), "addrc": distinct(F.filter("_addr", digit)), "street": distinct(street),
        "nb": distinct(F.concat(_whole(F.col("_core"), ""), _whole(F.col("_alias"), ""), _pairs(F.col("_core")), _pairs(F.col("_alias")))),
        "pb": distinct(F.concat(_whole(keys("_core"), " "), _whole(keys("_alias"), " "), _pairs(keys("_core")), _pairs(keys("_alias")))),
    })
    return out.withColumns({"pa": _cross(F.col("phon"), F.col("addrw")), "ca": _cross(F.col("addrc"), F.col("addrw"))}).drop("_core", "_alias", "_addr")


def key_tokens(records: DataFrame) -> DataFrame:
    """Adds `keys`, the plain blocking keys: street tokens, the first two name words sorted, the compact name."""
    core = words(F.col("name_core"))
    two = F.when(F.size(core) >= 2, F.array(F.concat(F.lit("k2:"), joined(F.array_sort(F.slice(core, 1, 2)))))).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.size(core) > 0, F.array(F.concat(F.lit("kc:"), F.array_join(core, "")))).otherwise(F.array().cast("array<string>"))
    return records.withColumn("keys", F.array_distinct(F.concat("street", two, whole)))


def explode_tokens(records: DataFrame, types: tuple[str, ...] = TYPES, carried: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, source, country, ttype, token) and the columns of `carried`, one row for each token of a record. Tokens are made
    distinct inside their record (row ids are unique), so nothing is shuffled."""

    def typed(kind: str) -> Column:
        return F.transform(F.array_distinct(kind), lambda x: F.struct(F.lit(kind).alias("ttype"), x.alias("token")))

    each = F.flatten(F.array(*map(typed, types)))
    kept = ["row_id", "source", "country", *carried]
    return records.select(*kept, F.explode(each).alias("_t")).select(*kept, "_t.ttype", "_t.token")
