"""License scans by diagonal voting, in DataFrame functions only.

All rolling word 2-grams and 4-grams of every text are hashed and joined to the positions of a fixed list of templates (a
constant of this module, so its broadcast has a proven bound); the words behind a hash are compared after the join. A
match of text word i with template word t votes for the diagonal i - t, and votes are added up by diagonal. Two kinds of
template:

* a phrase is a declaration all of whose words decide ("cc by nc 4 0"): all its 2-grams must lie on one diagonal, which
  is its exact occurrence. A phrase that stands inside a longer one says nothing of its own and is dropped, but for base
  phrases, all of whose places count;
* a text is a passage of a license: diagonals within NEAR words of one another are merged around each diagonal, and a
  span is good where at least COVER of the template's 4-grams lie on them. Of neighbouring spans the best is taken.

Defined results: a null or empty text has no words, no places, empty labels and score 0. Rows that repeat an id and a
text come out one by one with equal values. A null id is an id like any other. An empty table gives an empty result.
Other columns are ignored.
"""

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlode.llm import common

# The phrases that label a text by themselves.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Declarations, lower case, words only; every word decides.
PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license v2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license v3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license v 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "isc license": "isc",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa": "cc-by-sa",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc": "cc-by-nc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd": "cc-by-nd",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
    "creative commons attribution 4 0": "cc-by-4.0",
    "creative commons attribution sharealike 4 0": "cc-by-sa-4.0",
    "creative commons attribution noncommercial 4 0": "cc-by-nc-4.0",
    "creative commons zero": "cc0-1.0",
}

# Passages of licenses, lower case, words only.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software": "bsl-1.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2.0",
}

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this close are merged; share of a text's 4-grams that a span needs.
NEAR, COVER = 3, 0.8
PAIR, QUAD = 2, 4
_LONGEST = max(len(x.split()) for x in (*BASE, *PHRASES))


def templates() -> list[tuple[int, str, str, int, bool, int]]:
    """(template, words, label, words of a gram, whether base, grams)."""
    out = []
    for t, (words, label, k, base) in enumerate([(x, y, PAIR, True) for x, y in BASE.items()] + [(x, y, PAIR, False) for x, y in PHRASES.items()] + [(x, y, QUAD, False) for x, y in TEXTS.items()]):
        out.append((t, words, label, k, base, len(words.split()) - k + 1))
    return out


def _pair_hashes(words: str) -> Column:
    return F.transform(words, lambda w, i: F.xxhash64(w, F.get(F.col(words), i + 1)))


def _quad_hashes(pairs: str) -> Column:
    """A 4-gram's hash is that of its two halves' hashes."""
    return F.transform(pairs, lambda h, i: F.xxhash64(h, F.get(F.col(pairs), i + 2)))


def _grams(spark: SparkSession) -> DataFrame:
    """(tid, label, k, base, t_grams, t_pos, t_gram, t_hash) for each gram of each template, and a row with tid -1 for hash 0
    that a text's own row meets."""
    values = ", ".join(f"({t}, '{words}', '{label}', {k}, {str(base).lower()}, {n})" for t, words, label, k, base, n in templates())
    rows = spark.sql(f"SELECT tid, label, k, base, t_grams, split(words, ' ') AS words FROM VALUES {values} AS t(tid, words, label, k, base, t_grams)")
    rows = rows.withColumn("pairs", _pair_hashes("words")).withColumn("hashes", F.when(F.col("k") == PAIR, F.col("pairs")).otherwise(_quad_hashes("pairs")))
    grams = rows.select("tid", "label", "k", "base", "t_grams", "words", F.posexplode("hashes").alias("t_pos", "t_hash")).filter("t_pos < t_grams")
    grams = grams.select("tid", "label", "k", "base", "t_grams", "t_pos", F.array_join(F.slice("words", F.col("t_pos") + 1, F.col("k")), " ").alias("t_gram"), "t_hash")
    own = spark.sql("SELECT -1 AS tid, '' AS label, 0 AS k, false AS base, 0 AS t_grams, 0 AS t_pos, '' AS t_gram, 0L AS t_hash")
    return grams.unionByName(own)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), SEPARATORS), "")


def _votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Votes by diagonal, and for each row of docs one row of template -1 that carries its words and its count."""
    rows = docs.select(F.col(id_col).alias("doc_id"), common.content_key(id_col, text_col).alias("tkey"), words_of(common.whole(text_col)).alias("words"))
    rows = rows.withColumn("pairs", _pair_hashes("words")).withColumn("quads", _quad_hashes("pairs"))
    rolled = rows.select("doc_id", "tkey", "words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "pairs", "quads")).alias("at", "hash"))
    hits = rolled.join(F.broadcast(_grams(docs.sparkSession)), F.col("hash") == F.col("t_hash"))
    n = F.size("words")
    hits = hits.withColumn("word", F.when(F.col("k") == QUAD, F.col("at") - 1 - n).otherwise(F.col("at") - 1))
    same = (F.col("word") >= 0) & (F.array_join(F.slice("words", F.greatest(F.col("word"), F.lit(0)) + 1, F.greatest("k", F.lit(1))), " ") == F.col("t_gram"))
    hits = hits.filter(F.when(F.col("tid") < 0, F.col("at") == 0).otherwise(same))
    hits = hits.select("doc_id", "tkey", "tid", "label", "k", "base", "t_grams", "t_pos", "word", n.alias("n_words"))
    # the only exchange of the scan: everything below is grouped within a document
    hits = hits.repartition(common.partitions(docs.sparkSession), "doc_id", "tkey")
    return hits.withColumn("diagonal", F.col("word") - F.col("t_pos")).groupBy("doc_id", "tkey", "tid", "diagonal").agg(
        *(F.first(c).alias(c) for c in ("label", "k", "base", "t_grams")), F.max("n_words").alias("n_words"), F.count(F.when(F.col("tid") < 0, 1)).alias("copies"),
        F.collect_set("t_pos").alias("seen"), F.min("word").alias("start"), (F.max("word") + F.max("k") - 1).alias("end"))


def _spans(votes: DataFrame) -> DataFrame:
    """(doc_id, tkey, label, base, place, start, end, coverage, n_words, copies): good spans and the rows of the texts
    themselves, whose label is null."""
    line = Window.partitionBy("doc_id", "tkey", "tid").orderBy("diagonal")
    near = line.rangeBetween(-NEAR, NEAR)
    text = F.col("k") == QUAD
    merged = votes.withColumn("votes", F.size(F.when(text, F.array_distinct(F.flatten(F.collect_list("seen").over(near)))).otherwise(F.col("seen"))))
    merged = merged.withColumns({"start": F.when(text, F.min("start").over(near)).otherwise(F.col("start")), "end": F.when(text, F.max("end").over(near)).otherwise(F.col("end"))})
    best = F.max(F.struct("votes", -F.col("diagonal"))).over(near)
    merged = merged.withColumn("best", ~text | (best == F.struct("votes", -F.col("diagonal"))))
    coverage = F.col("votes") / F.greatest("t_grams", F.lit(1))
    good = F.when(text, (coverage >= COVER) & F.col("best")).otherwise(F.col("votes") == F.col("t_grams"))
    spans = merged.withColumn("coverage", coverage).filter((F.col("tid") < 0) | good)
    # a phrase inside a longer one; both are at most _LONGEST words long, so few can stand close enough
    around = Window.partitionBy("doc_id", "tkey").orderBy("start").rangeBetween(-_LONGEST, _LONGEST)
    phrase = (F.col("k") == PAIR) & ~F.col("base")
    others = F.collect_set(F.when(phrase, F.struct("start", "end"))).over(around)
    inside = F.exists(others, lambda o: (o["start"] <= F.col("start")) & (o["end"] >= F.col("end")) & (o["end"] - o["start"] > F.col("end") - F.col("start")))
    spans = spans.withColumn("inside", phrase & inside).filter("not inside")
    return spans.select("doc_id", "tkey", F.when(F.col("tid") >= 0, F.col("label")).alias("label"), "base", F.when(F.col("base"), F.col("start")).alias("place"), "start", "end", "coverage", "n_words", "copies")


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, base, start, end, coverage): every verified span, words from 0, end included; once for rows that
    repeat an id and a text."""
    return _spans(_votes(docs, id_col, text_col)).filter("label is not null").select("doc_id", "label", "base", "start", "end", "coverage")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row. score is the largest
    share of a template found in a good span."""
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = _spans(_votes(docs, id_col, text_col)).groupBy("doc_id", "tkey").agg(
        F.max(F.when(F.col("label").isNull(), F.col("n_words"))).cast("long").alias("n_words"), F.sum("copies").alias("copies"), F.count("place").alias("n_base"), F.min("place").cast("long").alias("first_word"), F.max("place").cast("long").alias("last_word"),
        labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("coverage"))), F.lit(0.0)).alias("score"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("tkey", "copies", "copy")


def scan_sql() -> str:
    """The same result in DuckDB SQL over a table `documents`: phrases by comparing words at each place of their first word,
    texts by 4-grams written out."""
    values = ", ".join(f"({t}, string_split('{words}', ' '), '{label}', {k}, {str(base).lower()}, {n})" for t, words, label, k, base, n in templates())
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
WITH t(tid, tw, label, k, base, t_grams) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
p AS (SELECT rid, tid, label, base, i - 1 AS start, i + len(tw) - 2 AS "end" FROM w JOIN t ON w = tw[1] AND k = {PAIR} JOIN d USING (rid) WHERE words[i:i + len(tw) - 1] = tw),
ph AS (SELECT rid, label, base, start, 1.0 AS coverage FROM p WHERE base OR NOT EXISTS (SELECT 1 FROM p o WHERE o.rid = p.rid AND NOT o.base AND o.start <= p.start AND o."end" >= p."end" AND o."end" - o.start > p."end" - p.start)),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER l || ' ' || lead(w, 2) OVER l || ' ' || lead(w, 3) OVER l AS gram FROM w WINDOW l AS (PARTITION BY rid ORDER BY i)),
tg AS (SELECT tid, label, t_grams, j, array_to_string(tw[j:j + 3], ' ') AS gram FROM (SELECT *, unnest(range(1, t_grams + 1)) AS j FROM t WHERE k = {QUAD})),
v AS (SELECT rid, tid, label, t_grams, i - j AS diagonal, list(DISTINCT j) AS seen FROM g JOIN tg USING (gram) GROUP BY ALL),
m AS (SELECT rid, label, len(list_distinct(flatten(list(seen) OVER (PARTITION BY rid, tid ORDER BY diagonal RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING)))) / t_grams AS coverage FROM v),
a AS (SELECT rid, label, base, start, coverage FROM ph UNION ALL SELECT rid, label, false, NULL, coverage FROM m WHERE coverage >= {COVER}),
f AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM a GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (rid)
"""
