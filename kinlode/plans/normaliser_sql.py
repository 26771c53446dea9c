"""DuckDB SQL of the normaliser: folded text, names, addresses, run-together names. Folding in SQL strips accents; compatibility
forms and Brahmic letters, which the documents don't have, are held by the cases of tests/test_text.py."""

from kinlode.functions import addresses, names
from kinlode.functions import conventions as C

_SPACE = r"[\x09-\x0D ]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_text, items)) + "]"


def _map(table: dict[str, str]) -> str:
    return f"MAP({_list(table)}, {_list(table.values())})"


def _joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


def _first_of_each(x: str) -> str:
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def fold(x: str) -> str:
    return f"lower(strip_accents(coalesce({x}, '')))"


def _undot(x: str) -> str:
    """Dotted runs are put between two marks; then dots between letters go, at most five. Spaces are doubled, as a run takes
    the sign before it and the sign after it along."""
    x = rf"regexp_replace(replace({x}, ' ', '  '), '(^|[^a-z0-9])((?:[a-z]\.){{1,5}}[a-z])\.?([^a-z0-9]|$)', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    for _ in range(5):
        x = rf"regexp_replace({x}, '(\x01[a-z]+)\.([a-z.]*\x02)', '\1\2', 'g')"
    return f"translate({x}, chr(1) || chr(2), '')"


def _name_tokens(x: str) -> str:
    x = _undot(f"regexp_replace(replace(replace({x}, '&', ' and '), '+', ' and '), '#{_SPACE}*[0-9]+', ' ', 'g')")
    x = f"regexp_replace(replace(translate({x}, {_text(chr(39) + '’`')}, ''), 'm/s', ' '), '[^a-z0-9]+', ' ', 'g')"
    x = f"list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]{{4,}}'))"
    return f"list_transform({x}, lambda w: CASE WHEN regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]') THEN translate(w, '{C.LEET[0]}', '{C.LEET[1]}') ELSE w END)"


def _core(x: str) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({_list([*C.LEGAL_FORMS, *C.NAME_STOP])}, w))"


def name_tokens(source: str, name: str = "n") -> str:
    """Steps up to tokens and other (those of a trade name) of source (row_id, business_name)."""
    return rf"""{name}_t AS (SELECT row_id, business_name, trim(regexp_replace({fold("business_name")}, '{_SPACE}+', ' ', 'g')) AS t FROM ({source})),
    {name}_d AS (SELECT *, regexp_matches(t, '{names.DOMAIN}') AS a, regexp_matches(t, '{names.BARE_COM}') AS b FROM {name}_t),
    {name}_w AS (SELECT row_id, business_name, a OR b AS is_domain, ' ' || CASE WHEN a THEN translate(regexp_extract(t, '{names.DOMAIN}', 1), '.-', '  ') WHEN b THEN regexp_extract(t, '{names.BARE_COM}', 1) ELSE t END || ' ' AS t FROM {name}_d),
    {name}_p AS (SELECT *, regexp_matches(t, '{names.ALIAS}') AS two FROM {name}_w),
    {name}_k AS (SELECT *, {_name_tokens(f"CASE WHEN two THEN regexp_extract(t, '(?s)^(.*?){names.ALIAS}', 1) ELSE t END")} AS tk, {_name_tokens(f"CASE WHEN two THEN regexp_extract(t, '(?s)^.*?{names.ALIAS}(.*)$', 1) ELSE '' END")} AS ok FROM {name}_p),
    {name}_tokens AS (SELECT row_id, business_name, is_domain, {_first_of_each("tk")} AS tokens, {_first_of_each("ok")} AS other FROM {name}_k)"""


def name_columns(tokens: str, name: str = "n") -> str:
    """The step {name}: the columns of a name from a step with tokens and other."""
    forms = _map(C.LEGAL_FORMS)
    legal = f"list_filter(list_transform(list_concat(tokens, other), lambda w: {forms}[w]), lambda w: w IS NOT NULL)"
    plain = f"list_filter(tokens, lambda w: NOT list_contains({_list(C.NAME_STOP)}, w))"
    return f"""{name} AS (SELECT row_id, business_name, {_joined(f"list_transform(tokens, lambda w: coalesce({forms}[w], w))")} AS name_full,
    {_joined(f"CASE WHEN len({_core('tokens')}) > 0 THEN {_core('tokens')} WHEN len({plain}) > 0 THEN {plain} ELSE tokens END")} AS name_core, {_joined(_core("other"))} AS name_alias,
    {_joined(f"list_sort(list_distinct({legal}))")} AS legal, is_domain, regexp_matches(coalesce(business_name, ''), '[ऀ-ൿ]') AS is_indic FROM {tokens})"""


def names_of(source: str) -> str:
    """All columns of names for a select of (row_id, business_name), as common table expressions; the last is n."""
    return name_tokens(source) + ", " + name_columns("n_tokens")


def segmented(known: str, glued: str) -> str:
    """Run-together names of `glued` split by the words of the names of `known`. Cuts grow by a word a step; of the cuts of
    a beginning the most probable goes on, among equals that with the longest last word."""
    return f"""{name_tokens(known, "v")}, {name_columns("v_tokens", "v")}, {name_tokens(glued, "g")},
    counts AS (SELECT word, count(*) AS c FROM (SELECT unnest(string_split(name_core || ' ' || name_full, ' ')) AS word FROM v) WHERE word <> '' GROUP BY word), total AS (SELECT sum(c) AS t FROM counts),
    seen AS (SELECT word, ln(c / t) AS logp FROM counts, total WHERE c >= 2 AND regexp_full_match(word, '[a-z]{{2,}}')),
    vocab AS (SELECT * FROM seen UNION ALL SELECT word, ln(1 / t) FROM (SELECT unnest({_list(C.LEGAL_FORMS)}) AS word), total WHERE word NOT IN (SELECT word FROM seen)),
    todo AS (SELECT DISTINCT tokens[1] AS token FROM g_tokens WHERE len(tokens) = 1 AND regexp_full_match(tokens[1], '[a-z]{{{names.LEAST_SPLIT},}}') AND tokens[1] NOT IN (SELECT word FROM vocab)),
    piece AS (SELECT token, i AS start, l AS size, word, logp FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM todo), range(1, {names.MAX_WORD + 1}) AS s(l), vocab WHERE i + l <= length(token) + 1 AND word = substr(token, i, l)),
    cut AS (WITH RECURSIVE c(token, upto, value, pieces, sizes) AS (SELECT token, 1::BIGINT, 0::DOUBLE, []::VARCHAR[], []::BIGINT[] FROM todo UNION ALL
      SELECT token, upto, value, pieces, sizes FROM (SELECT p.token, p.start + p.size AS upto, c.value + p.logp AS value, list_append(c.pieces, p.word) AS pieces, list_prepend(p.size, c.sizes) AS sizes FROM c JOIN piece p ON p.token = c.token AND p.start = c.upto)
      QUALIFY row_number() OVER (PARTITION BY token, upto ORDER BY value DESC, sizes DESC) = 1) SELECT * FROM c),
    best AS (SELECT token, pieces FROM cut WHERE upto = length(token) + 1 QUALIFY row_number() OVER (PARTITION BY token ORDER BY value DESC, sizes DESC) = 1),
    s_tokens AS (SELECT row_id, business_name, is_domain, coalesce({_first_of_each("pieces")}, tokens) AS tokens, other FROM g_tokens LEFT JOIN best ON len(tokens) = 1 AND tokens[1] = token), {name_columns("s_tokens")}"""


def addresses_of(source: str) -> str:
    """All columns of addresses for a select of (row_id, business_address, country); the last step is a."""
    text = fold("business_address")
    for pattern, new in addresses.BEFORE:
        text = f"regexp_replace({text}, {_text(pattern)}, {_text(new)}, 'g')"
    digit = "regexp_matches(k, '[0-9]')"
    zeros = lambda x: rf"regexp_replace({x}, '(^|[^0-9])0+([0-9])', '\1\2', 'g')"
    code = zeros("CASE WHEN regexp_full_match(k, '[0-9]+(st|nd|rd|th)') THEN regexp_extract(k, '[0-9]+') ELSE regexp_replace(k, '[-/.]', '', 'g') END")
    raw = "list_filter(string_split_regex(replace(k, '.', ''), '[-/]'), lambda w: w <> '')"
    local = " ".join(f"WHEN {_text(where)} THEN {_map(table)}[w]" for where, table in C.COUNTRY_WORDS.items())
    word = f"coalesce(CASE place {local} END, {_map(C.ADDRESS_WORDS)}[w], w)"
    known = f"list_filter(list_transform(list_filter({raw}, lambda w: NOT list_contains({_list(sorted(C.ADDRESS_STOP))}, w)), lambda w: {word}), lambda w: w <> '')"
    states = _map({f"{where}|{name}": short for where, table in C.STATES.items() for name, short in table.items()})
    return f"""a_k AS (SELECT row_id, trim(lower(coalesce(country, ''))) AS place, list_transform(string_split({text}, ','), lambda part: regexp_extract_all(part, {_text(addresses.TOKEN.pattern)})) AS parts FROM ({source})),
    a_p AS (SELECT row_id, place, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM a_k),
    a_c AS (SELECT row_id, i, place, list_transform(list_filter(p, lambda k: {digit}), lambda k: {code}) AS codes,
      flatten(list_transform(list_filter(p, lambda k: {digit}), lambda k: list_transform(regexp_extract_all(k, '[0-9]+'), lambda d: {zeros("d")}))) AS nums,
      flatten(list_transform(list_filter(p, lambda k: NOT {digit}), lambda k: {raw})) AS raw, flatten(list_transform(p, lambda k: CASE WHEN {digit} THEN [{code}] ELSE {known} END)) AS norm FROM a_p),
    a_s AS (SELECT *, CASE WHEN len(codes) = 0 THEN {states}[place || '|' || array_to_string(raw, ' ')] END AS state FROM a_c),
    a_f AS (SELECT *, min(CASE WHEN state IS NOT NULL THEN i END) OVER (PARTITION BY row_id) AS found FROM a_s),
    a_l AS (SELECT row_id, flatten(list(CASE WHEN i = found THEN [state] ELSE norm END ORDER BY i)) AS norm, coalesce(max(CASE WHEN i = found THEN state END), '') AS state, flatten(list(nums ORDER BY i)) AS nums, flatten(list(codes ORDER BY i)) AS codes FROM a_f GROUP BY row_id),
    a AS (SELECT row_id, {_joined("norm")} AS addr_norm, state, {_joined("nums")} AS nums, {_joined("codes")} AS codes, len(norm) = 0 AS addr_empty FROM a_l)"""
