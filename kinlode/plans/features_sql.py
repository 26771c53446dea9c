"""DuckDB SQL of the string similarities, the 54 pair features and the neighbour features. A similarity is a step (a, b, v) over
the distinct pairs of a select of (a, b); pairs with a null have no row. Strings may have up to 126 letters."""

from kinlode.operators.features import IDF_TYPES

_FULL = "((1::HUGEINT << length({a})::INT) - 1)"
_STEP = "lambda acc, hit: ((acc + (acc & hit)) | (acc - (acc & hit))) & every"


def _places(a: str, b: str, pairs: str) -> str:
    """Distinct pairs with, for each letter of b, the bits of its places in a, and the bits of all places of a."""
    at = f"map_from_entries(list_transform(list_distinct(string_split({a}, '')), lambda c: {{'k': c, 'v': list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))}}))"
    return f"SELECT *, CASE WHEN {b} = '' THEN [] ELSE list_transform(string_split({b}, ''), lambda c: coalesce(spots[c], 0::HUGEINT)) END AS ms FROM (SELECT *, {at} AS spots, {_FULL.format(a=a)} AS every FROM ({pairs}))"


def _common(a: str, masks: str) -> str:
    return f"(length({a}) - bit_count(list_reduce(list_prepend(every, {masks}), {_STEP})))"


def _distinct(pairs: str) -> str:
    return f"SELECT DISTINCT a, b FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL"


def ratio(name: str, pairs: str) -> str:
    return f"{name} AS (SELECT a, b, CASE WHEN a = '' AND b = '' THEN 100 ELSE 200::DOUBLE * {_common('a', 'ms')} / (length(a) + length(b)) END AS v FROM ({_places('a', 'b', _distinct(pairs))}))"


def token_sort(name: str, pairs: str) -> str:
    line = lambda x: f"coalesce(array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda w: w <> '')), ' '), '')"
    return f"""{name}_s AS (SELECT *, {line("a")} AS x, {line("b")} AS y FROM ({_distinct(pairs)})), {ratio(f"{name}_r", f"SELECT x AS a, y AS b FROM {name}_s")},
    {name} AS (SELECT s.a, s.b, v FROM {name}_s s JOIN {name}_r t ON t.a = x AND t.b = y)"""


def token_set(name: str, pairs: str) -> str:
    """The common words are the head of both lines, so a line's ratio with them needs their lengths alone."""
    words = lambda x: f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '')))"
    less = lambda s, t: f"list_filter({s}, lambda w: NOT list_contains({t}, w))"
    line = lambda rest: f"array_to_string(list_concat(same, {rest}), ' ')"
    head = lambda x: f"200::DOUBLE * length(h) / (length(h) + length({x}))"
    return f"""{name}_w AS (SELECT a, b, {words("a")} AS x, {words("b")} AS y FROM ({_distinct(pairs)})),
    {name}_p AS (SELECT *, list_filter(x, lambda w: list_contains(y, w)) AS same, {less("x", "y")} AS l, {less("y", "x")} AS r FROM {name}_w),
    {name}_l AS (SELECT *, coalesce(array_to_string(same, ' '), '') AS h, {line("l")} AS one, {line("r")} AS two FROM {name}_p), {ratio(f"{name}_r", f"SELECT one AS a, two AS b FROM {name}_l")},
    {name} AS (SELECT s.a, s.b, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN len(same) > 0 AND (len(l) = 0 OR len(r) = 0) THEN 100 WHEN len(same) = 0 THEN v ELSE greatest(v, {head("one")}, {head("two")}) END AS v FROM {name}_l s LEFT JOIN {name}_r t ON t.a = one AND t.b = two)"""


def partial(name: str, pairs: str) -> str:
    """Every window of the longer string, those over its ends too."""
    least, most = "greatest(i, 0)", "least(i + length(s), length(l))"
    window = f"200::DOUBLE * {_common('s', f'ms[{least} + 1 : {most}]')} / (length(s) + {most} - {least})"
    sided = f"SELECT *, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM ({_distinct(pairs)})"
    return f"{name} AS (SELECT a, b, CASE WHEN s = '' THEN CASE WHEN l = '' THEN 100 ELSE 0 END WHEN contains(l, s) THEN 100 ELSE list_max(list_transform(range(1 - length(s), length(l)), lambda i: {window})) END AS v FROM ({_places('s', 'l', sided)}))"


def jaro_winkler(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE 100 * jaro_winkler_similarity({a}, {b}) END"


#: Names and addresses of both sides of candidate pairs; an empty address of the right side is unknown.
SIDES = """f AS (SELECT c.*, a.name AS qw, b.name AS rw, array_to_string(a.name, ' ') AS qn, array_to_string(b.name, ' ') AS rn, array_to_string(a.name, '') AS qc, array_to_string(b.name, '') AS rc, array_to_string(a.keys, ' ') AS qp, array_to_string(b.keys, ' ') AS rp,
    array_to_string(a.addr, ' ') AS qa, CASE WHEN NOT b.addr_empty THEN array_to_string(b.addr, ' ') END AS ra, a.nums AS qm, b.nums AS rm, b.source AS r_source, b.addr_empty AS r_empty FROM cands c JOIN lists a ON c.q = a.row_id JOIN lists b ON c.r = b.row_id)"""


def _joined(steps: dict[str, tuple]) -> tuple[str, str, str]:
    """Steps, columns and joins of similarities (function, left column, right column) over f."""
    made = ", ".join(make(f"s_{name}", f"SELECT {x} AS a, {y} AS b FROM f") for name, (make, x, y) in steps.items())
    joins = " ".join(f"LEFT JOIN s_{name} ON s_{name}.a = {x} AND s_{name}.b = {y}" for name, (_, x, y) in steps.items())
    return made, ", ".join(f"round(s_{name}.v, 6) AS {name}" for name in steps), joins


def ratio_family(chain: str) -> str:
    made, columns, joins = _joined({"ratio": (ratio, "qn", "rn"), "token_sort": (token_sort, "qn", "rn"), "token_set": (token_set, "qn", "rn"), "partial": (partial, "qn", "rn"), "addr_token_set": (token_set, "qa", "coalesce(ra, '')")})
    return f"{chain}, {SIDES}, {made} SELECT q, r, {columns} FROM f {joins}"


def pair_features(chain: str, numbers: list[str]) -> str:
    """The row of 54 features and the rule score; numbers: the eight columns over a.nums and b.nums."""
    made, columns, joins = _joined({
        "n_ratio": (ratio, "qn", "rn"), "n_tsort": (token_sort, "qn", "rn"), "n_tset": (token_set, "qn", "rn"), "n_partial": (partial, "qn", "rn"), "n_compact_ratio": (ratio, "qc", "rc"), "n_compact_partial": (partial, "qc", "rc"),
        "n_phon_ratio": (ratio, "qp", "rp"), "a_ratio": (ratio, "qa", "ra"), "a_tsort": (token_sort, "qa", "ra"), "a_tset": (token_set, "qa", "ra"),
    })
    lists = ", ".join(f"coalesce(list({{'token': token, 'idf': idf}}) FILTER (WHERE ttype = '{t}'), []) AS w_{t}" for t in IDF_TYPES)
    total, top = (lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: t.idf)), 0)"), (lambda x: f"round(coalesce(list_max(list_transform({x}, lambda t: t.idf)), 0), 6)")
    both, less = (lambda t: f"list_filter(x.w_{t}, lambda w: list_contains(y.w_{t}, w))"), (lambda t, s, o: f"list_filter({s}.w_{t}, lambda w: NOT list_contains({o}.w_{t}, w))")
    part = lambda t, s: f"CASE WHEN {total(f'{s}.w_{t}')} > 0 THEN round({total(both(t))} / {total(f'{s}.w_{t}')}, 6) END"
    idf = {
        "n_idf_shared": f"round({total(both('name'))}, 6)", "n_idf_frac_q": part("name", "x"), "n_idf_frac_r": part("name", "y"), "n_idf_max_shared": top(both("name")), "n_idf_miss_q": top(less("name", "x", "y")), "n_idf_miss_r": top(less("name", "y", "x")),
        "p_idf_frac_q": part("phon", "x"), "p_idf_frac_r": part("phon", "y"), "a_idf_frac_q": part("addrw", "x"), "a_idf_frac_r": part("addrw", "y"), "a_idf_miss_q": top(less("addrw", "x", "y")),
        "c_idf_frac_q": part("addrc", "x"), "c_idf_frac_r": part("addrc", "y"), "street_shared": f"round({total(both('street'))}, 6)",
    }
    share = lambda w: f"CASE WHEN max(score) OVER {w} > 0 THEN score / max(score) OVER {w} ELSE 0 END"
    return f"""{chain}, {SIDES}, {made}, n AS (SELECT country, count(*) AS n FROM rec GROUP BY country), fi AS (SELECT country, ttype, token, ln((any_value(n) + 1) / count(*)) AS idf FROM tok JOIN n USING (country) WHERE ttype IN {IDF_TYPES} GROUP BY ALL),
    wt AS (SELECT row_id, {lists} FROM lists LEFT JOIN (SELECT row_id, ttype, token, idf FROM tok JOIN fi USING (country, ttype, token)) USING (row_id) GROUP BY row_id),
    g AS (SELECT q, r, {share("qs")} AS blk_frac_qmax, count(*) OVER rs AS r_ncand, row_number() OVER (PARTITION BY r ORDER BY score DESC, q) - 1 AS r_rank, {share("rs")} AS blk_frac_rmax FROM cands WINDOW qs AS (PARTITION BY q), rs AS (PARTITION BY r)),
    k AS (SELECT q, r, CASE WHEN r_code IS NOT NULL THEN count(*) OVER (PARTITION BY q, r_code) - 1 END AS code_support, sum(CASE WHEN r_code = q_code THEN 1 ELSE 0 END) OVER (PARTITION BY q)::BIGINT AS code_support_s1, CASE WHEN r_name IS NOT NULL THEN count(*) OVER (PARTITION BY q, r_name) - 1 END AS name_support FROM keyed),
    m AS (SELECT c.q, c.r, {", ".join(numbers)} FROM cands c JOIN cut a ON c.q = a.row_id JOIN cut b ON c.r = b.row_id),
    t AS (SELECT q, r, {columns}, round(s_n_ratio.v, 6) AS n_full_ratio, round({jaro_winkler("qn", "rn")}, 6) AS n_jw, NULL::DOUBLE AS n_alias_tset, (qn <> '' AND qw[1] IS NOT DISTINCT FROM rw[1])::INT::DOUBLE AS n_first_eq, len(qw) AS n_tok_q, len(rw) AS n_tok_r, 0::BIGINT AS legal_rel, 0::DOUBLE AS r_has_alias, NULL::DOUBLE AS state_eq,
      {", ".join(f"{v} AS {n}" for n, v in idf.items())}, m.* EXCLUDE (q, r), 0::DOUBLE AS r_is_domain, 0::DOUBLE AS r_is_indic, r_empty::INT::DOUBLE AS r_addr_empty, r_source::DOUBLE AS r_source,
      round(score, 6) AS blk_score, rank AS blk_rank, round(blk_frac_qmax, 6) AS blk_frac_qmax, r_ncand, r_rank, round(blk_frac_rmax, 6) AS blk_frac_rmax, code_support, code_support_s1, name_support,
      round(0.55 * s_n_tset.v / 100 + 0.30 * CASE WHEN r_empty THEN 50 ELSE s_a_tset.v END / 100 + 0.15 * coalesce(code_first_eq, 0.5), 6) AS p
      FROM f {joins} JOIN g USING (q, r) JOIN k USING (q, r) JOIN m USING (q, r) JOIN wt x ON x.row_id = q JOIN wt y ON y.row_id = r) SELECT * FROM t"""


def neighbours(chain: str, pairs: str) -> str:
    """Similarities of a record with its two neighbours; pairs: a select of (q, r, p, n1, p1n, n2, p2n). Nine digits, as a ratio
    times a rounded probability may end on a 5 in the seventh."""
    name, address = "array_to_string({}.name, ' ')", "CASE WHEN NOT {0}.addr_empty THEN array_to_string({0}.addr, ' ') END"
    made = ", ".join(token_set(f"s_{k}", f"SELECT {x} AS a, {y} AS b FROM w") for k, x, y in (("one", "rn", "n1n"), ("two", "rn", "n2n"), ("at", "ra", "n1a")))
    return f"""{chain}, e AS ({pairs}), w AS (SELECT e.*, {name.format("a")} AS rn, {name.format("b")} AS n1n, {name.format("c")} AS n2n, {address.format("a")} AS ra, {address.format("b")} AS n1a FROM e JOIN cut a ON a.row_id = e.r LEFT JOIN cut b ON b.row_id = n1 LEFT JOIN cut c ON c.row_id = n2), {made}
    SELECT q, r, round(s_one.v, 9) AS nb1_name, p1n AS nb1_p, round(s_two.v, 9) AS nb2_name, p2n AS nb2_p, round(s_at.v, 9) AS nb1_addr, round(greatest(coalesce(s_one.v * p1n, 0), coalesce(s_two.v * p2n, 0)), 9) AS nb_name_max_w
    FROM w LEFT JOIN s_one ON s_one.a = rn AND s_one.b = n1n LEFT JOIN s_two ON s_two.a = rn AND s_two.b = n2n LEFT JOIN s_at ON s_at.a = ra AND s_at.b = n1a"""
