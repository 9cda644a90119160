"""Expressions that the queries' DuckDB SQL is put together from."""

from __future__ import annotations

from ..functions import values
from ..functions.phonetic import CODES
from ..functions.text import WS, WS_IN_LINE
from ..operators.matching import DIGIT_LETTERS


def quoted(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def rx(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"


def strip(c: str) -> str:
    return rx(c, rf"\A[{WS}]+|[{WS}]+\z")


def collapse(c: str) -> str:
    return f"trim({rx(c, f'[{WS}]+', ' ')})"


def tokens(c: str) -> str:
    return f"list_filter(string_split({collapse(c)}, ' '), lambda t: t <> '')"


def normal_form(c: str) -> str:
    return f"trim({rx(rx(collapse(c), r'\A[^A-Za-z]+'), r'[^A-Za-z.)]+\z')})"


def soundex(c: str) -> str:
    letters = f"upper({rx(c, '[^A-Za-z]')})"
    coded = f"translate({letters}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{CODES}')"
    for k in range(7):
        coded = rx(coded, f"{k}+", str(k))
    rest = f"replace(substring({coded}, 2), '0', '')"
    return f"CASE WHEN {letters} = '' THEN '0000' ELSE substring(rpad(substring({letters}, 1, 1) || {rest}, 4, '0'), 1, 4) END"


def person_words(c: str) -> str:
    return tokens(rx(f"translate(lower({c}), '0123456789', '{DIGIT_LETTERS}')", r"[^a-z\s'\-]"))


def place_form(c: str) -> str:
    bare = rx(rx(c, rf"[{WS}]*\([^)]+\)"), r"\A(?i:a |an |the )")
    return collapse(rx(f"translate(lower(trim({bare})), '0123456789', '{DIGIT_LETTERS}')", rf"[^a-z0-9{WS}'.\-]", " "))


def place_keys(norm: str) -> str:
    w = f"string_split({norm}, ' ')"
    a, b = (f"upper(substring({norm}, 1, 1)) || '_' || ({soundex(f'({w})[{k}]')})" for k in (1, 2))
    return f"CASE WHEN {norm} = '' THEN ['X_0000'] WHEN len({w}) >= 3 THEN list_distinct([{a}, {b}]) ELSE [{a}] END"


def reconciled(source: str, norm: str, keys: str, least_words: int, word: int, near: str = "true") -> str:
    """CTEs from source (idx, name, a, b: dates, and more) to edges and clustered; near is asked of close pairs further."""
    return f"""
        rows AS MATERIALIZED (SELECT * FROM {source}), normed AS MATERIALIZED (SELECT *, {norm} AS norm FROM rows), blocked AS MATERIALIZED (SELECT *, unnest({keys}) AS block_key FROM normed),
        sized AS (SELECT block_key FROM blocked GROUP BY block_key HAVING count(*) BETWEEN 2 AND 150),
        pairs AS MATERIALIZED (SELECT x.block_key, x AS x, y AS y FROM blocked x JOIN blocked y USING (block_key) JOIN sized USING (block_key) WHERE x.idx < y.idx),
        shaped AS (SELECT *, x.norm AS na, y.norm AS nb, CASE WHEN length(x.norm) <= length(y.norm) THEN x.norm ELSE y.norm END AS sn, CASE WHEN length(x.norm) <= length(y.norm) THEN y.norm ELSE x.norm END AS ln FROM pairs),
        led AS (SELECT *, (sn = ln OR starts_with(ln, sn || ' ')) AND len({tokens('sn')}) >= {least_words} AS is_prefix, {token_sort('na')} AS sa, {token_sort('nb')} AS sb FROM shaped),
        scored AS MATERIALIZED (SELECT *, CASE WHEN is_prefix THEN 100.0 ELSE {ratio('sa', 'sb')} END AS score, {ratio(f"string_split(na, ' ')[{word}]", f"string_split(nb, ' ')[{word}]")} AS word_score FROM led),
        judged AS (SELECT *, CASE WHEN is_prefix THEN 'prefix' WHEN score >= CASE WHEN regexp_matches(x.name || y.name, '[0-9]') THEN 80 ELSE 88 END THEN 'fuzzy'
            WHEN score >= 78 AND greatest(x.a - y.b, y.a - x.b) <= 365 AND word_score >= 78 AND {near} THEN 'temporal_proximity' END AS reason FROM scored),
        edges AS MATERIALIZED (SELECT x.idx AS idx_a, y.idx AS idx_b, block_key, score, reason FROM judged WHERE reason IS NOT NULL),
        both_ways AS (SELECT idx_a AS a, idx_b AS b FROM edges UNION SELECT idx_b, idx_a FROM edges UNION SELECT idx, idx FROM rows),
        reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
        clustered AS MATERIALIZED (SELECT p.*, c.cluster FROM rows p JOIN (SELECT a AS idx, min(b) AS cluster FROM reach GROUP BY a) c USING (idx))
    """


def person_form(c: str, context: list[str] = values.CONTEXT_WORDS) -> str:
    ctx = quoted(context)
    cut = f"list_filter([{person_words(c)}], lambda w: true)[1]"
    kept = f"list_transform([{cut}], lambda w: w[coalesce(nullif(list_position(list_transform(w, lambda x: list_contains({ctx}, x)), false), 0), 1000000):])[1]"
    keys, full = quoted(values.NICKNAMES), quoted(values.NICKNAMES.values())
    return f"array_to_string(list_transform({kept}, lambda x, i: CASE WHEN i = 1 THEN coalesce(({full})[nullif(list_position({keys}, x), 0)], x) ELSE x END), ' ')"


def person_keys(norm: str) -> str:
    w = f"string_split({norm}, ' ')"
    a = f"upper(substring({norm}, 1, 1)) || '_' || ({soundex(f'({w})[-1]')})"
    b = f"upper(substring({norm}, 1, 1)) || '_' || ({soundex(f'({w})[2]')})"
    return f"CASE WHEN {norm} = '' THEN ['X_0000'] WHEN len({w}) >= 3 THEN list_distinct([{a}, {b}]) ELSE [{a}] END"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: rows of its table, reduced over the characters of b."""
    rows = f"list_transform(string_split({b}, ''), lambda c: list_transform(string_split({a}, ''), lambda x: CASE WHEN x = c THEN 1::BIGINT ELSE 0::BIGINT END))"
    zero = f"list_transform(string_split({a}, ''), lambda x: 0::BIGINT)"
    step = "list_transform(range(1, len(r) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda k: greatest(r[k], CASE WHEN m[k] = 1 THEN coalesce(r[k - 1], 0) + 1 ELSE 0 END))))"
    return f"list_max(list_reduce(list_concat([{zero}], {rows}), lambda r, m: {step}))"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * coalesce({lcs(a, b)}, 0) / (length({a}) + length({b})) END"


def token_sort(c: str) -> str:
    return f"array_to_string(list_sort({tokens(c)}), ' ')"


def noise(s: str) -> str:
    words = f"regexp_extract_all({s}, '[A-Za-z]+')"
    return f"""CASE WHEN {s} = '' THEN false WHEN length({s}) < 3 THEN true WHEN length({s}) >= 30 THEN false WHEN NOT regexp_matches({s}, '[A-Za-z]{{3,}}') THEN true
        WHEN 5 * len(list_filter({words}, lambda w: length(w) <= 2)) > 3 * len({words}) THEN true ELSE 5 * length({rx(s, r'[^\p{L}\p{N}]')}) < 2 * length({s}) END"""


def gutter(c: str) -> str:
    return rx(rx(c, rf"\A[{WS}_|~]+"), r"\A- ([A-Za-z])", r"\1")


def cleaned(source: str) -> str:
    """CTEs that end in `cleaned`: doc_id, lines, kept, paragraphs of source (doc_id, text)."""
    broken = rf"([A-Za-z])-[{WS_IN_LINE}]*\n[{WS_IN_LINE}]*(\p{{Ll}}[^\n]*)"
    return f"""
        l0 AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
        l1 AS (SELECT r, doc_id, n, line, {strip('line')} = '' AS blank, {gutter('line')} AS cut FROM (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM l0)),
        l2 AS (SELECT *, {strip('cut')} AS s FROM l1),
        l3 AS (SELECT *, NOT blank AND {noise('s')} AS noise FROM l2),
        l4 AS (SELECT *, CASE WHEN blank OR noise OR s = '' THEN '' ELSE cut END AS kept FROM l3),
        l5 AS (SELECT r, doc_id, count(*) AS n_lines, count(*) FILTER (noise) AS n_noise, count(*) FILTER (NOT blank AND cut <> line) AS n_stripped,
            count(*) FILTER (regexp_matches(kept, '[A-Za-z]-[{WS}]*\\z')) AS n_hyphens, string_agg(kept, chr(10) ORDER BY n) AS whole FROM l4 GROUP BY r, doc_id),
        cleaned AS (SELECT *, list_transform(list_filter(regexp_split_to_array(replace({rx(rx('whole', broken, r'\1\2﷐'), rf'[{WS_IN_LINE}]+(\n|\z)', r'\1')}, '﷐', ''), '\\n\\n+'), lambda b: {strip('b')} <> ''),
            lambda b: replace({rx('b', r'\A\n+|\n+\z')}, chr(10), ' ')) AS paragraphs FROM l5)
    """


def title(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({c}), '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(substring(x, 1, 1)) || substring(x, 2)), '')"


def key(c: str, qualifier: str, dots: bool = False) -> str:
    bare = strip(rx(c, r"\A(?i:a |an |the )"))
    bare = rx(bare, r"\(([^)]+)\)", r" \1") if qualifier == "full" else rx(bare, rf"[{WS}]*\([^)]+\)")
    return rx(f"lower({collapse(rx(bare, rf'[^a-zA-Z0-9{WS}.\-]' if dots else rf'[^a-zA-Z0-9{WS}\-]', ' '))})", r"\.+\z")
