"""SQL for DuckDB of the text queries whose whole result SQL can express."""

from __future__ import annotations

from hydrolens.llm.decontaminate import MASKS
from hydrolens.llm.url_templates import ALIKE, DEPTH, LEAST, LIMIT, PRIOR, RULES, SHARE


def _seeds(words: str, at: str) -> str:
    """Text of each mask's words, with the mask's number."""
    texts = [
        f"CASE WHEN {at} + {mask[-1]} < len({words}) THEN concat_ws(' ', {i}, "
        + ", ".join(f"{words}[{at} + {place + 1}]" for place in mask)
        + ") END"
        for i, mask in enumerate(MASKS)
    ]
    return f"unnest([{', '.join(texts)}])"


_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OVERLAPS = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{_MARKS}'), lambda x: x <> '') AS w
  FROM documents),
t AS (
  SELECT *, len(v) AS n, least(len(v), 13) AS size FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{_MARKS}'), lambda x: x <> '') AS v
    FROM benchmark) WHERE len(v) >= 7),
asked AS (
  SELECT doc_id, i, {_seeds("w", "i")} AS seed
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d)),
known AS (
  SELECT item_id, p, {_seeds("v", "p")} AS seed
  FROM (SELECT item_id, v, unnest(range(len(v))) AS p FROM t)),
lines AS (
  SELECT DISTINCT doc_id, item_id, i - p AS diagonal FROM asked JOIN known USING (seed)),
compared AS (
  SELECT doc_id, item_id, diagonal, n, size,
         list_transform(range(n), lambda k: CASE WHEN diagonal + k >= 0
           AND w[greatest(diagonal + k, 0) + 1] = v[k + 1] THEN 1 ELSE 0 END) AS same
  FROM lines JOIN d USING (doc_id) JOIN t USING (item_id)),
accepted AS (
  SELECT *, list_filter(range(n - size + 1), lambda k: list_sum(same[k + 1 : k + size])
    >= size - CASE WHEN size >= 13 THEN 2 WHEN size >= 9 THEN 1 ELSE 0 END) AS ks
  FROM compared),
found AS (
  SELECT *, list_min(ks) AS first, list_max(ks) + size - list_min(ks) AS n_words FROM accepted WHERE len(ks) > 0)
SELECT doc_id, item_id, diagonal + first AS doc_start, first AS item_start, n_words,
       CAST(list_sum(same[first + 1 : first + n_words]) AS BIGINT) AS n_same
FROM found"""


def _rules() -> tuple[str, str]:
    """Name and verdict of the longest rule that fits, as CASE expressions."""
    cases = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r)
        for r in sorted(RULES, key=lambda r: (-len(r.name), r.name))
    ]
    name = " ".join(f"WHEN {test} THEN '{r.name}'" for test, r in cases)
    verdict = " ".join(f"WHEN {test} THEN '{r.verdict}'" for test, r in cases)
    return f"CASE {name} END", f"CASE {verdict} END"


def _verdicts() -> str:
    name, label = _rules()
    own = [f"coalesce(parts[{d}], '') AS s{d}" for d in range(1, DEPTH + 1)]
    parts = [
        """parsed AS (
  SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after
        FROM pages))""",
        f"ruled AS (SELECT *, {name} AS rule, {label} AS label, regexp_replace(path, '^/+|/+$', '', 'g') AS bare FROM parsed)",
        f"""level0 AS (SELECT *, {', '.join(own)}, CAST(len(parts) > {DEPTH} AS INTEGER) AS rest
  FROM (SELECT *, CASE WHEN bare = '' THEN []::VARCHAR[] ELSE string_split(bare, '/') END AS parts FROM ruled))""",
    ]
    branch = ["host"]
    for d in range(1, DEPTH + 1):
        above = ", ".join(branch)
        parts.append(f"""level{d} AS (
  SELECT * EXCLUDE (own_n, whole_n), CASE WHEN own_n >= greatest(whole_n * {SHARE}::DOUBLE, {LEAST}) OR s{d} = ''
    THEN s{d} ELSE '*' END AS t{d}
  FROM (SELECT *, count(*) OVER (PARTITION BY {above}, s{d}) AS own_n, count(*) OVER (PARTITION BY {above}) AS whole_n
        FROM level{d - 1}))""")
        branch.append(f"t{d}")
    levels = [*branch, "rest"]
    key = ", ".join(levels)
    parts.append(f"""leaves AS (
  SELECT {key}, count(*) FILTER (WHERE label = 'allow') AS allowed, count(label) AS labelled
  FROM level{DEPTH} GROUP BY {key})""")
    p = f"{PRIOR}::DOUBLE"
    parts.append(f"overall AS (SELECT (sum(allowed) + 0.5::DOUBLE * {p}) / (sum(labelled) + {p}) AS o FROM leaves)")
    parts.append(f"""known0 AS (SELECT host, (sum(allowed) + {p} * any_value(o)) / (sum(labelled) + {p}) AS above
  FROM leaves, overall GROUP BY host)""")
    parts.append("leaves0 AS (SELECT * FROM leaves)")
    merged = ["host"]
    for d in range(1, len(levels)):
        up, name_d = ", ".join(merged), levels[d]
        shape = f"max(CAST({levels[d + 1]} = '*' AS INTEGER))" if d < DEPTH else "0"
        parts.append(f"""nodes{d} AS (
  SELECT *, (allowed + {p} * above) / (labelled + {p}) AS purity, labelled + {p} AS n
  FROM (SELECT {up}, {name_d}, sum(allowed) AS allowed, sum(labelled) AS labelled, {shape} AS shape
        FROM leaves{d - 1} GROUP BY {up}, {name_d}) JOIN known{d - 1} USING ({up}))""")
        window = f"(PARTITION BY {up}, shape ORDER BY purity, {name_d})"
        parts.append(f"""steps{d} AS (
  SELECT *, CASE WHEN (purity - p0) / sqrt(greatest(q * (1 - q), 1e-9::DOUBLE) * (1 / n + 1 / n0)) >= {ALIKE}::DOUBLE
    THEN 1 ELSE 0 END AS step
  FROM (SELECT *, (n * purity + n0 * p0) / (n + n0) AS q
        FROM (SELECT *, lag(purity) OVER {window} AS p0, lag(n) OVER {window} AS n0 FROM nodes{d})))""")
        parts.append(f"""grouped{d} AS (
  SELECT *, shape || ':' || sum(step) OVER {window} AS m{d} FROM steps{d})""")
        parts.append(f"""known{d} AS (
  SELECT {up}, m{d}, (sum(allowed) + {p} * any_value(above)) / (sum(labelled) + {p}) AS above
  FROM grouped{d} GROUP BY {up}, m{d})""")
        parts.append(f"""leaves{d} AS (
  SELECT l.*, g.m{d} FROM leaves{d - 1} l JOIN grouped{d} g USING ({up}, {name_d}))""")
        merged.append(f"m{d}")
    last = len(levels) - 1
    parts.append(f"purities AS (SELECT {key}, above FROM leaves{last} JOIN known{last} USING ({', '.join(merged)}))")
    shown = f"rtrim(concat_ws('/', {', '.join(branch)}), '/')"
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN above < {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       {shown} || CASE WHEN rest = 1 THEN '/**' ELSE '' END AS template, above AS purity
FROM level{DEPTH} JOIN purities USING ({key})"""
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = (
    f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents),
totals AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0),
held AS (
  SELECT place, doc_id, size, term, count(*) AS tf
  FROM (SELECT place, doc_id, len(terms) AS size, unnest(terms) AS term FROM d) GROUP BY ALL),
weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * holding + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS holding FROM held GROUP BY term), totals),
asked AS (
  SELECT item_id, text, unnest(list_distinct({_TERMS})) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scored AS (
  SELECT item_id, text, place, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN held USING (term), totals GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0) WHERE rank <= 10"""

_JOINED = "array_to_string({}, ' ')".format
_CUTS = " UNION ALL ".join(
    f"SELECT lang, phrase, a, {k} AS k, {_JOINED(f'w[1:{k}]')} AS head, {_JOINED(f'w[{k + 1}:]')} AS rest FROM c WHERE len(w) > {k}"
    for k in (1, 2, 3)
)
_INNER = " UNION ALL ".join(
    f"SELECT lang, a, {_JOINED(f'w[{i}:{j}]')} AS phrase FROM c WHERE len(w) >= greatest({j}, {j - i + 2})"
    for i, j in ((1, 2), (2, 3), (3, 4), (1, 3), (2, 4))
)

PHRASES = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (
  SELECT row_number() OVER () AS id, lang,
         list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d),
words AS (SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM pieces),
after AS (
  SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, w AS phrase FROM after
    UNION ALL SELECT lang, w || ' ' || w2 FROM after WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3 FROM after WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM after WHERE w4 IS NOT NULL)
  GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE contains(phrase, ' ')),
cuts AS ({_CUTS}),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, k,
         CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM ({_INNER}) GROUP BY ALL),
kept AS (
  SELECT weakest.* FROM weakest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLE = {
    "op1_decontamination": OVERLAPS,
    "op6_url_verdicts": _verdicts(),
    "op11_ranked_search": SEARCH,
    "op12_collocations": PHRASES,
}
