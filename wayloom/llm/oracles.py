"""SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from .line_dedup import MIN_WORDS
from .quality_rules import CLASSES, COMMON, DIGIT, FOREIGN, OTHER, PARAMETERS, PUNCTUATION, SYMBOLS, UPPER

WORD = r"'[^\x20\x09-\x0D]+'"

LINES = f"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, {WORD})) AS n FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w),
ahead AS (SELECT s.doc_id, s.pos AS a, min(e.pos) AS z FROM c s JOIN c e ON e.doc_id = s.doc_id AND e.pos >= s.pos AND e.upto - s.upto + s.n >= {MIN_WORDS} GROUP BY 1, 2),
behind AS (SELECT e.doc_id, max(s.pos) AS a, e.pos AS z FROM c e JOIN c s ON e.doc_id = s.doc_id AND e.pos >= s.pos AND e.upto - s.upto + s.n >= {MIN_WORDS} GROUP BY 1, 3),
windows AS (SELECT doc_id, a, z FROM ahead UNION SELECT doc_id, a, z FROM behind),
named AS (SELECT v.doc_id, a, z, string_agg(line, chr(10) ORDER BY pos) AS name FROM windows v JOIN w ON w.doc_id = v.doc_id AND pos BETWEEN a AND z GROUP BY 1, 2, 3),
later AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, a) AS r FROM named) WHERE r > 1),
gone AS (SELECT DISTINCT w.doc_id, pos FROM w JOIN later t ON t.doc_id = w.doc_id AND pos BETWEEN a AND z),
runs AS (SELECT doc_id, count(*) AS n_deleted, sum(CASE WHEN before IS NULL OR before < pos - 1 THEN 1 ELSE 0 END) AS n_runs FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY 1),
kept AS (SELECT w.doc_id, string_agg(line, chr(10) ORDER BY w.pos) AS text FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos WHERE g.pos IS NULL GROUP BY 1),
sizes AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY 1)
SELECT s.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(length(coalesce(k.text, '')) AS BIGINT) AS n_chars_kept, md5(coalesce(k.text, '')) AS kept_md5
FROM sizes s LEFT JOIN runs r ON r.doc_id = s.doc_id LEFT JOIN kept k ON k.doc_id = s.doc_id"""


def _term(p: str, q: float) -> str:
    m = f"(({p} + {q!r}) / 2)"
    own = f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END"
    return f"({own}" + (f" + {q!r} * log2({q!r} / {m}))" if q > 0 else ")")


def _distance(counts: list[str], total: str, ref) -> str:
    return "sqrt(greatest((" + " + ".join(_term(f"(CAST({c} AS DOUBLE) / {total})", float(q)) for c, q in zip(counts, ref, strict=True)) + ") / 2, 0))"


def _quality() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    count = lambda x: f"len(regexp_extract_all(t, {quoted(x)}))"
    languages = {k: [f"CAST(len(list_filter(common, lambda x: x = {quoted(w)})) AS DOUBLE)" for w in ref] for k, ref in COMMON.items()}
    every = sorted({v + e for ref in COMMON.values() for w in ref for v in (w, w[:1].upper() + w[1:]) for e in ("", ".", ",")})
    by_words = ", ".join(_distance([*[f"{k}_{i}" for i in range(len(ref))], f"(n1 - ({' + '.join(f'{k}_{i}' for i in range(len(ref)))}))"], "n1", [*ref.values(), 1 - sum(ref.values())]) for k, ref in COMMON.items())
    by_chars = ", ".join(_distance(["(word_chars - upper - digit - punct - other - rest)", "upper", "(chars - word_chars)", "punct", "other", "rest"], "greatest(chars - digit, 1)", ref) for ref in CLASSES.values())
    p = PARAMETERS
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {WORD}) AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS lines FROM d),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS five FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS k FROM g) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(5) r(o) GROUP BY 1),
f AS (SELECT w.doc_id, len(words) AS n_words, greatest(len(words), 1) AS n1, coalesce(len(array_to_string(words, '')), 0) AS word_chars, {count(SYMBOLS)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  {count(UPPER)} AS upper, {count(DIGIT)} AS digit, {count(PUNCTUATION)} AS punct, {count(OTHER)} AS other, {count('[^[:ascii:]]')} AS rest, {count(FOREIGN)} AS outside, length(t) AS chars,
  list_transform(list_filter(words, lambda x: x IN ({', '.join(map(quoted, every))})), lambda x: replace(replace(lower(x), '.', ''), ',', '')) AS common FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id),
h AS (SELECT *, {', '.join(f'{x} AS {k}_{i}' for k, xs in languages.items() for i, x in enumerate(xs))} FROM f),
j AS (SELECT *, n_words < {p['least_words']} OR 100 * n_repeat_words > {p['repeat_percent']} * n_words AS base_failed, least({by_chars}) AS dc, least({by_words}) AS dw FROM h)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {p['min_words']} AND 2 * outside < word_chars AND (dc > {p['far_chars']} OR dc > {p['near_chars']} AND dw > {p['near_words']})) AS kept FROM j"""


SHINGLES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT x, b FROM reach JOIN links ON y = a)
SELECT x AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x"""

ORACLES = {"op2_line_dedup": LINES, "op6_quality_divergence": _quality(), "op10_ngram_join": SHINGLES}
