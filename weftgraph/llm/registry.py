"""Queries of the training-data operators, and their DuckDB oracles where SQL can express them."""

from weftgraph.llm.byte_bpe import op3_byte_bpe
from weftgraph.llm.jaccard_join import op7_jaccard_join
from weftgraph.llm.language_crf import op5_language_crf
from weftgraph.llm.media import op4_media_sequences
from weftgraph.llm.packing import op8_best_fit_packing
from weftgraph.llm.page_diff import op6_page_diff
from weftgraph.llm.quality_risk import RULES, Risk, op10_quality_rules
from weftgraph.llm.secret_scan import op2_secret_scan
from weftgraph.llm.sharding import op1_label_shards
from weftgraph.llm.token_counts import op9_token_counts

QUERIES = {f.__name__: f for f in (op1_label_shards, op2_secret_scan, op3_byte_bpe, op4_media_sequences, op5_language_crf, op6_page_diff, op7_jaccard_join, op8_best_fit_packing, op9_token_counts, op10_quality_rules)}

#: All pairs of documents that share a shingle, counted; then what can be reached by links.
JACCARD_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM docs),
each AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.r AS a, b.r AS b FROM each a JOIN each b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE min(o.doc_id) END AS component_id
FROM sets JOIN reach ON sets.r = reach.a JOIN sets o ON o.r = reach.b GROUP BY sets.r, sets.doc_id, sets.s
"""


def quality_sql(risk: Risk = Risk()) -> str:
    """The counts by plain SQL; the binomial bound as a sum over logarithms of factorials."""
    cuts = [(r.name, r.measure, n, c) for r in RULES for n, c in enumerate(r.cutoffs)]
    tried = " UNION ALL ".join(f"SELECT s, '{name}' AS rule, {n} AS step, {c!r} AS cut, count(*) AS n, count(*) FILTER ({measure} > {c!r}) AS k FROM held GROUP BY s" for name, measure, n, c in cuts)
    over = " OR ".join(f"coalesce({r.measure} > {r.name}_cut, false)" for r in RULES)
    chosen = ", ".join(f"min(cut) FILTER (rule = '{r.name}') AS {r.name}_cut" for r in RULES)
    share = risk.alpha / len(RULES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, 'null') AS s FROM documents),
words AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM again GROUP BY r),
counts AS (
  SELECT doc_id, s, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeated USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM failed WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL)),
tried AS ({tried}),
level AS (SELECT {risk.delta!r} / (greatest(1, count(DISTINCT s)) * {len(RULES)}) AS most FROM held),
bound AS (SELECT s, rule, step, any_value(cut) AS cut, CASE WHEN any_value(k) >= any_value(n) THEN 1 ELSE sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share!r}) + (n - i) * ln(1 - {share!r}))) END AS p
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM tried) GROUP BY s, rule, step),
passed AS (SELECT *, bool_and(p <= most) OVER (PARTITION BY s, rule ORDER BY step) AS ok FROM bound, level),
chosen AS (SELECT s, {chosen} FROM passed WHERE ok GROUP BY s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE NOT ({over}) END AS kept
FROM failed LEFT JOIN chosen USING (s)
"""


ORACLES: dict[str, str] = {"op7_jaccard_join": JACCARD_SQL, "op10_quality_rules": quality_sql()}
