"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import ann, bpe, exact_dedup, line_dedup, near_dedup, packing, pieces, pii, quality, ranked_search, suffix_dedup, toxicity, whitening

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY 1) m ON m.id = d.doc_id
"""

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_collision_ann": ann.op2_collision_ann,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality": quality.op9_quality,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_whitening": whitening.op12_whitening,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}
SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
}
