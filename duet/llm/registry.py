"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op1_suffix, op2_bpe, op3_quality, op4_counts, op5_idfiles, op6_decontaminate, op7_shards, op8_html, op9_jaccard, op10_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix.query,
    "op2_bpe": op2_bpe.query,
    "op3_quality_rules": op3_quality.query,
    "op4_token_counts": op4_counts.query,
    "op5_id_files": op5_idfiles.query,
    "op6_decontamination": op6_decontaminate.query,
    "op7_shards": op7_shards.query,
    "op8_html_text": op8_html.query,
    "op9_jaccard_join": op9_jaccard.query,
    "op10_toxicity": op10_toxicity.query,
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The others learn from labels, tokenise, tile strings or place rows by hashes: they are tested against brute force and the library.
ORACLE: dict[str, str] = {
    "op1_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h, CAST(octet_length(encode(coalesce(text,''))) AS BIGINT) AS n FROM documents),
 w AS (SELECT doc_id, p, md5(substr(h, CAST(2*p+1 AS BIGINT), 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, n-99)) AS p FROM d WHERE n>=100)),
 r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM w) WHERE rn>1),
 i AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT *, CASE WHEN p<=lag(p) OVER (PARTITION BY doc_id ORDER BY p)+100 THEN 0 ELSE 1 END AS nw FROM r)),
 s AS (SELECT doc_id, min(p) AS a, max(p)+100 AS b FROM i GROUP BY doc_id, g),
 k AS (SELECT d.doc_id, d.n, s.a, s.b, substr(d.h, CAST(2*coalesce(lag(s.b) OVER o,0)+1 AS BIGINT), CAST(2*(s.a-coalesce(lag(s.b) OVER o,0)) AS BIGINT)) AS piece, substr(d.h, CAST(2*s.b+1 AS BIGINT)) AS tail, row_number() OVER (PARTITION BY d.doc_id ORDER BY s.a DESC) AS back FROM d JOIN s USING (doc_id) WINDOW o AS (PARTITION BY d.doc_id ORDER BY s.a)),
 c AS (SELECT doc_id, CAST(sum(b-a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) || max(tail) FILTER (back=1) AS kept FROM k GROUP BY doc_id)
 SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed,0) AS n_removed, coalesce(n_spans,0) AS n_spans, sha256(unhex(coalesce(kept, d.h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)""",
    "op9_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<5 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' '))) END AS s FROM w),
 u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.t=b.t AND a.doc_id<>b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p WHERE 100*c>=80*(na+nb-c)), r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.a, r.root FROM r JOIN l ON l.b=r.doc_id),
 m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id), n AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
 SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, coalesce(n_links,0) AS n_links FROM s JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
