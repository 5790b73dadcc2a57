"""SQL that says the same as the registered queries, built from shared pieces."""

from __future__ import annotations

from lexmill.functions.text import PASS_PREFIXES, SHORT_WORDS, STOP_WORDS, TOKEN

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents)"
QUESTIONS = "qs AS (SELECT 'b_' || item_id AS qid, coalesce(text, '') AS question FROM benchmark)"
GOLD = """gold0 AS (SELECT 'b_' || item_id AS qid, b.text AS question, min(CAST(d.doc_id AS VARCHAR)) AS gold_doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '' GROUP BY ALL),
gold AS (SELECT qid, question, gold_doc_id, lang || '/' || source AS topic, CAST(doc_id % 5 AS BIGINT) AS fold, CASE WHEN doc_id % 5 = 4 THEN 'holdout' ELSE 'cv' END AS split, instr(text, question) - 1 AS place0, length(text) AS chars FROM gold0 JOIN documents ON CAST(doc_id AS VARCHAR) = gold_doc_id)"""


def norm(text: str) -> str:
    return rf"lower(trim(regexp_replace({text}, '[\s\x1c-\x1f]+', ' ', 'g')))"


def generic(n: str) -> str:
    return f"list_filter(regexp_extract_all({n}, '{TOKEN}'), lambda x: x IN ({_LIST(SHORT_WORDS)}) OR (length(x) > 2 AND x NOT IN ({_LIST(STOP_WORDS)})))"


def dates(n: str) -> str:
    y = "string_split(m, '.')[3]"
    year = f"CASE WHEN length({y}) = 2 THEN CASE WHEN CAST({y} AS INT) < 50 THEN '20' ELSE '19' END || {y} ELSE lpad({y}, 4, '0') END"
    return rf"list_transform(regexp_extract_all({n}, '\b\d{{1,2}}\.\d{{1,2}}\.\d{{2,4}}\b'), lambda m: 'date_' || {year} || '-' || lpad(string_split(m, '.')[2], 2, '0') || '-' || lpad(string_split(m, '.')[1], 2, '0'))"


def dotted(n: str) -> str:
    return rf"regexp_extract_all({n}, '\b\d+(?:\.\d+)+(?:-\d+)?\b')"


def tokens(text: str) -> str:
    """All tokens of a text in which no Cyrillic pattern matches."""
    n = norm(text)
    return f"list_concat(list_concat({generic(n)}, {dates(n)}), {dotted(n)})"


def simple_tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{TOKEN}'), lambda x: length(x) > 2 AND x NOT IN ({_LIST(STOP_WORDS)}))"


def lemma_tokens(text: str) -> str:
    """Tokens by the lemma table of the registered queries: the first four characters of longer words."""
    kept = f"x IN ({_LIST(SHORT_WORDS)}) OR regexp_matches(x, '^({'|'.join(PASS_PREFIXES)})|[0-9]') OR length(x) <= 4"
    return f"list_transform({tokens(text)}, lambda x: CASE WHEN {kept} THEN x ELSE substr(x, 1, 4) END)"


#: Endings that the lemma table of `predicted_lemmas` takes off.
ENDINGS = "(ing|ed|es|s|en|er|e)$"


def predicted_lemmas(held: str, longest: int) -> str:
    return rf"""WITH {DOCS}, w AS (SELECT DISTINCT unnest({tokens('text')}) AS token FROM docs),
words AS (SELECT token FROM w WHERE NOT (token IN ({_LIST(SHORT_WORDS)}) OR regexp_matches(token, '^({'|'.join(PASS_PREFIXES)})|[0-9]'))),
known AS (SELECT token, regexp_replace(token, '{ENDINGS}', '') AS lemma FROM words WHERE {held}),
changes AS (SELECT token, length(token) - kept AS cut, substr(lemma, kept + 1) AS add FROM (SELECT *, list_max(list_filter(range(greatest(0, length(token) - {longest}), least(length(token), length(lemma)) + 1), lambda i: substr(token, 1, i) = substr(lemma, 1, i))) AS kept FROM known) WHERE kept IS NOT NULL),
counted AS (SELECT right(token, l) AS suffix, cut, add, count(*) AS n FROM (SELECT *, unnest(range(greatest(cut, 1), least(length(token), {longest}) + 1)) AS l FROM changes) GROUP BY ALL),
rules AS (SELECT suffix, cut, add FROM counted QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, add) = 1),
spread AS (SELECT token, unnest(range(1, least(length(token) - 1, {longest}) + 1)) AS l FROM words WHERE NOT ({held})),
best AS (SELECT token, cut, add FROM spread JOIN rules ON suffix = right(token, l) QUALIFY row_number() OVER (PARTITION BY token ORDER BY l DESC) = 1),
changed AS (SELECT token, left(token, length(token) - cut) || add AS lemma FROM best)
SELECT token, lemma FROM known UNION ALL
SELECT token, coalesce(nullif(lemma, ''), token) FROM words LEFT JOIN changed USING (token) WHERE NOT ({held})"""


def windows(size: int, stride: int) -> str:
    return rf"""cut AS (SELECT doc_id, i, substr(text, CAST(i * {stride} + 1 AS BIGINT), {size}) AS chunk_text FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - {size}) / {stride})) AS BIGINT) + 1)) AS i FROM docs WHERE length(text) > 0)),
kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_no, chunk_text FROM cut WHERE regexp_replace(chunk_text, '[\s\x1c-\x1f]+', '', 'g') <> ''),
chunks AS (SELECT * FROM kept UNION ALL SELECT doc_id, 0, text FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM kept))"""


def structured(size: int, stride: int) -> str:
    """CTEs up to chunks: units by lists, chunks by a recursion over the first unit of each."""
    space = r"[\s\x1c-\x1f]"
    strip = lambda x: rf"regexp_replace({x}, '^{space}+|{space}+$', '', 'g')"
    one = lambda x: rf"trim(regexp_replace({x}, '{space}+', ' ', 'g'))"
    sentences = rf"list_filter(string_split(regexp_replace(x, '([.!?…;:])\s+([А-ЯЁA-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: y <> '')"
    cuts = rf"list_filter(list_transform(range(0, CAST(greatest(0, ceil((length(x) - {size}) / {stride})) AS BIGINT) + 1), lambda i: substr(x, CAST(i * {stride} + 1 AS BIGINT), {size})), lambda y: regexp_replace(y, '{space}+', '', 'g') <> '')"
    nothing = "CAST([] AS VARCHAR[])"
    back = "e" if size == stride else f"least(e - 1, len(list_filter(p, lambda x: x < p[e + 1] - 1 - {size - stride})))"
    end = f"greatest(f + 1, len(list_filter(p, lambda x: x <= p[f + 1] + 1 + {size})) - 1)"
    return rf"""para AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex({strip('text')}, '\n{space}*\n+'), lambda x: {one('x')}), lambda x: x <> '') AS u FROM docs),
sent AS (SELECT doc_id, text, flatten(list_concat([{nothing}], list_transform(u, lambda x: CASE WHEN length(x) <= {size} THEN [x] ELSE {sentences} END))) AS u FROM para),
unit AS MATERIALIZED (SELECT doc_id, text, flatten(list_concat([{nothing}], list_transform(u, lambda x: CASE WHEN length(x) <= {size} THEN [x] ELSE {cuts} END))) AS u FROM sent),
pref AS MATERIALIZED (SELECT doc_id, u, list_transform(range(0, len(u) + 1), lambda i: CAST(coalesce(list_sum(list_transform(u[1:i], lambda x: length(x) + 1)), 0) AS BIGINT)) AS p FROM unit WHERE len(u) > 0),
walk AS (WITH RECURSIVE w(doc_id, chunk_no, f, e) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, {end} FROM (SELECT doc_id, p, 0 AS f FROM pref)
  UNION ALL SELECT doc_id, chunk_no + 1, f, {end} FROM (SELECT w.doc_id, w.chunk_no, p, u, greatest({back}, f + 1) AS f FROM w JOIN pref USING (doc_id) WHERE e < len(u)))
  SELECT * FROM w),
chunks AS (SELECT doc_id, chunk_no, array_to_string(u[f + 1:e], ' ') AS chunk_text FROM walk JOIN pref USING (doc_id) UNION ALL SELECT doc_id, 0, text FROM unit WHERE len(u) = 0)"""


def units(chunked: tuple | None, tok=tokens) -> str:
    if chunked is None:
        return f"units AS (SELECT doc_id AS unit_id, doc_id, {tok('text')} AS tokens FROM docs)"
    made = structured(*chunked[1:]) if chunked[0] == "structured" else windows(*chunked)
    return made + f",\nunits AS (SELECT doc_id || '#' || chunk_no AS unit_id, doc_id, {tok('chunk_text')} AS tokens FROM chunks)"


POSTINGS = """postings AS (SELECT unit_id, doc_id, term, count(*) AS tf FROM (SELECT unit_id, doc_id, unnest(tokens) AS term FROM units) GROUP BY ALL),
lens AS (SELECT unit_id, doc_id, len(tokens) AS dl FROM units),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
bm0 AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS i0 FROM postings, corpus GROUP BY term),
bm AS (SELECT term, df, CASE WHEN i0 < 0 THEN 0.25 * (SELECT avg(i0) FROM bm0) ELSE i0 END AS idf FROM bm0),
ti AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM postings, corpus GROUP BY term)"""
BM25 = """scores AS (SELECT qid, p.unit_id, p.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN postings p USING (term) JOIN bm USING (term) JOIN lens ON lens.unit_id = p.unit_id, corpus GROUP BY ALL)"""
TFIDF = """w AS (SELECT unit_id, doc_id, term, tf * idf AS w FROM postings JOIN ti USING (term)),
norms AS (SELECT unit_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit_id),
qw AS (SELECT qid, term, qtf * idf AS qw FROM qt JOIN ti USING (term)),
qnorms AS (SELECT qid, sqrt(sum(qw * qw)) AS qnorm FROM qw GROUP BY qid),
scores AS (SELECT qid, unit_id, doc_id, dot / (norm * qnorm) AS score FROM (SELECT qid, unit_id, doc_id, sum(w * qw) AS dot FROM w JOIN qw USING (term) GROUP BY ALL) JOIN norms USING (unit_id) JOIN qnorms USING (qid))"""
POOLED = {
    "max": lambda k: "s[1]",
    "top2_sum": lambda k: "list_sum(s[1:2])",
    "mean_topk": lambda k: f"list_sum(s[1:{k}]) / len(s[1:{k}])",
    "logsumexp": lambda k: f"s[1] + ln(list_sum(list_transform(s[1:{k}], lambda x: exp(x - s[1]))))",
}


def query_terms(tok=tokens) -> str:
    return f"qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('question')}) AS term FROM qs) GROUP BY ALL)"


def document_scores(scoring: str = BM25, chunked: tuple | None = None, mode: str = "max", k: int = 2, questions: str = QUESTIONS, tok=tokens) -> str:
    """CTEs up to dense(qid, doc_id, score)."""
    head = ",\n".join([DOCS, questions, query_terms(tok), units(chunked, tok)])
    if chunked is not None and scoring is BM25:
        head += ",\nall_units AS (SELECT * FROM units)"
        post = POSTINGS.replace("FROM units", "FROM filled")
        head += ",\nfilled AS (SELECT * FROM all_units WHERE len(tokens) > 0)"
        live = "filled"
    else:
        post, live = POSTINGS, "units"
    if chunked is None:
        dense = "dense AS (SELECT qs.qid, docs.doc_id, coalesce(score, 0) AS score FROM qs CROSS JOIN docs LEFT JOIN scores ON scores.qid = qs.qid AND scores.doc_id = docs.doc_id)"
    else:
        dense = f"""lists AS (SELECT qs.qid, u.doc_id, list_reverse_sort(list(coalesce(score, 0))) AS s FROM qs CROSS JOIN {live} u LEFT JOIN scores ON scores.qid = qs.qid AND scores.unit_id = u.unit_id GROUP BY ALL),
dense AS (SELECT qs.qid, docs.doc_id, coalesce({POOLED[mode](k)}, CAST('-infinity' AS DOUBLE)) AS score FROM qs CROSS JOIN docs LEFT JOIN lists ON lists.qid = qs.qid AND lists.doc_id = docs.doc_id)"""
    return ",\n".join([head, post, scoring, dense])


def top(source: str, k: int, name: str = "ranked") -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8) DESC, doc_id) AS rank, doc_id, score FROM {source}) WHERE rank <= {k})"


def show(source: str = "ranked") -> str:
    return f"SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score FROM {source}"


def topk(depth: int = 5, **how) -> str:
    return f"WITH {document_scores(**how)},\n{top('dense', depth)}\n{show()}"


def nested(name: str, k: int, **how) -> str:
    """A ranking as one CTE of its own."""
    return f"{name} AS (WITH {document_scores(**how)},\n{top('dense', k)}\nSELECT qid, rank, doc_id, score FROM ranked)"


def fused(depth: int, name: str = "hybrid", tok=tokens) -> str:
    parts = nested("r1", depth, tok=tok) + ",\n" + nested("r2", depth, chunked=(1600, 800), tok=tok)
    return parts + f",\nrrf AS (SELECT qid, doc_id, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY ALL),\n{top('rrf', depth, name)}"


def inside(limit: int, candidates: str, chunk_ctes: str, tok=tokens) -> str:
    """CTEs up to placed(qid, doc_id, place, chunk_no, score): passages ranked inside their document."""
    return f"""{chunk_ctes},
ct0 AS (SELECT doc_id, chunk_no, chunk_text, {tok('chunk_text')} AS t FROM chunks WHERE doc_id IN (SELECT doc_id FROM {candidates})),
ct AS (SELECT doc_id, chunk_no, len(t) = 0 AS empty, CASE WHEN len(t) = 0 THEN ['__empty__'] ELSE t END AS t FROM ct0),
pd AS (SELECT doc_id, count(*) AS n, avg(len(t)) AS avgdl, bool_and(empty) AS all_empty FROM ct GROUP BY doc_id),
cp AS (SELECT doc_id, chunk_no, dl, term, count(*) AS tf FROM (SELECT doc_id, chunk_no, len(t) AS dl, unnest(t) AS term FROM ct) GROUP BY ALL),
ci0 AS (SELECT cp.doc_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS i0 FROM cp JOIN pd USING (doc_id) GROUP BY ALL),
ci AS (SELECT doc_id, term, CASE WHEN i0 < 0 THEN 0.25 * avg(i0) OVER (PARTITION BY doc_id) ELSE i0 END AS idf FROM ci0),
cs AS (SELECT c.qid, cp.doc_id, cp.chunk_no, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM {candidates} c JOIN cqt ON cqt.qid = c.qid JOIN cp ON cp.doc_id = c.doc_id AND cp.term = cqt.term JOIN ci ON ci.doc_id = cp.doc_id AND ci.term = cp.term JOIN pd ON pd.doc_id = cp.doc_id GROUP BY ALL),
cq AS (SELECT qid, question, {tok('question')} AS t FROM cqs),
ca AS (SELECT c.qid, ct.doc_id, ct.chunk_no, CASE WHEN n <= {limit} OR all_empty OR len(cq.t) = 0 THEN 0 ELSE coalesce(cs.score, 0) END AS score
  FROM {candidates} c JOIN cq ON cq.qid = c.qid JOIN ct ON ct.doc_id = c.doc_id JOIN pd ON pd.doc_id = c.doc_id LEFT JOIN cs ON cs.qid = c.qid AND cs.doc_id = ct.doc_id AND cs.chunk_no = ct.chunk_no),
placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 8) DESC, chunk_no) AS place FROM ca) WHERE place <= {limit})"""


def chunk_questions(tok=tokens) -> str:
    return f"cqs AS (SELECT 'b_' || item_id AS qid, coalesce(text, '') AS question FROM benchmark),\ncqt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('question')}) AS term FROM cqs) GROUP BY ALL)"


def top_chunks(depth: int, limit: int) -> str:
    return f"WITH {fused(depth)},\n{DOCS},\n{chunk_questions()},\n{inside(limit, 'hybrid', windows(1600, 800))}\nSELECT qid, doc_id, CAST(place AS BIGINT) AS place, CAST(chunk_no AS BIGINT) AS chunk_no, round(score, 6) AS score FROM placed"


def reranked(mode: str, k: int, depth: int, limit: int, tok=tokens) -> str:
    contained = "CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END"
    ce = f"ce AS (SELECT qid, doc_id, max({contained}) AS ce FROM (SELECT placed.qid, placed.doc_id, {tokens('question')} AS a, {tokens('chunk_text')} AS b FROM placed JOIN cqs USING (qid) JOIN chunks ON chunks.doc_id = placed.doc_id AND chunks.chunk_no = placed.chunk_no) GROUP BY ALL),\npairs AS (SELECT hybrid.qid, hybrid.doc_id, hybrid.score AS sparse, ce FROM hybrid JOIN ce ON ce.qid = hybrid.qid AND ce.doc_id = hybrid.doc_id)"
    mm = lambda c: f"CASE WHEN max({c}) OVER (PARTITION BY qid) <= min({c}) OVER (PARTITION BY qid) THEN 1 ELSE ({c} - min({c}) OVER (PARTITION BY qid)) / (max({c}) OVER (PARTITION BY qid) - min({c}) OVER (PARTITION BY qid)) END"
    rk = lambda c: f"row_number() OVER (PARTITION BY qid ORDER BY round({c}, 8) DESC, doc_id)"
    score = {"ce_only": "ce", "linear": f"0.7 * ({mm('ce')}) + 0.3 * ({mm('sparse')})", "rrf": f"0.7 / (60 + {rk('ce')}) + 0.3 / (60 + {rk('sparse')})"}[mode]
    return f"WITH {fused(depth, tok=tok)},\n{DOCS},\n{chunk_questions(tok)},\n{inside(limit, 'hybrid', windows(1600, 800), tok)},\n{ce},\nblended AS (SELECT qid, doc_id, CAST({score} AS DOUBLE) AS score FROM pairs),\n{top('blended', k)}\n{show()}"


#: Labelled questions with the rank of their gold document among the first 20 by BM25.
LABELLED = "qs AS (SELECT qid, question FROM gold)"


def placed(**how) -> str:
    return f"{GOLD},\n{document_scores(questions=LABELLED, **how)},\n{top('dense', 20)},\nplaced AS (SELECT gold.*, ranked.rank AS gold_rank FROM gold LEFT JOIN ranked ON ranked.qid = gold.qid AND ranked.doc_id = gold.gold_doc_id)"


def recall(k: int) -> str:
    return f"coalesce(avg(CASE WHEN gold_rank <= {k} THEN 1.0 ELSE 0.0 END), 0)"


def cv_rows(ks: list[int], labels: str = "", **how) -> str:
    rows = []
    for k in ks:
        rows.append(f"SELECT {labels}'recall_at_{k}' AS metric, (SELECT round(avg(r), 6) FROM (SELECT {recall(k)} AS r FROM placed WHERE split = 'cv' GROUP BY fold)) AS strict_cv_mean, (SELECT round(stddev_pop(r), 6) FROM (SELECT {recall(k)} AS r FROM placed WHERE split = 'cv' GROUP BY fold)) AS strict_cv_std, (SELECT round({recall(k)}, 6) FROM placed WHERE split = 'holdout') AS strict_holdout")
    return f"WITH {placed(**how)}\n" + " UNION ALL ".join(rows)
