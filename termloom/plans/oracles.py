"""The queries of termloom.plans.queries in DuckDB's SQL."""

from __future__ import annotations

from termloom.functions.porter import STEP_2, STEP_3, STEP_4
from termloom.functions.text import DIGIT, MODEL_STOP, PATTERNS, SPACE, STOP
from termloom.operators.metrics import ERFC
from termloom.plans.queries import ALPHAS, BASELINE, BETAS, FEEDBACK, N_TEST, QUERIES_PER_DOC

ALPHANUM, SYMBOL = (PATTERNS[m].replace("\\-", "-") for m in ("alphanum", "symbol"))


def toks(text: str, pattern: str = ALPHANUM) -> str:
    return f"list_transform(regexp_extract_all(coalesce({text}, ''), '{pattern}'), lambda x: lower(x))"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


POST = f"""docs AS MATERIALIZED (SELECT doc_id AS docid, {toks('text')} AS tokens FROM documents),
post AS MATERIALIZED (SELECT docid, term, count(*) AS tf FROM (SELECT docid, unnest(tokens) AS term FROM docs) GROUP BY docid, term)"""

TOPICS = f"terms AS (SELECT item_id AS qid, unnest({toks('text')}) AS term FROM benchmark)"

QRELS = "qrels AS MATERIALIZED (SELECT item_id AS qid, doc_id AS docid FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"

CLICKS = f"""titles AS (SELECT page_id, array_to_string({toks("regexp_extract(html, '<title>(.*?)</title>', 1)")}, ' ') AS query FROM pages),
clicks AS MATERIALIZED (SELECT event_id AS line_no, user_id AS qid, query, (props->>'$.k')::BIGINT AS docid FROM events
  JOIN titles ON page_id = user_id % (SELECT count(*) FROM pages) WHERE event_type = 'click' AND query <> '')"""

SPLIT = f"""test AS MATERIALIZED (SELECT qid FROM (SELECT DISTINCT qid FROM clicks) ORDER BY md5('42:' || qid), qid LIMIT {N_TEST}),
train AS MATERIALIZED (SELECT * FROM clicks WHERE qid NOT IN (SELECT qid FROM test))"""

EDGES = "edges AS MATERIALIZED (SELECT query, docid, count(*)::DOUBLE AS w FROM train GROUP BY query, docid)"


def core(source: str, rounds: int) -> str:
    """Rounds of pruning written out; rounds beyond the fixpoint change nothing."""
    parts = [f"core0 AS MATERIALIZED (SELECT DISTINCT query, docid FROM {source})"]
    for k in range(rounds):
        parts.append(f"half{k} AS MATERIALIZED (SELECT * FROM core{k} WHERE docid IN (SELECT docid FROM core{k} GROUP BY docid HAVING count(*) > 1))")
        parts.append(f"core{k + 1} AS MATERIALIZED (SELECT * FROM half{k} WHERE query IN (SELECT query FROM half{k} GROUP BY query HAVING count(*) > 1))")
    parts.append(f"core AS (SELECT * FROM core{rounds})")
    return ",\n".join(parts)


def bm25(name: str, terms: str = "terms", post: str = "post", k: int = 10, by: str = "", key: str = "qid") -> str:
    b, on = (f"{by}, ", f"AND {{0}}.{by} = {{1}}.{by} ") if by else ("", "")
    link = lambda x, y: on.format(x, y)
    return f"""{name}_len AS MATERIALIZED (SELECT {b}docid, sum(tf)::DOUBLE AS dl FROM {post} GROUP BY {b}docid),
{name}_all AS (SELECT {b}count(*)::DOUBLE AS n, sum(dl) / count(*) AS avgdl FROM {name}_len {'GROUP BY ' + by if by else ''}),
{name}_q AS (SELECT {key}, term, count(*)::DOUBLE AS qtf FROM {terms} GROUP BY {key}, term),
{name}_df AS (SELECT {b}term, count(*)::DOUBLE AS df FROM {post} GROUP BY {b}term),
{name}_s AS (
  SELECT {'p.' + by + ', ' if by else ''}q.{key}, p.docid,
         sum(q.qtf * ln(1::DOUBLE + (a.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * p.tf::DOUBLE / (p.tf::DOUBLE + 0.9::DOUBLE * (1::DOUBLE - 0.4::DOUBLE + 0.4::DOUBLE * l.dl / a.avgdl))) AS score
  FROM {name}_q q JOIN {post} p ON q.term = p.term JOIN {name}_df f ON f.term = p.term {link('f', 'p')}
  JOIN {name}_len l ON l.docid = p.docid {link('l', 'p')} JOIN {name}_all a ON true {link('a', 'p')}
  GROUP BY {'p.' + by + ', ' if by else ''}q.{key}, p.docid
),
{name} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {b}{key} ORDER BY round(score, 9) DESC, docid::VARCHAR) AS rank FROM {name}_s) WHERE rank <= {k}
)"""


def per_query(name: str, run: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"""{name}_n AS (SELECT qid, count(*) AS n FROM qrels GROUP BY qid),
{name} AS MATERIALIZED (
  SELECT {'r.' + by + ', ' if by else ''}r.qid, coalesce(1::DOUBLE / min(r.rank) FILTER (q.qid IS NOT NULL), 0::DOUBLE) AS rr,
         sum(CASE WHEN q.qid IS NOT NULL THEN 1::DOUBLE / log2(r.rank + 1) ELSE 0::DOUBLE END)
           / list_sum(list_transform(range(1, least(any_value(n.n), 10) + 1), lambda i: 1::DOUBLE / log2(i + 1))) AS ndcg
  FROM {run} r JOIN {name}_n n ON r.qid = n.qid LEFT JOIN (SELECT DISTINCT * FROM qrels) q ON q.qid = r.qid AND q.docid = r.docid
  GROUP BY {'r.' + by + ', ' if by else ''}r.qid
)"""


def summary(run: str) -> str:
    return f"""SELECT a.variant, round(coalesce(m.mrr, 0::DOUBLE), 4) AS mrr, round(coalesce(m.ndcg, 0::DOUBLE), 4) AS ndcg, a.n AS queries_evaluated
FROM (SELECT variant, count(DISTINCT qid) AS n FROM {run} GROUP BY variant) a
LEFT JOIN (SELECT variant, avg(rr) AS mrr, avg(ndcg) AS ndcg FROM each GROUP BY variant) m ON a.variant = m.variant"""


CG = f"""cg AS MATERIALIZED (
  SELECT p.docid, p.term, round(p.tf::DOUBLE / t.total, 8) AS probability FROM post p
  JOIN (SELECT docid, sum(tf)::DOUBLE AS total FROM post GROUP BY docid) t ON p.docid = t.docid WHERE p.docid IN (SELECT docid FROM edges)
)"""


def scaled(name: str, weights: str, top: float) -> str:
    return f"""{name}_r AS (SELECT ln(min(probability)) AS lo, ln(max(probability)) - ln(min(probability)) AS rg FROM {weights} WHERE probability > 0),
{name} AS MATERIALIZED (
  SELECT docid, term, round(round(CASE WHEN rg > 0 THEN (ln(probability) - lo) / rg * {top}::DOUBLE ELSE {top / 2}::DOUBLE END, 9))::INT + 1 AS scaled FROM {weights}, {name}_r WHERE probability > 0
)"""


def name_of(v: float) -> str:
    return f"{v:.2f}".replace(".", "_")


def alphas(kind: str) -> str:
    return "variants(variant, alpha) AS (VALUES " + ", ".join(f"('{kind}_alphanum_maxval10_alpha_{name_of(a)}', {a}::FLOAT)" for a in ALPHAS) + ")"


REWEIGHTED = """reweighted AS MATERIALIZED (
  SELECT v.variant, p.docid, p.term,
         CASE WHEN s.scaled IS NULL THEN greatest(1, p.tf::INT)
              ELSE greatest(1, round(round((v.alpha * p.tf::FLOAT)::DOUBLE + (1::DOUBLE - v.alpha::DOUBLE) * s.scaled::DOUBLE, 9))::INT) END AS tf
  FROM post p LEFT JOIN scaled s ON p.docid = s.docid AND p.term = s.term CROSS JOIN variants v
)"""

MODEL = f"""mpost AS MATERIALIZED (SELECT * FROM post WHERE NOT list_contains({listed(MODEL_STOP)}, term)),
coll AS MATERIALIZED (SELECT term, sum(tf) AS cf, sum(tf)::DOUBLE / (SELECT sum(tf)::DOUBLE FROM mpost) AS bg FROM mpost GROUP BY term),
models AS MATERIALIZED (
  SELECT p.docid, p.term, 0.6::DOUBLE * (p.tf::DOUBLE / l.dl) + (1::DOUBLE - 0.6::DOUBLE) * c.bg AS p, 0.6::DOUBLE * (p.tf::DOUBLE / l.dl - c.bg) AS extra
  FROM mpost p JOIN (SELECT docid, sum(tf)::DOUBLE AS dl FROM mpost GROUP BY docid) l ON p.docid = l.docid JOIN coll c ON p.term = c.term
)"""

LOG_TERMS = "log_terms AS MATERIALIZED (SELECT query, unnest(string_split(query, ' ')) AS term FROM (SELECT DISTINCT query FROM train))"

def rlm_ctes(pairs: str) -> str:
    """The relevance model of each pair (docid, query, times)."""
    return f"""asked AS (
  SELECT t.query, t.term AS t, count(*) AS qtf, coalesce(any_value(c.bg), 0.5::DOUBLE / (SELECT sum(tf)::DOUBLE FROM mpost)) AS bg_t
  FROM log_terms t LEFT JOIN coll c ON t.term = c.term WHERE NOT list_contains({listed(MODEL_STOP)}, t.term) GROUP BY t.query, t.term
),
pairs AS MATERIALIZED (
  SELECT docid, query, count(*) AS times FROM {pairs} GROUP BY docid, query
),
wanted AS MATERIALIZED (SELECT DISTINCT x.query, p.term FROM pairs x JOIN mpost p ON x.docid = p.docid),
own AS MATERIALIZED (SELECT f.query, f.docid, m.term, m.extra FROM fb f JOIN models m ON f.docid = m.docid),
n AS (SELECT query, count(DISTINCT docid) AS n FROM own GROUP BY query),
ob AS MATERIALIZED (SELECT o.* FROM own o JOIN asked a ON a.query = o.query AND a.t = o.term),
ow AS MATERIALIZED (SELECT o.* FROM own o JOIN wanted w ON w.query = o.query AND w.term = o.term),
sb AS (SELECT query, term AS t, sum(extra) AS b FROM ob GROUP BY query, term),
sa AS (SELECT query, term, sum(extra) AS a FROM ow GROUP BY query, term),
sx AS MATERIALIZED (SELECT ow.query, ow.term, ob.term AS t, sum(ow.extra * ob.extra) AS x FROM ow JOIN ob ON ow.query = ob.query AND ow.docid = ob.docid GROUP BY ow.query, ow.term, ob.term),
scores AS MATERIALIZED (
  SELECT w.query, w.term, sum(q.qtf * ln(greatest((n.n * c.bg * q.bg_t + c.bg * coalesce(sb.b, 0::DOUBLE) + q.bg_t * coalesce(sa.a, 0::DOUBLE) + coalesce(sx.x, 0::DOUBLE)) / (n.n * c.bg + coalesce(sa.a, 0::DOUBLE)), 1e-10::DOUBLE))) AS log_p
  FROM wanted w JOIN coll c ON w.term = c.term JOIN n ON n.query = w.query JOIN asked q ON q.query = w.query
  LEFT JOIN sa ON sa.query = w.query AND sa.term = w.term LEFT JOIN sb ON sb.query = w.query AND sb.t = q.t LEFT JOIN sx ON sx.query = w.query AND sx.term = w.term AND sx.t = q.t
  GROUP BY w.query, w.term
),
perq AS MATERIALIZED (
  SELECT x.docid, x.query, p.term, ln(c.cf / t.all_cf) + s.log_p AS log_weight, coalesce(fb.score, 0::DOUBLE) AS doc_score, x.times
  FROM pairs x JOIN mpost p ON x.docid = p.docid JOIN coll c ON c.term = p.term
  JOIN (SELECT p.docid, sum(c.cf)::DOUBLE AS all_cf FROM mpost p JOIN coll c ON p.term = c.term GROUP BY p.docid) t ON t.docid = x.docid
  JOIN scores s ON s.query = x.query AND s.term = p.term LEFT JOIN fb ON fb.query = x.query AND fb.docid = x.docid
),
whole AS (SELECT docid, sum(times) AS n, sum(doc_score * times) AS all_scores FROM (SELECT DISTINCT docid, query, doc_score, times FROM perq) GROUP BY docid)"""


RLM = rlm_ctes(f"(SELECT *, row_number() OVER (PARTITION BY docid ORDER BY line_no) AS nth FROM train) WHERE nth <= {QUERIES_PER_DOC}")
RLM_ALL = rlm_ctes("train")

SHARES = {
    "weighted_mean": "sum(CASE WHEN all_scores > 0 THEN doc_score * times / all_scores ELSE times::DOUBLE / n END * exp(log_weight))",
    "mean": "sum(times::DOUBLE / n * exp(log_weight))",
    "max": "max(exp(log_weight))",
}


def rlm(strategy: str) -> str:
    return f"rlm AS MATERIALIZED (SELECT docid, term, {SHARES[strategy]} AS probability FROM perq JOIN whole USING (docid) GROUP BY docid, term HAVING {SHARES[strategy]} > 0)"


FB = bm25("fb", "log_terms", "post", FEEDBACK, key="query")
RLM_BASE = (POST, CLICKS, SPLIT, MODEL, LOG_TERMS, FB, RLM)
SIM = "sim AS MATERIALIZED (SELECT x.docid AS d1, y.docid AS d2, sum(1::DOUBLE / g.n) AS s FROM core x JOIN core y ON x.query = y.query AND x.docid < y.docid JOIN (SELECT query, count(*)::DOUBLE AS n FROM core GROUP BY query) g ON g.query = x.query GROUP BY x.docid, y.docid)"
NEAR = """near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY round(s, 9) DESC, other DESC) AS nth
  FROM (SELECT d1 AS docid, d2 AS other, s FROM sim UNION ALL SELECT d2, d1, s FROM sim)) WHERE nth <= 10)"""


def walk(rounds: int) -> str:
    parts = ["""adj AS MATERIALIZED (SELECT k, src, dst, w / sum(w) OVER (PARTITION BY k, src) AS p FROM (
  SELECT 'q' AS k, query AS src, docid::VARCHAR AS dst, w FROM edges UNION ALL SELECT 'd', docid::VARCHAR, query, w FROM edges))""",
             "walk0 AS MATERIALIZED (SELECT DISTINCT 'q' AS kind, query AS node, 1::DOUBLE AS score FROM edges)"]
    for r in range(rounds):
        parts.append(f"""walk{r + 1} AS MATERIALIZED (SELECT kind, node, sum(score) AS score FROM (
  SELECT CASE WHEN w.kind = 'q' THEN 'd' ELSE 'q' END AS kind, a.dst AS node, (1::DOUBLE - 0.15::DOUBLE) * w.score * a.p AS score FROM walk{r} w JOIN adj a ON a.k = w.kind AND a.src = w.node
  UNION ALL SELECT kind, node, 0.15::DOUBLE FROM walk0) GROUP BY kind, node)""")
    return ",\n".join(parts)


VARIANT_RUN = (POST, TOPICS, CLICKS, SPLIT, EDGES, CG, scaled("scaled", "cg", 10.0), alphas("index_cg"), REWEIGHTED, bm25("run", "terms", "reweighted", 10, "variant"))

def signed(value: str, x: str = "") -> str:
    """Signed ranks of one metric; x keeps the names of two of them apart."""
    return f"""d{x} AS (SELECT v.variant, v.qid, round(b.{value} - v.{value}, 12) AS d FROM each v JOIN each b ON v.qid = b.qid AND b.variant = '{BASELINE}' WHERE v.variant <> '{BASELINE}'),
shared{x} AS (SELECT variant, count(*) AS n_queries FROM d{x} GROUP BY variant HAVING count(*) >= 10),
r{x} AS (SELECT *, count(*) OVER (PARTITION BY variant, abs(d)) AS ties, rank() OVER (PARTITION BY variant ORDER BY abs(d)) AS low FROM d{x} WHERE d <> 0),
u{x} AS (
  SELECT variant, count(*) AS n, sum(CASE WHEN d > 0 THEN low + (ties - 1) / 2.0::DOUBLE ELSE 0::DOUBLE END) AS plus, sum(CASE WHEN d < 0 THEN low + (ties - 1) / 2.0::DOUBLE ELSE 0::DOUBLE END) AS minus,
         sum(ties * ties - 1)::DOUBLE AS tied FROM r{x} GROUP BY variant
),
z{x} AS (
  SELECT s.variant, s.n_queries, coalesce(u.n, 0) AS n, least(plus, minus) AS w,
         (least(plus, minus) - u.n * (u.n + 1) / 4::DOUBLE) / nullif(sqrt(u.n::DOUBLE * (u.n + 1) * (2 * u.n + 1) / 24 - tied / 48), 0) AS z
  FROM shared{x} s LEFT JOIN u{x} u ON s.variant = u.variant
)"""


def tail(z: str) -> str:
    t = f"(1::DOUBLE / (1::DOUBLE + 0.5::DOUBLE * abs({z}) / sqrt(2::DOUBLE)))"
    poly = f"{ERFC[-1]}::DOUBLE"
    for c in reversed(ERFC[:-1]):
        poly = f"({poly} * {t} + ({c})::DOUBLE)"
    return f"{t} * exp(-{z} * {z} / 2::DOUBLE + {poly})"


def combined() -> str:
    rows = [f"('index_combined_alphanum_maxvalrlm10_maxvalcg5_a{name_of(a)}_b{name_of(b)}', {a}::FLOAT, {b}::FLOAT)" for a in (0.0, 0.5, 1.0) for b in BETAS if a + b <= 1 + 1e-6]
    return "variants(variant, alpha, beta) AS (VALUES " + ", ".join(rows) + ")"


RAW = """raw AS MATERIALIZED (
  SELECT page_id::VARCHAR AS docid, coalesce(url, '') AS url, regexp_replace(regexp_extract(coalesce(html, ''), '<title>(.*?)</title>', 1), '[\\t\\r\\n]', ' ', 'g') AS title,
         regexp_replace(coalesce(html, ''), '[\\r\\n]', ' ', 'g') AS body FROM pages
)"""
ANALYZED = f"analyzed AS (SELECT docid, array_to_string({toks('title')}, ' ') AS title, array_to_string({toks('body')}, ' ') AS body FROM raw)"
TEXT_IDS = "wide AS (SELECT 'D' || docid AS docid, term, probability FROM cg), own AS (SELECT 'D' || doc_id AS docid FROM documents WHERE lang = 'en')"


def form(word: str) -> str:
    """v and c for the letters of a word."""
    return f"list_reduce(string_split({word}, ''), lambda o, x: o || CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND right(o, 1) = 'c') THEN 'v' ELSE 'c' END, '')"


def size(word: str) -> str:
    return f"len(regexp_extract_all({form(word)}, 'v+c+'))"


def cut(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def closed(word: str) -> str:
    return f"(right({form(word)}, 3) = 'cvc' AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def ends(word: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"ends_with({word}, '{x}')" for x in suffixes) + ")"


def suffixes(rules, least: int, more: str = "") -> str:
    """The longest of the rules' suffixes goes where what's before it has more than `least` vowel runs; more: another condition for ion."""
    cases = []
    for old, new in sorted(rules, key=lambda r: -len(r[0])):
        base = cut("w", len(old))
        also = f" AND {ends(base, 's', 't')}" if old == "ion" else ""
        cases.append(f"WHEN ends_with(w, '{old}') THEN CASE WHEN {size(base)} > {least}{also} THEN {base} || '{new}' ELSE w END")
    return "CASE " + " ".join(cases) + " ELSE w END"


def porter(words: str) -> str:
    """CTEs that end in stems(word, stem), from a table of distinct words (column word)."""
    stripped = f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {size(cut('w', 3))} > 0 THEN {cut('w', 1)} ELSE w END
  WHEN base IS NULL OR NOT contains({form('base')}, 'v') THEN w WHEN {ends('base', 'at', 'bl', 'iz')} THEN base || 'e'
  WHEN length(base) > 1 AND right(base, 1) = left(right(base, 2), 1) AND right({form('base')}, 1) = 'c' THEN CASE WHEN right(base, 1) IN ('l', 's', 'z') THEN base ELSE {cut('base', 1)} END
  WHEN {size('base')} = 1 AND {closed('base')} THEN base || 'e' ELSE base END"""
    return f"""p1 AS (SELECT word, CASE WHEN {ends('word', 'sses', 'ies')} THEN {cut('word', 2)} WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN {cut('word', 1)} ELSE word END AS w FROM {words} WHERE length(word) > 2),
p2 AS (SELECT *, CASE WHEN ends_with(w, 'ed') THEN {cut('w', 2)} WHEN ends_with(w, 'ing') THEN {cut('w', 3)} END AS base FROM p1),
p3 AS (SELECT word, {stripped} AS w FROM p2),
p4 AS (SELECT word, CASE WHEN ends_with(w, 'y') AND contains({form(cut('w', 1))}, 'v') THEN {cut('w', 1)} || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT word, {suffixes(STEP_2, 0)} AS w FROM p4),
p6 AS (SELECT word, {suffixes(STEP_3, 0)} AS w FROM p5),
p7 AS (SELECT word, {suffixes([(x, '') for x in STEP_4], 1)} AS w FROM p6),
p8 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({size(cut('w', 1))} > 1 OR ({size(cut('w', 1))} = 1 AND NOT {closed(cut('w', 1))})) THEN {cut('w', 1)} ELSE w END AS w FROM p7),
stems AS MATERIALIZED (SELECT word, CASE WHEN ends_with(w, 'll') AND {size('w')} > 1 THEN {cut('w', 1)} ELSE w END AS stem FROM p8 UNION ALL SELECT word, word FROM {words} WHERE length(word) <= 2)"""


def chain(source: str, mode: str) -> str:
    """CTEs that end in done(key, text) from source(key, text): words, apostrophes, stop words, stems, apostrophes."""
    off = lambda x: f"regexp_replace({x}, '[''’‘]+$', '')"
    if mode == "english":
        words = "list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*'), lambda x: regexp_replace(lower(x), '[''’]s$', ''))"
        bare = "true"
    else:
        words = toks("text", {"symbol": SYMBOL, "alphanum": ALPHANUM}[mode])
        bare = "NOT regexp_matches(e.word, '[+#&.-]')"
    return f"""each AS MATERIALIZED (
  SELECT key, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word
  FROM (SELECT key, list_filter(list_transform({words}, lambda x: {off('x')}), lambda x: x <> '' AND NOT list_contains({listed(STOP)}, x)) AS ws FROM {source})
), vocabulary AS (SELECT DISTINCT word FROM each),
{porter('vocabulary')},
done AS (
  SELECT s.key, coalesce(t.text, '') AS text FROM {source} s LEFT JOIN (
    SELECT key, string_agg(x, ' ' ORDER BY pos) FILTER (x <> '') AS text FROM (SELECT e.key, e.pos, {off(f'CASE WHEN {bare} THEN stems.stem ELSE e.word END')} AS x FROM each e JOIN stems ON stems.word = e.word) GROUP BY key
  ) t ON t.key = s.key
)"""


def chained_documents(mode: str) -> str:
    return ctes("source AS (SELECT doc_id AS key, text FROM documents)", chain("source", mode)) + "SELECT key AS doc_id, text FROM done"


def all_sql() -> dict[str, str]:
    doc = "documents"
    debug = "(('0x' || substr(md5('42:' || docid || ':' || term), 1, 12))::BIGINT % 1000000)"
    return {
        "tokens_alphanum": f"SELECT doc_id AS docid, array_to_string({toks('text')}, ' ') AS text, len({toks('text')}) AS n FROM {doc}",
        "tokens_symbol": f"SELECT doc_id AS docid, array_to_string({toks('text', SYMBOL)}, ' ') AS text, len({toks('text', SYMBOL)}) AS n FROM {doc}",
        "stopword_filter": f"SELECT doc_id AS docid, array_to_string(list_filter({toks('text', SYMBOL)}, lambda x: NOT list_contains({listed(STOP)}, x)), ' ') AS text FROM {doc}",
        "click_tokenizer": f"""SELECT doc_id AS docid, array_to_string(w, ' ') AS words, array_to_string(list_filter(w, lambda x: NOT regexp_full_match(x, '[{DIGIT}]+')), ' ') AS without_numbers
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[{SPACE}]+'), lambda x: x <> '') AS w FROM documents)""",
        "postings": ctes(POST) + "SELECT * FROM post",
        "doc_stats": ctes(POST) + "SELECT docid, sum(tf)::BIGINT AS dl FROM post GROUP BY docid",
        "term_stats": ctes(POST) + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
        "collection_stats": ctes(POST) + "SELECT count(DISTINCT docid) AS n_docs, sum(tf)::BIGINT AS n_tokens, count(DISTINCT term) AS n_terms, round(sum(tf)::DOUBLE / count(DISTINCT docid), 6) AS avgdl FROM post",
        "tf_percentiles": ctes(POST) + "SELECT p::DOUBLE AS percent, round(v, 6) AS tf FROM (SELECT unnest([50, 75, 90, 95, 99, 99.9]) AS p, unnest(quantile_cont(tf::DOUBLE, [0.5, 0.75, 0.9, 0.95, 0.99, 0.999])) AS v FROM post)",
        "rebuilt_text": ctes(POST) + "SELECT docid, md5(string_agg(rtrim(repeat(term || ' ', tf)), ' ' ORDER BY term)) AS contents_md5 FROM post GROUP BY docid",
        "analyzed_corpus_rows": ctes(RAW, ANALYZED) + "SELECT docid, title, md5(body) AS body_md5, md5(title || ' ' || body) AS all_md5 FROM analyzed",
        "malformed_row_filter": """WITH l AS (SELECT doc_id, string_split(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS f FROM documents)
SELECT doc_id, count(*) FILTER (len(f) >= 4) AS n_good, count(*) FILTER (len(f) < 4) AS n_bad, sum(CASE WHEN len(f) >= 4 THEN length(array_to_string(f[4:], ' ')) ELSE 0 END)::BIGINT AS last_chars FROM l GROUP BY doc_id""",
        "bm25_topk": ctes(POST, TOPICS, bm25("run")) + "SELECT qid, docid, round(score, 6) AS score, rank FROM run",
        "topics": f"""WITH q AS (SELECT DISTINCT item_id AS qid, array_to_string({toks('text')}, ' ') AS query FROM benchmark)
SELECT qid, query, term, count(*)::DOUBLE AS n FROM (SELECT qid, query, unnest(string_split(query, ' ')) AS term FROM q WHERE query <> '') GROUP BY qid, query, term""",
        "qrels": ctes(QRELS) + "SELECT * FROM qrels",
        "corpus_semi_join": ctes(CLICKS) + "SELECT doc_id AS docid, lang, n_chars FROM documents WHERE doc_id IN (SELECT docid FROM clicks)",
        "missing_docs_anti": "SELECT DISTINCT l_partkey AS docid FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM documents)",
        "test_split": ctes(CLICKS, SPLIT) + "SELECT qid FROM test",
        "train_split": ctes(CLICKS, SPLIT) + "SELECT line_no, qid, query, docid FROM train",
        "test_qrels": ctes(CLICKS, SPLIT) + "SELECT line_no, qid, query, docid FROM clicks WHERE qid IN (SELECT qid FROM test)",
        "doc_query_lists": ctes(CLICKS) + "SELECT docid, string_agg(query, '|' ORDER BY line_no) AS queries, count(*) AS n FROM clicks GROUP BY docid",
        "first_queries": ctes(CLICKS) + f"SELECT docid, line_no, qid, nth FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY line_no) AS nth FROM clicks) WHERE nth <= {QUERIES_PER_DOC}",
        "busiest_documents": ctes(CLICKS) + "SELECT docid, count(*) AS n_queries FROM clicks WHERE docid IN (SELECT doc_id FROM documents) GROUP BY docid HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 20",
        "per_query_metrics": ctes(POST, TOPICS, QRELS, bm25("run"), per_query("each", "run")) + "SELECT qid, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM each",
        "evaluation_summary": ctes(POST, TOPICS, QRELS, bm25("plain"), "run AS (SELECT 'baseline' AS variant, * FROM plain)", per_query("each", "run", "variant")) + summary("run"),
        "click_edges": ctes(CLICKS, SPLIT, EDGES) + "SELECT * FROM edges",
        "two_core": ctes("sold AS (SELECT l_orderkey AS query, l_partkey AS docid FROM lineitem)", core("sold", 6)) + "SELECT query, docid FROM core",
        "adjacency": ctes(CLICKS, SPLIT, EDGES, walk(0)) + "SELECT k AS src_kind, src, dst, round(p, 6) AS p FROM adj",
        "page_rank": ctes(CLICKS, SPLIT, EDGES, walk(20)) + "SELECT kind, node, round(score, 6) AS score FROM walk20",
        "cg_weights": ctes(POST, CLICKS, SPLIT, EDGES, CG) + "SELECT docid, term, round(probability, 6) AS probability FROM cg",
        "cg_weights_uniform": ctes(POST, CLICKS, SPLIT, EDGES) + "SELECT docid, term, round(round(1::DOUBLE / count(*) OVER (PARTITION BY docid), 8), 6) AS probability FROM post WHERE docid IN (SELECT docid FROM edges)",
        "coclick_sim": ctes(CLICKS, SPLIT, EDGES, core("edges", 8), SIM) + "SELECT d1, d2, round(s, 6) AS s FROM sim",
        "coclick_topk": ctes(CLICKS, SPLIT, EDGES, core("edges", 8), SIM, NEAR) + "SELECT docid, other, round(s, 6) AS s, nth FROM near",
        "cg_expand": ctes(POST, CLICKS, SPLIT, EDGES, core("edges", 8), SIM, NEAR) + """,
mixed AS (
  SELECT n.docid, p.term, sum(n.s / a.s * (p.tf::DOUBLE / l.dl)) AS v FROM near n JOIN (SELECT docid, sum(s) AS s FROM near GROUP BY docid) a ON a.docid = n.docid
  JOIN post p ON p.docid = n.other JOIN (SELECT docid, sum(tf)::DOUBLE AS dl FROM post GROUP BY docid) l ON l.docid = n.other GROUP BY n.docid, p.term
)
SELECT docid, term, round(v / sum(v) OVER (PARTITION BY docid), 8) AS probability FROM mixed""",
        "collection_model": ctes(POST, MODEL) + "SELECT term, cf::BIGINT AS cf, round(bg, 9) AS bg FROM coll",
        "unigram_model": ctes(POST, MODEL) + "SELECT docid, term, round(p, 9) AS p FROM models",
        "feedback_docs": ctes(POST, CLICKS, SPLIT, LOG_TERMS, FB) + "SELECT query, docid, round(score, 6) AS score, rank FROM fb",
        "rlm_per_query": ctes(POST, CLICKS, SPLIT, MODEL, LOG_TERMS, FB, RLM_ALL) + "SELECT docid, query, term, round(log_weight, 6) AS log_weight, round(doc_score, 6) AS doc_score, times FROM perq",
        **{f"rlm_{s}": ctes(*RLM_BASE, rlm(s)) + "SELECT docid, term, round(ln(probability), 6) AS log_weight FROM rlm" for s in SHARES},
        "weight_range": ctes(POST, CLICKS, SPLIT, EDGES, CG) + "SELECT round(ln(min(probability)), 6) AS log_min, round(ln(max(probability)) - ln(min(probability)), 6) AS log_range FROM cg WHERE probability > 0",
        "scale_weights": ctes(POST, CLICKS, SPLIT, EDGES, CG, scaled("scaled", "cg", 10.0)) + "SELECT docid, term, scaled FROM scaled",
        "sorted_weights": ctes(POST, CLICKS, SPLIT, EDGES, CG) + "SELECT i.traversal_idx, cg.docid, cg.term, round(cg.probability, 6) AS probability FROM cg JOIN (SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS traversal_idx FROM (SELECT DISTINCT docid FROM post)) i ON i.docid = cg.docid",
        "reweight_cg_multi": ctes(POST, CLICKS, SPLIT, EDGES, CG, scaled("scaled", "cg", 10.0), alphas("index_cg"), REWEIGHTED) + "SELECT * FROM reweighted",
        "reweight_rlm_multi": ctes(*RLM_BASE, rlm("weighted_mean"), scaled("scaled", "rlm", 10.0), alphas("index_rlm"), REWEIGHTED) + "SELECT * FROM reweighted",
        "reweight_combined_multi": ctes(*RLM_BASE, EDGES, CG, rlm("weighted_mean"), scaled("rs", "rlm", 10.0), scaled("cs", "cg", 5.0), combined()) + """SELECT v.variant, p.docid, p.term,
  greatest(1, round(round((v.alpha * p.tf::FLOAT + v.beta * coalesce(r.scaled::FLOAT, p.tf::FLOAT))::DOUBLE + (1::DOUBLE - v.alpha::DOUBLE - v.beta::DOUBLE) * coalesce(c.scaled::FLOAT, p.tf::FLOAT)::DOUBLE, 9))::INT) AS tf
FROM post p LEFT JOIN rs r ON p.docid = r.docid AND p.term = r.term LEFT JOIN cs c ON p.docid = c.docid AND p.term = c.term CROSS JOIN variants v""",
        "reweighted_bm25": ctes(*VARIANT_RUN) + "SELECT variant, qid, docid, round(score, 6) AS score, rank FROM run",
        "variant_summary": ctes(*VARIANT_RUN, QRELS, per_query("each", "run", "variant")) + summary("run"),
        "wilcoxon_w_z": ctes(*VARIANT_RUN, QRELS, per_query("each", "run", "variant"), signed("ndcg")) + "SELECT variant, n_queries, n, round(w, 6) AS w, round(z, 6) AS z FROM z",
        "significance": ctes(*VARIANT_RUN, QRELS, per_query("each", "run", "variant"), signed("rr", "1"), signed("ndcg", "2")) + f"""SELECT variant, n_queries, round(p_mrr, 6) AS p_mrr, round(p_ndcg, 6) AS p_ndcg, p_mrr < a AS sig_mrr, p_ndcg < a AS sig_ndcg
FROM (SELECT z1.variant, z1.n_queries, {tail('z1.z')} AS p_mrr, {tail('z2.z')} AS p_ndcg, 0.05::DOUBLE / (SELECT count(DISTINCT variant) - 1 FROM each) AS a FROM z1 JOIN z2 ON z1.variant = z2.variant)""",
        "reweight_constant": ctes(POST) + "SELECT docid, term, 1 AS tf FROM post",
        "reweight_random": ctes(POST) + f"SELECT docid, term, ({debug} % 3)::INT + 1 AS tf FROM post",
        "reweight_weighted_random": ctes(POST) + f"SELECT docid, term, greatest(1, round(round(tf * (0.5::DOUBLE + {debug} / 1e6::DOUBLE), 9))::INT) AS tf FROM post",
        "porter_terms": ctes(POST, "vocabulary AS (SELECT DISTINCT term AS word FROM post)", porter("vocabulary")) + "SELECT word, stem FROM stems",
        "analyze_symbol_stemmed": chained_documents("symbol"),
        "analyze_english": chained_documents("english"),
        "sorted_text_weights": ctes(POST, CLICKS, SPLIT, EDGES, CG, TEXT_IDS) + "SELECT i.traversal_idx, wide.docid, wide.term, round(wide.probability, 6) AS probability FROM wide JOIN (SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS traversal_idx FROM own) i ON i.docid = wide.docid",
        "unplaced_weights": ctes(POST, CLICKS, SPLIT, EDGES, CG, TEXT_IDS) + "SELECT count(*) AS n_weights, count(DISTINCT docid) AS n_docs FROM wide WHERE docid NOT IN (SELECT docid FROM own)",
        "latest_weights": ctes(POST, CLICKS, SPLIT, EDGES) + "SELECT docid, term, round(round(1::DOUBLE / count(*) OVER (PARTITION BY docid), 8), 6) AS probability FROM post WHERE docid IN (SELECT docid FROM edges)",
        "rewritten_documents": ctes(POST, CLICKS, SPLIT, EDGES, CG, scaled("scaled", "cg", 10.0), alphas("index_cg"), REWEIGHTED) + """SELECT v.variant, d.doc_id AS docid, md5(coalesce(r.x, d.text, '')) AS contents_md5, r.x IS NOT NULL AS counted
FROM documents d CROSS JOIN variants v LEFT JOIN (SELECT variant, docid, string_agg(rtrim(repeat(term || ' ', tf)), ' ' ORDER BY term) AS x FROM reweighted GROUP BY variant, docid) r ON r.variant = v.variant AND r.docid = d.doc_id""",
        "read_raw_clicks": ctes(CLICKS) + "SELECT qid::VARCHAR AS qid, query, docid::VARCHAR AS docid, 'u' || chr(9) || line_no AS url FROM clicks",
        "read_clicked_ids": ctes(CLICKS) + "SELECT DISTINCT docid::VARCHAR AS docid FROM clicks",
        "read_raw_corpus": ctes(RAW) + "SELECT docid, url, title, md5(body) AS body_md5 FROM raw",
        "read_corpus_lines": ctes(RAW) + "SELECT docid, md5(concat_ws(chr(9), docid, url, title, body)) AS line_md5 FROM raw",
        "counted_clicks": ctes(CLICKS) + "SELECT (SELECT count(*) FROM clicks) AS n_good, (SELECT count(*) FROM events WHERE event_type <> 'click') AS n_bad",
        "clicks_after_line": ctes(CLICKS) + "SELECT line_no, qid, query, docid FROM clicks WHERE line_no > 500",
        "read_analyzed_corpus": ctes(RAW, ANALYZED) + "SELECT docid, title, md5(body) AS body_md5 FROM analyzed",
        "read_judgements": ctes(CLICKS, SPLIT) + "SELECT CASE WHEN qid IN (SELECT qid FROM test) THEN 'test' ELSE 'train' END AS split, qid::VARCHAR AS qid, query, docid::VARCHAR AS docid FROM clicks",
        "read_quoted_judgements": ctes(CLICKS, SPLIT) + "SELECT qid::VARCHAR AS qid, query, docid::VARCHAR AS docid FROM clicks WHERE qid IN (SELECT qid FROM test)",
        "read_train_ids": ctes(CLICKS, SPLIT) + "SELECT DISTINCT qid::VARCHAR AS qid FROM train",
        "read_click_graph": ctes(CLICKS, SPLIT) + "SELECT qid::VARCHAR AS qid, query, docid::VARCHAR AS docid FROM train",
        "read_split_ids": ctes(CLICKS, SPLIT) + "SELECT qid::VARCHAR AS qid FROM test",
        "read_json_corpus": f"SELECT doc_id::VARCHAR AS docid, md5(text) AS contents_md5 FROM documents WHERE regexp_matches(text, '[^{SPACE}]')",
        "stored_documents": "SELECT i.docid, md5(coalesce(d.text, '')) AS contents_md5, coalesce(d.text, '') = '' AS empty FROM (SELECT DISTINCT l_partkey AS k, l_partkey::VARCHAR AS docid FROM lineitem) i LEFT JOIN documents d ON d.doc_id = i.k",
        "read_runs": ctes(POST, TOPICS, bm25("run")) + f"SELECT 'baseline_alphanum' AS variant, run.qid::VARCHAR AS qid, array_to_string({toks('b.text')}, ' ') AS query, run.docid::VARCHAR AS docid, run.rank, round(run.score, 6) AS score FROM run JOIN benchmark b ON b.item_id = run.qid",
        "read_click_weights": ctes(POST, CLICKS, SPLIT, EDGES, CG) + "SELECT docid::VARCHAR AS docid, term, round(probability, 6) AS probability FROM cg",
        "read_model_weights": ctes(POST, CLICKS, SPLIT, EDGES) + "SELECT docid::VARCHAR AS docid, term, round(round(1::DOUBLE / count(*) OVER (PARTITION BY docid), 8), 6) AS probability FROM post WHERE docid IN (SELECT docid FROM edges)",
        "read_sorted_weights": ctes(POST, CLICKS, SPLIT, EDGES, CG) + "SELECT docid::VARCHAR AS docid, term, round(probability, 6) AS probability FROM cg",
        "read_results": ctes(POST, TOPICS, QRELS, bm25("plain"), "run AS (SELECT 'baseline' AS variant, * FROM plain)", per_query("each", "run", "variant")) + summary("run"),
        "read_index": ctes(POST) + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
        "queries_per_document": ctes(CLICKS) + "SELECT min(n) AS n_min, max(n) AS n_max, round(avg(n), 6) AS n_mean FROM (SELECT docid, count(*) AS n FROM clicks GROUP BY docid)",
        "preprocess_clicks": ctes(CLICKS, "source AS (SELECT DISTINCT query AS key, query AS text FROM clicks)", chain("source", "symbol")) + "SELECT c.qid::VARCHAR AS qid, d.text AS query, c.docid::VARCHAR AS docid FROM clicks c JOIN done d ON d.key = c.query WHERE d.text <> ''",
        "preprocess_corpus": ctes(RAW, "source AS (SELECT DISTINCT x AS key, x AS text FROM (SELECT title AS x FROM raw UNION ALL SELECT body FROM raw))", chain("source", "alphanum"))
        + "SELECT r.docid, t.text AS title, md5(b.text) AS body_md5, (SELECT count(*) FROM raw) AS n_good, 0::BIGINT AS n_bad FROM raw r JOIN done t ON t.key = r.title JOIN done b ON b.key = r.body",
    }
