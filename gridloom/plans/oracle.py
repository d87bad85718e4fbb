"""Each query's result stated as SQL over the same tables, independent of the operators."""

from __future__ import annotations

from gridloom.functions.text import STOP_WORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_CUT = "chr(1)"


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    """One statement of named parts, each with what it needs before it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in _NEEDS.get(name, ()):
            need(other)
        order.append(name)

    for p in parts:
        need(p)
    return f"WITH {'RECURSIVE ' * (recursive or 'spans' in order)}" + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in order) + "\n" + select


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: NOT list_contains({_STOP}, t))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _discount(r: str) -> str:
    return f"CASE WHEN {r} <= 1 THEN 1.0 ELSE 1 / log2({r}) END"


def _ideal(n: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, least({n}, 10)::BIGINT + 1), lambda i: {_discount('i')})), 0.0)"


_EMBED = "list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)"
_COUNTS = "list_transform(range(64), lambda i: len(list_filter(b, lambda y: y = i))::DOUBLE)"
_UNIT = "list_transform(c, lambda x: CASE WHEN list_inner_product(c, c) > 0 THEN x / sqrt(list_inner_product(c, c)) ELSE 0.0 END)"
_FINE = "len({0}) = 64 AND len(list_filter({0}, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter({0}, lambda v: v <> 0)) > 0"

_PARTS = {
    "pages": "SELECT page_id, title, content FROM page WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY crawled_at DESC NULLS LAST) = 1",
    "passages": "SELECT * FROM passage QUALIFY row_number() OVER (PARTITION BY passage_id) = 1",
    # vectors
    "vq": "SELECT vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0",
    "products": "SELECT q, vec_id, list_inner_product(e, embedding::DOUBLE[]) AS score FROM vq, embeddings",
    # the log
    "ops": "SELECT DISTINCT scenario, seq, op, batch FROM manifest",
    "rows_": """SELECT batch, op, vec_id, min(pos) AS pos, arg_max_null(embedding, pos) AS embedding FROM changelog WHERE op = 'insert' AND vec_id IS NOT NULL GROUP BY batch, op, vec_id
  UNION ALL SELECT DISTINCT batch, op, vec_id, pos, NULL FROM changelog WHERE op = 'delete' AND vec_id IS NOT NULL""",
    "log": "SELECT scenario, seq, pos, op, vec_id, embedding FROM rows_ JOIN ops USING (batch, op) WHERE batch IS NOT NULL",
    "seen": "SELECT *, lag(op) OVER (PARTITION BY scenario, vec_id ORDER BY seq, pos) AS before FROM log",
    "status": "SELECT * EXCLUDE before, CASE WHEN op = 'insert' THEN before IS NULL OR before = 'delete' ELSE coalesce(before = 'insert', false) END AS succeeded FROM seen",
    "results": """SELECT scenario, seq, op, coalesce(list(vec_id ORDER BY pos, vec_id) FILTER (succeeded), []) AS succeeded, coalesce(list(vec_id ORDER BY pos, vec_id) FILTER (NOT succeeded), []) AS failed
  FROM status GROUP BY scenario, seq, op""",
    "lives": """SELECT scenario, vec_id, embedding, seq AS born, died FROM (SELECT *, lead(seq) OVER (PARTITION BY scenario, vec_id ORDER BY seq, pos) AS died FROM status WHERE succeeded)
  WHERE op = 'insert'""",
    "initial": "SELECT vec_id FROM rows_ WHERE op = 'insert' AND batch = 'scenario_000/op_0000_insert.npy'",
    # texts
    "sentences": rf"""SELECT page_id, {_strip("coalesce(title, '')")} AS title, list_filter(list_transform(string_split(regexp_replace(coalesce(content, ''), '([.!?])\s+', '\1' || {_CUT}, 'g'), {_CUT}), lambda s: {_strip('s')}), lambda s: s <> '') AS s FROM pages""",
    "units": "SELECT page_id, title, CASE WHEN len(s) > 0 THEN s ELSE [CASE WHEN coalesce(title, '') <> '' THEN title ELSE page_id::VARCHAR END] END AS s FROM sentences",
    "docs": f"SELECT page_id, {_tokens('coalesce(title, ' + chr(39) * 2 + ') || ' + chr(39) + ' ' + chr(39) + ' || coalesce(content, ' + chr(39) * 2 + ')')} AS tokens FROM pages",
    "lens": "SELECT page_id, len(tokens)::BIGINT AS doc_len FROM docs",
    "tf": "SELECT page_id, term, least(count(*), 65535)::BIGINT AS tf FROM (SELECT page_id, unnest(tokens) AS term FROM docs) GROUP BY ALL",
    "vocab": "SELECT term, count(*) AS df, ln(((SELECT count(*) FROM pages) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY term HAVING count(*) > 1",
    "terms": f"SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({_tokens('query')}) AS term FROM search_query)",
    "lexical": """SELECT query_id, page_id, sum(idf * tf * 3.0 / (tf + 2.0 * doc_len / (SELECT avg(doc_len) FROM lens))) AS score
  FROM terms JOIN vocab USING (term) JOIN tf USING (term) JOIN lens USING (page_id) GROUP BY ALL""",
    "lexical_top": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM lexical QUALIFY rank <= 10",
    "found_numbers": r"""SELECT query_id, unnest(range(len(d))) AS grp, unnest(d) AS d, unnest(p) AS p FROM
  (SELECT query_id, regexp_extract_all(lower(query), '\b(\d{1,4})(s?)\b', 1) AS d, regexp_extract_all(lower(query), '\b(\d{1,4})(s?)\b', 2) AS p FROM search_query)""",
    "number_terms": """SELECT query_id, grp, unnest(CASE WHEN p = 's' AND len(d) = 4 AND d LIKE '%0' THEN list_transform(range(10), lambda i: (d::INT + i)::VARCHAR) ELSE [d] END) AS term FROM found_numbers""",
    "number_best": "SELECT query_id, grp, max(idf) AS idf FROM number_terms JOIN vocab USING (term) GROUP BY ALL",
    "numbers": """SELECT query_id, page_id, sum(idf) AS score FROM (SELECT DISTINCT query_id, grp, page_id FROM number_terms JOIN vocab USING (term) JOIN tf USING (term)) JOIN number_best USING (query_id, grp) GROUP BY ALL""",
    # dense
    "p_emb": f"SELECT passage_id, granularity, page_id, chunk_id, {_UNIT} AS e FROM (SELECT *, {_COUNTS} AS c FROM (SELECT *, {_EMBED.format(x='text')} AS b FROM passages))",
    "q_emb": f"SELECT query_id, {_UNIT} AS e FROM (SELECT *, {_COUNTS} AS c FROM (SELECT *, {_EMBED.format(x='query')} AS b FROM search_query))",
    "dense": """SELECT query_id, granularity, page_id, max(s) AS best, max(s) FILTER (chunk_id = 0) AS lead
  FROM (SELECT query_id, granularity, page_id, chunk_id, list_inner_product(q.e, p.e) AS s FROM q_emb q, p_emb p) GROUP BY ALL""",
    "z": """SELECT query_id, granularity, page_id, (best - avg(best) OVER w) / greatest(stddev_pop(best) OVER w, 1e-9) AS z_best, (lead - avg(lead) OVER w) / greatest(stddev_pop(lead) OVER w, 1e-9) AS z_lead
  FROM dense WINDOW w AS (PARTITION BY query_id, granularity)""",
    "lex_m": "SELECT query_id, sum(score) / n AS m, greatest(sqrt(greatest(sum(score * score) / n - (sum(score) / n) ** 2, 0)), 1e-9) AS sd FROM lexical, (SELECT count(*) AS n FROM pages) GROUP BY query_id, n",
    "num_m": "SELECT query_id, sum(score) / n AS m, greatest(sqrt(greatest(sum(score * score) / n - (sum(score) / n) ** 2, 0)), 1e-9) AS sd FROM numbers, (SELECT count(*) AS n FROM pages) GROUP BY query_id, n",
    "fused": """SELECT query_id, page_id, d + coalesce((coalesce(l.score, 0) - lm.m) / lm.sd, 0) + 2.5 * coalesce((coalesce(n.score, 0) - nm.m) / nm.sd, 0) AS score
  FROM (SELECT query_id, page_id, sum(z_best + 0.8 * coalesce(z_lead, 0)) AS d FROM z GROUP BY ALL)
  LEFT JOIN lexical l USING (query_id, page_id) LEFT JOIN numbers n USING (query_id, page_id) LEFT JOIN lex_m lm USING (query_id) LEFT JOIN num_m nm USING (query_id)""",
    # entity clusters
    "leads": f"SELECT page_id, min(embedding)::DOUBLE[64] AS e FROM passages WHERE granularity = 100 AND chunk_id = 0 AND {_FINE.format('embedding')} GROUP BY page_id",
    "pairs": "SELECT a.page_id AS a, b.page_id AS b, round(array_cosine_similarity(a.e, b.e), 9) AS similarity FROM leads a JOIN leads b ON a.page_id < b.page_id WHERE round(array_cosine_similarity(a.e, b.e), 9) > 0.75",
    "reach": "SELECT a, b FROM (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs) UNION SELECT r.a, p.b FROM reach r JOIN (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs) p ON r.b = p.a",
    "labels": "SELECT page_id, least(page_id, coalesce(min(b), page_id)) AS cluster_id FROM pages LEFT JOIN reach ON a = page_id GROUP BY page_id",
    "candidates": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS r FROM fused QUALIFY r <= 200",
    "members": "SELECT *, row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY r) AS m FROM candidates JOIN labels USING (page_id)",
    "weighed": "SELECT *, round(sum(CASE WHEN m <= 2 THEN score END) OVER c, 9) AS cs, min(r) OVER c AS f FROM members WINDOW c AS (PARTITION BY query_id, cluster_id)",
    "regrouped": "SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY cs DESC, f, m) AS rank FROM weighed QUALIFY rank <= 10",
    "asks": r"SELECT query_id, regexp_matches(coalesce(query, ''), '(?i)\b(links|connect|together|learned about)\b') AS flag FROM search_query",
    # evaluation
    "gains": "SELECT query_id, rank, CASE WHEN list_contains(relevant, page_id) THEN 1.0 ELSE 0.0 END AS gain FROM lexical_top JOIN search_query USING (query_id)",
    "ideals": f"SELECT query_id, query, relevant, {_ideal('len(list_distinct(relevant))')} AS ideal FROM search_query",
    "ndcgs": f"SELECT query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0.0 END AS ndcg FROM ideals LEFT JOIN (SELECT query_id, sum(gain * {_discount('rank')}) AS dcg FROM gains GROUP BY query_id) USING (query_id)",
}
_NEEDS = {
    "products": ["vq"], "rows_": [], "log": ["rows_", "ops"], "seen": ["log"], "status": ["seen"], "results": ["status"], "lives": ["status"], "initial": ["rows_"],
    "sentences": ["pages"], "units": ["sentences"], "docs": ["pages"], "lens": ["docs"], "tf": ["docs"], "vocab": ["pages", "tf"], "lexical": ["terms", "vocab", "tf", "lens"], "lexical_top": ["lexical"],
    "number_terms": ["found_numbers"], "number_best": ["number_terms", "vocab"], "numbers": ["number_best", "tf"], "p_emb": ["passages"], "dense": ["p_emb", "q_emb"], "z": ["dense"],
    "lex_m": ["lexical", "pages"], "num_m": ["numbers", "pages"], "fused": ["z", "lexical", "numbers", "lex_m", "num_m"], "leads": ["passages"], "pairs": ["leads"], "reach": ["pairs"], "labels": ["pages", "reach"],
    "candidates": ["fused"], "members": ["candidates", "labels"], "weighed": ["members"], "regrouped": ["weighed"], "gains": ["lexical_top"], "ndcgs": ["ideals", "gains"],
}


def _fold(target: int, n: str = "") -> str:
    """Passages by a recursion over sentences: from every row the next sentence joins the open passage or closes it."""
    words = rf"len(string_split(regexp_replace({_strip('x')}, '\s+', ' ', 'g'), ' '))"
    return f"""own{n} AS (SELECT page_id, title, s, list_transform(s, lambda x: CASE WHEN {_strip('x')} = '' THEN 0 ELSE {words} END) AS w FROM units),
fold{n} AS (SELECT page_id, 0 AS i, 0 AS st, 0::BIGINT AS acc, NULL::INT AS cs, NULL::INT AS ce FROM own{n}
  UNION ALL SELECT f.page_id, i + 1,
    CASE WHEN acc + w[i + 1] >= {target} THEN CASE WHEN w[i + 1] <= {target // 2} THEN i ELSE i + 1 END ELSE st END,
    CASE WHEN acc + w[i + 1] >= {target} THEN CASE WHEN w[i + 1] <= {target // 2} THEN w[i + 1] ELSE 0 END ELSE acc + w[i + 1] END,
    CASE WHEN acc + w[i + 1] >= {target} THEN st END, CASE WHEN acc + w[i + 1] >= {target} THEN i END
  FROM fold{n} f JOIN own{n} USING (page_id) WHERE i < len(s)),
spans{n} AS (SELECT page_id, cs, ce, i FROM fold{n} WHERE cs IS NOT NULL UNION ALL SELECT page_id, st, i - 1, i + 1 FROM fold{n} JOIN own{n} USING (page_id) WHERE i = len(s) AND acc > 0),
chunks{n} AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS chunk_id, CASE WHEN title <> '' THEN title || '. ' ELSE '' END || array_to_string(s[cs + 1:ce + 1], ' ') AS text
  FROM spans{n} JOIN own{n} USING (page_id))"""


def _chunks(target: int, title: str = "title") -> str:
    return f"""WITH RECURSIVE pages AS (SELECT page_id, {title} AS title, content FROM ({_PARTS['pages']})), sentences AS ({_PARTS['sentences']}), units AS ({_PARTS['units']}),
{_fold(target)} SELECT page_id, chunk_id, text FROM chunks"""


_HALF = "list_transform({0}, lambda v: CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE round_even(v / pow(2, greatest(floor(log2(abs(v))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(v))), -14) - 10) END)"


def _corpus() -> str:
    """The whole of `hybrid_search` over passages that are made from the pages."""
    own = {
        "passages": "SELECT NULL AS passage_id, 100 AS granularity, page_id, chunk_id, text FROM chunks100 UNION ALL SELECT NULL, 150, page_id, chunk_id, text FROM chunks150",
        "p_emb": f"SELECT * EXCLUDE e, {_HALF.format('e')} AS e FROM ({_PARTS['p_emb']})",
        "leads": "SELECT page_id, e::DOUBLE[64] AS e FROM p_emb WHERE granularity = 100 AND chunk_id = 0 AND list_inner_product(e, e) > 0",
    }
    names = "docs lens tf vocab terms lexical found_numbers number_terms number_best numbers passages p_emb q_emb dense z lex_m num_m fused leads pairs reach labels candidates members weighed regrouped asks".split()
    rest = ",\n".join(f"{x} AS ({own.get(x, _PARTS[x])})" for x in names)
    head = f"pages AS ({_PARTS['pages']}), sentences AS ({_PARTS['sentences']}), units AS ({_PARTS['units']}),\n{_fold(100, n='100')},\n{_fold(150, n='150')}"
    return f"WITH RECURSIVE {head},\n{rest}\n{_ANSWERS}"


_ANSWERS = """SELECT query_id, page_id, r AS rank FROM candidates JOIN asks USING (query_id) WHERE NOT flag AND r <= 10
UNION ALL SELECT query_id, page_id, rank FROM regrouped JOIN asks USING (query_id) WHERE flag"""


def _top(where: str = "", k: int = 10) -> str:
    return f"SELECT q, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM products {where} QUALIFY rank <= {k}"


# an index that never removes what it holds
_STALE = f"""stale AS (SELECT * EXCLUDE (succeeded), succeeded AS t, CASE WHEN op = 'insert' THEN n = 0 ELSE n > 0 END AS g
  FROM (SELECT *, count(*) FILTER (op = 'insert') OVER (PARTITION BY scenario, vec_id ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM status)),
ids AS (SELECT scenario, seq, op, vec_id, bool_or(t)::INT AS ts, bool_or(NOT t)::INT AS tf, bool_or(g)::INT AS gs, bool_or(NOT g)::INT AS gf, count(*) AS items FROM stale GROUP BY ALL),
mutations AS (SELECT scenario, seq, op, sum(items) AS items, 0.5 * (CASE WHEN sum(greatest(ts, gs)) = 0 THEN 1.0 ELSE sum(least(ts, gs)) / sum(greatest(ts, gs)) END
  + CASE WHEN sum(greatest(tf, gf)) = 0 THEN 1.0 ELSE sum(least(tf, gf)) / sum(greatest(tf, gf)) END) AS score FROM ids GROUP BY ALL),
times AS (SELECT DISTINCT scenario, seq FROM ops WHERE op NOT IN ('insert', 'delete')),
kept AS (SELECT scenario, vec_id, embedding, seq AS born, NULL::INT AS died FROM stale WHERE op = 'insert' AND g),
{{truth}}, {{got}},
per AS (SELECT t.scenario, t.seq, t.q, count(g.vec_id) / count(*) AS r FROM truth t LEFT JOIN got g ON g.scenario = t.scenario AND g.seq = t.seq AND g.q = t.q AND g.vec_id = t.vec_id
  AND g.rank <= (SELECT count(*) FROM truth x WHERE x.scenario = t.scenario AND x.seq = t.seq AND x.q = t.q) GROUP BY ALL),
recalls AS (SELECT scenario, seq, (coalesce(sum(r), 0) + (SELECT count(*) FROM vq) - count(q)) / (SELECT count(*) FROM vq) AS recall, (SELECT count(*) FROM vq) AS n_queries FROM times LEFT JOIN per USING (scenario, seq) GROUP BY scenario, seq)"""
_BEST = """{0} AS (SELECT scenario, o.seq, q, vec_id, row_number() OVER (PARTITION BY scenario, o.seq, q ORDER BY round(list_inner_product(e, embedding::DOUBLE[]), 9) DESC, vec_id) AS rank
  FROM times o JOIN (SELECT * FROM {1} WHERE {2}) l USING (scenario), vq WHERE born < o.seq AND (died IS NULL OR died > o.seq) QUALIFY rank <= 10)"""
_STALE = _STALE.replace("{truth}", _BEST.format("truth", "lives", _FINE.format("embedding"))).replace("{got}", _BEST.format("got", "kept", _FINE.format("embedding")))
_SUM = "coalesce(sum(score * items) FILTER (op = '{0}'), 0.0) / greatest(coalesce(sum(items) FILTER (op = '{0}'), 0), 1)"


def _stale(select: str) -> str:
    return _with("status", "lives", "ops", "vq", select="").rstrip() + ",\n" + _STALE + "\n" + select


# vectors of `_played` after its three calls
_KEPT = """SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda v: -v) ELSE embedding END::DOUBLE[] AS e FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 3 = 0"""

ORACLE: dict[str, str] = {
    "vec_topk": _with("products", select=_top()),
    "vec_topk_sql": _with("products", select=_top()),
    "vec_topk_after_delete": _with("products", select=_top("WHERE vec_id % 7 <> 0")),
    "vec_query_dedup": _with("products", select=f"SELECT q + d AS q, rank, vec_id, score FROM ({_top(k=5)}), (VALUES (0), (1000000)) t(d)"),
    "vec_insert_status": _with("initial", select="SELECT batch, pos, vec_id, vec_id NOT IN (SELECT vec_id FROM initial) AS succeeded FROM rows_ WHERE op = 'insert'"),
    "vec_delete_status": _with("initial", select="SELECT batch, pos, vec_id, vec_id IN (SELECT vec_id FROM initial) AND row_number() OVER (PARTITION BY vec_id ORDER BY batch, pos) = 1 AS succeeded FROM rows_ WHERE op = 'delete'"),
    "vec_replay_status": _with("status", select="SELECT scenario, seq, pos, vec_id, op, succeeded FROM status"),
    "vec_replay_results": _with("results", select="SELECT scenario, seq, op, succeeded, failed FROM results"),
    "vec_replay_search": _with("lives", "vq", select=f"""SELECT scenario, seq, q, row_number() OVER (PARTITION BY scenario, seq, q ORDER BY round(s, 9) DESC, vec_id) AS rank, vec_id, round(s, 6) AS score
FROM (SELECT scenario, o.seq, q, vec_id, list_inner_product(e, embedding::DOUBLE[]) AS s FROM (SELECT DISTINCT scenario, seq FROM ops WHERE op NOT IN ('insert', 'delete')) o
  JOIN (SELECT * FROM lives WHERE {_FINE.format('embedding')}) l USING (scenario), vq WHERE born < o.seq AND (died IS NULL OR died > o.seq)) QUALIFY rank <= 10"""),
    "vec_half": """SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE
  round(round_even(v / pow(2, greatest(floor(log2(abs(v))), -14) - 10), 0) * pow(2, greatest(floor(log2(abs(v))), -14) - 10), 9) END) AS embedding FROM embeddings""",
    "jaccard_scores": _with("results", select="""SELECT scenario, seq, round(CASE WHEN n = 0 THEN 1 ELSE len(list_distinct(succeeded)) / n END, 6) AS j_succeeded, round(CASE WHEN n = 0 THEN 1 ELSE len(list_distinct(failed)) / n END, 6) AS j_failed
FROM (SELECT *, len(list_distinct(list_concat(succeeded, failed))) AS n FROM results)"""),
    "functional_score": _stale(f"""SELECT scenario, round(i, 6) AS insert_score, round(d, 6) AS delete_score, round(s, 6) AS search_score, round(0.5 * s + 0.3 * i + 0.2 * d, 6) AS functional
FROM (SELECT scenario, {_SUM.format('insert')} AS i, {_SUM.format('delete')} AS d FROM mutations GROUP BY scenario) JOIN (SELECT scenario, coalesce(sum(recall * n_queries) / greatest(sum(n_queries), 1), 0.0) AS s
  FROM (SELECT DISTINCT scenario FROM mutations) LEFT JOIN recalls USING (scenario) GROUP BY scenario) USING (scenario)"""),
    "search_recall": _stale("SELECT scenario, seq, round(recall, 6) AS recall, n_queries FROM recalls"),
    "vec_index_status": """SELECT 0 AS call, vec_id, true AS succeeded FROM embeddings UNION ALL SELECT 1, vec_id, true FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT 1, 1000000000, false
UNION ALL SELECT 2, vec_id, vec_id % 7 = 0 FROM embeddings WHERE vec_id % 3 = 0""",
    "vec_index_search": f"""WITH vq AS ({_PARTS['vq']}), kept AS ({_KEPT}), products AS (SELECT q, vec_id, list_inner_product(vq.e, kept.e) AS score FROM vq, kept) {_top(k=70)}""",
    "vec_naive_search": _with("products", select=_top()),
    "corpus_scan": _with("pages", select="SELECT page_id, coalesce(title, '') AS title, coalesce(content, '') AS content FROM pages"),
    "query_scan": "SELECT query_id, query, 2 * len(relevant) AS n_list, list_sort(list_distinct(relevant)) AS relevant FROM search_query",
    "batch_scan": _with("rows_", select="SELECT batch, op, pos, vec_id, coalesce(len(embedding), 0) AS n FROM rows_"),
    "operation_scan": _with("ops", select="SELECT op, batch, 64 AS dim, count(*) AS n FROM ops GROUP BY ALL"),
    "matrix_round_trip": "SELECT vec_id, list_transform(embedding, lambda v: round(v::DOUBLE, 6)) AS embedding FROM embeddings",
    "postings_round_trip": _with("vocab", "lens", select="SELECT term, page_id, tf, df, doc_len FROM tf JOIN vocab USING (term) JOIN lens USING (page_id)"),
    "live_table": """WITH rows_ AS (SELECT DISTINCT vec_id, op, logged_at, pos, embedding FROM changelog WHERE vec_id IS NOT NULL),
days AS (SELECT d, ntile(3) OVER (ORDER BY d) AS part FROM (SELECT DISTINCT date_trunc('day', logged_at) AS d FROM changelog)),
parts AS (SELECT r.*, part FROM rows_ r JOIN days ON d = date_trunc('day', logged_at)),
ends AS (SELECT *, max((part, logged_at, pos)) FILTER (op = 'delete') OVER (PARTITION BY vec_id) AS gone FROM parts)
SELECT vec_id, len(arg_min(embedding, (part, logged_at, pos))) AS n FROM ends WHERE op = 'insert' AND embedding IS NOT NULL AND (gone IS NULL OR (part, logged_at, pos) > gone) GROUP BY vec_id""",
    "corpus_search": _corpus(),
    "runtime_multiplier": "SELECT doc_id, CASE WHEN n_chars / 1000.0 <= 0.5 THEN 1.0 WHEN n_chars / 1000.0 <= 1 THEN 0.9 WHEN n_chars / 1000.0 <= 2 THEN 0.75 ELSE 0.5 END::DOUBLE AS multiplier FROM documents",
    "recall_at_k": _with("lexical_top", select="""SELECT query_id, round(CASE WHEN n = 0 THEN 1.0 ELSE len(list_intersect(coalesce(result, [])[:n], relevant[:n])) / n END, 6) AS recall
FROM (SELECT query_id, relevant, least(10, len(relevant)) AS n, result FROM search_query LEFT JOIN (SELECT query_id, list(page_id ORDER BY rank) AS result FROM lexical_top GROUP BY query_id) USING (query_id))"""),
    "page_id_normalize": _with("pages", select="SELECT len(page_id::VARCHAR) + 3 AS raw_length, page_id FROM pages"),
    "entry_text": _with("pages", select=f"""SELECT page_id, t AS titled, {_strip("CASE WHEN t AND coalesce(title, '') <> '' THEN title || chr(10) || chr(10) ELSE '' END || coalesce(content, '')")} AS entry FROM pages, (VALUES (true), (false)) v(t)"""),
    "sentence_split": _with("sentences", select="SELECT page_id, unnest(range(len(s))) AS sent_id, unnest(s) AS sentence FROM sentences"),
    "word_count": _with("pages", select=rf"SELECT page_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n_words FROM (SELECT page_id, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g')) AS t FROM pages)"),
    "chunk_w100": _chunks(100),
    "chunk_w150": _chunks(150),
    "chunk_untitled": _chunks(100, "CASE WHEN page_id % 2 = 0 THEN '  ' ELSE ' ' || chr(9) || coalesce(title, '') || ' ' END"),
    "hash_embeddings": _with("p_emb", select="SELECT passage_id, list_transform(e, lambda x: round(x, 6)) AS embedding FROM p_emb"),
    "tokenize": _with("docs", select="SELECT page_id, tokens FROM docs"),
    "doc_length": _with("lens", select="SELECT page_id, doc_len FROM lens"),
    "term_freq": _with("tf", select="SELECT page_id, term, tf FROM tf"),
    "vocab_idf": _with("vocab", select="SELECT term, df, round(idf, 6) AS idf FROM vocab"),
    "postings": _with("vocab", select="SELECT term, page_id, tf FROM tf JOIN vocab USING (term)"),
    "bm25_score": _with("lexical", select="SELECT query_id, page_id, round(score, 6) AS score FROM lexical"),
    "bm25_topk": _with("lexical_top", select="SELECT query_id, rank, page_id, round(score, 6) AS score FROM lexical_top"),
    "number_groups": _with("number_terms", select="SELECT query_id, grp, term FROM number_terms"),
    "number_score": _with("numbers", select="SELECT query_id, page_id, round(score, 6) AS score FROM numbers"),
    "connective_flag": _with("asks", select="SELECT query_id, flag FROM asks"),
    "dense_max": _with("dense", select="SELECT query_id, granularity, page_id, round(best, 6) AS best FROM dense"),
    "dense_lead": _with("dense", select="SELECT query_id, granularity, page_id, round(lead, 6) AS lead FROM dense WHERE lead IS NOT NULL"),
    "zscore_dense": _with("z", select="SELECT query_id, granularity, page_id, round(z_best, 6) AS z_best, round(z_lead, 6) AS z_lead FROM z"),
    "zscore_sparse": _with("lex_m", select="SELECT query_id, page_id, round((score - m) / sd, 6) AS z FROM lexical JOIN lex_m USING (query_id) UNION ALL SELECT query_id, NULL, round(-m / sd, 6) FROM lex_m"),
    "fusion_score": _with("fused", select="SELECT query_id, page_id, round(score, 6) AS score FROM fused"),
    "fusion_topk": _with("fused", select="SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank, page_id, round(score, 6) AS score FROM fused QUALIFY rank <= 10"),
    "sim_pairs": _with("pairs", select="SELECT a, b, round(similarity, 6) AS similarity FROM pairs"),
    "clusters": _with("labels", select="SELECT page_id, cluster_id FROM labels", recursive=True),
    "connected_pairs": _with("reach", select="SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a", recursive=True),
    "cluster_rerank": _with("regrouped", select="SELECT query_id, page_id, rank FROM regrouped", recursive=True),
    "hybrid_search": _with("regrouped", "asks", select=_ANSWERS, recursive=True),
    "dcg": _with("gains", select=f"SELECT query_id, round(sum(gain * {_discount('rank')}), 6) AS dcg FROM gains GROUP BY query_id"),
    "ndcg_at_k": _with("ndcgs", select="SELECT query_id, round(ndcg, 6) AS ndcg FROM ndcgs"),
    "mean_ndcg": _with("ndcgs", select="SELECT count(*) AS n_queries, round(coalesce(avg(ndcg), 0), 6) AS mean_ndcg FROM ndcgs"),
    "oracle_ceiling": _with("ideals", select=f"""SELECT count(*) AS n_queries, round(avg(coalesce(s, 0)), 6) AS ceiling FROM search_query LEFT JOIN
(SELECT query_id, sum(v * {_discount('k')}) AS s FROM (SELECT query_id, v, row_number() OVER (PARTITION BY query ORDER BY round(v, 12) DESC, query_id, page_id) AS k
  FROM (SELECT query, query_id, 1 / ideal AS v, unnest(list_distinct(relevant)) AS page_id FROM ideals WHERE ideal > 0) QUALIFY k <= 10) GROUP BY query_id) USING (query_id)"""),
    "pooled_coverage": _with("lexical_top", select="""SELECT sum(f)::BIGINT AS found, sum(p)::BIGINT AS possible, round(CASE WHEN sum(p) > 0 THEN sum(f) / sum(p) ELSE 0 END, 6) AS coverage
FROM (SELECT len(list_intersect(coalesce(top, []), pool)) AS f, least(len(pool), 10) AS p FROM (SELECT min(query_id) AS query_id, list_distinct(flatten(list(relevant))) AS pool FROM search_query GROUP BY query)
  LEFT JOIN (SELECT query_id, list(page_id) AS top FROM lexical_top GROUP BY query_id) USING (query_id))"""),
}
