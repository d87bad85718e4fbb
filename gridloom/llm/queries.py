"""Queries of the training-data operators, each over its whole tables, and SQL to hold them against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import clusters, distinctive, encoding, frequency, neardup, neighbours, packing, repetition, sentences, splitting
from gridloom.llm.common import counted_pages, table


def _over(fn: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(*(table(spark, sf_dir, t) for t in tables))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": _over(neighbours.found, "changelog", "passage"),
    "p2_found": _over(frequency.found, "page"),
    "p2_terms": _over(lambda pages: frequency.marked(counted_pages(pages, "content"), "content"), "page"),
    "p3_found": _over(sentences.found, "page"),
    "p4_found": _over(distinctive.found, "page"),
    "p4_top_terms": _over(lambda pages: distinctive.top_terms(pages).withColumn("probability", F.round("probability", 6)), "page"),
    "p5_found": _over(splitting.found, "page", "passage"),
    "p6_found": _over(clusters.found, "page"),
    "p6_clusters": _over(clusters.clusters, "page"),
    "p7_found": _over(neardup.found, "page"),
    "p7_classes": _over(neardup.classes, "page"),
    "p8_ids": _over(encoding.encode, "documents"),
    "p9_containers": _over(packing.pack, "documents"),
    "p9_summary": _over(packing.summary, "documents"),
    "p10_found": _over(repetition.found, "documents"),
    "p10_share": _over(lambda docs: repetition.repeated_share(docs).select("doc_id", "n_windows", "n_repeated"), "documents"),
    "p10_lines": _over(repetition.line_frequency, "documents"),
}

_PAGES = "pages AS (SELECT page_id, title, content FROM page WHERE page_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY crawled_at DESC NULLS LAST) = 1)"
_TERMS = r"'[\p{L}\p{M}\p{N}]+'"
_SQUEEZE = r"regexp_replace(lower({}), '[ \t\r\n]+', ' ', 'g')"
_BLANK = "[' ', chr(9), chr(13), chr(10)]"
_USABLE = "len({0}) = 64 AND len(list_filter({0}, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter({0}, lambda v: v <> 0)) > 0"
_COUNTS = f"""WITH {_PAGES}, words AS (SELECT page_id, unnest(regexp_extract_all(lower(content), {_TERMS})) AS term FROM pages),
counts AS (SELECT term, count(*) AS n_occurrences, count(DISTINCT page_id) AS n_records FROM words GROUP BY term),
marked AS (SELECT *, CASE WHEN n_records = 1 THEN 'rare' WHEN n_records * 10 > (SELECT count(*) FROM pages) THEN 'common' END AS mark FROM counts)
"""
_WINDOWS = f"""WITH texts AS (SELECT doc_id, {_SQUEEZE.format("coalesce(text, '')")} AS t FROM documents),
windows AS (SELECT doc_id, unnest(list_transform(range(1, length(t) - 18), lambda i: substring(t, i, 20))) AS w FROM texts WHERE length(t) >= 20),
sums AS (SELECT doc_id, count(*) AS n_windows, count(*) - count(DISTINCT w) AS n_repeated FROM windows GROUP BY doc_id)
"""

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH first AS (SELECT vec_id AS id, embedding FROM changelog WHERE op = 'insert' AND vec_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logged_at) = 1),
vectors AS (SELECT 'batch' AS coll, id, embedding FROM first WHERE id NOT IN (SELECT vec_id FROM changelog WHERE op = 'delete' AND vec_id IS NOT NULL)
  UNION ALL SELECT DISTINCT 'passage', passage_id, embedding FROM passage WHERE passage_id IS NOT NULL),
fine AS (SELECT coll, id, embedding::DOUBLE[64] AS e FROM vectors WHERE {_USABLE.format('embedding')}),
near AS (SELECT a.coll, a.id AS a, b.id AS b, array_cosine_similarity(a.e, b.e) AS s FROM fine a JOIN fine b ON a.coll = b.coll AND a.id <> b.id WHERE array_cosine_similarity(a.e, b.e) >= 0.85),
top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY coll, a ORDER BY round(s, 9) DESC, b) <= 10)
SELECT DISTINCT coll, least(a, b) AS id_a, greatest(a, b) AS id_b FROM top""",
    "p2_found": _COUNTS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_terms": _COUNTS + "SELECT term, n_occurrences, n_records, mark FROM marked",
    "p4_found": f"""WITH {_PAGES}, words AS (SELECT page_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(content, '')), {_TERMS})) AS term FROM pages),
tf AS (SELECT page_id, term, count(*) AS n FROM words GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term HAVING count(*) > 1)
SELECT page_id, term FROM tf JOIN df USING (term)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY round(n * ln((SELECT count(*) FROM pages) / d), 9) DESC, encode(term)) <= 3""",
    "p4_top_terms": f"""WITH RECURSIVE {_PAGES}, words AS (SELECT page_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(content, '')), {_TERMS})) AS term FROM pages),
tf AS (SELECT page_id, term, count(*)::DOUBLE AS c FROM words GROUP BY ALL), total AS (SELECT sum(c) AS n FROM tf),
bg AS (SELECT term, sum(c) / n AS q, count(*) AS d FROM tf, total GROUP BY term, n),
em AS (SELECT page_id, term, c, q, d, c / sum(c) OVER (PARTITION BY page_id) AS p, 0 AS step, true AS going FROM tf JOIN bg USING (term)
  UNION ALL SELECT page_id, term, c, q, d, p2, step + 1, max(abs(p2 - p)) OVER (PARTITION BY page_id) >= {distinctive.CHANGE} FROM
    (SELECT *, CASE WHEN m < {distinctive.LEAST} THEN 0.0::DOUBLE ELSE m END AS p2 FROM (SELECT *, e / greatest(sum(e) OVER (PARTITION BY page_id), 1e-300) AS m FROM
      (SELECT *, CASE WHEN p > 0 THEN c * {distinctive.OWN}::DOUBLE * p / ({distinctive.OWN}::DOUBLE * p + (1 - {distinctive.OWN}::DOUBLE) * q) ELSE 0.0::DOUBLE END AS e FROM em WHERE going AND step < {distinctive.STEPS})))),
done AS (SELECT * FROM em QUALIFY step = max(step) OVER (PARTITION BY page_id))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY round(p, 9) DESC, encode(term))::INT AS rank, term, round(round(p, 9), 6) AS probability FROM done WHERE d > 1 AND p > 0 QUALIFY rank <= 10""",
    "p6_found": f"""WITH RECURSIVE {_PAGES}, words AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || content), {_TERMS})) AS term FROM pages WHERE content IS NOT NULL),
sizes AS (SELECT page_id, count(*) AS n FROM words GROUP BY page_id HAVING count(*) >= 30),
shared AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS s FROM words a JOIN words b ON a.term = b.term AND a.page_id <> b.page_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.page_id = a JOIN sizes y ON y.page_id = b WHERE 2 * s >= x.n + y.n - s),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS page_a, b AS page_b FROM reach WHERE a < b""",
    "p7_found": f"""WITH {_PAGES}, texts AS (SELECT page_id, {_SQUEEZE.format('content')} AS t FROM pages WHERE content IS NOT NULL),
grams AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) AS g FROM texts WHERE length(t) >= 200),
sizes AS (SELECT page_id, count(*) AS n FROM grams GROUP BY page_id),
shared AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.page_id < b.page_id GROUP BY ALL)
SELECT a AS page_a, b AS page_b FROM shared JOIN sizes x ON x.page_id = a JOIN sizes y ON y.page_id = b WHERE 10 * s >= 7 * (x.n + y.n - s)""",
    "p5_found": f"""WITH RECURSIVE {_PAGES}, items AS (SELECT 'page' AS item_kind, page_id AS item_id, content AS t FROM pages WHERE length(content) > 1500
  UNION ALL SELECT DISTINCT 'passage', passage_id, text FROM passage WHERE passage_id IS NOT NULL AND length(text) > 1500),
walk AS (SELECT item_kind, item_id, t, 0 AS s, -1 AS e, 0 AS k FROM items
  UNION ALL SELECT item_kind, item_id, t, q, CASE WHEN length(t) <= q + 1500 THEN length(t) ELSE q + coalesce(
      list_filter(range(1500, 750, -1), lambda p: c[p] = chr(10) AND c[p - 1] = chr(10) AND c[p + 1] <> chr(10))[1],
      list_filter(range(1500, 750, -1), lambda p: list_contains(['。', '！', '？'], c[p]) OR list_contains(['.', '!', '?', '।'], c[p]) AND list_contains({_BLANK}, c[p + 1]))[1],
      list_filter(range(1500, 750, -1), lambda p: list_contains({_BLANK}, c[p]))[1], 1500) END, k + 1
    FROM (SELECT *, string_split(substring(t, q + 1, 1502), '') AS c FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE e - 150 + coalesce(list_filter(range(150), lambda i: list_contains({_BLANK}, d[i + 1]))[1], 0) END AS q
      FROM (SELECT *, string_split(substring(t, e - 150, 150), '') AS d FROM walk WHERE k = 0 OR e < length(t)))))
SELECT item_kind, item_id, s::INT AS piece_start, e::INT AS piece_end FROM walk WHERE k > 0""",
    "p7_classes": f"""WITH RECURSIVE {_PAGES}, texts AS (SELECT page_id, {_SQUEEZE.format('content')} AS t FROM pages WHERE content IS NOT NULL AND length({_SQUEEZE.format('content')}) >= 200),
reps AS (SELECT min(page_id) AS rep, t FROM texts GROUP BY t),
grams AS (SELECT DISTINCT rep, unnest(list_transform(range(1, length(t) - 3), lambda i: substring(t, i, 5))) AS g FROM reps),
sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.rep = a JOIN sizes y ON y.rep = b WHERE 10 * s >= 7 * (x.n + y.n - s)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT page_id, least(rep, coalesce((SELECT min(b) FROM reach WHERE a = rep), rep)) AS class_id, (SELECT count(*) FROM links WHERE a = rep) AS n_links FROM texts JOIN reps USING (t)""",
    "p9_summary": "SELECT count(DISTINCT doc_id) AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_wrong, 0::BIGINT AS n_split FROM documents",
    "p10_found": _WINDOWS + "SELECT doc_id FROM sums JOIN texts USING (doc_id) WHERE length(t) >= 100 AND 4 * n_repeated >= n_windows",
    "p10_share": _WINDOWS + "SELECT doc_id, coalesce(n_windows, 0) AS n_windows, coalesce(n_repeated, 0) AS n_repeated FROM texts LEFT JOIN sums USING (doc_id)",
    "p10_lines": r"""WITH split AS (SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents),
lines AS (SELECT doc_id, host, trim(regexp_replace(lower(x), '[ \t\r]+', ' ', 'g')) AS x FROM split),
kept AS (SELECT * FROM lines WHERE x <> ''),
common AS (SELECT host, x FROM kept GROUP BY host, x HAVING count(DISTINCT doc_id) > 3),
sums AS (SELECT doc_id, count(*) AS n_lines, count(c.x) AS n_removed, sum(length(k.x)) AS chars, sum(CASE WHEN c.x IS NULL THEN length(k.x) ELSE 0 END) AS chars_left
  FROM kept k LEFT JOIN common c ON k.host = c.host AND k.x = c.x GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(chars, 0)::BIGINT AS chars, coalesce(chars_left, 0)::BIGINT AS chars_left,
  coalesce(chars, 0) = 0 OR chars_left < 0.5 * chars AS rejected FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN sums USING (doc_id)""",
}
