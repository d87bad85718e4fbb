"""All queries of the engine's own operators by name, with the SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.functions import metrics, text
from gridloom.functions.embedding import hash_embed
from gridloom.functions.vectors import half
from gridloom.operators import bm25, chunking, components, entity_clusters, evaluation, fusion, replay, vector_index
from gridloom.plans import pipeline
from gridloom.plans.oracle import ORACLE
from gridloom.session import cut, shared_dir, standing
from gridloom.sources.tables import batch_rows, latest_pages, manifest_json, operations, pages_json, queries_json, read_matrix, read_postings, table, write_matrix, write_postings
from gridloom.streaming.changelog import LiveTable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return latest_pages(table(spark, d, "page"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "passage").dropDuplicates(["passage_id"])


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_query")


def _fresh(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}/trip-{uuid.uuid4().hex}"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding")


def _r(name: str):
    return F.round(name, 6).alias(name)


# vectors

@query
def vec_topk(spark, d):
    return vector_index.top_k(_vector_queries(spark, d), _vectors(spark, d), 10).select("q", "rank", "vec_id", _r("score"))


@query
def vec_topk_sql(spark, d):
    return vector_index.top_k_sql(_vector_queries(spark, d), _vectors(spark, d), 10).select("q", "rank", "vec_id", _r("score"))


@query
def vec_topk_after_delete(spark, d):
    live = _vectors(spark, d)
    gone = live.where("vec_id % 7 = 0").select(F.col("vec_id").alias("pos"), "vec_id")
    left = live.join(vector_index.delete_status(live, gone).where("succeeded").select("vec_id"), "vec_id", "left_anti")
    return vector_index.top_k(_vector_queries(spark, d), left, 10).select("q", "rank", "vec_id", _r("score"))


@query
def vec_query_dedup(spark, d):
    some = _vector_queries(spark, d)
    batch = some.union(some.select((F.col("q") + 1_000_000).alias("q"), "embedding"))
    distinct, same = vector_index.distinct_queries(batch)
    found = vector_index.top_k(distinct, _vectors(spark, d), 5).withColumnRenamed("q", "rep")
    return same.join(found, "rep").select("q", "rank", "vec_id", _r("score"))


def _initial(rows: DataFrame) -> DataFrame:
    return rows.where("op = 'insert' and batch = 'scenario_000/op_0000_insert.npy'")


@query
def vec_insert_status(spark, d):
    """Every insert batch of the log as if it came right after the initial build."""
    rows = batch_rows(table(spark, d, "changelog"))
    return vector_index.insert_status(_initial(rows), rows.where("op = 'insert'"), "batch").select("batch", "pos", "vec_id", "succeeded")


def _played(spark, d):
    """A VectorIndex after an insert of all vectors, a delete of every seventh and one more, and an insert of every third again, negated."""
    rows, index = _vectors(spark, d), vector_index.VectorIndex(spark, 64)
    first = index.insert(rows.select(F.col("vec_id").alias("pos"), "vec_id", "embedding"))
    gone = rows.where("vec_id % 7 = 0").select(F.col("vec_id").alias("pos"), "vec_id")
    second = index.delete(gone.union(spark.createDataFrame([(10**9, 10**9)], gone.schema)))
    again = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("pos"), "vec_id", F.transform("embedding", lambda v: -v).alias("embedding"))
    return index, (first, second, index.insert(again))


@query
def vec_index_status(spark, d):
    _, said = _played(spark, d)
    out = None
    for call, got in enumerate(said):
        for name in ("succeeded", "failed"):
            part = got[name].select(F.lit(call).alias("call"), "vec_id", F.lit(name == "succeeded").alias("succeeded"))
            out = part if out is None else out.union(part)
    return out


@query
def vec_index_search(spark, d):
    """The same search twice, before and after the cache holds it, with more neighbours than a block of the prescreen."""
    index, _ = _played(spark, d)
    some = _vector_queries(spark, d)
    index.search(some, 70)
    return index.search(some, 70).select("q", "rank", "vec_id", _r("score"))


@query
def vec_naive_search(spark, d):
    index = vector_index.NaiveIndex(spark, 64)
    index.insert(_vectors(spark, d).select(F.col("vec_id").alias("pos"), "vec_id", "embedding"))
    return index.search(_vector_queries(spark, d), 10).select("q", "rank", "vec_id", _r("score"))


@query
def vec_delete_status(spark, d):
    """All deletes of the log as one batch right after the initial build, in the order of batch and place."""
    rows = batch_rows(table(spark, d, "changelog"))
    gone = rows.where("op = 'delete'").select(F.struct("batch", "pos").alias("pos"), "vec_id")
    return vector_index.delete_status(_initial(rows), gone).select("pos.batch", "pos.pos", "vec_id", "succeeded")


def _status(spark, d):
    return replay.statuses(replay.log(table(spark, d, "changelog"), table(spark, d, "manifest")))


@query
def vec_replay_status(spark, d):
    return _status(spark, d).select("scenario", "seq", "pos", "vec_id", "op", "succeeded")


@query
def vec_replay_results(spark, d):
    return replay.results(_status(spark, d)).select("scenario", "seq", "op", "succeeded", "failed")


@query
def vec_replay_search(spark, d):
    at = replay.searches(table(spark, d, "manifest"))
    return replay.search(_status(spark, d), at, _vector_queries(spark, d), 10).select("scenario", "seq", "q", "rank", "vec_id", _r("score"))


@query
def vec_half(spark, d):
    return _vectors(spark, d).select("vec_id", F.transform(half(F.col("embedding")), lambda v: F.round(v, 9)).alias("embedding"))


# scores

@query
def jaccard_scores(spark, d):
    got = replay.results(_status(spark, d))
    whole = F.array_union("succeeded", "failed")
    return got.select("scenario", "seq", F.round(metrics.jaccard(F.col("succeeded"), whole), 6).alias("j_succeeded"), F.round(metrics.jaccard(F.col("failed"), whole), 6).alias("j_failed"))


def _stale(status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An index that never removes what it holds: its statuses, and what it takes to be live.

    An id's first insert succeeds, and every delete of an id that was ever inserted.
    """
    w = Window.partitionBy("scenario", "vec_id").orderBy("seq", "pos")
    before = F.coalesce(F.sum(F.when(F.col("op") == "insert", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    said = status.withColumn("succeeded", F.when(F.col("op") == "insert", before == 0).otherwise(before > 0))
    live = said.where("op = 'insert' and succeeded").select("scenario", "vec_id", "embedding", F.col("seq").alias("born"), F.lit(None).cast("int").alias("died"))
    return said, live


@query
def functional_score(spark, d):
    """The scores of an index that never removes anything, whose searches are answered from all it ever took in."""
    status, at, some = cut(_status(spark, d)), replay.searches(table(spark, d, "manifest")), _vector_queries(spark, d)
    said, live = _stale(status)
    found = replay.recalls(cut(replay.search_lives(live, at, some)), cut(replay.search(status, at, some)), at, some)
    names = ("insert_score", "delete_score", "search_score", "functional")
    return replay.scenario_scores(replay.mutation_scores(said, status), found).select("scenario", *[_r(n) for n in names])


@query
def search_recall(spark, d):
    status, at, some = cut(_status(spark, d)), replay.searches(table(spark, d, "manifest")), _vector_queries(spark, d)
    got, truth = replay.search_lives(_stale(status)[1], at, some), replay.search(status, at, some)
    return replay.recalls(cut(got), cut(truth), at, some).select("scenario", "seq", _r("recall"), "n_queries")


@query
def runtime_multiplier(spark, d):
    ratio = F.col("n_chars") / 1000.0
    return table(spark, d, "documents").select("doc_id", metrics.runtime_multiplier(ratio).alias("multiplier"))


@query
def recall_at_k(spark, d):
    top = fusion.ranked(_bm25(spark, d), 10).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda x: x["page_id"]).alias("result"))
    rows = _queries(spark, d).select("query_id", "relevant").join(top, "query_id", "left")
    return rows.select("query_id", F.round(metrics.recall_at_k(F.col("result"), F.col("relevant"), 10), 6).alias("recall"))


# texts

@query
def page_id_normalize(spark, d):
    ids = _pages(spark, d).select(F.concat(F.lit(" \t"), F.col("page_id").cast("string"), F.lit("\n")).alias("raw"))
    return ids.select(F.length("raw").cast("bigint").alias("raw_length"), text.page_id("raw").alias("page_id"))


@query
def entry_text(spark, d):
    rows = _pages(spark, d).select("page_id", "title", "content", F.explode(F.array(F.lit(True), F.lit(False))).alias("titled"))
    return rows.select("page_id", "titled", text.entry_text(F.when(F.col("titled"), F.col("title")).otherwise(""), "content").alias("entry"))


# readers and writers, by round trip

@query
def corpus_scan(spark, d):
    """Every page as a JSON file of its own, read back."""
    path = _fresh(spark)
    rows = _pages(spark, d).select(F.col("page_id").alias("k"), F.concat(F.lit(" "), F.col("page_id").cast("string")).alias("page_id"), "title", "content")
    rows.repartition("k").write.partitionBy("k").json(path)
    return pages_json(spark, f"{path}/*").select("page_id", "title", "content")


@query
def query_scan(spark, d):
    """The stated queries as JSON with ids as strings, read back as lists and as sets."""
    path = _fresh(spark)
    doubled = F.transform(F.concat("relevant", "relevant"), lambda i: i.cast("string")).alias("relevant_page_ids")
    _queries(spark, d).select("query_id", "query", doubled).write.json(path)
    lists, sets = queries_json(spark, f"{path}/*.json", lines=True), queries_json(spark, f"{path}/*.json", as_set=True, lines=True)
    return lists.select("query_id", F.size("relevant").cast("bigint").alias("n_list")).join(sets.select("query_id", "query", F.array_sort("relevant").alias("relevant")), "query_id")


@query
def batch_scan(spark, d):
    """Every batch of the log as a map of ids."""
    return batch_rows(table(spark, d, "changelog")).select("batch", "op", F.col("pos").cast("bigint").alias("pos"), "vec_id", F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint").alias("n"))


@query
def operation_scan(spark, d):
    """The operations of the manifest's scenarios, written as JSON manifests, read back with their totals."""
    ops = operations(table(spark, d, "manifest"))
    one = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("op").alias("type"), "batch"))), lambda o: F.struct(o["type"].alias("type"), o["batch"].alias("batch")))
    path = _fresh(spark)
    ops.groupBy("scenario").agg(one.alias("operations")).withColumn("dim", F.lit(64)).write.json(path)
    return manifest_json(spark, f"{path}/*.json", lines=True).groupBy("op", "batch", "dim").agg(F.count("*").alias("n"))


@query
def matrix_round_trip(spark, d):
    path = _fresh(spark)
    write_matrix(_vectors(spark, d), path, 64)
    return read_matrix(spark, path).select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 6)).alias("embedding"))


@query
def postings_round_trip(spark, d):
    path = _fresh(spark)
    write_postings(_index(spark, d), path)
    held = read_postings(spark, path)
    return held["postings"].join(held["vocab"], "term").join(held["lengths"], "page_id").select("term", "page_id", "tf", "df", "doc_len")


@query
def live_table(spark, d):
    """The vectors that are live after every batch of the log, by logged_at: each batch a micro-batch, on objects that know the path only."""
    rows = table(spark, d, "changelog").select("vec_id", "op", "logged_at", "pos", "embedding")
    path = _fresh(spark)
    cuts = F.ntile(3).over(Window.orderBy("at"))
    times = cut(rows.select(F.date_trunc("day", "logged_at").alias("at")).distinct().select("at", cuts.alias("part")))
    parts = cut(rows.withColumn("at", F.date_trunc("day", "logged_at")).join(times, "at", "left"))
    for number in range(3):
        LiveTable(spark, path).apply(parts.where(F.col("part") == number + 1), number)
    return LiveTable(spark, path).read().select("vec_id", F.size("embedding").cast("bigint").alias("n"))


@query
def corpus_search(spark, d):
    """From pages as JSON lines to answers: chunks, embeddings, clusters and postings are built, written and loaded, then searched.

    A file a page, as `corpus_scan` writes, takes more time and disk for the folders and checksums of small files than all that follows.
    """
    path = _fresh(spark)
    _pages(spark, d).select(F.col("page_id").cast("string").alias("page_id"), "title", "content").write.json(f"{path}/pages")
    pipeline.build_index(pages_json(spark, f"{path}/pages", lines=True).drop("position"), f"{path}/index")
    return pipeline.search_batch(pipeline.load_index(spark, f"{path}/index"), _queries(spark, d), 10)


@query
def sentence_split(spark, d):
    return _pages(spark, d).select("page_id", F.posexplode(text.sentences("content")).alias("sent_id", "sentence")).select("page_id", F.col("sent_id").cast("bigint").alias("sent_id"), "sentence")


@query
def word_count(spark, d):
    return _pages(spark, d).select("page_id", text.words("content").cast("bigint").alias("n_words"))


def _chunks(pages: DataFrame, target: int) -> DataFrame:
    return chunking.chunks(pages, target).select("page_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "text")


@query
def chunk_w100(spark, d):
    return _chunks(_pages(spark, d), 100)


@query
def chunk_w150(spark, d):
    return _chunks(_pages(spark, d), 150)


@query
def chunk_untitled(spark, d):
    """Titles of white space alone, and titles within white space: every page has one of the two."""
    blank = F.col("page_id") % 2 == 0
    return _chunks(_pages(spark, d).withColumn("title", F.when(blank, "  ").otherwise(F.concat(F.lit(" \t"), text.text_of("title"), F.lit(" ")))), 100)


@query
def hash_embeddings(spark, d):
    rows = hash_embed(_passages(spark, d), "passage_id", "text")
    return rows.select("passage_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# lexical index

#: What was built of a folder's tables, by application and folder: queries of one session share it.
_BUILT: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, d: str, name: str, build: Callable[[], object]):
    key = (spark.sparkContext.applicationId, d, name)
    held = _BUILT.get(key)
    # `clean`, or somebody else, may have removed the tables since
    if held is None or not all(standing(x) for x in (held.values() if isinstance(held, dict) else [held])):
        held = _BUILT[key] = build()
    return held


def build_all(spark: SparkSession, d: str) -> None:
    """Postings, embedded passages and entity clusters of a folder, which the queries of this session then read."""
    _with_clusters(spark, d)


def _index(spark, d):
    return _once(spark, d, "postings", lambda: bm25.build(cut(_pages(spark, d))))


def _bm25(spark, d):
    return bm25.scores(_index(spark, d), _queries(spark, d))


@query
def tokenize(spark, d):
    return bm25.documents(_pages(spark, d))


@query
def doc_length(spark, d):
    return bm25.lengths(bm25.documents(_pages(spark, d)))


@query
def term_freq(spark, d):
    return bm25.frequencies(bm25.documents(_pages(spark, d)))


@query
def vocab_idf(spark, d):
    return _index(spark, d)["vocab"].select("term", "df", _r("idf"))


@query
def postings(spark, d):
    return _index(spark, d)["postings"]


@query
def bm25_score(spark, d):
    return _bm25(spark, d).select("query_id", "page_id", _r("score"))


@query
def bm25_topk(spark, d):
    return fusion.ranked(_bm25(spark, d), 10).select("query_id", "rank", "page_id", _r("score"))


@query
def number_groups(spark, d):
    return bm25.number_terms(_queries(spark, d)).select("query_id", F.col("grp").cast("bigint").alias("grp"), "term")


@query
def number_score(spark, d):
    return bm25.number_scores(_index(spark, d), _queries(spark, d)).select("query_id", "page_id", _r("score"))


@query
def connective_flag(spark, d):
    return _queries(spark, d).select("query_id", text.connective("query").alias("flag"))


# dense scores and fusion

def _embedded(spark, d):
    return _once(spark, d, "passages", lambda: _embed(spark, d))


def _embed(spark, d):
    return cut(pipeline.embed_passages(_passages(spark, d).select("granularity", "page_id", "chunk_id", "text")))


def _dense(spark, d):
    return fusion.dense(pipeline.embed_queries(_queries(spark, d)), _embedded(spark, d))


@query
def dense_max(spark, d):
    return _dense(spark, d).select("query_id", "granularity", "page_id", _r("best"))


@query
def dense_lead(spark, d):
    return _dense(spark, d).where("lead is not null").select("query_id", "granularity", "page_id", _r("lead"))


@query
def zscore_dense(spark, d):
    return fusion.z_dense(_dense(spark, d), "best", "lead").select("query_id", "granularity", "page_id", _r("z_best"), _r("z_lead"))


@query
def zscore_sparse(spark, d):
    index = _index(spark, d)
    z, rest = fusion.z_sparse(bm25.scores(index, _queries(spark, d)), index["corpus"].first()["n_docs"])
    return z.select("query_id", "page_id", _r("z")).unionByName(rest.select("query_id", F.lit(None).cast("bigint").alias("page_id"), F.round("z0", 6).alias("z")))


def _with_clusters(spark, d):
    groups = _once(spark, d, "clusters", lambda: cut(entity_clusters.clusters(_pages(spark, d), entity_clusters.similar_pairs(_leads(spark, d), 0.75))))
    nested = _once(spark, d, "vectors", lambda: cut(fusion.nest(_embedded(spark, d))))
    return _index(spark, d) | {"passages": _embedded(spark, d), "vectors": nested, "clusters": groups}


def _fused(spark, d):
    index = _index(spark, d) | {"passages": _embedded(spark, d)}
    return pipeline.signals(index, _queries(spark, d))


@query
def fusion_score(spark, d):
    return _fused(spark, d).select("query_id", "page_id", _r("score"))


@query
def fusion_topk(spark, d):
    return fusion.ranked(_fused(spark, d), 10).select("query_id", "rank", "page_id", _r("score"))


def _leads(spark, d):
    return _passages(spark, d).where("granularity = 100 and chunk_id = 0").select("page_id", "embedding")


@query
def sim_pairs(spark, d):
    return entity_clusters.similar_pairs(_leads(spark, d), 0.75).select("a", "b", _r("similarity"))


@query
def clusters(spark, d):
    return entity_clusters.clusters(_pages(spark, d), entity_clusters.similar_pairs(_leads(spark, d), 0.75))


@query
def connected_pairs(spark, d):
    """Components of the pairs alone."""
    return components.connected_components(entity_clusters.similar_pairs(_leads(spark, d), 0.75))


@query
def cluster_rerank(spark, d):
    return fusion.rerank(cut(_fused(spark, d)), clusters(spark, d), 10)


@query
def hybrid_search(spark, d):
    return pipeline.search_batch(_with_clusters(spark, d), _queries(spark, d), 10)


# evaluation

@query
def dcg(spark, d):
    return evaluation.dcg(evaluation.gains(fusion.ranked(_bm25(spark, d), 10), _queries(spark, d), 10)).select("query_id", _r("dcg"))


@query
def ndcg_at_k(spark, d):
    return evaluation.ndcg(fusion.ranked(_bm25(spark, d), 10), _queries(spark, d), 10).select("query_id", _r("ndcg"))


@query
def mean_ndcg(spark, d):
    return evaluation.mean_ndcg(fusion.ranked(_bm25(spark, d), 10), _queries(spark, d), 10).select("n_queries", _r("mean_ndcg"))


@query
def oracle_ceiling(spark, d):
    return evaluation.oracle_ceiling(_queries(spark, d), 10).select("n_queries", _r("ceiling"))


@query
def pooled_coverage(spark, d):
    return evaluation.pooled_coverage(fusion.ranked(_bm25(spark, d), 10), _queries(spark, d), 10).select("found", "possible", _r("coverage"))


__all__ = ["ORACLE", "QUERIES"]
