import random
from pathlib import Path

import numpy as np
import pytest
from helpers import prose, squeeze, time

from gridloom.llm import encoding, neighbours, packing, repetition

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, added_at timestamp, ids int, container int"
needs_files = pytest.mark.skipif(not Path(encoding.TOKENIZERS, "byte_bpe_50k.json").exists(), reason="no vocabulary files")


def doc_rows(seed=3, n=40):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(1, 400))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "ab " * 500), (104, "<|endoftext|> 🙂é̂‍"), (105, "กขค" * 400), (106, prose(rng, 9000)), (107, "x" * 3000)]
    rows += [(108, "\n".join(["same footer line"] + [prose(rng, 8)] * 3)), (109, "same footer line"), (110, "Same  footer LINE\nsame footer line"), (111, "same footer line\n" + prose(rng, 30)), (112, "same footer line\nown")]
    return [(i, t, "en", "s" if i >= 108 else f"h{i % 3}", None, None, time(i), 0, 0) for i, t in rows]


def docs(spark, rows=None):
    return spark.createDataFrame(doc_rows() if rows is None else rows, DOC).repartition(3)


def test_repetition(spark):
    want = set()
    for r in doc_rows():
        t = squeeze(r[1] or "")
        if len(t) >= 100:
            w = [t[k : k + 20] for k in range(len(t) - 19)]
            if 4 * (len(w) - len(set(w))) >= len(w):
                want.add(r[0])
    assert {r[0] for r in repetition.found(docs(spark)).collect()} == want and {103, 105, 107} <= want
    share = {r["doc_id"]: r["share"] for r in repetition.repeated_share(docs(spark)).collect()}
    assert share[100] == share[101] == share[102] == 0 and share[107] > 0.99 and len(share) == len(doc_rows())


def test_line_frequency(spark):
    got = {r["doc_id"]: r for r in repetition.line_frequency(docs(spark)).collect()}
    assert len(got) == len(doc_rows())
    assert (got[110]["n_lines"], got[110]["n_removed"], got[110]["rejected"]) == (2, 2, True)
    assert got[111]["n_removed"] == 1 and not got[111]["rejected"] and got[112]["rejected"]
    assert got[100]["rejected"] and got[100]["n_lines"] == 0


@needs_files
def test_encoding_matches_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(docs(spark)).collect()}
    assert got[100] == got[101] == []
    for r in doc_rows():
        assert got[r[0]] == lib.encode(r[1] or "", add_special_tokens=False).ids
    assert lib.decode(got[104], skip_special_tokens=False) == doc_rows()[44][1]


@needs_files
def test_encoding_of_long_runs():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(9)
    texts = ["".join(rng.choice(a) for _ in range(rng.randrange(1, 2500))) for a in ("a", "ab", "the", "กข", "0 ", "aA.\n") for _ in range(12)]
    own = encoding.Bpe(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_rank_queue():
    rng = random.Random(1)
    queue, want = encoding.RankQueue(50_000), {}
    for _ in range(400):
        r = rng.randrange(50_000)
        queue.push(r, np.array([r]))
        want[r] = want.get(r, 0) + 1
    out = []
    while (top := queue.pop()) is not None:
        out.append((top[0], len(top[1])))
        if top[0] % 7 == 0 and top[0] + 1 not in want:
            queue.push(top[0] + 1, np.array([0]))
            want[top[0] + 1] = 1
    assert out == sorted(want.items())


@needs_files
def test_packing(spark):
    rows = packing.pack(docs(spark), stretch=20).collect()
    sizes = {r["doc_id"]: len(r["ids"]) for r in encoding.encode(docs(spark)).collect()}
    by_doc, by_box = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_box[r["container"]] = by_box.get(r["container"], 0) + r["n_tokens"]
    assert set(by_doc) == set(sizes)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert sum(r["n_tokens"] for r in parts) == sizes[i]
        assert len(parts) == max(1, -(-sizes[i] // packing.CAPACITY))
        assert [r["token_start"] for r in parts] == [k * packing.CAPACITY for k in range(len(parts))]
    assert max(by_box.values()) <= packing.CAPACITY
    assert len(by_box) <= -(-sum(sizes.values()) // packing.CAPACITY) * 1.15 + 1


@needs_files
def test_packing_does_not_depend_on_cores(spark):
    same = doc_rows(n=90) + [(900 + i, "the same text over and over", "en", "s", None, None, None, 0, 0) for i in range(90)]
    found = []
    for parts, size in (("2", 16), ("9", 16)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({tuple(r) for r in packing.pack(docs(spark, same).repartition(int(parts)), stretch=size).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
    assert [tuple(r) for r in packing.summary(docs(spark, same)).collect()] == [(len(same), 0, 0, 0)]


def test_hilbert_is_a_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert(cells, 3)
    order = np.argsort(keys)
    assert len(set(keys.tolist())) == 512
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


@needs_files
def test_empty_documents(spark):
    none = spark.createDataFrame([], DOC)
    for fn in (repetition.found, repetition.line_frequency, encoding.encode, packing.pack):
        assert fn(none).count() == 0


LOG = "batch string, pos int, op string, vec_id bigint, embedding array<float>, logged_at timestamp, arrived_at timestamp, id int, rep int, a int"


def log_rows(n=900, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, 64))
    rows = []
    for i in range(n):
        v = base[rng.integers(60)] + rng.normal(size=64) * 0.25 if i % 3 else rng.normal(size=64)
        rows.append(("b", i, "insert", i, (v * rng.uniform(0.1, 5)).astype(np.float32).tolist(), time(i)))
    rows += [("b", i, "insert", i, rows[7][4], time(i)) for i in range(n, n + 30)]  # more copies than neighbours are kept
    rows += [("b", i, "insert", i, rows[8][4], time(i)) for i in range(n + 30, n + 34)]
    rows += [("c", 0, "insert", 5, rows[9][4], time(5000)), ("c", 1, "delete", 11, None, time(6000)), ("c", 2, "delete", 99999, None, time(6000)), rows[3], rows[3]]
    bad = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    rows += [("d", k, "insert", 3000 + k, v, time(7000)) for k, v in enumerate(bad)]
    return [r + (r[5], 0, 0, 0) for r in rows]


def brute_pairs(vectors, k=10, least=0.85):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x @ x.T, 9)
    np.fill_diagonal(sim, -9)
    out = set()
    for r, i in enumerate(ids):
        for c in np.lexsort((np.array(ids), -sim[r]))[:k]:
            if sim[r, c] >= least:
                out.add((min(i, ids[c]), max(i, ids[c])))
    return out


@pytest.mark.parametrize("block", [2048, 50])
def test_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = log_rows()
    live = {}
    for r in sorted(rows, key=lambda r: r[5]):
        v = r[4]
        if r[2] == "insert" and r[3] != 11 and v and len(v) == 64 and r[3] not in live and all(x is not None and np.isfinite(x) for x in v) and any(v):
            live[r[3]] = v
    passages = [(i, rows[i][4]) for i in range(0, 300)] + [(3, rows[3][4]), (None, rows[3][4]), (999, None)]
    got = neighbours.found(spark.createDataFrame(rows, LOG).repartition(3), spark.createDataFrame(passages, "passage_id bigint, embedding array<float>")).collect()
    assert len(got) == len({tuple(r) for r in got})
    for coll, vectors in (("batch", live), ("passage", {i: v for i, v in passages if i is not None and v})):
        want = brute_pairs(vectors)
        have = {(r["id_a"], r["id_b"]) for r in got if r["coll"] == coll}
        assert len(want & have) >= 0.98 * len(want) and len(have - want) <= 0.02 * len(want)


def dense_group(n=600, spread=2e-3, seed=6):
    """A third of the vectors in one ball that is tighter than any code word."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x[::3] = rng.normal(size=64) + rng.normal(size=(len(x[::3]), 64)) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_items_within_the_error_of_their_codes_are_compared():
    x = dense_group().astype(np.float32)
    index = neighbours.Index(x, 256)
    a, b, _ = neighbours._compare(index, 0, x, np.arange(len(x)), x, np.arange(len(x)), 10, 0.85)
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == brute_pairs(dict(enumerate(x)))


@pytest.mark.parametrize("block", [2048, 50])
def test_neighbours_closer_than_half_precision(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    x = dense_group().astype(np.float32)
    got = neighbours.most_similar(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, embedding array<float>")).collect()
    assert {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in got} == brute_pairs(dict(enumerate(x)))


def test_a_list_of_a_third_of_all_vectors_is_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SPLIT", 600)
    monkeypatch.setattr(neighbours, "FINE", 256)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x[::3] = rng.normal(size=64) * 2 + rng.normal(size=(2000, 16)) @ rng.normal(size=(16, 64)) * 0.1
    x = x.astype(np.float32)
    got = neighbours.most_similar(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, embedding array<float>")).collect()
    have, want = {(min(r["id"], r["other"]), max(r["id"], r["other"])) for r in got}, brute_pairs(dict(enumerate(x)))
    assert len(want) > 10_000 and len(want & have) >= 0.9 * len(want)


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], LOG)
    assert neighbours.found(none, spark.createDataFrame([(1, [1.0] * 64)], "passage_id bigint, embedding array<float>")).count() == 0
