import math
import random
from collections import Counter
from time import perf_counter as time_of_day, process_time as cpu_time

import numpy as np
import pyarrow as pa
import pytest
import regex
from helpers import PAGE, WORDS, counted, page_rows, pages, prose, squeeze, time
from xxhash import xxh3_64_intdigest

from gridloom.llm import clusters, distinctive, frequency, neardup, sentences, splitting
from gridloom.session import cut

TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def terms(*parts):
    return TERM.findall(" ".join(p or "" for p in parts).lower())


@pytest.mark.parametrize(("burst", "cap", "flush"), [(512, 20000, 400000), (4, 10, 50)])
def test_frequency(spark, monkeypatch, burst, cap, flush):
    monkeypatch.setattr(frequency, "LEAST_CAP", cap)
    monkeypatch.setattr(frequency, "FLUSH", flush)
    monkeypatch.setattr(frequency.BurstTrie.__init__, "__defaults__", (burst,))
    rows = counted(page_rows())
    n, seen, held = len(rows), Counter(), Counter()
    for r in rows.values():
        seen.update(terms(r[2]))
        held.update(set(terms(r[2])))
    got = frequency.marked(__import__("gridloom.llm.common", fromlist=["x"]).counted_pages(pages(spark), "content"), "content").collect()
    assert len(got) == len(held)
    assert {(r["term"], r["n_occurrences"], r["n_records"]) for r in got} == {(t, seen[t], held[t]) for t in held}
    want = {(t, "rare" if k == 1 else "common") for t, k in held.items() if k == 1 or 10 * k > n}
    assert {tuple(r) for r in frequency.found(pages(spark)).collect()} == want


def test_burst_trie():
    rng = random.Random(2)
    trie, want = frequency.BurstTrie(3), Counter()
    for _ in range(3000):
        t = "".join(rng.choice("ab€𝄞") for _ in range(rng.randrange(1, 6)))
        trie.add(t, 2, 1)
        want[t] += 1
    got = {p + s: tuple(c) for p, held in trie.containers() for s, c in held.items()}
    assert got == {t: (2 * k, k) for t, k in want.items()} and trie.size == len(want)


def test_distinctive(spark):
    rows = counted(page_rows())
    vectors = {i: Counter(terms(r[1], r[2])) for i, r in rows.items()}
    df = Counter(t for v in vectors.values() for t in v)
    want = set()
    for i, v in vectors.items():
        best = sorted((-round(c * math.log(len(rows) / df[t]), 9), t) for t, c in v.items() if df[t] > 1)[:3]
        want |= {(i, t) for _, t in best}
    assert {tuple(r) for r in distinctive.found(pages(spark)).collect()} == want
    top = distinctive.top_terms(pages(spark), 2).collect()
    assert {r["rank"] for r in top} == {1, 2} and all(r["probability"] > 0 for r in top)


def test_everyday_words_are_left_to_the_background(spark):
    rng = random.Random(12)
    everyday = "the of and a this each that one in near above along was to".split()
    topics = [[f"{w}{t}" for w in ("tower", "river", "mill", "bridge", "wall")] for t in range(12)]
    texts = [" ".join(rng.choice(everyday) if rng.random() < 0.5 else rng.choice(topics[i % 12]) for _ in range(rng.randrange(40, 200))) for i in range(60)]
    rows = [(i, None, x, "en", time(i), time(i), "r", "t", 1, 1, "k") for i, x in enumerate(texts)]
    top = distinctive.top_terms(pages(spark, rows), 3).collect()
    assert len(top) == 180 and not [r for r in top if r["term"] in everyday]


def test_parsimonious_moves_mass():
    counts = np.array([5.0, 5.0, 4.0])
    p = distinctive.parsimonious(counts, np.array([0.5, 0.001, 0.4]), np.array([0]), own=0.3)
    assert p[1] > 0.9 and p[0] < 0.05 and p.sum() == pytest.approx(1)
    both = distinctive.parsimonious(np.concatenate([counts, counts]), np.tile([0.5, 0.001, 0.4], 2), np.array([0, 3]), own=0.3)
    assert both[:3] == pytest.approx(p) and both[3:] == pytest.approx(p)


def test_distinctive_of_common_terms(spark):
    texts = ["spam " * 3000, "spam only once " + " ".join(f"w{k}" for k in range(400)), "word " * 10000 + "the and", *["the and of " * 40 + f"x{k} word" for k in range(12)], *[f"none{k} else{k}" for k in range(12)]]
    rows = [(i, None, x, "en", time(i), time(i), "r", "t", 1, 1, "k") for i, x in enumerate(texts)]
    got = {tuple(r) for r in distinctive.found(pages(spark, rows)).collect()}
    assert (1, "spam") in got and {t for i, t in got if i == 2} == {"word", "the", "and"}


def test_parsimonious_stops_by_record():
    quick, slow = (np.array([5.0, 5.0]), np.array([0.5, 0.5])), (np.array([5.0, 5.0, 1.0]), np.array([0.3, 0.29, 0.05]))
    alone = distinctive.parsimonious(*quick, np.array([0]), own=0.3)
    for other in (slow, (np.array([9.0, 8.0, 7.0, 1.0]), np.array([0.9, 0.01, 0.02, 0.001]))):
        both = distinctive.parsimonious(np.concatenate([quick[0], other[0]]), np.concatenate([quick[1], other[1]]), np.array([0, 2]), own=0.3)
        assert (both[:2] == alone).all() and (both[2:] == distinctive.parsimonious(*other, np.array([0]), own=0.3)).all()


def least_cpu(fn, *args):
    """CPU seconds of the fastest of three calls."""
    took = []
    for _ in range(3):
        began = cpu_time()
        fn(*args)
        took.append(cpu_time() - began)
    return min(took)


def by_steps(counts, background, starts, own=distinctive.OWN):
    """EM of all records side by side, every term in every step."""
    sizes = np.diff(np.append(starts, len(counts)))
    p, going = counts / np.repeat(np.add.reduceat(counts, starts), sizes), np.ones(len(starts), bool)
    for _ in range(distinctive.STEPS):
        e = counts * own * p / (own * p + (1 - own) * background)
        new = e / np.repeat(np.add.reduceat(e, starts), sizes)
        new[new < distinctive.LEAST] = 0
        new = np.where(np.repeat(going, sizes), new, p)
        going = going & (np.maximum.reduceat(np.abs(new - p), starts) >= distinctive.CHANGE)
        p = new
    return p


def test_parsimonious_of_many_records():
    rng = np.random.default_rng(3)
    sizes = np.concatenate([[1, 1, 30000], rng.integers(1, 180, 1500), [700, 5000]])
    starts = np.cumsum(sizes) - sizes
    counts, background = 1.0 + rng.geometric(0.5, sizes.sum()), rng.pareto(1.2, sizes.sum()) * 1e-4 + 1e-7
    p = distinctive.parsimonious(counts, background, starts)
    assert np.abs(p - by_steps(counts, background, starts)).max() < 1e-12 and (p == 0).any()
    for i in (0, 2, 3, 40, len(sizes) - 1):
        of = slice(starts[i], starts[i] + sizes[i])
        assert (distinctive.parsimonious(counts[of], background[of], np.array([0])) == p[of]).all()
    assert distinctive.parsimonious(np.empty(0), np.empty(0), np.empty(0, int)).size == 0


def test_count_terms():
    rng = random.Random(7)
    odd = ["", " ", "\n", "a", " a", "a ", "b a\nb", "cafe\u0301 caf\u00e9", "\u0301x", "x\u0e33\u0e49 \u0939\u093f\u0928\u094d\u0926\u0940", "\U0001d11e \U00020000\U00020001 z", "\u0130".lower(), "1_2 3\u00bd \u216b", "\ue000a\uffff", "", "y" * 300]
    spread = ["".join(chr(rng.choice((rng.randrange(32, 128), rng.randrange(128, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(rng.randrange(200))) for _ in range(200)]
    for texts in (odd, spread, odd + spread, [""], ["", ""], ["!"]):
        names, sizes, codes, counts = distinctive.count_terms(texts)
        held, ends = names.to_pylist(), np.cumsum(sizes)
        assert held == sorted({t for x in texts for t in TERM.findall(x)}) and len(sizes) == len(texts)
        for text, a, b in zip(texts, ends - sizes, ends, strict=True):
            assert [(held[c], k) for c, k in zip(codes[a:b], counts[a:b], strict=True)] == sorted(Counter(TERM.findall(text)).items())
    prose = [" ".join(f"word{rng.randrange(3000)}" for _ in range(200)) for _ in range(1000)]
    assert least_cpu(distinctive.count_terms, prose) < 0.75 * least_cpu(lambda: [sorted(Counter(TERM.findall(x)).items()) for x in prose])


@pytest.mark.parametrize(("block", "chars"), [(1, 1 << 22), (7, 1 << 22), (2048, 1500), (2048, 1 << 22)])
def test_distinctive_in_blocks(spark, monkeypatch, block, chars):
    monkeypatch.setattr(distinctive, "CHARS", chars)
    rows = counted(page_rows())
    vectors = {i: sorted(Counter(terms(r[1], r[2])).items()) for i, r in rows.items()}
    cf, df = Counter(), Counter()
    for v in vectors.values():
        cf.update(dict(v))
        df.update(t for t, _ in v)
    got, n = distinctive.scores(distinctive.counted_pages(pages(spark), "title", "content"), "page_id", "title", "content", block=block)
    got = {r["page_id"]: r for r in got.collect()}
    assert n == len(rows) and set(got) == set(rows)
    for i, v in vectors.items():
        assert list(zip(got[i]["terms"], got[i]["counts"], strict=True)) == v and got[i]["records"] == [df[t] for t, _ in v]
        if v:
            want = by_steps(np.array([c for _, c in v], float), np.array([cf[t] for t, _ in v]) / cf.total(), np.array([0]))
            assert got[i]["probabilities"] == pytest.approx(want, abs=1e-9)


def test_distinctive_sums_terms_without_a_join(spark):
    plan = distinctive.found(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1


def test_near_duplicates(spark):
    rows = counted(page_rows())
    sets = {}
    for i, r in rows.items():
        t = squeeze(r[2] or "")
        if len(t) >= 200:
            sets[i] = {t[k : k + 5] for k in range(len(t) - 4)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    got = [tuple(r) for r in neardup.found(pages(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    classes = {r["page_id"]: r for r in neardup.classes(pages(spark)).collect()}
    assert set(classes) == set(sets)
    assert all(classes[a]["class_id"] == classes[b]["class_id"] for a, b in want)


def test_thresholds_bound_the_miss():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 65536, (600, neardup.VALUES)).astype(np.uint16)
    values[:, :16] = rng.integers(0, 3, (600, 1))  # boilerplate: these agree together
    groups = neardup.partitions(values)
    assert sorted(c for g in groups for c in g) == list(range(neardup.VALUES))
    assert sum(set(g) <= set(range(16)) for g in groups) == 4
    chosen = neardup.allocate(values, groups)
    s, miss = neardup.SIMILARITY, 1.0
    for g, t in zip(groups, chosen, strict=True):
        p = s ** len(g)
        miss *= 1 if t < 0 else 1 - p - (t == 1) * len(g) * s ** (len(g) - 1) * (1 - s)
    assert miss <= neardup.MISS * 1.05
    spoiled = [t for g, t in zip(groups, chosen, strict=True) if set(g) <= set(range(16))]
    assert spoiled == [-1] * 4


def test_clusters(spark):
    rows = counted(page_rows())
    sets = {i: set(terms(r[1], r[2])) for i, r in rows.items() if r[2] is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= 30}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    want = {(a, b) for a in sets for b in sets if a < b and label[a] == label[b]}
    got = [tuple(r) for r in clusters.found(pages(spark)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    described = clusters.clusters(pages(spark)).collect()
    assert described and all(r["n_members"] > 1 and 1 <= r["rank"] <= 3 for r in described)
    assert all(label[r["page_id"]] == label[r["community"]] for r in described)


def bridged_groups(n=8, members=30, seed=5):
    """Pairs of dense groups of term sets; of each pair only the two cores are linked, at 66 / 126."""
    rng, out = random.Random(seed), []
    for g in range(n):
        for side in "xy":
            core = [f"b{g}t{k}" for k in range(66)] + [f"{side}{g}t{k}" for k in range(30)]
            out.append(set(core))
            for m in range(members):
                out.append(set(core) - set(rng.sample(core, 3)) | {f"{side}{g}m{m}u{k}" for k in range(8)})
    return dict(enumerate(out))


def joined_pairs(sets):
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and label[a] != label[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
                old = label[b]
                label = {k: label[a] if v == old else v for k, v in label.items()}
    return {(a, b) for a in sets for b in sets if a < b and label[a] == label[b]}


def set_pages(spark, sets):
    return pages(spark, [(i, None, " ".join(sorted(s)), "en", time(i), time(i), "r", "t", 1, 1, "k") for i, s in sets.items()])


def test_clusters_joined_by_one_link(spark):
    sets = bridged_groups()
    want = joined_pairs(sets)
    assert len(want) == 8 * 62 * 61 // 2
    assert {tuple(r) for r in clusters.found(set_pages(spark, sets)).collect()} == want


def test_pairs_within_blocks(spark):
    from gridloom.llm.common import pairs_within

    rows = spark.createDataFrame([(i, i % 3 if i > 40 else 0) for i in range(70)], "page_id bigint, g int")
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["g"], []).append(r["page_id"])
    want = sorted((a, b) for held in groups.values() for a in held for b in held if a < b)
    for size in (4096, 7):
        assert sorted(tuple(r) for r in pairs_within(rows, "g", "page_id", size).collect()) == want


def test_hot_probe_keys(spark, monkeypatch):
    rows = counted(page_rows())
    want = {tuple(r) for r in neardup.found(pages(spark)).collect()}
    monkeypatch.setattr(neardup, "HOT", 2)
    got = [tuple(r) for r in neardup.found(pages(spark)).collect()]
    assert want and set(got) == want and len(got) == len(want) and rows


def test_clusters_need_no_sketch(spark, monkeypatch):
    monkeypatch.setattr(clusters, "_MOST", -1)  # every pair is over the limit of differing bits
    monkeypatch.setattr(clusters, "HOT", 20, raising=False)
    sets = bridged_groups(2)
    assert {tuple(r) for r in clusters.found(set_pages(spark, sets)).collect()} == joined_pairs(sets)


def test_communities_split_a_bridge(spark):
    links = [(a, b, 1.0) for block in (range(0, 6), range(10, 16)) for a in block for b in block if a < b] + [(5, 10, 1.0)]
    got = {r["node"]: r["community"] for r in clusters.communities(spark.createDataFrame(links, "a bigint, b bigint, similarity double")).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]
    assert clusters.communities(spark.createDataFrame([], "a bigint, b bigint, similarity double")).count() == 0


def ring(spark, n, size=5):
    """Cliques in a ring, each linked to the next."""
    links = [(c * size + i, c * size + j) for c in range(n) for j in range(size) for i in range(j)] + [(c * size + size - 1, (c + 1) % n * size) for c in range(n)]
    return spark.createDataFrame([(min(x), max(x), 1.0) for x in links], "a bigint, b bigint, similarity double")


@pytest.mark.parametrize("local", [clusters.LOCAL, 0])
def test_communities_of_a_ring(spark, local):
    for n, most in ((12, 1), (30, 3)):
        graph = ring(spark, n)
        label = clusters.communities(graph, local=local)
        got = {r["node"]: r["community"] for r in label.collect()}
        assert all(len({got[c * 5 + i] for i in range(5)}) == 1 for c in range(n))  # no clique is split
        assert n / most <= len(set(got.values())) <= n
        whole = n * 11
        volume = {}
        for i, c in got.items():
            volume[c] = volume.get(c, 0) + (5 if i % 5 in (0, 4) else 4)
        inside = sum(got[r["a"]] == got[r["b"]] for r in graph.collect())
        assert clusters.modularity(graph, label) == pytest.approx(inside / whole - sum(v * v for v in volume.values()) / (2 * whole) ** 2)
        assert {r["component"] for r in clusters.joined(graph, label).collect()} == {min(got.values())}


def test_first_pairs_do_not_depend_on_ranges(spark):
    sets = clusters.term_sets(clusters.counted_pages(pages(spark), "title", "content"), "page_id", "title", "content").withColumnRenamed("page_id", "rep")
    found = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({(r["a"], r["b"]) for r in clusters.first_pairs(clusters.sketches(sets)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] and found[0] <= found[1]


def test_hashed_terms():
    rng = random.Random(21)
    texts = ["", " \n", "one", "..", "a b a", "ab ba abc cba", "\x00 a\x00", "x" * 48 + " " + "x" * 49 + " " + "x" * 200 + " " + "x" * 201, "naïve nai\u0308ve 中文 ไทย 𝒳𝒴 ½", "a\ud800b", "", *(prose(rng, rng.randrange(400)).lower() for _ in range(40)), "end"]
    got, sizes = clusters.hashed_terms(texts)
    ends = np.cumsum(sizes)
    name = {}
    for text, i, j in zip(texts, ends - sizes, ends, strict=True):
        held = got[i:j].tolist()
        assert held == sorted(set(held)) and len(held) == len(set(TERM.findall(text)))
        for t in set(TERM.findall(text)):
            (h,), _ = clusters.hashed_terms([t])
            assert h in held and name.setdefault(int(h), t) == t
    assert [len(x) for x in clusters.hashed_terms([])] == [0, 0]


def test_term_sets_cost_less_than_a_loop(spark):
    rng = random.Random(22)
    texts = pa.array([" ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(300)) for _ in range(400)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["page_id", "content"])
    made = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(clusters, "arrow_map", lambda df, fn, schema: made.append(fn))
        clusters.term_sets(pages(spark), "page_id", "content")

    def loop():
        for x in texts.to_pylist():
            held = set(TERM.findall(x.lower()))
            np.sort(np.fromiter((xxh3_64_intdigest(t.encode()) for t in held), np.uint64, len(held)))

    assert least_cpu(lambda: list(made[0](batch))) < 0.75 * least_cpu(loop)


def test_first_pairs_are_all_followers(spark, monkeypatch):
    sets = clusters.term_sets(clusters.counted_pages(pages(spark), "title", "content"), "page_id", "title", "content").withColumnRenamed("page_id", "rep")
    sketched = clusters.sketches(sets)
    rows = sketched.collect()
    bits = {r["rep"]: [r[f"s{i}"] & (2**64 - 1) for i in range(4)] for r in rows}
    differ = {(a, b): sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b], strict=True)) for a in bits for b in bits if a < b}
    prefixes = {r["rep"]: np.frombuffer(r["p"], np.int64).reshape(-1, 2).tolist() for r in rows}
    near = set()
    for o in range(clusters.ORDERS):
        order = sorted(bits, key=lambda i: (prefixes[i][o], i))
        near |= {(min(a, b), max(a, b)) for k, a in enumerate(order) for b in order[k + 1 : k + 1 + clusters.AHEAD]}
    want = {(*p, differ[p]) for p in near if differ[p] <= clusters._MOST}
    got = {(r["a"], r["b"], r["d"]) for r in clusters.first_pairs(sketched).collect()}
    assert want and got == want
    monkeypatch.setattr(clusters, "RANGE", 30)  # ranges of few rows; what follows across their ends is found all the same
    got = {(r["a"], r["b"], r["d"]) for r in clusters.first_pairs(sketched).collect()}
    assert want <= got and all(differ[a, b] == d <= clusters._MOST for a, b, d in got)


def test_descent_compares_what_is_new(spark):
    """Pairs of two neighbours that had been compared before add nothing."""
    rng = random.Random(23)
    bits = {i: [rng.getrandbits(63) for _ in range(4)] for i in range(3)}
    for i in range(3, 70):
        bits[i] = [x ^ (1 << rng.randrange(63) | 1 << rng.randrange(63)) for x in bits[rng.randrange(i)]]
    differ = {(a, b): sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(bits[a], bits[b], strict=True)) for a in bits for b in bits if a < b}
    first = {p for p in rng.sample(sorted(differ), 150) if differ[p] <= clusters._MOST}
    want = set(first)
    for _ in range(clusters.ROUNDS):
        near = {i: sorted((differ[min(i, j), max(i, j)], j) for j in bits if j != i and (min(i, j), max(i, j)) in want)[: clusters.K] for i in bits}
        want |= {(a, b) for held in near.values() for _, a in held for _, b in held if a < b and differ[a, b] <= clusters._MOST}
    pairs = cut(spark.createDataFrame([(a, b, differ[a, b]) for a, b in sorted(first)], "a bigint, b bigint, d int"))
    sketched = cut(spark.createDataFrame([(i, *b) for i, b in bits.items()], "rep bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"))
    got = [(r["a"], r["b"], r["d"]) for r in clusters.descend(pairs, sketched).collect()]
    assert len(want) > len(first) and sorted(got) == sorted((a, b, differ[a, b]) for a, b in want)


def test_parities_bound_what_differs():
    rng = random.Random(8)
    sets = [np.array(rng.sample(range(1, 1 << 40), rng.choice((30, 90, 150, 400, 900))), np.uint64) for _ in range(30)]
    sets += [np.concatenate([x[: len(x) // 2], y[: len(y) // 2]]) for x, y in zip(sets, sets[1:], strict=False)]
    bits = [b for x in sets for _, _, b in clusters._parities(x, np.array([len(x)]))]
    bits = [x.ravel() for x in bits]
    ends = np.cumsum([len(x) for x in bits])
    held = clusters._Parities(np.concatenate(bits), ends - [len(x) for x in bits], ends)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    true = np.array([len(set(sets[i].tolist()) ^ set(sets[j].tolist())) for i, j in zip(a, b, strict=True)])
    got = held.differ(a, b)
    size = np.array([len(x) for x in sets])
    alike = (true > 0) & (np.maximum(size[a], size[b]) <= 2 * np.minimum(size[a], size[b]))
    assert (got <= true).all() and (got[alike] >= true[alike] / 2).mean() > 0.7


def brute_cuts(t, limit, least, overlap):
    n, out, s, white = len(t), [], 0, " \t\r\n"
    while True:
        if n <= s + limit:
            return [*out, (s, n)]
        places = range(s + limit, s + least, -1)
        e = next((p for p in places if t[p - 2 : p] == "\n\n" and t[p : p + 1] != "\n"), None)
        e = e or next((p for p in places if t[p - 1] in "。！？" or t[p - 1] in ".!?।" and t[p] in white), None)
        e = e or next((p for p in places if t[p - 1] in white), None) or s + limit
        out.append((s, e))
        s = next((q for q in range(e - overlap, e) if t[q - 1] in white), e - overlap)


def test_cuts_against_walk():
    rng = random.Random(4)
    for alphabet in ("ab. \n", "あ。い！", "abcdefghij ", "xyz", "ab\n\n\n", "क। ", "é𝄞 ?"):
        for _ in range(25):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 900)))
            s, e = splitting.cuts(t, 60, 30, 12)
            assert list(zip(s.tolist(), e.tolist(), strict=True)) == brute_cuts(t, 60, 30, 12)


def test_pieces(spark):
    rows = page_rows()
    long = "word " * 2000
    rows += [(400, "L", long, "en", time(1), time(1), "r", "t", 1, 1, "k")]
    passages = spark.createDataFrame([(1, long), (1, long), (2, None), (3, "short"), (None, long)], "passage_id bigint, text string")
    got = [tuple(r) for r in splitting.found(pages(spark, rows), passages).collect()]
    want = [("page", 400, *x) for x in brute_cuts(long, 1500, 750, 150)] + [("passage", 1, *x) for x in brute_cuts(long, 1500, 750, 150)]
    assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        splitting.pieces(passages, "p", "passage_id", "text", 10, 20, 5)


CASES = [
    ("en", "Dr. Mire met Mrs. Gale. He left at 5 p.m. on 3 Oct. 1901! Why?", ["Dr. Mire met Mrs. Gale.", "He left at 5 p.m. on 3 Oct. 1901!", "Why?"]),
    ("en", "A rate of 3.5 (see fig. 2.1, pp. 4–5). It is sold to Vale & Co. The end ... and so on.", ["A rate of 3.5 (see fig. 2.1, pp. 4–5).", "It is sold to Vale & Co.", "The end ... and so on."]),
    ("en", "He asked, “Was it?” The man left. “It was!” wrote A. E. Dole. See a.example/b.", ["He asked, “Was it?”", "The man left.", "“It was!” wrote A. E. Dole.", "See a.example/b."]),
    ("en", "Near the street.Then more\nof it.\n\nEarly years\n\nIn 1900.", ["Near the street.", "Then more\nof it.", "Early years", "In 1900."]),
    ("de", "Der 53. Band u. a. von Prof. Au blieb. Siehe Bd. 5, S. 9 ff. im Archiv. „Ja!“, schrieb K. Au. Seit 1912. Es war 8.000 m.", ["Der 53. Band u. a. von Prof. Au blieb.", "Siehe Bd. 5, S. 9 ff. im Archiv.", "„Ja!“, schrieb K. Au.", "Seit 1912.", "Es war 8.000 m."]),
    ("fr", "« Où ? » demanda Mme Lac. M. Val dit « un lac ! » dans ses notes. Qui ? Voir p. 4, éd. Pont, 1900.", ["« Où ? » demanda Mme Lac.", "M. Val dit « un lac ! » dans ses notes.", "Qui ?", "Voir p. 4, éd. Pont, 1900."]),
    ("es", "«¡Sí!», dijo la Dra. Paz. Los EE. UU. vieron 5 a las 5 p. m. en 1900. ¿Qué? ¡No!", ["«¡Sí!», dijo la Dra. Paz.", "Los EE. UU. vieron 5 a las 5 p. m. en 1900.", "¿Qué?", "¡No!"]),
    ("ru", "В 1945 г. проф. А. В. Лес жил на ул. Гора, д. 3. «Да!» — сказал он. Всё.", ["В 1945 г. проф. А. В. Лес жил на ул. Гора, д. 3.", "«Да!» — сказал он.", "Всё."]),
    ("zh", "他问：「是吗？」没有。「好！」林写道。《石。木》是书。高3.5米……后来。", ["他问：「是吗？」", "没有。", "「好！」林写道。", "《石。木》是书。", "高3.5米……后来。"]),
    ("ja", "「行った。」と彼は書いた。誰か？分からない！", ["「行った。」と彼は書いた。", "誰か？", "分からない！"]),
    ("hi", "डॉ. राम ने नं. 5 रखा। “वह गया!” राम ने लिखा। मूल्य रु. 9 था॥", ["डॉ. राम ने नं. 5 रखा।", "“वह गया!” राम ने लिखा।", "मूल्य रु. 9 था॥"]),
    ("th", "กาขา คางา 25 งาจา ตา", ["กาขา", "คางา 25 งาจา", "ตา"]),
    ("en", "He said no. Then he left. Choose plan b. Then go. Vitamin C. It helps. It was I. He went.", ["He said no.", "Then he left.", "Choose plan b.", "Then go.", "Vitamin C.", "It helps.", "It was I.", "He went."]),
    ("en", "Work ended in 1388. 1313 brought rain. See No. 5. It rained on 3 Oct. 1901 at 3. 40 men left.", ["Work ended in 1388.", "1313 brought rain.", "See No. 5.", "It rained on 3 Oct. 1901 at 3.", "40 men left."]),
    ("en", "At 5 p.m. The U.S. The U.S. Army. By J. R. Hall.\u2029One (" + "long. Words. " * 60 + "end). Two.", ["At 5 p.m.", "The U.S.", "The U.S. Army.", "By J. R. Hall.", "One (" + "long. Words. " * 60 + "end).", "Two."]),
    ("en", "An open ( bracket. Never closed.\n\nA ) here. End.", ["An open ( bracket.", "Never closed.", "A ) here.", "End."]),
    ("ru", "Он жил в 1945 г. Потом уехал. В г. Москва.", ["Он жил в 1945 г.", "Потом уехал.", "В г. Москва."]),
    ("de", "Es waren 12. Der Rest ging. Der 12. Mai kam.", ["Es waren 12.", "Der Rest ging.", "Der 12. Mai kam."]),
    ("it", "Il sig. Rossi arriva con la dott.ssa Verdi. Bene.", ["Il sig. Rossi arriva con la dott.ssa Verdi.", "Bene."]),
    ("pt", "O Sr. Silva chegou. Bom.", ["O Sr. Silva chegou.", "Bom."]),
    (None, "O Sr. Silva viu o sig. Rossi.", ["O Sr. Silva viu o sig. Rossi."]),
    ("lo", "ກາຂາ ຄາງາ 25 ຕາ", ["ກາຂາ", "ຄາງາ 25 ຕາ"]),
    (None, "Der Hund und die Katze, der 5. Band.", ["Der Hund und die Katze, der 5. Band."]),
    ("en", "", []),
    ("en", " \n \t", []),
    (None, None, []),
]


@pytest.mark.parametrize(("lang", "text", "want"), CASES)
def test_sentence_spans(lang, text, want):
    assert [text[a:b] for a, b in sentences.spans(text, lang)] == want


def test_sentences_of_long_runs_take_linear_time():
    for piece in ("a.b", "(", "Mr. A ", "A.", "x/"):
        began = time_of_day()
        sentences.spans(piece * 60000 + " End. Of it.", "en")
        assert time_of_day() - began < 5


def test_language_of_the_whole_text():
    assert sentences.language("1,204 " * 150 + "\n\n" + "Der Turm und die Mauer sind alt. " * 20, None) == "de"
    assert sentences.language("Нижний Новгород, " * 40 + "\n\n" + "The wall of the old town and that tower. " * 100, None) == "en"
    assert sentences.language("1234 " * 100 + "Город стоит на реке.", None) == "ru"
    assert [sentences.language(x, None) for x in ("नदी के किनारे", "เมืองนี้อยู่", "この町は古い", "这座城市", "", "12")] == ["hi", "th", "ja", "zh", "", ""]


def test_sentences(spark):
    got = {tuple(r) for r in sentences.found(pages(spark)).collect()}
    want = {(i, a, b) for i, r in counted(page_rows()).items() for a, b in sentences.spans(r[2], r[3])}
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAGE)
    for fn in (frequency.found, distinctive.found, sentences.found, neardup.found, neardup.classes, clusters.found, clusters.clusters):
        assert fn(none).count() == 0
    assert splitting.found(none, spark.createDataFrame([], "passage_id bigint, text string")).count() == 0
