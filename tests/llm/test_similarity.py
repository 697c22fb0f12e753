import itertools
from collections import Counter

import numpy as np
import pytest

from framestride.llm import containment, groups, jaccard_join, vectors
from tests.llm.test_text_tokens import plain_shingles

SF = "/root/testdata/sf0.01"


def classes(links, nodes):
    """Smallest reachable node of each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 4999), (7, 7)]
    got = {r["node"]: r["component"] for r in groups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == classes(edges, nodes)


def test_blocks_bring_any_two_rows_together_once(spark):
    for n in (2, 33, 500):
        rows = groups.blocked(spark.range(n).selectExpr("id", "1L as g", f"{n}L as size"), "g", "size", "id").collect()
        met = Counter()
        for (lo, hi), part in itertools.groupby(sorted(rows, key=lambda r: (r["lo"], r["hi"])), lambda r: (r["lo"], r["hi"])):
            part = list(part)
            for x, y in itertools.combinations(part, 2):
                if lo == hi or x["own"] != y["own"]:
                    met[tuple(sorted((x["id"], y["id"])))] += 1
        assert set(met.values()) == {1} and len(met) == n * (n - 1) // 2


def expected_vectors(rows):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not len(v) or None in v:
            continue
        x = np.array(v, float)
        if np.isfinite(x).all() and x.any():
            good.setdefault((label, len(x)), []).append((i, x / np.linalg.norm(x)))
    links, degree = [], Counter()
    for members in good.values():
        for (a, x), (b, y) in itertools.combinations(members, 2):
            if x @ y >= 0.98:
                links.append((a, b))
                degree[a] += 1
                degree[b] += 1
    return degree, classes(links, {r[0] for r in rows if r[0] is not None})


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=16)
        for _ in range(1 if k % 3 else 12):
            rows.append((len(rows), (base + rng.normal(scale=0.04, size=16)).tolist(), k % 2))
    dense = rng.normal(size=16)
    rows += [(len(rows) + k, (dense + rng.normal(scale=0.03, size=16)).tolist(), 1) for k in range(150)]
    rows += [
        (9001, rows[0][1], 0), (9002, [-0.0 if x == 0 else x for x in rows[0][1]], 0), (9003, rows[0][1], 1), (9004, rows[0][1], None),
        (9005, None, 0), (9006, [], 0), (9007, [0.0] * 16, 0), (9008, [None] + [1.0] * 15, 0), (9009, [float("nan")] + [1.0] * 15, 0),
        (9010, [float("inf")] + [1.0] * 15, 0), (9011, [1.0, 0.0], 0), (9012, [2.0, 0.0], 0), (None, rows[0][1], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as rep", "'x' as key", "1 as dim", "2 as links")
    got = vectors.near_duplicates(df.repartition(4)).collect()
    degree, component = expected_vectors(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert tuple(r) == (None, 0, None, True)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree[r["vec_id"]], component[r["vec_id"]], component[r["vec_id"]] == r["vec_id"]), r


def test_repeated_vectors_count_as_copies(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3 + [(2, [1.0, 2.01], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in vectors.near_duplicates(df).collect()) == [(1, 3, 1, True)] * 3 + [(2, 3, 1, False)]


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_passes_grow_with_the_data():
    assert vectors.passes(2) < vectors.passes(10**4) < vectors.passes(10**9)


def test_unlike_vectors_that_share_a_vec_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.001, 1.0], 0)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_windows_cross_blocks_and_measure_what_they_miss(spark, monkeypatch):
    """With windows much smaller than the labels, the passes find the planted pairs without what is compared whole."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "_near", lambda *_: lambda table, bounds: iter(()))
    x = _cone(np.random.default_rng(4), 2000, 200, 0.0)
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df.repartition(8), window=8).collect()}
    assert sum(got[k]["component_id"] == got[2000 + k]["component_id"] == k for k in range(200)) >= 190


def expected_join(rows):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, plain_shingles(text))
    links, degree, first = [], Counter(), {}
    count = Counter(i for i, _ in rows if i is not None)
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            links.append((a, b))
            degree[a] += count[b]
            degree[b] += count[a]
            if x == y:
                first[b] = min(first.get(b, b), a)
    for i in sets:
        if sets[i]:
            degree[i] += count[i] - 1
    return degree, classes(links, sets), first


def test_join_equals_brute_force_on_odd_rows(odd, odd_rows):
    got = jaccard_join.join(odd).collect()
    degree, component, first = expected_join([r[:2] for r in odd_rows])
    assert len(got) == len(odd_rows)
    for r in got:
        i = r["doc_id"]
        if i is None:
            assert tuple(r) == (None, None, 0, None, True)
        else:
            assert (r["class_id"], r["n_links"], r["component_id"], r["kept"]) == (first.get(i, i), degree[i], component[i], component[i] == i), r


def test_join_finds_every_link_of_a_dense_group(spark):
    rng = np.random.default_rng(8)
    base = [f"t{k}" for k in range(200)]
    rows = []
    for k in range(400):
        words = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 5)):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"y{k}z{j}" for j in range(50))) for k in range(100)]
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    degree, component, first = expected_join(rows)
    bad = [r for r in got if (r["n_links"], r["component_id"]) != (degree[r["doc_id"]], component[r["doc_id"]])]
    assert not bad


def test_join_of_nothing(nothing):
    assert jaccard_join.join(nothing).collect() == []
    assert jaccard_join.without_copies(nothing).columns == nothing.columns
    assert jaccard_join.without_copies(nothing).collect() == []


def test_runs_follow_the_recall():
    assert jaccard_join.survival(0, 0.8) == 1.0
    assert jaccard_join.runs(recall=0.9) < jaccard_join.runs(recall=0.9995)


@pytest.fixture(scope="module")
def items(spark, odd_rows):
    long_text = odd_rows[11][1].split()
    texts = [" ".join(long_text[500:540]), " ".join([*long_text[900:930], "other", *long_text[930:960]]), "one two", " ".join(long_text[5:10]), None, "", "no such words at all here", " ".join(long_text[100:112]).upper()]
    return [(k, t) for k, t in enumerate(texts)]


def test_containment_equals_brute_force(spark, odd, odd_rows, items):
    got = containment.contained(odd, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n", "'y' as doc_id")).collect()
    want = []
    for doc, text, *_ in odd_rows:
        for item, short in items:
            s = plain_shingles(short)
            shared = len(s & plain_shingles(text))
            if s and shared >= 0.8 * len(s):
                want.append((doc, item, len(s), shared, shared / len(s)))
    key = lambda r: [(v is not None, v or 0) for v in r]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert {w[1] for w in want} >= {0, 1, 2, 3, 7}


def test_items_in_several_blocks(spark, odd, items, monkeypatch):
    df = spark.createDataFrame(items, "item_id long, text string")
    sets = [b.load() for b in containment.blocks(df, 0.8, 0.9999, most=20)]
    assert sum(len(b.ids) for b in sets) == 6 and len(sets) > 2


def test_containment_of_nothing(spark, nothing, odd, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    assert containment.contained(nothing, df).collect() == []
    assert containment.contained(odd, df.limit(0)).collect() == []
    assert odd.where(containment.is_contaminated(odd["text"], df.limit(0))).count() == 0


def test_step_reaches_the_recall():
    assert containment.step_for(200) == 0 and containment.step_for(1) == -1
    assert containment.step_for(6) > containment.step_for(40)


def _cone(rng, n, pairs, cosine, dim=64):
    """Vectors at a mutual cosine, and planted pairs just above the threshold."""
    mean = rng.normal(size=dim)
    mean /= np.linalg.norm(mean)

    def across(base, size):
        v = rng.normal(size=(size, dim))
        v -= (v * base).sum(-1, keepdims=True) * base
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    x = np.sqrt(cosine) * mean + np.sqrt(1 - cosine) * across(mean, n)
    y = 0.9815 * x[:pairs] + np.sqrt(1 - 0.9815**2) * across(x[:pairs], pairs)
    return np.concatenate([x, y])


@pytest.mark.parametrize("cosine", [0.0, 0.95])
def test_clustered_vectors_keep_their_pairs(spark, cosine):
    x = _cone(np.random.default_rng(8), 5000, 300, cosine)
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df.repartition(8)).collect()}
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    want = near.sum(1)
    assert sum(got[k]["n_links"] == want[k] for k in range(len(x))) >= 0.998 * len(x)
    assert sum(got[k]["component_id"] == got[5000 + k]["component_id"] for k in range(300)) >= 299


def test_join_recall_counts_the_shared_tokens():
    rng = np.random.default_rng(3)
    number = jaccard_join.runs()
    agree = rng.binomial(jaccard_join.TOKENS, 0.8, 200_000)
    sketched = agree + rng.binomial(jaccard_join.TOKENS - agree, 0.25) >= jaccard_join._least(0.8)
    lost = np.array([(1 - jaccard_join.survival(jaccard_join.DEEPEST, 0.8, k / jaccard_join.TOKENS)) ** number for k in range(jaccard_join.TOKENS + 1)])
    assert (sketched * (1 - lost[agree])).mean() >= 0.9994
    assert jaccard_join.reached(9) < 0.9992 and jaccard_join.reached(number) >= 0.9995
