"""The pipeline's near-dedup against all pairs of texts."""

import random

import numpy as np

from sequora.llm import common, shingle_dedup, simhash_dedup


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_all_pairs(docs):
    sets, root = [shingles(t or "") for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {docs[find(i)][0] for i in range(len(docs))}


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.random()}"
    return " ".join(words)


def test_near_copies_at_the_threshold(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(0, None), (1, ""), (2, "Two words"), (3, "two  WORDS")]
    for g in range(12):
        base = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice((60, 200)))]
        docs += [(len(docs) + i, edited(rng, base, rng.choice((0, 1, 2, 3, 5)))) for i in range(40 if g == 0 else 4)]
    table, want = spark.createDataFrame(docs, "doc_id long, text string"), kept_by_all_pairs(docs)
    for tokens in (200_000, 900):  # one block a cluster, and several
        monkeypatch.setattr(shingle_dedup, "TOKENS", tokens)
        monkeypatch.setattr(shingle_dedup, "SMALL", tokens)
        assert {r.doc_id for r in shingle_dedup.keep_one(table).collect()} == want


def test_texts_are_not_shuffled_for_a_few_near_copies(spark, monkeypatch):
    from sequora.llm import common

    words = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join(words) if i == 0 else " ".join(words[:-1])) for i in range(2)] + [(i, f"text {i}") for i in range(2, 40)]
    plans, write = [], common.materialise

    def noted(df, name, *args):
        if name == "sets":
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name, *args)

    monkeypatch.setattr(common, "materialise", noted)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(r.doc_id for r in shingle_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [0, *range(2, 40)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def roots_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_segments_meet_what_all_pairs_meet(monkeypatch):
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 64, (simhash_dedup.COMPARED, 60), np.uint64)
    prints = np.concatenate([prints ^ (np.uint64(1) << rng.integers(0, 64, prints.shape, np.uint64)) for _ in range(5)], axis=1)
    prints[0] ^= np.where(rng.random(300) < 0.3, np.uint64(0xFFFFFFF), np.uint64(0))  # some copies are too far off
    n, values, sizes = 300, rng.integers(0, 1 << 5, 300) << 6, rng.integers(8, 14, 300)
    want = {}
    for i in range(n):
        for j in range(i):
            apart = [int(np.bitwise_count(a ^ b)) for a, b in zip(prints[:, i], prints[:, j])]
            if 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]) and apart[0] <= simhash_dedup.FAR_FIRST and sum(apart) <= simhash_dedup.FAR:
                want[j, i] = int(values[i] ^ values[j])
    for plain, wild in ((True, range(0, 8)), (False, range(8, 16))):
        bits = {0} if plain else set()
        met = {p for p, x in want.items() if x in bits | {1 << b for b in wild}}
        assert met
        for crowd, pairs in ((10**9, 1 << 18), (10**9, 50), (0, 50)):
            monkeypatch.setattr(simhash_dedup, "CROWD", crowd)
            monkeypatch.setattr(simhash_dedup, "PAIRS", pairs)
            u, v = simhash_dedup.met_in_segment(values, sizes, prints, plain, wild)
            found = [(min(a, b), max(a, b)) for a, b in zip(u.tolist(), v.tolist())]
            if crowd:
                assert sorted(found) == sorted(met)
            else:  # crowded signatures give a forest, which may link what the halves of a signature don't
                assert set(found) <= set(want)
                roots = roots_of(n, found)
                assert all(roots[a] == roots[b] for a, b in met)


def test_simhash_nominates_near_copies(spark, monkeypatch):
    rng, links = random.Random(3), []
    docs = []
    for g in range(60):  # pairs at 0.8 to 0.82, of one size
        base = [f"w{rng.randrange(10_000)}" for _ in range(94)]
        other = list(base)
        other[45] = "new"
        other[75 if g % 2 else 52] = "newer"
        docs += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    docs += [(1000 + g, " ".join(f"v{rng.randrange(10_000)}" for _ in range(94))) for g in range(40)]
    nominate = simhash_dedup.wide_links

    def noted(nodes):
        found, _ = common.materialise(nominate(nodes), "found")
        links.extend(found.distinct().collect())
        return found

    monkeypatch.setattr(shingle_dedup, "wide_links", noted)
    for group in (50_000, 40):  # one group a half, and several
        links.clear()
        monkeypatch.setattr(simhash_dedup, "GROUP", group)
        kept = {r.doc_id for r in shingle_dedup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert kept == kept_by_all_pairs(docs) == {d for d, _ in docs if d >= 1000 or d % 2 == 0}
        assert len(links) == 60
