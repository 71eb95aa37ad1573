"""The methods themselves against plain versions: entropy windows, FTRL, packing, trees and fences."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sequora.llm import common, packing, quality_classifier, quality_rules, registry, secrets, url_filter

SF = "/root/testdata/sf0.001"


def entropy_stretch(value):
    if all(c in "0123456789abcdefABCDEF" for c in value):
        least = secrets.THRESHOLDS["hex"]
    else:
        least = secrets.THRESHOLDS["alnum" if value.isalnum() else "base64"]
    hot = []
    for at in range(len(value) - secrets.WINDOW + 1):
        counts = Counter(value[at : at + secrets.WINDOW])
        if -sum(n / secrets.WINDOW * math.log2(n / secrets.WINDOW) for n in counts.values()) >= least - 1e-12:
            hot.append(at)
    return (hot[0], hot[-1] + secrets.WINDOW) if hot else (None, None)


def test_entropy_by_windows(spark):
    rng = random.Random(2)
    alphabets = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", secrets.ALPHABET, "ab1", "abcdefgh")
    values = ["".join(rng.choices(rng.choice(alphabets), k=rng.choice((20, 21, 40)))) + "".join(rng.choices(rng.choice(alphabets), k=rng.choice((0, 15, 60)))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", secrets.entropy_stretch(F.col("v")).alias("s")).collect()
    got = {r.i: (r.s["first"], r.s["last"]) for r in rows}
    assert got == {i: entropy_stretch(v) for i, v in enumerate(values)}
    assert any(a is None for a, _ in got.values()) and any(a for a, _ in got.values())


def test_ftrl_by_dictionaries():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(40):
        at = np.sort(rng.choice(50, 6, replace=False)).astype("<i4")
        rows.append((int(at.min() < 8), at, rng.random(6).astype("<f4")))
    z, n, alpha, beta, l1, l2 = Counter(), Counter(), 0.5, 1.0, 0.02, 0.05

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for label, at, values in rows:
            x = dict(zip(at.tolist(), values.tolist(), strict=True)) | {quality_classifier.BUCKETS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    found = quality_classifier.train(rows, epochs=3)
    assert np.allclose([found[i] for i in z], [weight(i) for i in z], atol=1e-5) and np.count_nonzero(found) <= len(z)


def fewest(sizes, capacity):
    """Bins of an optimal packing, by trying all."""
    best = len(sizes)

    def go(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(sizes):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= sizes[at] and room not in rooms[:i]:
                go(at + 1, [*rooms[:i], room - sizes[at], *rooms[i + 1 :]])
        go(at + 1, [*rooms, capacity - sizes[at]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_reduction_loses_no_optimum():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice((10, 17, 24))
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, left = packing.reduce_instance(np.bincount(sizes, minlength=capacity + 1), capacity)
        rest = np.repeat(np.arange(capacity + 1), left).tolist()
        packed = [s for pattern, times in fixed for s in pattern * times]
        assert sorted(packed + rest) == sorted(sizes) and all(sum(p) <= capacity for p, _ in fixed)
        assert sum(times for _, times in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)
        filled = packing.best_fit(left, capacity)
        assert sorted(s for p, times in filled for s in p * times) == sorted(rest) and all(sum(p) <= capacity for p, _ in filled)


def test_pieces_hold_the_librarys_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sorted(tuple(r)[:5] for r in registry.QUERIES["op6_best_fit_packing"](spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    want = []
    for doc_id, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        pieces = -(-len(ids) // 1024)
        cuts = [0, *range(len(ids) - 1024 * (pieces - 1), len(ids) + 1, 1024)] if pieces > 1 else [0, len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert got == sorted(want)


def test_trees_by_exhaustive_splits(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(8)), float(rng.randrange(5)), 0) for _ in range(120)]
    rows = [(a, b, int((a > 3) != (b > 2) or rng.random() < 0.1)) for a, b, _ in rows]
    bias, trees = url_filter.train(spark.createDataFrame(rows, "x_a double, x_b double, label int"), ["x_a", "x_b"])
    names, cuts = ("x_a", "x_b"), [sorted({sorted(r[k] for r in rows)[max(0, math.ceil(q / url_filter.BINS * len(rows)) - 1)] for q in range(1, url_filter.BINS)}) for k in (0, 1)]
    score = {i: math.log(sum(r[2] for r in rows) / sum(1 - r[2] for r in rows)) for i in range(len(rows))}
    assert bias == pytest.approx(score[0])

    def grow(members, depth, grad, hess):
        g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
        best = None
        for k, cut in ((k, c) for k in (0, 1) for c in cuts[k]) if depth < url_filter.DEPTH else ():
            a = [i for i in members if rows[i][k] <= cut]
            gl, hl = sum(grad[i] for i in a), sum(hess[i] for i in a)
            gain = round(gl**2 / (hl + url_filter.L2) + (g - gl) ** 2 / (h - hl + url_filter.L2) - g**2 / (h + url_filter.L2), 9)
            if gain > 1e-6 and (best is None or (gain, -k, cut) > best):
                best = (gain, -k, cut)
        if best is None:
            return -url_filter.RATE * g / (h + url_filter.L2)
        k, cut = -best[1], best[2]
        sides = [[i for i in members if (rows[i][k] <= cut) == left] for left in (True, False)]
        return (names[k], cut, *(grow(s, depth + 1, grad, hess) if s else 0.0 for s in sides))

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[names.index(tree[0])] <= tree[1] else tree[3]
        return tree

    for tree in trees:
        p = {i: 1 / (1 + math.exp(-s)) for i, s in score.items()}
        want = grow(range(len(rows)), 0, {i: p[i] - rows[i][2] for i in p}, {i: p[i] * (1 - p[i]) for i in p})
        for i, row in enumerate(rows):
            assert value(tree, row) == pytest.approx(value(want, row), abs=1e-9)
            score[i] += value(tree, row)


def test_suffix_features_leave_the_own_fold_out(spark):
    pages = spark.createDataFrame([(i, f"http://a{i % 3}.{'com' if i % 2 else 'org'}/{'de' if i % 4 == 1 else 'fr'}/{i}") for i in range(60)] + [(99, "http://b.net/x")], "page_id long, url string")
    rows = url_filter.with_folds(pages)
    every = rows.select("suffix", "fold", "ruled").collect()
    for r in url_filter.suffix_statistics(rows, F.col("ruled").isNotNull()).collect():
        seen = [x for x in every if x.suffix == r.s and x.ruled is not None and x.fold != r.f]
        assert r.x_suffix_block == pytest.approx((sum(x.ruled == "block" for x in seen) + 1) / (len(seen) + 2))
        assert r.x_suffix_count == pytest.approx(math.log2(sum(x.suffix == r.s for x in every) + 1))
    judged = url_filter.held_out(pages).first()
    assert judged.n == sum(x.fold == 0 for x in every) and 0 <= judged.accuracy <= 1


def test_fences_by_sorting(spark):
    rng = random.Random(8)
    rows = [("en" if i % 3 else None, f"s{i % 4}", rng.choice((None, rng.gauss(5, 1))), rng.random() * (i % 5 == 0), rng.random(), 0.0) for i in range(400)]
    table = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{m} double" for m in quality_rules.MEASURES))

    def quantile(values, q):
        values = sorted(v for v in values if v is not None)
        return values[max(0, math.ceil(q * len(values)) - 1)] if values else None

    for f in quality_rules.fences(table).collect():
        for k, (m, (slack, low)) in enumerate(quality_rules.MEASURES.items(), 2):
            group, lang = ([r[k] for r in rows if r[0] == f.f_lang and (r[1] == f.f_source or whole)] for whole in (False, True))
            n = sum(r[2] is not None for r in rows if (r[0], r[1]) == (f.f_lang, f.f_source))
            for name, q, give in (("high", 0.9, slack), ("low", 1 - 0.9, -slack)):
                far = [quantile(v, q) + 3 * (quantile(v, q) - quantile(v, 0.5)) + give for v in (group, lang)]
                want = (n * far[0] + quality_rules.WEIGHT * far[1]) / (n + quality_rules.WEIGHT) if low or name == "high" else None
                assert f[f"{m}_{name}"] == (pytest.approx(want) if want is not None else None)


def test_stages_bear_clashing_columns(spark):
    extra = ["ld_text", "ld_removed", "ld_lines", "leak_text", "id", "chosen_id", "chosen_row", "fp", "root", "row", "node", "first", "site", "score", "hit_id", "f", "h1"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now, _ = common.materialise(stage(spark, now, SF), "stage")
        assert now.dtypes == docs.dtypes
    assert now.count() and [now.agg(F.min(c), F.max(c)).first()[0] for c in extra] == list(range(len(extra)))
    assert corpus_pipeline.pack(spark, now, SF).select("doc_id").distinct().count() == now.count()
