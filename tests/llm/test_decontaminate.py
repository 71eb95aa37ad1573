"""Benchmark items in texts against every window compared with every item."""

import random
import sys
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from sequora.llm import decontaminate  # noqa: E402


def planted(rng):
    """Items at random, periodic and of few words, and texts with edited, cut and turned copies of them."""
    items, docs = [], [(-1, None), (-2, ""), (-3, "!!! --")]
    for i in range(6):
        length, kind = rng.choice((3, 5, 13, 15, 30, 59)), rng.choice(("random", "periodic", "few"))
        words = [{"random": f"w{rng.randrange(5000)}", "periodic": "ab"[k % 2], "few": f"x{rng.randrange(4)}"}[kind] for k in range(length)]
        items.append((i, " ".join(words)))
        for edits in range(4):
            own = list(words)
            for _ in range(min(edits, 1) if kind == "random" else edits):
                own[rng.randrange(length)] = rng.choice(words)
            own = own[: max(1, int(length * 0.9))] if rng.random() < 0.3 else own
            own = own[1:] + own[:1] if rng.random() < 0.5 else own
            around = [f"z{rng.randrange(100)}" for _ in range(rng.choice((0, 0, 3, 50)))]
            docs.append((len(docs), " ".join([*around, *own, *(around if rng.random() < 0.5 else [])])))
    return docs, items


def test_search_equals_all_windows():
    rng, pairs = random.Random(1), 0
    for _ in range(25):
        docs, items = planted(rng)
        found = {(docs[t][0], w[0]): w[1] for t, windows in decontaminate.Items(items).search(pa.array([t for _, t in docs])) for w in windows}
        want = brute.leaks(docs, items)
        assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-9 for k in want)
        pairs += len(want)
    assert pairs > 300


def test_alternating_words_at_the_threshold(spark):
    docs, items = [(1, "b a " * 6 + "b")], [(7, "a b " * 6 + "a")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, round(r.similarity, 9)) for r in found] == [(1, 7, 0.8)]


def test_blocks_by_lengths(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_LENGTHS", 1)
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l m"), (3, "n o p q r s"), (4, None)], "item_id long, text string")
    assert [sorted(i for i, _ in block) for block in decontaminate.item_blocks(items)] == [[1, 3], [2]]
    docs = spark.createDataFrame([(1, "x a b c d e f", 0), (2, "g h i j k l m", 1), (3, "x y z", 2)], "doc_id long, text string, leak_text int")
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(3, "x y z", 2)]


def test_hashes_of_words_in_bulk():
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    from sequora.llm import decontaminate

    words = ["Plain", "a-B", "straße", "É", "--", "x_y", "İ2", "7", "plain", "a-B", "Σας"]
    want = [xxh64_intdigest(c) if (c := decontaminate._NOISE.sub("", w.lower())) else 0 for w in words]
    for _ in range(2):  # again from memory
        assert decontaminate.hash_words(pa.array(words, pa.string())).tolist() == want
    assert decontaminate.hash_words(pa.array([], pa.string())).tolist() == []
