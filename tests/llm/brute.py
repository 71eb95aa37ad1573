"""Plain versions that the operators are held against."""

import itertools
from collections import Counter

from sequora.llm.decontaminate import SIMILARITY, WIDTH, clean


def leaks(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> dict[tuple[int, int], float]:
    """Every window against every item, for tests."""

    def words(text):
        return [c for w in (text or "").split() if (c := clean(w))]

    def shingles(run, width):
        return Counter(tuple(run[i : i + width]) for i in range(len(run) - width + 1))

    out = {}
    for (doc_id, text), (item_id, item) in itertools.product(docs, items):
        own, want = words(text), words(item)
        if not own or not want or len(own) < min(WIDTH, len(want)):
            continue
        width = min(WIDTH, len(want))
        b = shingles(want, width)
        for at in range(max(1, len(own) - len(want) + 1)):
            a = shingles(own[at : at + len(want)], width)
            similarity = sum((a & b).values()) / sum((a | b).values())
            if similarity >= SIMILARITY:
                out[doc_id, item_id] = max(similarity, out.get((doc_id, item_id), 0))
    return out
