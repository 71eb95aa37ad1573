"""Disclosing terms and sanitised texts against plain counts."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

from sequora.llm import sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def words_of(text):
    return set(re.findall(r"[^\W_]+", EMAIL.sub(lambda m: " " * len(m[0]), text).lower()))


def plain(texts):
    """{(term, entity): share} of distinct texts whose only entities are e-mail addresses."""
    distinct = set(texts)
    entities = {t: {"email:" + m.lower() for m in EMAIL.findall(t)} for t in distinct}
    c_e, c_t, c_te = Counter(), Counter(), Counter()
    for t in distinct:
        c_e.update(entities[t])
        c_t.update(words_of(t))
        c_te.update(itertools.product(words_of(t), entities[t]))
    out = {}
    for (t, e), n in c_te.items():
        own = math.log2(len(distinct) / c_e[e])
        share = math.log2(len(distinct) * n / (c_t[t] * c_e[e])) / own if own > 0 else 0.0
        if n >= 2 and share >= sanitise.GENERALISE - 1e-12:
            out[t, e] = share
    return out


def texts(rng):
    common = [f"w{i}" for i in range(30)]
    out = []
    for i in range(60):
        words = rng.choices(common, k=rng.randrange(5, 60))
        if i % 3 == 0:
            who = rng.randrange(5)
            words += [f"p{who}@mail.org", f"Nick{who}", f"near{rng.randrange(3)}"] + [f"maybe{who}"] * rng.randrange(2)
        elif i % 7 == 0:
            words.append(f"nick{rng.randrange(5)}")
        rng.shuffle(words)
        out.append(" ".join(words))
    return out + out[:4] + ["", None]


def test_pairs_equal_plain_counts(spark):
    rows = texts(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(r.term, r.entity): r.ratio for r in sanitise.disclosing(docs, sanitise.entities(docs)).collect()}
    want = plain([t or "" for t in rows])
    assert got and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_every_place_is_marked(spark):
    rows = texts(random.Random(5))
    best = defaultdict(float)
    for (t, _), share in plain([t or "" for t in rows]).items():
        best[t] = max(best[t], share)

    def clean(text):
        out = EMAIL.sub("[EMAIL]", text)
        return re.sub(r"[^\W_]+", lambda m: m[0] if m[0] == "EMAIL" or m[0].lower() not in best else "" if best[m[0].lower()] >= sanitise.REMOVE else sanitise.MARK, out)

    got = {r.doc_id: r.text for r in sanitise.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {i: clean(t or "") for i, t in enumerate(rows)}
    assert any(sanitise.MARK in t for t in got.values()) or any(t.count("  ") for t in got.values())


def test_copies_are_no_evidence(spark):
    rows = [(i, "a@b.de secretword") for i in range(9)] + [(20 + i, f"other{i} words") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sanitise.disclosing(docs, sanitise.entities(docs)).count() == 0
