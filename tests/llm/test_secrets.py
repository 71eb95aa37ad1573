"""Keys behind a word and a separator are spans; paths of words are not."""

from sequora.llm import secrets

KEY = "q7Zp2Xv9Lk4Tn8Rb3Wd6Hs1Jm5Gc0FyAeUoK"
FOUND = [f"ghp_{KEY}", f"sk_live_{KEY[:24]}", f"sk-{KEY[:20]}", f"glpat-{KEY[:20]}", f"path/{KEY[:24]}"]
FREE = ["some/path/of/several/words", "a_name_made_of_many_words"]


def test_prefixed_keys_are_found(spark):
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(FOUND + FREE)], "doc_id long, text string")
    found = {r.doc_id: r.found.entropy for r in secrets.scan(docs).collect()}
    assert [len(found[i]) for i in range(len(found))] == [1] * len(FOUND) + [0] * len(FREE)
