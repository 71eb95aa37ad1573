"""Python workers outlive an operator; a pipeline must not hold the tables of all its stages in them at once."""

import public_tokenizers
import pyarrow as pa

from sequora.llm import common, decontaminate, tokens


def test_a_worker_keeps_the_tables_of_one_operator():
    class Shared:
        value = [(1, "one two three four five six seven eight")]

    texts = pa.array(["zero one two three four five six seven eight nine", "something else"])
    found = [[w[0] for w in windows] for _, windows in decontaminate.items_of(Shared).search(texts)]
    assert found == [[1]] and decontaminate._last[0] is Shared.value and decontaminate._buffers
    ids, counts = tokens.worker_tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(texts, 2)
    assert decontaminate._last == [None, None] and not decontaminate._hashes and not decontaminate._buffers
    again = tokens.worker_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert again.number  # the operator at hand keeps its own
    assert [[w[0] for w in windows] for _, windows in decontaminate.items_of(Shared).search(texts)] == [[1]]
    assert not tokens._workers
    common.hold()
    assert decontaminate._last == [None, None]
    other_ids, other_counts = tokens.worker_tokenizer(public_tokenizers.path("byte_bpe_50k.json")).encode(texts, 2)
    assert other_ids.tolist() == ids.tolist() and other_counts.tolist() == counts.tolist()
