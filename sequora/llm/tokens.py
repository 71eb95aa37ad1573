"""Token ids by the tokenizers library, each distinct stretch of text encoded once per worker.

Both vocabularies used here cut a text before they merge, and neither lets a cut-out part hold a space that follows a
visible character.  So a text may be cut in front of such a space, and the parts' ids joined are the text's ids.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Parts remembered by a worker unless told otherwise; later ones are encoded anew each time, so memory stays bounded and ids are the same.
REMEMBERED = 300_000
#: Characters of the longest part remembered.
LONGEST = 64
#: White space other than single spaces and line ends: such texts need the slower cut.
_UNPLAIN = r"[ \n][ \n]|[\t\x0b-\x0d\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters and these signs are never in one cut-out part, and no sign here composes with what follows it.
_LETTER_THEN_MARK = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,*$%&#!|])"
MARK = "\x01\x02"
_CUT = re.compile(r"(?<![\s\x1c-\x1f])(?= )")
_workers: dict[str, "PartTokenizer"] = {}


def worker_tokenizer(path: str, remembered: int = REMEMBERED) -> "PartTokenizer":
    """The tokenizer of this Python worker for a vocabulary file; it remembers that many parts."""
    common.hold("tokens", _workers.clear)
    if path not in _workers:
        _workers[path] = PartTokenizer(path)
    _workers[path].remembered = remembered
    return _workers[path]


class PartTokenizer:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.used = 0
        self.remembered = REMEMBERED

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
        return flat, counts

    def _remember(self, parts: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        short = np.fromiter((len(p) <= LONGEST for p in parts), bool, len(parts))
        if not short.all():
            flat = flat[np.repeat(short, counts)]
            parts, counts = [p for p in parts if len(p) <= LONGEST], counts[short]
        n, room = len(self.number), self.remembered - len(self.number)
        if room <= 0:
            return
        parts, counts = parts[:room], counts[:room]
        flat = flat[: counts.sum()]
        while n + len(parts) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.first[n : n + len(parts)] = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.count[n : n + len(parts)] = counts
        self.used += len(flat)
        self.number.update(zip(parts, range(n, n + len(parts)), strict=True))

    def _distinct(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts: (pool, first position in the pool, count)."""
        known = self.number.get
        at = np.fromiter((known(p, -1) for p in parts), np.int64, len(parts))
        old = at >= 0
        first, count = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        first[old], count[old] = self.first[at[old]], self.count[at[old]]
        new = np.flatnonzero(~old)
        pool = self.ids
        if len(new):
            missing = [parts[i] for i in new]
            flat, counts = self._encode(missing)
            base = self.used
            first[new] = base + np.concatenate([[0], np.cumsum(counts)[:-1]])
            count[new] = counts
            pool = np.concatenate([self.ids[:base], flat])
            self._remember(missing, flat, counts)
        return pool, first, count

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by ``end_id``: (flat ids, ids per text)."""
        texts = pc.fill_null(texts, "")
        if len(texts) and pa.types.is_string(texts.type):
            texts = texts.cast(pa.large_string())
        parts, numbers = self._cut(texts)
        coded = parts.dictionary_encode()
        pool, first, count = self._distinct(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = count[index]
        ends = np.cumsum(numbers)
        total = np.concatenate([[0], np.cumsum(each)])
        per_text = total[ends] - total[ends - numbers]
        n = int(total[-1])
        taken = np.repeat(first[index] - total[:-1], each) + np.arange(n)
        out = np.full(n + len(numbers), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(per_text + 1) - 1] = False
        out[keep] = pool[taken]
        return out, per_text + 1

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of all texts in order, and how many each text has."""
        plain = ~np.asarray(pc.match_substring_regex(texts, _UNPLAIN).to_numpy(zero_copy_only=False), bool)
        for word in self.specials:
            plain &= ~pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        if plain.all():
            return self._marked(texts)
        chunks: list[pa.Array] = []
        numbers = np.zeros(len(texts), np.int64)
        edges = np.flatnonzero(np.diff(plain.astype(np.int8))) + 1
        for a, b in zip([0, *edges], [*edges, len(texts)], strict=True):
            if plain[a]:
                part, numbers[a:b] = self._marked(texts.slice(a, b - a))
                chunks.append(part)
                continue
            for i in range(a, b):
                text = texts[i].as_py()
                own = [text] if any(w in text for w in self.specials) else _CUT.split(text)
                numbers[i] = len(own)
                chunks.append(pa.array(own, pa.large_string()))
        return pa.concat_arrays(chunks), numbers

    @staticmethod
    def _marked(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The cut of texts without runs of white space, by a marker that none of them holds."""
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            own = [_CUT.split(t) for t in texts.to_pylist()]
            return pa.array([p for o in own for p in o], pa.large_string()), np.array([len(o) for o in own], np.int64)
        texts = pc.replace_substring_regex(texts, _LETTER_THEN_MARK, rf"\1{MARK}\2")
        texts = pc.replace_substring(pc.replace_substring(texts, " ", f"{MARK} "), "\n", f"{MARK}\n{MARK}")
        parts = pc.split_pattern(texts, MARK)
        return parts.flatten(), np.diff(parts.offsets.to_numpy()).astype(np.int64)
