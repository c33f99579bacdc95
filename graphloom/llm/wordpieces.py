"""Token ids of whole Arrow batches by the tokenizers library.

Space and line feed always part tokens of the vocabulary used here, so a text's
ids are those of its space-separated chunks end to end. Each distinct chunk of a
batch is encoded once. A chunk of plain letters with closing punctuation is one
word of the model and takes the library's model alone; every other chunk takes
the library's whole path. Tokenizers without that property get whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm.textbytes import AT_TASK_END, expand

#: Words whose ids a task keeps, about 200 bytes each; beyond it the store starts anew, as it does with each task.
KEPT = 500_000
_PLAIN = re.compile("([a-zß-öø-ÿÀ-ÖØ-Þ]+)([!-/:-@\\[-`{-~]*)")


class Encoder:
    """``encode`` gives (flat ids, count of each text); nulls and empty texts have none."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre, model = json.dumps(spec.get("pre_tokenizer")), spec["model"]
        drops = '"behavior": "Removed", "invert": true' in pre and "[^\\\\s\\\\p{L}\\\\p{N}]+" in pre and "[\\\\p{L}]+" in pre
        self.parts = drops and "Lowercase" in json.dumps(spec.get("normalizer")) and model["type"] == "BPE"
        self.tokenizer_model = self.tokenizer.model
        self.kept: dict[str, bytes] = {}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        table = _byte_letters()
        self.trans = {c: "".join(table[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _word(self, word: str) -> bytes:
        got = self.kept.get(word)
        if got is None:
            ids = [t.id for t in self.tokenizer_model.tokenize(word if word.isascii() else word.lower().translate(self.trans))]
            got = self.kept[word] = array("I", ids).tobytes()
        return got

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        if len(self.kept) > KEPT:
            self.kept = {}
        match, word = _PLAIN.fullmatch, self._word
        out = list(map(self.kept.get, chunks))
        rest = []
        for i, got in enumerate(out):
            if got is None:
                m = match(chunks[i])
                if m is None:
                    rest.append(i)
                else:
                    out[i] = word(m[1]) + word(m[2]) if m[2] else word(m[1])
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False) if rest else []):
            out[i] = array("I", e.ids).tobytes()
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        col = pc.fill_null(col, "")
        if not len(col):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.parts:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(col.to_pylist(), add_special_tokens=False)]
            flat = np.fromiter((x for e in ids for x in e), np.uint32, sum(map(len, ids)))
            return flat, np.array([len(e) for e in ids], np.int64)
        low = pc.ascii_lower(col)
        if any(pc.any(pc.match_substring(low, t.lower())).as_py() for t in self.specials):
            low = col  # special tokens are matched as they are written
        split = pc.split_pattern(pc.replace_substring(low, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids = self._chunks(coded.dictionary.to_pylist())
        count = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), np.uint32)
        first = np.concatenate(([0], np.cumsum(count)))[:-1] if len(count) else np.zeros(0, np.int64)
        which = coded.indices.to_numpy()
        sizes = count[which]
        out = flat[expand(first[which], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = split.offsets.to_numpy()
        at = at - at[0]
        return out, ends[at[1:]] - ends[at[:-1]]


def _forget() -> None:
    for e in Encoder._made.values():
        e.kept = {}


AT_TASK_END.append(_forget)


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level tokenizers write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out
