"""Token ids of whole texts, with the work done once for each distinct piece of a batch."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space next to white space (or NUL): only there can a cut before a space change the ids.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}|\x00"
#: Distinct pieces that a worker keeps ids of: the first ones, among which are the frequent ones.
_CACHED = 300_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of the texts of an Arrow array under a tokenizer file.

    The pre-tokenizers of the files used here never join a space to what stands
    before it, so a text may be cut before each single space: the pieces' ids one
    after another are the text's. Other texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids as 32-bit integers."""
        known = self.known
        out = list(map(known.get, pieces))
        fresh = [k for k, x in enumerate(out) if x is None]
        if fresh:
            for k, found in zip(fresh, self.tokenizer.encode_batch_fast([pieces[k] for k in fresh], add_special_tokens=False)):
                out[k] = array("I", found.ids).tobytes()
                if len(known) < _CACHED:
                    known[pieces[k]] = out[k]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and where each text's begin (one entry more than texts)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD)
        parts = pc.split_pattern(pc.if_else(odd, texts, pc.replace_substring(texts, " ", "\x00 ")), "\x00")
        if pc.any(odd).as_py():  # a NUL of the text's own must not cut it
            whole = pc.list_flatten(pa.array([[x] for x in texts.to_pylist()]))
            rows = [[w] if o else p for p, w, o in zip(parts.to_pylist(), whole.to_pylist(), odd.to_pylist())]
            parts = pa.array(rows, pa.list_(pa.string()))
        coded = parts.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy()
        n = lengths[codes]
        upto = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(starts[codes] - upto[:-1], n) + np.arange(upto[-1])
        return flat[at], upto[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


def encoder(path: str) -> Encoder:
    """The encoder of this worker for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, begins: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more, `end`, after each text."""
    n = len(begins) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    fresh = begins + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[fresh[1:] - 1] = False
    out[keep] = ids
    return out, fresh
