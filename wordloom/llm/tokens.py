"""Token ids of whole columns at once, whatever encodes a single word.

A space between two characters that are no white space always begins a piece of the tokenizers' pattern, and no piece
reaches over it: the texts between such spaces are encoded apart, exactly.  So a batch is cut at its spaces, equal
words are encoded once, and the ids are put back by index.  A text with other white space beside a space, or one at
its ends, is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat_ranges

#: White space beside a space, where a space does not begin a piece of its own (RE2 has no Unicode \s).
ODD = r"(^ )|( $)|( [\s\v\x1c-\x1f\x{85}\p{Z}])|([\s\v\x1c-\x1f\x{85}\p{Z}] )"
#: Bytes of text encoded at once: more of its words are equal than in a small batch.
TOKEN_BATCH = 8 << 20
#: White space of any kind: a word without any is encoded in one text with others.
WHITE = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
#: Words of one such text.
RUN = 64
#: Words whose ids a worker keeps, and bytes of the longest it keeps past that.
KEEP, KEEP_BYTES = 1_000_000, 64


class Words:
    """``encode`` gets a list of different texts and gives their ids; those of words after a space are kept up to a
    bound, as columns: a batch's words are found among them at once, and only new ones are encoded.  Texts that hold one
    of ``whole`` are encoded as wholes.  ``spaced`` tells of each id whether its token begins with a space: then new
    words are encoded ``RUN`` at a time, as one text that is cut where such tokens stand."""

    def __init__(self, encode: Callable[[list[str]], list], keep: int = KEEP, whole: tuple[str, ...] = (), spaced: np.ndarray | None = None):
        self.encode, self.keep, self.whole, self.spaced = encode, keep, whole, spaced
        self._clear(pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _clear(self, words: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.words, self.flat, self.lengths = words, flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def _find(self, found: pa.Array) -> np.ndarray:
        """The place of each word of ``found`` (all different) among the kept ones; new ones are added."""
        at = pc.index_in(found, value_set=self.words)
        new = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            words = found.take(pa.array(new))
            flat, lengths = self._encode_words(words)
            at[new] = len(self.words) + np.arange(len(new))
            self._clear(pa.concat_arrays([self.words, words]), np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths]))
        return at

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.encode(texts)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())), lengths

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_encode` of each word with a space before it."""
        alone = pc.or_(pc.match_substring_regex(words, WHITE), pc.equal(words, "")).to_numpy(zero_copy_only=False)
        run = [] if self.spaced is None else words.filter(pa.array(~alone)).to_pylist()
        flat, _ = self._encode([" " + " ".join(run[k : k + RUN]) for k in range(0, len(run), RUN)])
        heads = np.flatnonzero(self.spaced[flat]) if len(flat) else np.zeros(0, np.int64)
        # A tokenizer that marks spaces otherwise gives another count.
        if not run or len(heads) != len(run):
            return self._encode([" " + w for w in words.to_pylist()])
        lengths = np.zeros(len(words), np.int64)
        lengths[~alone] = np.diff(heads, append=len(flat))
        if not alone.any():
            return flat, lengths
        rest, lengths[alone] = self._encode([" " + w for w in words.filter(pa.array(alone)).to_pylist()])
        out, place = np.zeros(int(lengths.sum()), np.uint32), np.repeat(alone, lengths)
        out[~place], out[place] = flat, rest
        return out, lengths

    def _forget(self, used: np.ndarray) -> None:
        """Past the bound, only the last batch's words stay, and of them only ones of usual length."""
        if len(self.words) > self.keep or self.words.nbytes > 64 * self.keep:
            used = np.unique(used)
            used = used[pc.binary_length(self.words.take(pa.array(used))).to_numpy(zero_copy_only=False) <= KEEP_BYTES][-self.keep // 2 :]
            self._clear(self.words.take(pa.array(used)), self.flat[flat_ranges(self.starts[used], self.lengths[used])], self.lengths[used])

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each text), ids of all texts one after the other."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        for token in self.whole:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar(""), texts)
        parts = pc.split_pattern(plain, " ")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(parts.flatten())
        index = coded.indices.to_numpy(zero_copy_only=False)
        first = np.cumsum(sizes) - sizes
        # First words have no space before them; texts of the odd kind are first words as wholes.
        heads = coded.dictionary.take(pa.array(index[first])).to_pylist()
        for k in np.flatnonzero(odd).tolist():
            heads[k] = texts[k].as_py()
        place = self._find(coded.dictionary)
        flat, lengths = self._encode(heads)
        starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        per = np.concatenate([self.lengths, lengths])
        index = place[index]
        index[first] = len(self.words) + np.arange(len(heads))
        per_word = per[index]
        ids = np.concatenate([self.flat, flat])[flat_ranges(starts[index], per_word)]
        self._forget(place)
        return ids, np.add.reduceat(per_word, first)
