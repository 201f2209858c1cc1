"""Tokenising whole Arrow blocks with the ``tokenizers`` library, each distinct chunk once.

Texts are cut at single ASCII spaces that stand between two characters which are not white space. No pre-token of the
two supported families reaches across such a place (byte-level BPE takes the space into the next piece; word-end BPE
drops white space), so encoding the distinct chunks and joining their ids equals encoding the whole text. Texts with
any other use of spaces are encoded whole.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mapframe.llm.common import offsets_of, ranges, text_of

_UNSAFE = "(^ )|( $)|( [\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}])|([\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}] )"
#: Chunks that are surely one or two pre-tokens of the word-end tokenizer.
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-&(-/:;=?@\\[-`{-~]*$"
#: Distinct chunks that a worker remembers; beyond it, it forgets those it has hardly used.
_MOST = 600_000

#: Bytes of text encoded together: the known chunks are indexed anew for each block, so a block is worth that.
BLOCK_BYTES = 4 << 20

_encoders: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, most: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once a process; ``most``: the chunks it remembers."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]


def vocabulary_size(path: str) -> int:
    return encoder(path).size


class Encoder:
    def __init__(self, path: str, most: int | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.starts_word = np.zeros(self.size, bool)
        self.ends_word = np.zeros(self.size, bool)
        for token, i in vocab.items():
            self.starts_word[i] = token.startswith("Ġ")
            self.ends_word[i] = token.endswith("</w>")
        self.byte_level = not self.ends_word.any()
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.pool = np.zeros(1 << 16, np.uint32)
        self.filled = 0
        self.at = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)

    def _thin(self) -> None:
        """Forget the chunks that only one block had, and if that is not half of all, the less used ones too."""
        uses = self.uses[: len(self.known)]
        keep = np.flatnonzero(uses > max(1, int(np.median(uses))))[: (self.most or _MOST) // 2] if len(uses) else np.zeros(0, np.int64)
        known, pool, at, length = self.known, self.pool, self.at[keep], self.length[keep]
        self._forget()
        if len(keep):
            self._keep(known.take(pa.array(keep)), pool[ranges(at, length)], length)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, chunk: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, first = len(chunk), len(self.known)
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        if first + n > len(self.at):
            grow = np.zeros(max(len(self.at), n), np.int64)
            self.at, self.length = np.concatenate([self.at, grow]), np.concatenate([self.length, grow])
            self.uses = np.concatenate([self.uses, grow.astype(np.int32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        ends = np.cumsum(lengths)
        self.at[first : first + n] = self.filled + ends - lengths
        self.length[first : first + n] = lengths
        self.filled += len(ids)
        self.known = pa.concat_arrays([self.known, chunk])

    def _learn(self, new: pa.Array) -> None:
        """Encode chunks not seen before; simple ones many at a time, since a call for each costs more than its work."""
        if self.byte_level:
            simple = pc.and_(pc.starts_with(new, " "), pc.invert(pc.match_substring(new, "<|"))).to_numpy(zero_copy_only=False)
            marks = np.ones(len(new), np.int64)
        else:
            simple = pc.match_substring_regex(new, _PLAIN).to_numpy(zero_copy_only=False)
            marks = 2 - pc.match_substring_regex(new, "^[A-Za-zÀ-ÿ]+$").to_numpy(zero_copy_only=False).astype(np.int64)
        odd, fine, marks = [new.filter(pa.array(~simple))], new.filter(pa.array(simple)), marks[simple]
        for k in range(0, len(fine), 20_000):
            part, many = fine.slice(k, 20_000), marks[k : k + 20_000]
            lists = pa.ListArray.from_arrays(pa.array([*range(0, len(part), 500), len(part)], pa.int32()), part)
            joined = pc.binary_join(lists, "" if self.byte_level else " ").to_pylist()
            ids = _flat(self._whole(joined))
            if self.byte_level:
                firsts = np.flatnonzero(self.starts_word[ids])
                good = len(firsts) == len(part)
                lengths = np.diff(np.append(firsts, len(ids)))
            else:
                ends = np.flatnonzero(self.ends_word[ids])
                good = len(ends) == int(many.sum())
                lengths = np.diff(np.concatenate([[0], ends[np.cumsum(many) - 1] + 1])) if good else None
            if good:
                self._keep(part, ids, lengths)
            else:
                odd.append(part)
        for k in range(0, len(rest := pa.concat_arrays(odd)), 20_000):
            got = self._whole(rest.slice(k, 20_000).to_pylist())
            self._keep(rest.slice(k, 20_000), _flat(got), np.array([len(x) for x in got], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts, offsets per text)``: what ``encode(text, add_special_tokens=False)`` gives for each."""
        texts = text_of(texts)
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            return self._chunked(texts)
        whole = self._whole(pc.filter(texts, pa.array(unsafe)).to_pylist())
        ids, offsets = self._chunked(text_of(pc.filter(texts, pa.array(~unsafe))))
        lengths = np.zeros(len(texts), np.int64)
        lengths[~unsafe] = np.diff(offsets)
        lengths[unsafe] = [len(x) for x in whole]
        out, bounds = np.zeros(int(lengths.sum()), np.uint32), np.concatenate([[0], np.cumsum(lengths)])
        out[ranges(bounds[:-1][~unsafe], lengths[~unsafe])] = ids
        out[ranges(bounds[:-1][unsafe], lengths[unsafe])] = np.array([i for x in whole for i in x], np.uint32)
        return out, bounds

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        bounds, flat = offsets_of(lists), lists.flatten()
        coded = flat.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if len(self.known) + len(distinct) > (self.most or _MOST):
            self._thin()
        if self.byte_level:  # the first chunk of a text has no space before it, the others do; an empty text has no ids
            firsts = np.zeros(len(flat), bool)
            firsts[bounds[:-1]] = True
            out = self._numbers(pc.binary_join_element_wise("", distinct, " "))[codes]
            out[firsts] = self._numbers(heads := distinct.take(pa.array(codes[firsts])).dictionary_encode().dictionary)[pc.index_in(distinct.take(pa.array(codes[firsts])), heads).to_numpy(zero_copy_only=False)]
        else:
            out = self._numbers(distinct)[codes]
        lengths = self.length[out]
        ids = self.pool[ranges(self.at[out], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[bounds]

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of distinct chunks; new ones are encoded first."""
        found = pc.index_in(chunks, self.known)
        if found.null_count:
            self._learn(chunks.filter(pc.is_null(found)))
            found = pc.index_in(chunks, self.known)
        numbers = found.to_numpy(zero_copy_only=False)
        self.uses[numbers] += 1
        return numbers


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
