"""Token ids of whole texts by the tokenizers library, with a cache of pieces.

Both kinds of vocabulary used here split a text before they merge, and no
merge crosses that split. So a batch of texts is cut at single spaces and line
ends in Arrow, its distinct pieces are looked up in a table of known ones or
encoded once by the library, and their ids are gathered. The table is two
Arrow columns, so a piece takes some 50 bytes of a worker and no step but the
library's goes piece by piece. Words of letters alone go to the library
many to a text, as their tokens show where each begins (or ends); if they
don't, one by one. Texts whose spacing or characters could make the two cuts
differ (white space in a row, odd white space, control or combining
characters, a special token's string) go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from terraloom.llm.common import tidy

#: Odd white space, control, combining and joining characters, and starts of special tokens.
_ODD = "[\x00-\x09\x0b-\x1f\x7f-\xa0̀-ͯᄀ-ᇿ ᠎ -‏ -  -⁤　゙゚﻿]|  |\n\n| \n|\n |<\\||\\A[ \n]|[ \n]\\z"
#: Marks that may follow a word; none starts a contraction.
_MARKS = ".,;:!?%*&$#|"
_MOST = 100_000  #: pieces a worker keeps, unless an operator asks for more: each takes some 50 bytes
_MANY = 512  #: words in a text given to the library
_CALL = 32  #: such texts a call: what it returns takes some 100 bytes an id
#: How a piece that doesn't follow a space begins.
_FIRST, _LINE = "\x01", "\n"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``most`` bytes of one column: words repeat less often from batch to batch."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held.clear()
    tidy()


class Pieces:
    """Texts and their ids, in two columns."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, size: np.ndarray):
        self.texts, self.ids, self.size = texts, ids, size

    def __len__(self) -> int:
        return len(self.texts)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of the pieces at ``at``, in a row."""
        begin = np.insert(np.cumsum(self.size), 0, 0).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(begin), pa.array(self.ids)).take(pa.array(at)).flatten().to_numpy()

    def some(self, at: np.ndarray) -> "Pieces":
        return Pieces(self.texts.take(pa.array(at)), self.gather(at), self.size[at])

    def find(self, texts: pa.Array) -> np.ndarray:
        """Where each text stands, or -1."""
        return np.array(pc.fill_null(pc.index_in(texts, value_set=self.texts), -1), np.int64)

    @staticmethod
    def joined(*parts: "Pieces") -> "Pieces":
        return Pieces(pa.concat_arrays([p.texts for p in parts]), np.concatenate([p.ids for p in parts]), np.concatenate([p.size for p in parts]))


def _list(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """``flat(texts)``: the ids of all texts in a row, and where each text's begin."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        # A task has one core; the library's threads would each hold memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        #: Whether white space is dropped; else a space belongs to the word after it.
        self.dropped = self.tokenizer.normalizer is not None
        #: Pieces as they stand after a space; where white space is dropped, as they stand anywhere.
        self.known = Pieces(pa.array(["", _FIRST]), np.empty(0, np.uint32), np.zeros(2, np.int64))
        #: Where the pieces of the last batch stand among them.
        self.recent = np.arange(2)
        #: Pieces kept from batch to batch; beyond them those of the last one stay.
        self.most = _MOST
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Tokens that end a word, or begin one after a space.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, at in vocabulary.items():
            self.edge[at] = token.endswith("</w>") if self.dropped else token.startswith("\u0120")

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, texts: pa.Array, given: list[str]) -> Pieces:
        """``texts`` with the ids of ``given``, one for each."""
        ids = [x for i in range(0, len(given), _MANY) for x in self.whole(given[i : i + _MANY])]
        return Pieces(texts, np.concatenate([np.empty(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids)))

    def words(self, words: pa.Array) -> Pieces:
        """Words of letters, each with its ids as it stands after a space."""
        if not len(words):
            return self.encoded(words, [])
        ids, size = [], []
        space = "" if self.dropped else " "
        groups = pa.array([*range(0, len(words), _MANY), len(words)], pa.int32())
        joined = _list(pc.binary_join(pa.ListArray.from_arrays(groups, words), " "))
        for i in range(0, len(joined), _CALL):
            for k, got in enumerate(self.tokenizer.encode_batch_fast([space + g for g in joined[i : i + _CALL]], add_special_tokens=False), i):
                group = words[k * _MANY : (k + 1) * _MANY]
                own = np.array(got.ids, np.uint32)
                edge = np.flatnonzero(self.edge[own])
                if len(edge) == len(group):
                    ids.append(own)
                    size.append(np.diff(np.append(edge, len(own)) if space else np.insert(edge + 1, 0, 0)))
                else:
                    alone = self.encoded(group, [space + w for w in _list(group)])
                    ids.append(alone.ids)
                    size.append(alone.size)
        return Pieces(words, np.concatenate(ids), np.concatenate(size))

    def learn(self, new: pa.Array) -> None:
        """Append pieces to the known ones. A word and the marks after it never merge, so both are looked up apart."""
        word = pc.utf8_rtrim(new, characters=_MARKS)
        letters = pc.utf8_is_alpha(word).to_numpy(zero_copy_only=False)
        lettered, other = np.flatnonzero(letters), np.flatnonzero(~letters)
        coded = word.take(pa.array(lettered)).dictionary_encode()
        at = self.known.find(coded.dictionary)
        fresh = self.words(coded.dictionary.filter(pa.array(at < 0)))
        at[at < 0] = len(self.known) + np.arange(len(fresh))
        space = "" if self.dropped else " "
        others = new.take(pa.array(other))
        others = self.encoded(others, [p[1:] if p[0] == _FIRST else p if p[0] == _LINE else space + p for p in _list(others)])
        longer = pc.subtract(pc.binary_length(new), pc.binary_length(word)).to_numpy()
        parted = np.flatnonzero(letters & (longer > 0))
        tails: dict[str, int] = {}
        tail = np.fromiter((tails.setdefault(p[-n:], len(tails)) for p, n in zip(_list(new.take(pa.array(parted))), longer[parted].tolist())), np.int64, len(parted))
        marks = self.encoded(pa.array(tails, pa.string(), size=len(tails)), list(tails))
        # A piece is one of these, or two in a row.
        units = Pieces.joined(self.known, fresh, others, marks)
        first, second = np.empty(len(new), np.int64), np.full(len(new), -1)
        first[lettered] = at[coded.indices.to_numpy()]
        first[other] = len(self.known) + len(fresh) + np.arange(len(others))
        second[parted] = len(units) - len(marks) + tail
        both = np.stack([first, second], 1).ravel()
        size = units.size[first] + np.where(second < 0, 0, units.size[second])
        learnt = Pieces(new, units.gather(both[both >= 0]), size)
        # Words that stood with marks alone are known from now on, too.
        self.known = Pieces.joined(self.known, learnt, fresh.some(np.flatnonzero(learnt.find(fresh.texts) < 0)))

    def flat(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32 bits) of all texts, and the place of each text's first; null texts have none."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if len(self.known) > self.most:
            self.known = self.known.some(np.union1d([0, 1], self.recent))
        odd = pc.match_substring_regex(texts, _ODD)
        apart = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        alone = self.whole([texts[int(i)].as_py() for i in apart])
        plain = pc.if_else(odd, "", texts)
        if self.dropped:
            plain = pc.replace_substring(plain, "\n", " ")
        else:
            plain = pc.binary_join_element_wise(_FIRST, pc.replace_substring(plain, "\n", " \n"), "")
        cut = pc.split_pattern(plain, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        place = self.known.find(coded.dictionary)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.known) + np.arange(len(new))
            self.learn(coded.dictionary.take(pa.array(new)))
        self.recent = place
        index = place[coded.indices.to_numpy()]
        upto = np.insert(np.cumsum(self.known.size[index]), 0, 0)
        ids, at = self.known.gather(index), upto[offsets - offsets[0]]
        for i, own in zip(apart[::-1], alone[::-1]):
            ids = np.concatenate([ids[: at[i]], own, ids[at[i] :]])
            at[i + 1 :] += len(own)
        return ids, at

    def ids(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, as bytes."""
        ids, at = self.flat(texts)
        raw, at = ids.astype("<u4", copy=False).tobytes(), (at * 4).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]
