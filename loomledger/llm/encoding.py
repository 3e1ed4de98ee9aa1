"""Token ids of whole texts by the ``tokenizers`` library, each distinct chunk encoded once.

A text is cut only where the tokenizer's own pre-tokenisation always cuts, so the ids of the chunks,
joined, are the ids of the text.  A text that holds the string of an added token (such as
``<|endoftext|>``) goes whole through the library, which makes that token of it.  Most words repeat; a bounded cache of chunks makes that cheap.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

CACHED = 700_000
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class ChunkEncoder:
    """``keeps_space``: the vocabulary marks the space before a word (byte-level), else white space is dropped.

    Ids are returned as little-endian uint16 bytes, or uint32 where the vocabulary needs it.
    """

    def __init__(self, path: str, keeps_space: bool, cache_size: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.keeps_space = keeps_space
        self.cache_size = cache_size or (CACHED // 2 if keeps_space else CACHED)  # with the space, two caches are in use
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.first: dict[str, bytes] = {}  # a text's first chunk, and, without a leading space, the others
        self.later: dict[str, bytes] = {}
        self.lead = " " if keeps_space else ""
        self.older: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        # Where white space is dropped, a symbol between blanks keeps the chunks apart.
        self.separator = "\n" if keeps_space else " ~ "
        (self.separator_id,) = self._batch([self.separator.strip(" ")])[0].ids

    def _learn(self, known: dict[str, bytes], chunks: set[str], lead: str, odd: bool = False) -> None:
        """``odd``: chunks may be empty, hold line ends or have white space at their ends."""
        new, old = chunks.difference(known), self.older[lead]
        if old and (moved := [c for c in new if c in old]):
            known.update(zip(moved, map(old.__getitem__, moved)))
            new.difference_update(moved)
        if odd:
            rest = [c for c in new if not c or "\n" in c or c[0].isspace() or c[-1].isspace()]
            known.update((c, self._pack(e.ids)) for c, e in zip(rest, self._batch([lead + c for c in rest])))
            new.difference_update(rest)
        # A line end is a token of its own, so many chunks go through the library as lines of one text.
        plain, between, width = list(new), self.separator + lead, self.dtype.itemsize
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = self._pack(self._batch([lead + between.join(part)])[0].ids)
            cuts = np.flatnonzero(np.frombuffer(ids, self.dtype) == self.separator_id) * width
            if len(cuts) != len(part) - 1:  # a chunk that makes the separator's own token
                known.update((c, self._pack(e.ids)) for c, e in zip(part, self._batch([lead + c for c in part])))
                continue
            starts = [0, *(cuts + width).tolist()]
            known.update(zip(part, [ids[i:j] for i, j in zip(starts, [*cuts.tolist(), len(ids)])]))

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode(self, texts: Iterable[str], group: int = 256) -> Iterable[bytes]:
        """The ids of each text."""
        texts = list(texts)
        line_end = self._pack([self.separator_id]) if self.keeps_space else b""
        for at in range(0, len(texts), group):
            if len(self.later) > self.cache_size:  # two generations: what is in use moves to the newer one
                self.older[self.lead], self.later = self.later, {}
            if len(self.first) > self.cache_size:
                self.older[""], self.first = self.first, {}
            part = texts[at : at + group]
            special = [k for k, text in enumerate(part) if self.added.search(text)]
            whole = dict(zip(special, (self._pack(e.ids) for e in self._batch([part[k] for k in special]))))
            cut, heads, odd = [], [], []
            for k, text in enumerate(part):
                if k in whole:
                    text = ""
                if not self.keeps_space:
                    cut.append(text.replace("\n", " ").split(" "))
                elif " ".join(text.split()) != text.replace("\n", " "):  # white space other than single blanks and line ends
                    head, *tail = _SINGLE_SPACE.split(text)
                    odd.append((head, tail))
                    cut.append([(head, tail)])
                else:
                    lines = [(line[0], line[1:]) for line in (x.split(" ") for x in text.split("\n"))]
                    heads.extend(line[0] for line in lines)
                    cut.append(lines)
            if not self.keeps_space:
                self._learn(self.later, set().union(*cut), "")
                known = self.later.__getitem__
                for k, chunks in enumerate(cut):
                    yield whole[k] if k in whole else b"".join(map(known, chunks))
                continue
            self._learn(self.first, {head for head, _ in odd}, "", odd=True)
            self._learn(self.later, set().union(*(tail for _, tail in odd)), " ", odd=True)
            self._learn(self.first, set(heads) - {""}, "")
            self._learn(self.later, set().union(*(tail for lines in cut for _, tail in lines)), " ")
            self.first[""] = b""
            first, later = self.first, self.later.__getitem__
            for k, lines in enumerate(cut):
                yield whole[k] if k in whole else line_end.join([first[head] + b"".join(map(later, tail)) for head, tail in lines])


@lru_cache(maxsize=2)
def shared_encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    return ChunkEncoder(path, keeps_space)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
