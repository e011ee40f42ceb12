"""Encoding whole texts with a public tokenizer, one memo of chunks per worker.

A text is cut only before a space or line feed that follows another character,
where no pre-token of the supported tokenizers can cross.  The distinct chunks of a
batch are looked up once each, and the library sees only those that a bounded memo
lacks: its normaliser and pre-tokenizer split a chunk, its model spells the parts.
For letters with ASCII marks behind them, which are two pre-tokens, the library is
asked once how it writes each letter.  A text for which the cut does not hold (tabs,
carriage returns, runs of white space, other Unicode spaces, a space at the end, an
added token) is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Chunks and pre-tokens that a worker remembers; it learns others again for each batch.
MEMO_ENTRIES = 250_000
#: Bytes of text that are looked up together.
BATCH_BYTES = 1_000_000

#: Leads the first chunk of a text, which no white space opens.
_FIRST = "\x00"
_ODD = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]| \z"
#: Letters that never compose with one another: Latin, Greek and Cyrillic.
_ALPHABET = [c for c in map(chr, range(0x41, 0x530)) if c.isalpha()]


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.splitter = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        #: how a pre-token shows the space before it, and the ids of a line feed
        self.opened = self._parts(" a")[0][:-1]
        written = {c: self._parts(c) for c in _ALPHABET}
        written = {c: w[0] for c, w in written.items() if len(w) == 1 and self._parts(f" a{c}a") == [f"{self.opened}a{w[0]}a"]}
        self.written = str.maketrans(written)
        self.letters = re.compile(rf"({_FIRST}?)([{''.join(written)}]+)([!-/:-@\[-`{{-~]*)")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *map(re.escape, added)])
        self.memo: dict[str, bytes] = {}
        self.line = b"".join(map(self._part, self._parts("\n")))

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """The encoder of this Python worker, until the worker turns to something else."""
        return kept(path, lambda: cls(path))

    def _parts(self, text: str) -> list[str]:
        """Pre-tokens by the library."""
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [part for part, _ in self.splitter.pre_tokenize_str(text)]

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token; NUL, which no pre-token holds, keeps it apart from chunks."""
        key = _FIRST + _FIRST + part
        got = self.memo.get(key)
        if got is None:
            got = array("I", [t.id for t in self.model.tokenize(part)]).tobytes()
            if len(self.memo) < MEMO_ENTRIES:
                self.memo[key] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk; one that has no mark of what opens it follows a space."""
        got = self.memo.get(chunk)
        if got is not None:
            return got
        plain = self.letters.fullmatch(chunk)
        if plain:
            first, word, marks = plain.groups()
            if marks:
                got = self._chunk(first + word) + self._part(marks)
            else:
                spelled = ("" if first else self.opened) + word.translate(self.written)
                got = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        elif chunk[:1] == "\n":
            got = self.line + self._chunk(_FIRST + chunk[1:])
        else:
            text = chunk[1:] if chunk[:1] == _FIRST else " " + chunk
            got = b"".join(map(self._part, self._parts(text)))
        if len(self.memo) < MEMO_ENTRIES:
            self.memo[chunk] = got
        return got

    def _whole(self, text: str) -> bytes:
        got = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(got.ids, dtype="<u4").tobytes()

    def _batch(self, texts: pa.Array) -> Iterator[bytes]:
        whole = pc.match_substring_regex(texts, self.odd)
        led = pc.binary_join_element_wise(_FIRST, pc.replace_substring(texts.filter(pc.invert(whole)), "\n", " \n"), "")
        cut = pc.split_pattern(led, " ")
        chunks = cut.flatten().dictionary_encode()
        known = self.memo.get
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        spelled = [known(c) or self._chunk(c) for c in distinct]
        pool = np.frombuffer(b"".join(spelled), "<u4")
        size = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
        code = chunks.indices.to_numpy()
        # where each chunk's ids lie in the pool, less where they go
        n = size[code]
        ends = np.cumsum(n)
        shift = (np.cumsum(size) - size)[code] - (ends - n)
        ids = pool[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)]
        bound = np.concatenate(([0], ends))[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        at = 0
        for i, odd in enumerate(whole.to_pylist()):
            if odd:
                yield self._whole(texts[i].as_py())
            else:
                yield ids[bound[at] : bound[at + 1]].tobytes()
                at += 1

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, in order; a null or empty text has none."""
        texts = pc.fill_null(texts, "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + BATCH_BYTES, side="right")))
            yield from self._batch(texts.slice(at, to - at))
            at = to
        pa.default_memory_pool().release_unused()
