"""Token ids by a public tokenizer, one white-space word at a time through a bounded table of known words."""

import re
from array import array

import numpy as np

from kinlode.llm import kernels as K

#: Most words, and most parts of words, that a worker remembers; what lies beyond is tokenised each time it comes.
KNOWN_WORDS, KNOWN_PARTS = 600_000, 60_000
#: Words that a batch hands to the tokenizer at once.
AT_ONCE = 1000
_HASH = 0x9E6C63D0876A9A47
#: How the tokenizer cuts words of these plain letters, digits and marks (other words go to it whole).
_PLAIN = re.compile("[\x21-\x7eß-öø-ķĹ-ň]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ķĹ-ň]+|[0-9]|[^a-z0-9ß-öø-ķĹ-ň]+")
#: A tokenizer whose ids of this text are not those of its words in a row is refused.
PROBE = ["It's the 1st word-end PROBE, isn't it?\n\tÜber 42 naïve cafés & co...", "don't !!! a1b2 x_y 日本語 テスト emoji 🙂 <tag>\x85end", "", "  "]


class WordTokenizer:
    """ids of a tokenizer that drops white space, lower-cases, and never joins words, letters, digits and marks, as the
    word-end BPE does; for such a tokenizer the ids of a text are those of its parts in a row. Known words are looked up
    by 64 bits of hash."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.inner = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.inner.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        #: Hashes of the known words in order, and the entry of each; entries: first id in flat and number of ids.
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.size, self.flat, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), 0
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = {b: byte_level.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)}
        for c in map(chr, range(0x80, 0x180)):  # two bytes each; together they show every byte that plain words have
            latin.update(zip(c.encode(), byte_level.pre_tokenize_str(c)[0][0], strict=True))
        self.alphabet = latin
        if any(mine.tolist() != self.inner.encode(text, add_special_tokens=False).ids for text, mine in zip(PROBE, self.texts([x.encode() for x in PROBE]), strict=True)):
            raise ValueError(f"{path}: its ids are not those of white-space words in a row")

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), AT_ONCE):
            out.extend(array("I", e.ids).tobytes() for e in self.inner.encode_batch(texts[i : i + AT_ONCE], add_special_tokens=False))
        return out

    def _part(self, part: str) -> bytes:
        """One part by the model itself, written in the byte alphabet of the tokenizer."""
        if not part.isascii():
            part = "".join([self.alphabet[b] for b in part.encode()])
        return array("I", [t.id for t in self.inner.model.tokenize(part)]).tobytes()

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of 32-bit numbers."""
        out, odd, parts = [b""] * len(words), [], self.parts
        for i, word in enumerate(words):
            text = word.decode().lower()
            if text.isascii() and text.isalpha():
                out[i] = self._part(text)
                continue
            if not _PLAIN.fullmatch(text):
                odd.append(i)
                continue
            ids = []
            for x in _PARTS.findall(text):
                found = parts.get(x)
                if found is None:
                    found = self._part(x)
                    if len(parts) < KNOWN_PARTS:
                        parts[x] = found
                ids.append(found)
            out[i] = b"".join(ids)
        for i, ids in zip(odd, self._ids([words[i].decode() for i in odd]), strict=True):
            out[i] = ids
        return out

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, size, ids) of new words, hashes in order; they are remembered as long as there is room."""
        ids = self._words(words)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        room = max(0, min(len(words), KNOWN_WORDS - len(self.keys)))
        if room:
            n = int(size[:room].sum())
            while self.used + n > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + n] = flat[:n]
            at = np.searchsorted(self.keys, hashes[:room])
            self.entry = np.insert(self.entry, at, np.arange(len(self.first), len(self.first) + room, dtype=np.int32))
            self.keys = np.insert(self.keys, at, hashes[:room])
            self.first = np.append(self.first, self.used + first[:room])
            self.size = np.append(self.size, size[:room].astype(np.int32))
            self.used += n
        return first, size, flat

    def texts(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, as uint32."""
        special = {i for i, raw in enumerate(raws) if any(s in raw for s in self.special)}
        lower = b"".join([b"" if i in special else raw for i, raw in enumerate(raws)]).lower()
        offsets = np.cumsum([0, *(0 if i in special else len(raw) for i, raw in enumerate(raws))])
        data = np.frombuffer(lower, np.uint8)
        starts, ends, words = K.word_spans(data, offsets)
        h = K.word_hashes(data, starts, ends, _HASH)
        first, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        known = np.zeros(len(h), dtype=bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[at] == h
            at = self.entry[at[known]]
            first[known], size[known] = self.first[at], self.size[at]
        new = np.flatnonzero(~known)
        source = self.flat
        if len(new):
            hashes, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            where = new[where]
            got, count, flat = self._learn(hashes, [lower[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            source = np.concatenate([self.flat[: self.used], flat])
            first[new], size[new] = self.used + got[back], count[back]
        upto = np.cumsum(size)
        tokens = source[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - (upto - size), size)]
        bounds = np.concatenate([[0], upto])[words]
        out = [tokens[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in special:
            out[i] = np.frombuffer(self._ids([raws[i].decode()])[0], np.uint32)
        return out


_open: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _open:
        _open[path] = WordTokenizer(path)
    return _open[path]
