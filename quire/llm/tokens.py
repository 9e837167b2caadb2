"""Byte-level BPE over Arrow text: each distinct pre-token of a batch is encoded once by the tokenizers library."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the byte-level pre-token pattern of the vocabulary files.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode white space besides ASCII's, as a character class body.
WIDE_SPACE = r"\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space which is not followed by a visible character: such texts are cut by the slower pattern.
ODD_SPACE = rf" (?:[\s\x{{0b}}{WIDE_SPACE}]|\z)"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte; bytes without a printable Latin-1 form are numbered on from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class ByteBpe:
    """Encodes Arrow string arrays as the library does. The cache holds at most cache_size pre-tokens and starts anew beyond that.

    A text that holds the string of an added token goes to the library whole, which gives that token its own id.
    """

    def __init__(self, path: str, cache_size: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.plain = Tokenizer.from_file(path)  # as it is, for texts with added tokens
        self.added = "|".join(re.escape(t.content) for t in self.plain.get_added_tokens_decoder().values() if t.content)
        self.model = Tokenizer.from_file(path)
        self.vocab_size = self.model.get_vocab_size()
        self.model.encode_special_tokens = True
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # we hand over byte-lettered pre-tokens parted by spaces
        self.pattern = regex.compile(PRETOKEN)
        self.split_odd = re.compile(r" (?=\S)")
        self.letters = byte_letters() | {0xFF: " "}  # byte FF is never part of UTF-8
        self.cache_size = cache_size
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint32), [np.zeros(1, np.int64)], 0

    def _learn(self, words: list[str]) -> None:
        """Encode new pre-tokens, many to a call."""
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            lettered = "\udcff".join(part).encode("utf-8", "surrogateescape").decode("latin-1").translate(self.letters)
            got = self.model.encode_batch([lettered], add_special_tokens=False)[0]
            ids = np.array(got.ids, np.uint32)
            counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts.append(self.used + np.cumsum(counts))
            self.used += len(ids)
            for w in part:
                self.known[w] = len(self.known)

    def _codes(self, pre: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(pre) if w not in known]
        if new:
            self._learn(new)
        return np.fromiter(map(known.__getitem__, pre), np.int64, len(pre))

    def _chunks(self, chunks: list[str], led: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, and how many each has. led: each is preceded by one space and starts with a visible
        character, so that none of its pre-tokens can reach over its borders."""
        if not chunks:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if led:
            whole = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))  # a space and letters: one pre-token
            pre = [" " + c for c, w in zip(chunks, whole.tolist()) if w]
            cut = [c for c, w in zip(chunks, whole.tolist()) if not w]
            more = self.pattern.findall(" " + " ".join(cut)) if cut else []
            ends = np.cumsum(np.fromiter(map(len, more), np.int64, len(more)))
            cut_ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1)
            each = np.ones(len(chunks), np.int64)
            each[~whole] = np.diff(np.searchsorted(ends, cut_ends) + 1, prepend=0)
            upto = np.cumsum(each)
            found = self._codes(pre + more)
            codes = np.empty(len(found), np.int64)
            mine = np.repeat(whole, each)
            codes[mine], codes[~mine] = found[: len(pre)], found[len(pre) :]
        else:
            each = [self.pattern.findall(c) for c in chunks]
            pre = [w for ws in each for w in ws]
            upto = np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
            codes = self._codes(pre)
        starts = np.concatenate(self.starts)
        self.starts = [starts]
        ids, lens = gather(self.flat, starts, codes)
        token_ends = np.concatenate([[0], np.cumsum(lens)])[upto]
        return ids, np.diff(token_ends, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32) and the number of ids of each text; nulls count as empty."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > self.cache_size:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False) & ~whole
        kinds = [(~(odd | whole), self._plain_chunks), (odd, self._odd_chunks)]
        done = [(np.flatnonzero(which), *self._encoded(cut(texts.filter(pa.array(which))))) for which, cut in kinds if which.any()]
        if whole.any():
            each = [np.array(self.plain.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.filter(pa.array(whole)).to_pylist()]
            done.append((np.flatnonzero(whole), np.concatenate(each), np.array([len(x) for x in each], np.int64)))
        if len(done) == 1:
            return done[0][1], done[0][2]
        counts = np.concatenate([d[2] for d in done])
        back = np.argsort(np.concatenate([d[0] for d in done]))
        return gather(np.concatenate([d[1] for d in done]), np.concatenate([[0], np.cumsum(counts)]), back)

    @staticmethod
    def _plain_chunks(texts: pa.Array) -> pa.Array:
        return pc.split_pattern(texts, " ")

    def _odd_chunks(self, texts: pa.Array) -> pa.Array:
        return pa.array([self.split_odd.split(t) for t in texts.to_pylist()], pa.large_list(pa.large_string()))

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are cut before spaces which a visible character follows. A text's first piece has no space before
        it and is cut by itself; each distinct piece is encoded once."""
        offsets = pieces.offsets.to_numpy().astype(np.int64)
        values = pieces.flatten()
        offsets = offsets - offsets[0]
        coded = values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        uniq = coded.dictionary.to_pylist()
        later, where_later = np.unique(codes[~first], return_inverse=True)
        led_ids, led_counts = self._chunks([uniq[c] for c in later], True)
        opening, where_first = np.unique(codes[first], return_inverse=True)
        open_ids, open_counts = self._chunks([uniq[c] for c in opening], False)
        codes[~first] = where_later
        codes[first] = len(later) + where_first
        counts = np.concatenate([led_counts, open_counts])
        ids, lens = gather(np.concatenate([led_ids, open_ids]), np.concatenate([[0], np.cumsum(counts)]), codes)
        return ids, np.diff(np.concatenate([[0], np.cumsum(lens)])[offsets])


def gather(flat: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows codes of the ragged array (flat, starts) end to end, and their lengths."""
    begin = starts[codes]
    lens = starts[codes + 1] - begin
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(begin - (ends - lens), lens)
    at += np.arange(total)
    return flat[at], lens


_ENCODERS: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]
