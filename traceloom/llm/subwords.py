"""Token ids of whole texts, put together from the ids of their pieces: the library encodes each piece once a worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: What tells that a model drops white space, or that its tokens begin with their space (no token reaches over the cut).
DROPS = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
BY_SPACE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Letters of which lower case, composition and class are the same in all versions of Unicode.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Pieces of these characters, and of no special token, split into the library's words by the patterns below; \0 parts them.
PLAIN = rf"^[\t-\r -~{LETTERS}]*$"
PARTS = re.compile(rf"\0|[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s\x000-9{LETTERS}]+")
SPACED = re.compile(rf"\0| ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\x000-9{LETTERS}]+|\s+(?![^\s\0])|\s+")
IS_SPACE, WIDE_SPACE = np.zeros(256, bool), np.zeros(256, bool)
IS_SPACE[[*range(9, 14), *range(28, 33)]] = True
WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of white space beyond ASCII


def cutting(path: str) -> str:
    """'dropped' or 'spaced' by the model's own normaliser and pre-tokeniser; '' if texts must stay whole."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in d["added_tokens"]):
        return ""
    before, split = d["normalizer"] or {}, d["pre_tokenizer"] or {}
    kinds = [x["type"] for x in before.get("normalizers", [])]
    parts = [x["type"] for x in split.get("pretokenizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and before["normalizers"][1] == DROPS and parts == ["Split", "ByteLevel"]:
        first, last = split["pretokenizers"]
        if first["invert"] and first["behavior"] == "Removed" and first["pattern"].get("Regex", "").endswith("[^\\s\\p{L}\\p{N}]+") and not last["add_prefix_space"]:
            return "dropped"
    return "spaced" if not before and BY_SPACE.items() <= split.items() else ""


class Memory:
    """Ids of strings met so far."""

    def __init__(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.end, self.bytes = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def gather(self, strings: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings, one after another; number of ids of each); learn gives those of new strings."""
        coded = strings.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            new = coded.dictionary.filter(found.is_null())
            place[place < 0] = len(self.known) + np.arange(len(new))
            flat, n = learn(new)
            self.ids, self.end = np.concatenate([self.ids, flat]), np.concatenate([self.end, self.end[-1] + np.cumsum(n)])
            self.known = pa.concat_arrays([self.known, new])
            self.bytes += new.nbytes + 4 * len(flat) + 8 * len(n)
        place = place[coded.indices.to_numpy()]
        begin = self.end[place]
        n = self.end[place + 1] - begin
        total = np.append(0, np.cumsum(n))
        return self.ids[np.repeat(begin - total[:-1], n) + np.arange(total[-1])], n


def summed(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the next counts[i] values of n, for each i."""
    return np.diff(np.append(0, np.cumsum(n))[np.append(0, np.cumsum(counts))])


class Encoder:
    """Ids of texts. A batch is cut into pieces over which no token reaches; different pieces are looked up, new ones of
    plain characters are split into the model's words, and the library encodes each new word, and each other
    new piece, once. All ids are gathered at once.

    Pieces and words are remembered up to about `held` bytes; then the memory starts anew.
    """

    def __init__(self, path: str, held: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.size = self.model.get_vocab_size(with_added_tokens=True)
        self.word = Tokenizer(self.model.model)
        self.word.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.cutting = cutting(path)
        self.held, self.pieces, self.words = held, Memory(), Memory()

    def _library(self, model: Tokenizer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for lo in range(0, len(texts), 4096) for e in model.encode_batch_fast(texts.slice(lo, 4096).to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(n.sum())), n

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = np.zeros(len(pieces), bool)
        if self.cutting:
            plain = pc.and_(pc.match_substring_regex(pieces, PLAIN), pc.invert(pc.match_substring(pieces, "<|"))).to_numpy(zero_copy_only=False)
        odd_ids, odd_n = self._library(self.model, pieces.filter(pa.array(~plain)))
        joined = "\0".join(pieces.filter(pa.array(plain)).to_pylist()) + "\0" if plain.any() else ""
        items = pa.array((PARTS if self.cutting == "dropped" else SPACED).findall(joined.lower() if self.cutting == "dropped" else joined), pa.string())
        ends = pc.equal(items, "\0").to_numpy(zero_copy_only=False)
        ids, n = self.words.gather(items.filter(pa.array(~ends)), lambda words: self._library(self.word, words))
        own = summed(n, np.diff(np.flatnonzero(ends), prepend=-1) - 1)
        counts = np.zeros(len(pieces), np.int64)
        counts[plain], counts[~plain] = own, odd_n
        of_plain = np.repeat(plain, counts)
        flat = np.zeros(len(of_plain), np.uint32)
        flat[of_plain], flat[~of_plain] = ids, odd_ids
        return flat, counts

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces, text by text, and how many each text has."""
        if not self.cutting:
            return texts, np.ones(len(texts), np.int64)
        if self.cutting == "dropped":
            lists = pc.ascii_split_whitespace(texts)
            return lists.flatten(), np.diff(lists.offsets.to_numpy())
        texts = pa.concat_arrays([texts])
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
        # a space is no cut beside white space, nor beside a byte that may belong to white space beyond ASCII
        before = np.concatenate([np.full(3, 32, np.uint8), raw])
        bad_left = IS_SPACE[before[2:-1]] | (raw >= 128)[np.maximum(np.arange(len(raw)) - 1, 0)] & (WIDE_SPACE[before[1:-2]] | WIDE_SPACE[before[:-3]])
        after = np.append(raw[1:], np.uint8(32))
        cut = (raw == 32) & ~bad_left & ~IS_SPACE[after] & ~WIDE_SPACE[after]
        cut[ends[:-1][ends[:-1] < len(raw)]] = False
        cut[np.maximum(ends[1:] - 1, 0)[ends[1:] > 0]] = False
        cuts = np.flatnonzero(cut)
        offsets = np.append(np.sort(np.concatenate([ends[:-1], cuts]), kind="stable"), ends[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), texts.buffers()[2])
        return pieces, 1 + np.diff(np.searchsorted(cuts, ends, side="left"))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; number of ids of each text); a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        pieces, n_pieces = self._pieces(texts)
        if self.pieces.bytes + self.words.bytes > self.held:
            self.pieces, self.words = Memory(), Memory()
        ids, n = self.pieces.gather(pieces, self._learn)
        return ids, summed(n, n_pieces)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
