"""Token ids of whole texts by the tokenizers library, word by word.

The tokenizer's pre-tokens never cross white space, so the ids of a text are those of its words in
turn. Arrow cuts a lot of texts into words and numbers the distinct ones; only those are looked at
one by one, and the texts' ids are gathered by number. Words repeat, so each worker process remembers
the ids of the pieces it met; new ones go to the library many at a time. The memory is bounded; when
full it starts anew.
"""

from __future__ import annotations

import json
import os
import string
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
#: Pieces (words, or their letters and trailing signs) remembered by a worker, about 150 bytes each.
MEMORY_WORDS = 500_000
#: Words given to the library at once.
AT_ONCE = 4096
#: Signs after a word: one pre-token, however many follow each other.
_TAIL = string.punctuation
#: Parts of a tokenizer that leave a word of lower-case ASCII letters as it is.
_PLAIN_FORM, _PLAIN_CUT = {"NFC", "Replace", "Lowercase"}, ["Split", "ByteLevel"]
_LOADED: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _binary(texts: pa.Array) -> np.ndarray:
    return texts.cast(pa.large_binary()).to_numpy(zero_copy_only=False)


def _all_letters(low: bytes) -> bool:
    """Whether lower-cased UTF-8 text is letters only and stays so in the tokenizer's normal form."""
    return unicodedata.normalize("NFC", low.decode()).lower().isalpha()


def _cut_only(path: str):
    """The tokenizer's model behind a cut at blanks alone; None where its other parts are unknown.

    Words of lower-case ASCII letters are their own normal form and one pre-token each, so they need
    no more than this.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    form, cut = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
    if (
        not {x["type"] for x in form.get("normalizers", [form]) if x} <= _PLAIN_FORM
        or [x["type"] for x in cut.get("pretokenizers", [])] != _PLAIN_CUT
    ):
        return None
    parts["normalizer"], parts["added_tokens"] = None, []
    parts["pre_tokenizer"] = {"type": "CharDelimiterSplit", "delimiter": " "}
    return Tokenizer.from_str(json.dumps(parts))


class WordEncoder:
    """Encodes UTF-8 texts to little-endian 32-bit ids, as bytes."""

    def __init__(self, path: str, memory: int = MEMORY_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, dtype=bool)
        if suffix:
            for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[number] = token.endswith(suffix)
        self.suffix = bool(suffix)
        self.for_ascii = (_cut_only(path) if suffix else None) or self.tokenizer
        self.memory, self.known, self.cores = memory, {}, {}

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(
            [x.decode() for x in words], add_special_tokens=False
        )
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _letters(self, words: list[bytes], tokenizer) -> list[bytes]:
        """Words of letters alone: one pre-token each, told apart by the end-of-word suffix."""
        joined = tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(joined[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or (len(cuts) and cuts[-1] != len(ids)):
            return self._one_by_one(words)
        raw, stops = ids.tobytes(), (cuts * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, cores: list[bytes], others: list[bytes]) -> None:
        """Remember new pieces: lower-cased words of letters, and whole words or trailing signs."""
        for words, tokenizer in (
            ([x for x in cores if x.isascii()], self.for_ascii),
            ([x for x in cores if not x.isascii()], self.tokenizer),
        ):
            for at in range(0, len(words), AT_ONCE):
                part = words[at : at + AT_ONCE]
                self.cores.update(zip(part, self._letters(part, tokenizer), strict=True))
        self.known.update(zip(others, self._one_by_one(others), strict=True))

    def _pieces(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of the pieces of distinct words, and the numbers of each word's two pieces.

        A word is its letters, then the signs after them. That holds only where the tokenizer's normal
        form of the letters (composed, lower case) is letters too; some letters become a letter and a
        mark, which the sign would join. Such words, and all others, are a second piece alone.
        """
        lows = pc.ascii_lower(pc.ascii_rtrim(words, characters=_TAIL)).dictionary_encode()
        at, cores = lows.indices.to_numpy(), _binary(lows.dictionary).tolist()
        met = list(map(self.cores.get, cores))
        letters = pc.ascii_is_alpha(lows.dictionary).to_numpy(zero_copy_only=False).copy()
        for n in np.flatnonzero(~pc.string_is_ascii(lows.dictionary).to_numpy(zero_copy_only=False)):
            letters[n] = met[n] is not None or _all_letters(cores[n])
        letters &= self.suffix
        sizes = pc.binary_length(lows.dictionary).to_numpy() * letters
        begins = sizes[at]
        cut = np.flatnonzero(begins < pc.binary_length(words).to_numpy())
        ends: dict[bytes, int] = {}
        after = np.full(len(words), -1)
        after[cut] = [
            ends.setdefault(word[begin:], len(ends))
            for word, begin in zip(_binary(words)[cut], begins[cut].tolist(), strict=True)
        ]
        new = [n for n in np.flatnonzero(letters).tolist() if met[n] is None]
        self._learn([cores[n] for n in new], [x for x in ends if x not in self.known])
        for n in new:
            met[n] = self.cores[cores[n]]
        ids = [x or b"" for x in met]
        ids.extend(map(self.known.__getitem__, ends))
        ids.append(b"")
        # a word without a second piece gets the last, empty one
        return ids, np.stack([at, np.where(after < 0, len(ids) - 1, after + len(cores))], axis=1)

    def encode(
        self, texts: pa.Array | Iterable[bytes | None], end: int | None = None
    ) -> list[bytes]:
        """Ids of each text, followed by ``end`` if given; None is an empty text."""
        if len(self.known) + len(self.cores) > self.memory:
            self.known, self.cores = {}, {}
        if not isinstance(texts, pa.Array):
            texts = pa.array(list(texts), pa.large_binary())
        texts = texts.cast(pa.large_binary()).fill_null(b"").cast(pa.large_string())
        words = pc.ascii_split_whitespace(texts)
        stops = words.offsets.to_numpy()
        numbered = words.flatten().dictionary_encode()
        ids, pieces = self._pieces(numbered.dictionary)
        numbers = pieces[numbered.indices.to_numpy()].ravel()
        # ids of the distinct pieces end to end; each piece of the texts takes its stretch of them
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts = sizes[numbers]
        after = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((np.cumsum(sizes) - sizes)[numbers] - after[:-1], counts)
        raw = np.frombuffer(b"".join(ids), "<u4")[at + np.arange(after[-1])].tobytes()
        last = b"" if end is None else np.array([end], dtype="<u4").tobytes()
        cuts = (after[2 * (stops - stops[0])] * 4).tolist()
        return [raw[a:b] + last for a, b in zip(cuts, cuts[1:], strict=False)]
