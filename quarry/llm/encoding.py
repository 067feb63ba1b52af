"""Whole-text encoding with a public word-level BPE vocabulary, piece by piece with a bounded cache.

The vocabulary's normaliser composes, lower-cases and makes white space one; its pre-tokeniser then
takes contractions, letter runs, single digits and runs of other signs, and never joins pieces
across white space. So the ids of a text are the ids of its parts between white space, or of its pieces, one after
the other. Arrow cuts a lot of texts into parts and numbers the different ones; only these are looked up, and
the lot's ids are gathered by number. Each worker keeps the ids of the parts it has met, in two
generations; the cache only saves time: what is not in it is encoded again.

* Texts of Latin-1 and common punctuation alone are cut into the vocabulary's own pieces. Each of these is one piece
  to the library too, so new ones are encoded as one text and cut behind the ids that end a piece.
* Other texts are cut at white space. A part may then be no piece or several, so new parts are joined by a special
  token, which the library takes out before all else, and cut at its id.
* Texts with control characters that Arrow takes for white space, or with a special token, are encoded alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import kept_between_tasks

END_ID = 1
#: Entries of each of the cache's two generations, and the longest parts that are kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 200
#: Bytes of texts in a lot.
LOT_BYTES = 2 << 20
#: Parts encoded as one text.
_JOIN = 5000
#: Texts that are encoded alone.
_ALONE = r"[\x1c-\x1f]|<\|"
#: What texts in the vocabulary's pieces do not hold: all beyond Latin-1 but common punctuation, and numbers that are no digits.
_OTHER = "[^\\x00-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\xff\u2010-\u2027\u20ac]"
#: Pieces that are no letter runs, of lower-case texts without such characters.
_SIGNS = r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\x0b\x85\xa0\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+"
_SPACES = re.compile(r"[ \t\n\r]+")


class PieceEncoder:
    """Encodes texts as unsigned 32-bit ids."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a piece.
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = "<|endoftext|>"
        self.special_id = vocabulary[self.special]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def _raw(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _encoded_parts(self, parts: list[str], pieces: bool) -> list[bytes]:
        """Ids of parts without white space; ``pieces``: each is one piece of the vocabulary."""
        out = []
        for k in range(0, len(parts), _JOIN):
            lot = parts[k : k + _JOIN]
            skip = 0
            if pieces:
                ids = self._raw(" ".join(lot))
                ends = np.nonzero(self.ends[ids])[0]
            if not pieces or len(ends) != len(lot):
                ids, skip = self._raw(self.special.join(lot) + self.special), 1
                ends = np.nonzero(ids == self.special_id)[0]
            data, starts = ids.tobytes(), np.append(0, ends[:-1] + 1)
            out += [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), (ends + 1 - skip).tolist())]
        return out

    def _ids_of(self, parts: list[str], pieces: bool) -> list[bytes]:
        """Ids of different parts, from the cache where it has them."""
        if len(self.new) >= self.cache_entries:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        out = [new.get(p) for p in parts]
        missing = []
        for k, found in enumerate(out):
            if found is None:
                found = out[k] = old.get(parts[k])
                if found is None:
                    missing.append(k)
                else:
                    new[parts[k]] = found
        for k, found in zip(missing, self._encoded_parts([parts[k] for k in missing], pieces)):
            out[k] = found
            if len(parts[k]) <= CACHE_CHARS:
                new[parts[k]] = found
        return out

    def _alone(self, text: str) -> np.ndarray:
        if "<|" in text:
            return self._raw(text)
        return np.frombuffer(b"".join(self._encoded_parts([p for p in _SPACES.split(text) if p], False)), dtype="<u4")

    def _gathered(self, lists, pieces: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of parts, and where each list's begin."""
        parts = lists.flatten().dictionary_encode()
        number = parts.indices.to_numpy(zero_copy_only=False)
        found = self._ids_of(parts.dictionary.to_pylist(), pieces)
        own = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        count = own[number]
        ends = np.cumsum(count)
        first = np.cumsum(own) - own
        place = np.repeat(first[number] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)
        last = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        return np.frombuffer(b"".join(found), dtype="<u4")[place], np.append(0, np.append(0, ends)[last])

    def _lot(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        alone = pc.match_substring_regex(texts, _ALONE).to_numpy(zero_copy_only=False)
        other = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False) & ~alone
        groups = []
        for which, pieces in ((~alone & ~other, True), (other, False)):
            if which.any():
                some = texts if which.all() else texts.filter(pa.array(which))
                if pieces:
                    some = pc.replace_substring_regex(pc.utf8_lower(some), _SIGNS, r" \0 ")
                groups.append((np.nonzero(which)[0], *self._gathered(pc.utf8_split_whitespace(some), pieces)))
        if len(groups) == 1 and not alone.any():
            return groups[0][1:]
        parts = {int(k): self._alone(texts[int(k)].as_py()) for k in np.nonzero(alone)[0]}
        for rows, ids, offsets in groups:
            parts |= {k: ids[a:b] for k, a, b in zip(rows.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())}
        ordered = [parts[k] for k in range(len(texts))]
        return np.concatenate(ordered), np.append(0, np.cumsum([len(p) for p in ordered]))

    def encoded(self, texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Lots of an Arrow array of texts without nulls: first text, ids of all its texts, and where each text's begin."""
        import pyarrow.compute as pc

        size = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(size, size[start] + LOT_BYTES, side="right")) - 1)
            yield start, *self._lot(texts.slice(start, end - start))
            start = end

    def encode(self, text: str) -> bytes:
        """Ids of one text, little-endian."""
        import pyarrow as pa

        return self._lot(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


@kept_between_tasks
@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process, kept between tasks until one of another operator of the pipeline."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
