"""Token ids of whole texts by a vocabulary file of the tokenizers library."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A piece that begins and ends in neither white space nor control characters, a line feed in front aside.
_FIT = r"^\n?[^\s\pZ\pC](?s:.*[^\s\pZ\pC])?$"
#: A word of common Latin letters and the punctuation that closes it, which is marked as a piece without a blank in front.
_CLOSED, _CLOSING = r"^(\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)$", "\x01"

_encoders: dict[tuple, "Encoder"] = {}


def vocabulary(path: str | None = None) -> bytes:
    """The file's bytes, to be sent to executors; by default the public byte-level vocabulary of 50k ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def _byte_lengths(tokenizer) -> np.ndarray:
    """Bytes that each id stands for: a byte-level vocabulary writes each byte as one character."""
    vocab = tokenizer.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of runs, one run after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((starts - ends + sizes).astype(np.int32), sizes) + np.arange(total, dtype=np.int32)


class Encoder:
    """Ids of texts, equal to those of encoding each whole text with the tokenizer.

    A byte-level vocabulary cuts a text into pieces before it merges anything. It always cuts before a
    blank or line feed that has no white space at either side, and between a letter and closing punctuation.
    Texts are cut there; each distinct piece is encoded once, together with all others that are new, and
    remembered in an Arrow array that whole slices are looked up in. Beyond ``most`` pieces
    the memory keeps those met most, at most half of it. Texts in which a blank or line feed meets other
    white space, or that end in one, are encoded whole.
    """

    #: Bytes of text looked up together, and new pieces encoded together.
    SLICE, JOINED = 4 << 20, 20_000

    def __init__(self, data: bytes, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.bytes_of = _byte_lengths(self.tokenizer)
        self.most = most
        self.known = pa.array([], pa.large_string())
        self.flat, self.at, self.met = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces met most; what is kept must be met again to stay the next time."""
        least = 2
        while 2 * np.count_nonzero(self.met >= least) > self.most:
            least *= 2
        often = np.flatnonzero(self.met >= least)
        sizes = np.diff(self.at)[often]
        self.flat = self.flat[spread(self.at[often], sizes)]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.known, self.met = self.known.take(pa.array(often)), self.met[often] // 2

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _learn(self, new: pa.Array) -> None:
        """New pieces are joined and encoded as one text; byte lengths tell which ids belong to which."""
        closing = pc.starts_with(new, _CLOSING)
        words, marks = new.filter(pc.invert(closing)), new.filter(closing)
        flat, sizes = [self.flat], [np.diff(self.at)]
        spaced = pc.replace_substring_regex(words, r"^([^\n])", r" \1")
        for i in range(0, len(spaced), self.JOINED):
            some = spaced.slice(i, self.JOINED)
            ids = self._whole("".join(some.to_pylist()))
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(pc.binary_length(some).to_numpy()), side="left") + 1
            flat.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        for mark in marks.to_pylist():
            flat.append(self._whole(mark[1:]))
            sizes.append([len(flat[-1])])
        self.flat = np.concatenate(flat)
        self.at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.known = pa.concat_arrays([self.known, words, marks])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])

    def slices(self, batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
        """Rows of about ``SLICE`` bytes of text at a time."""
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        of = np.cumsum(sizes, dtype=np.int64) // self.SLICE
        cuts = [*np.flatnonzero(np.diff(of, prepend=-1)), batch.num_rows]
        for i, j in pairwise(cuts):
            yield batch.slice(i, j - i)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the len(texts) + 1 offsets of each. Nulls are empty."""
        out, ends = [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        for part in self.slices(pa.record_batch([texts], ["text"]), 0):
            ids, offsets = self._some(part.column(0))
            out.append(ids)
            ends.append(offsets[1:] + ends[-1][-1])
        return np.concatenate(out), np.concatenate(ends)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the memory has each piece; new ones are learned."""
        found = pc.index_in(pieces, value_set=self.known)
        of = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            missing = pieces.filter(found.is_null())
            before, new = len(self.known), missing.unique()
            self._learn(new)
            added = pc.index_in(missing, value_set=self.known.slice(before))
            of[found.is_null().to_numpy(zero_copy_only=False)] = added.to_numpy() + before
        return of

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string())), " ")
        coded = cut.flatten().dictionary_encode()
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        indices, distinct = coded.indices.to_numpy(), coded.dictionary
        del cut
        if len(self.known) > self.most:
            self._forget()
        # distinct pieces of this slice: a word, and closing punctuation as a piece of its own
        fit = pc.match_substring_regex(distinct, _FIT)
        parts = pc.split_pattern(pc.replace_substring_regex(distinct.filter(fit), _CLOSED, rf"\1 {_CLOSING}\2"), " ")
        fit, heads = fit.to_numpy(zero_copy_only=False), parts.offsets.to_numpy()
        place = self._places(parts.flatten())
        sizes = (self.at[place + 1] - self.at[place]).astype(np.int64)
        local = self.flat[spread(self.at[place], sizes)]
        times = np.bincount(indices, minlength=len(distinct))
        np.add.at(self.met, place, np.repeat(times[fit], np.diff(heads)))
        ends = np.concatenate([[0], np.cumsum(sizes)])[heads]
        start, length = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        start[fit], length[fit] = ends[:-1], np.diff(ends)
        # pieces in the order of the texts
        odd = np.add.reduceat((~fit)[indices], first[:-1], dtype=np.int64) > 0
        start, length = start[indices], length[indices]
        whole = first[:-1][~odd]
        start[whole] += 1  # without the line feed put before each text
        length[whole] -= 1
        offsets = np.concatenate([[0], np.cumsum(length)])[first]
        ids = local[spread(start, length)]
        if not odd.any():
            return ids, offsets
        out, lengths = [], []
        for i, text in enumerate(texts):
            own = self._whole(text.as_py()) if odd[i] else ids[offsets[i] : offsets[i + 1]]
            out.append(own)
            lengths.append(len(own))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(lengths)])


def encoder(data: bytes) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    key = (len(data), hash(data))
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]
