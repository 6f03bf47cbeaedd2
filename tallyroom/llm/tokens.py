"""Token ids of whole texts by the tokenizers library, with words that were met before kept.

A byte-level BPE splits a text before every single space that stands between two
characters that are no white space, whatever surrounds it. So a text is cut there and
every distinct chunk is encoded once and then known by its bytes. A text with
other white space patterns is encoded whole. Inside a chunk of plain letters, digits, marks
and single newlines the pieces are plain to see, and the library's model encodes each new
one; any other chunk goes through the library's own splitting, and a text that holds an added token is
encoded whole. All ways give its ids.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Chunks that a worker knows, and as many of the time before.
KNOWN = 250_000
#: Bytes of texts that are cut and put together at once.
SLICE = 8 << 20
#: Pieces that need no look at Unicode classes: letters, digits, marks without the apostrophe, a lone newline.
PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n(?!\n)")


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


LETTERS = _letters()
SPACE, NEWLINE = LETTERS[32], LETTERS[10]
LETTERS_ONLY = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known(dict):
    """Chunks by their bytes, as many as a limit; when it is full, those used since the last time are kept."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, chunk: bytes) -> bytes | None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        found = self[chunk] = self.old[chunk] if chunk in self.old else self.make(chunk)
        return found


class Encoder:
    """Unsigned 32-bit ids of texts."""

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known, self.pieces = Known(self._chunk, known), Known(self._piece, known)

    def whole(self, text: bytes) -> np.ndarray:
        ids = self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one entry more than texts). Texts are UTF-8 bytes; null counts as empty."""
        parts, sizes, at = [], [np.zeros(1, np.int64)], 0
        lengths = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False), nan=0).cumsum()
        while at < len(texts):  # a text, or as many as SLICE holds
            done = lengths[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(lengths, done + SLICE, "right")))
            ids, ends = self._slice(texts.slice(at, end - at))
            parts.append(ids)
            sizes.append(np.diff(ends))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, "<u4"), np.concatenate(sizes).cumsum()

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts.cast(pa.large_binary()).fill_null(b""), b" ")
        flat, cuts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = flat.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int32)
        filled = np.diff(cuts) > 0
        first = cuts[:-1][filled]
        heads = flat.take(pa.array(first)).to_pylist()
        values = list(map(self.known.__getitem__, coded.dictionary.to_pylist()))
        values += [self.known[b"\n" + c] if c else b"" for c in heads]  # no space before it
        which[first] = len(values) - len(first) + np.arange(len(first))
        # A text that is empty or begins with a space has an empty first chunk.
        spaced = [at for at, c, n in zip(which[first].tolist(), heads, np.diff(cuts)[filled].tolist()) if n > 1 and not c]
        unclear = np.zeros(len(values), bool)
        unclear[spaced] = True
        if None in values:
            unclear[[k for k, v in enumerate(values) if v is None]] = True
            values = [v or b"" for v in values]
        lens = np.fromiter(map(len, values), np.int32, len(values)) // 4
        pool, begins = np.frombuffer(b"".join(values), "<u4"), (lens.cumsum() - lens).astype(np.int32)
        took = lens[which]
        ends = np.zeros(len(which) + 1, np.int64)
        took.cumsum(out=ends[1:])
        # Ids of a slice and of its chunks are far fewer than 2^31.
        ids = pool[np.repeat(begins[which] - ends[:-1].astype(np.int32), took) + np.arange(ends[-1], dtype=np.int32)]
        ends = ends[cuts]
        strange = np.zeros(len(texts), bool)
        for content in self.added:  # the library takes an added token out of a text before it splits it
            strange |= pc.match_substring(texts, content).fill_null(False).to_numpy(zero_copy_only=False)
        if unclear.any():
            strange |= (np.add.reduceat(np.append(unclear[which], False), cuts[:-1]) * filled).astype(bool)
        odd = np.flatnonzero(strange)
        if len(odd):
            each = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for k in odd:
                each[k] = self.whole(texts[int(k)].as_py())
            ids, ends = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, ends

    def _chunk(self, c: bytes) -> bytes | None:
        """Ids of a chunk; None where white space at its ends leaves its split to what stands outside."""
        first = c[:1] == b"\n"
        try:
            text = c[1:].decode() if first else " " + c.decode()
        except UnicodeDecodeError:
            return None
        if LETTERS_ONLY(text, not first):
            return self._piece(text)
        body = text if first else text[1:]
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        pieces = PIECE.findall(text)
        if sum(map(len, pieces)) != len(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.pieces.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        shown = piece.replace(" ", SPACE).replace("\n", NEWLINE) if piece.isascii() else piece.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.model.tokenize(shown)]
        return PACK[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    return Encoder(path)


def ended(ids: np.ndarray, ends: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text."""
    n = len(ends) - 1
    ends = ends + np.arange(n + 1)
    out, own = np.full(len(ids) + n, end, "<u4"), np.ones(len(ids) + n, bool)
    own[ends[1:] - 1] = False
    out[own] = ids
    return out, ends
