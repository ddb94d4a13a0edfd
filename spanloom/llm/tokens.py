"""Token ids of whole texts by a public tokenizer file, with a cache of pieces per worker.

A text is cut before white space that follows a non-blank. No pre-tokenizer of the supported files joins characters
across such a cut, so the ids of the text are the ids of its pieces in turn, and a piece is encoded once per worker.
Texts with white space that the libraries may class differently are encoded as a whole.
"""

from __future__ import annotations

import os
import re

ID_BYTES = 4
# Pieces of a generation of the cache, of which a worker keeps two; a piece that is used again moves to the newer one.
# About 250 bytes each.
CACHE_PIECES = 400_000
# Pieces that are encoded in one call.
LEARN_PIECES = 1_000
# Texts of which the pieces are numbered together, and bytes of texts that are encoded in one call.
TOGETHER_TEXTS, TOGETHER_BYTES = 4_096, 4 << 20

# White space and controls that need care, and those that are left to the library.
_ODD = re.compile("[\0\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_WIDE = re.compile("[\0\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_PIECES = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
# After a letter these begin a new token, whatever the letter belongs to.
_MARKS = ".,;:!?%*&$#()[]\"-"


# The blank in front of a token, and the end of a word, as the files write them.
_BLANK, _WORD_END = "\u0120", "</w>"


def _flags(ids: list[int], size: int):
    import numpy as np

    flags = np.zeros(max([size, *(i + 1 for i in ids)]), bool)
    flags[ids] = True
    return flags


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; strings of special tokens count as ordinary text."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.cache_pieces = cache_pieces
        # Spark runs the tasks; threads of the library would only compete with them.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        special = [t for t in self.coder.get_added_tokens_decoder().values() if t.special]
        self.mark = special[-1].content if special else None
        self.mark_id = self.coder.token_to_id(self.mark) if special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # By id: whether the token begins a word that follows a blank, or ends a word, whichever the file marks.
        names = self.coder.get_vocab(with_added_tokens=False)
        self.begins = _flags([i for t, i in names.items() if t.startswith(_BLANK)], len(names))
        self.ends = _flags([i for t, i in names.items() if t.endswith(_WORD_END)], len(names))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pieces that are not known yet are learnt together."""
        if len(self.cache) > self.cache_pieces:
            self.older, self.cache, self.marks = self.cache, {}, {}
        found: list = [None] * len(texts)
        plain = [i for i, text in enumerate(texts) if _is_plain(text)]
        for at in range(0, len(plain), TOGETHER_TEXTS):
            part = plain[at : at + TOGETHER_TEXTS]
            for i, ids in zip(part, self._encode_plain([texts[i] for i in part])):
                found[i] = ids
        for i, text in enumerate(texts):
            if found[i] is None:
                found[i] = self._whole([text])[0] if _WIDE.search(text) else self._encode_spaced(text)
        return found

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts with single blanks. The pieces of all are cut and numbered together; each is looked up once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # A piece has no blank in front; the marker keeps the first piece of a text apart.
        texts = [text.replace("\n", " \n") for text in texts]
        joined = pa.array([" ".join(["\0" + text for text in texts])], pa.large_string())
        coded = pc.split_pattern(joined, " ").flatten().dictionary_encode()
        ids = self._known_ended(coded.dictionary)
        each = np.empty(len(ids), object)
        each[:] = ids
        each, low, found = each[coded.indices.to_numpy()], 0, []
        for text in texts:
            high = low + text.count(" ") + 1
            found.append(b"".join(each[low:high].tolist()))
            low = high
        return found

    def _encode_spaced(self, text: str) -> bytes:
        return b"".join(self._known([" " + p for p in _PIECES.findall(text)], _strip))

    def _known_ended(self, pieces) -> list[bytes]:
        """The ids of an Arrow array of pieces cut at single blanks; marks behind a letter are looked up apart."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bodies = pc.utf8_rtrim(pieces, characters=_MARKS)
        last = pc.utf8_slice_codeunits(bodies, -1, None).dictionary_encode()
        # Lower-casing may end a letter in a mark, which then joins those that follow.
        letter = np.array([c.isalpha() and c.lower().isalpha() for c in last.dictionary.to_pylist()], bool)
        longer = pc.greater(pc.binary_length(pieces), pc.binary_length(bodies)).to_numpy(zero_copy_only=False)
        ended = np.flatnonzero(letter[last.indices.to_numpy()] & longer).tolist()
        words = pieces.to_numpy(zero_copy_only=False).tolist()
        trimmed = bodies.take(pa.array(ended, pa.int64())).to_numpy(zero_copy_only=False).tolist()
        tails = []
        for i, body in zip(ended, trimmed):
            tails.append(words[i][len(body) :])
            words[i] = body
        ids = self._known(words, _restore)
        for marks in set(tails).difference(self.marks):
            self.marks[marks] = self._whole([marks])[0]
        for i, marks in zip(ended, map(self.marks.__getitem__, tails)):
            ids[i] += marks
        return ids

    def _known(self, pieces: list[str], text_of) -> list[bytes]:
        """The ids of each piece; `text_of` makes text of a piece again. Those not known yet are learnt."""
        ids = list(map(self.cache.get, pieces))
        if None in ids:
            gaps = [i for i, one in enumerate(ids) if one is None]
            self._learn({pieces[i] for i in gaps}, text_of)
            for i in gaps:
                ids[i] = self.cache[pieces[i]]
        return ids

    def _learn(self, pieces: set[str], text_of) -> None:
        import numpy as np

        single, joined, alone = [], [], []
        for piece in pieces:
            if piece in self.older:
                self.cache[piece] = self.older[piece]
            elif piece.isalpha():
                single.append(piece)
            else:
                text = text_of(piece)
                (joined if self.mark and "<|" not in text and text.strip() else alone).append((piece, text))
        for at in range(0, len(single), LEARN_PIECES):
            part = single[at : at + LEARN_PIECES]
            if not self._learn_words(part, text_of):
                alone += [(piece, text_of(piece)) for piece in part]
        for at in range(0, len(joined), LEARN_PIECES):
            part = joined[at : at + LEARN_PIECES]
            ids = np.frombuffer(self._whole([self.mark.join(t for _, t in part)], ordinary=False)[0], "<u4")
            self._keep([p for p, _ in part], ids, np.flatnonzero(ids == self.mark_id), 1)
        if alone:
            for (piece, _), ids in zip(alone, self._whole([t for _, t in alone])):
                self.cache[piece] = ids

    def _learn_words(self, words: list[str], text_of) -> bool:
        """Learn pieces that are a blank and letters in one call, if their tokens show where each begins or ends."""
        import numpy as np

        text = "".join([" " + w for w in words])
        if text_of(words[0]) != " " + words[0]:
            return False
        ids = np.frombuffer(self._whole([text])[0], "<u4")
        for flags, shift in ((self.begins, 0), (self.ends, 1)):
            edges = np.flatnonzero(flags[ids]) + shift
            if len(edges) == len(words) and (edges[0] == 0 if shift == 0 else edges[-1] == len(ids)):
                self._keep(words, ids, edges[1:] if shift == 0 else edges[:-1], 0)
                return True
        return False

    def _keep(self, pieces: list[str], ids, cuts, gap: int) -> None:
        """Remember the ids of each piece, cut before the places `cuts`; `gap` ids after a cut are left out."""
        data, low = ids.tobytes(), 0
        for piece, cut in zip(pieces, [*(cuts * ID_BYTES).tolist(), len(data)], strict=True):
            self.cache[piece] = data[low:cut]
            low = cut + gap * ID_BYTES

    def _whole(self, texts: list[str], ordinary: bool = True) -> list[bytes]:
        """The ids of whole texts; strings of special tokens are ordinary text, or else those tokens."""
        import numpy as np

        self.coder.encode_special_tokens = ordinary
        found = self.coder.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]


def _is_plain(text: str) -> bool:
    """Whether all white space of a text is single blanks and line ends."""
    if _ODD.search(text) or "  " in text:
        return False
    return "\n" not in text or not ("\n\n" in text or "\n " in text or " \n" in text)


def gathered(batches, column: str):
    """Arrow batches, put together while their `column` of texts holds at most TOGETHER_BYTES or that of one batch does."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        more = batch.column(column).nbytes
        if held and size + more > TOGETHER_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def _restore(piece: str) -> str:
    """The text of a piece cut at single blanks: the first has no blank in front, nor has one after a line end."""
    if piece[:1] == "\0":
        return piece[1:]
    return piece if piece[:1] == "\n" else " " + piece


def _strip(piece: str) -> str:
    return piece[1:]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """The encoder of a file, one per worker process."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path, cache_pieces)
    return _ENCODERS[path]
