"""Token ids by the tokenizers library, with pieces met before kept per worker.

Both vocabularies cut a text into words before merging, and no word spans the
places where texts are cut here, so the ids of the pieces, one after the other,
are the ids of the text.  Pieces not met yet are encoded by the library, many
in a row with a token between them that none of them holds; texts that hold an
added token's string or white space that could join words across a cut are
encoded whole.

Where spaces are dropped and letters lower-cased, pieces of Latin letters with
marks around them are parts that the vocabulary merges each for itself, so
words are kept once, whatever their case and the marks beside them, and the
library's merges alone are run for new ones.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker keeps; the store is emptied when full.
CACHE_PIECES = 600_000
LONGEST_CACHED = 20
_ROW = 5000
#: White space other than space and line break.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Latin letters that are one code point in either case, and the marks of ASCII.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff"
_MARKS = r"!-/:-@\[-`{-~"
#: Marks, letters, marks; an apostrophe before letters may belong to them.
_PARTS = re.compile(rf"(?:([{_MARKS}]*(?<!'))([{_LETTERS}]+))?([{_MARKS}]*)")


class PieceTokenizer:
    """``spaces``: whether a space belongs to the word after it, or is dropped.

    Strings of added tokens, such as an end of text, become their ids, as the
    library has it; with ``plain_specials`` they are taken as plain text, which
    is safer where texts are not trusted.

    With spaces, a piece is what stands between single spaces and line breaks;
    one that starts a line carries the line break, and each text is taken as if
    a line break came before it, whose id is dropped at the end.
    """

    def __init__(self, path: str, spaces: bool, plain_specials: bool = False, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = plain_specials
        self._added = [] if plain_specials else [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._spaces, self._most = spaces, cache_pieces
        self._mark = "\n" if spaces else " \x01 "
        (self._mark_id,) = self._ids([self._mark])[0]
        self._seen: dict[str, bytes] = {}
        self._merge = None if spaces else self._merges()

    def _merges(self):
        """Ids of letters in lower case, or of marks, by merges alone; None if the vocabulary cuts otherwise."""
        normalize, cut, model = self._library.normalizer, self._library.pre_tokenizer, self._library.model
        if normalize is None or cut is None:
            return None
        letters = "".join(c for c in map(chr, range(256)) if re.fullmatch(f"[{_LETTERS}]", c))
        marks = "".join(c for c in map(chr, range(128)) if re.fullmatch(f"[{_MARKS}]", c))
        shown = {c: "".join(p for p, _ in cut.pre_tokenize_str(c)) for c in letters.lower() + marks}

        def parts(text: str) -> list[str]:
            return [p for p, _ in cut.pre_tokenize_str(normalize.normalize_str(text))]

        sides = ["".join(map(shown.get, letters.lower())), "".join(map(shown.get, marks))]
        if parts(f"{letters}{marks} {letters}") != [*sides, sides[0]] or parts(f'"{letters}') != [shown['"'], sides[0]]:
            return None
        plain = {ord(c): text for c, text in shown.items()}

        def merge(part: str) -> bytes:
            return array("I", [t.id for t in model.tokenize(part if part.isascii() else part.translate(plain))]).tobytes()

        return merge

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _row(self, pieces: list[str], row: str, lead: int) -> list[bytes]:
        """Ids of pieces from those of a row; ``lead``: ids of the mark that each begins with."""
        ids = np.array(self._ids([row])[0], np.uint32)
        marks = 4 * np.flatnonzero(ids == self._mark_id)
        raw = ids.tobytes()
        if lead:
            starts, stops = marks.tolist(), [*marks[1:].tolist(), len(raw)]
        else:
            starts, stops = [0, *(marks + 4).tolist()], [*marks.tolist(), len(raw)]
        if len(starts) != len(pieces):
            raise ValueError("a piece holds the mark between pieces")
        return [raw[a:b] for a, b in zip(starts, stops, strict=True)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        lines = [p for p in new if p[:1] == "\n"] if self._spaces else []
        words = [p for p in new if p[:1] != "\n"] if self._spaces else new
        for at in range(0, len(lines), _ROW):
            part = lines[at : at + _ROW]
            found.update(zip(part, self._row(part, "".join(part), 1), strict=True))
        glue = self._mark + " " if self._spaces else self._mark
        for at in range(0, len(words), _ROW):
            part = words[at : at + _ROW]
            row = (" " if self._spaces else "") + glue.join(part)
            found.update(zip(part, self._row(part, row, 0), strict=True))
        return found

    def _spaced(self, text: str) -> str | None:
        """The text with a space between pieces; None if it must be encoded whole."""
        if any(map(text.__contains__, self._added)):
            return None
        if not self._spaces:
            return None if "\x01" in text else text.replace("\n", " ")
        if any(map(text.__contains__, _OTHER_SPACE)):
            return None
        text = ("\n" + text).replace("\n", " \n")[1:]
        # two spaces in a row, one at an end, or a line break by itself
        return None if "  " in text or "\n " in text or text.endswith((" ", "\n")) else text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The uint32 ids of each text."""
        spaced = [self._spaced(t or "") for t in texts]
        whole = [i for i, t in enumerate(spaced) if t is None]
        # each different piece is looked up once; Arrow puts their ids in the order of the texts
        pieces = pc.split_pattern(pa.array([t for t in spaced if t is not None], pa.string()), " ")
        coded = pieces.flatten().dictionary_encode()
        table = pa.array(self._known(coded.dictionary.to_pylist()), pa.binary())
        taken = table.take(coded.indices)
        _, offsets, data = taken.buffers()
        ids = np.frombuffer(data or b"", np.uint32)
        ends = np.frombuffer(offsets or b"\0" * 4, np.int32, len(taken) + 1)[pieces.offsets.to_numpy()] // 4
        skip = 1 if self._spaces else 0
        out = [ids[a + skip : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i, found in zip(whole, self._ids([texts[i] or "" for i in whole]), strict=True):
            out.insert(i, np.array(found, np.uint32))
        return out

    def _merged(self, pieces: list[str], raws: list[bytes | None], new: list[int]) -> tuple[list[int], dict[str, bytes]]:
        """Fill in the pieces that are letters and marks; the others, and parts not met before."""
        seen, found, others = self._seen, {}, []
        for i in new:
            cut = _PARTS.fullmatch(pieces[i])
            if cut is None:
                others.append(i)
                continue
            raw = b""
            before, word, after = cut.groups("")
            for part in before, word.lower(), after:
                if part:
                    one = seen.get(part) or found.get(part)
                    if one is None:
                        one = found[part] = self._merge(part)
                    raw += one
            raws[i] = raw
        return others, found

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces as bytes."""
        raws = list(map(self._seen.get, pieces))
        new = [i for i, r in enumerate(raws) if r is None]
        merged: dict[str, bytes] = {}
        if new and self._merge:
            new, merged = self._merged(pieces, raws, new)
        if new or merged:
            found = self._learn([pieces[i] for i in new]) | merged
            if len(self._seen) + len(found) > self._most:
                self._seen.clear()
            for i in new:
                raws[i] = found[pieces[i]]
            self._seen.update([(p, r) for p, r in found.items() if len(p) <= LONGEST_CACHED])
        return raws


@lru_cache(maxsize=4)
def tokenizer(path: str, spaces: bool, plain_specials: bool = False, cache_pieces: int = CACHE_PIECES) -> PieceTokenizer:
    return PieceTokenizer(path, spaces, plain_specials, cache_pieces)


def batches_of(texts: list, most_chars: int = 8_000_000):
    """Slices of a list of texts that hold about ``most_chars`` at most."""
    yield from _slices([len(t) if t else 0 for t in texts], most_chars)


def slices(texts, most_bytes: int = 4_000_000):
    """Slices of an Arrow array of texts that hold about ``most_bytes`` at most."""
    yield from _slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), most_bytes)


def _slices(sizes: list[int], most: int):
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
