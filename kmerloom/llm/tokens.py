"""Token ids by the tokenizers library, with the ids of pieces that were met before remembered.

Both tokenizers cut a text before the first white space of a run, whatever follows, so a text is cut there
first, each distinct piece is encoded once by the library, and a text's ids are the joined ids of its pieces.
Texts that are not of the common form (rare or repeated white space, strings of special tokens, letters that are
lowered by their place) are given to the library whole, or by runs.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space, by any usual definition, other than blank and line feed.
RARE_SPACE = [chr(c) for c in (*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ASCII_RARE = [c for c in RARE_SPACE if c.isascii()]
_RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_NONE = np.zeros(0, dtype="<u4")


class _Tokens:
    """Remembers, for a bounded number of pieces, the little-endian bytes of their ids."""

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {"": b""}
        self.library = Tokenizer.from_file(path)
        self.limit = limit
        self.marks = {m: self.encoded(m) for m in ",."}
        #: Special tokens stand for themselves wherever their strings are, so such texts are not cut.
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.borders = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that begin (or end) a piece of a joined text
        self.borders[[i for t, i in vocabulary.items() if self.is_border(t)]] = True
        self.widths = np.zeros(len(self.borders), dtype=np.int64)  # bytes that ids stand for
        self.widths[list(vocabulary.values())] = [len(t.removesuffix("</w>")) for t in vocabulary]

    def encoded(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def shown(self, piece: str) -> str:
        """The text that a piece stands for."""
        return piece

    def looked_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; unknown ones are given to the library together."""
        raw = list(map(self.known.get, pieces))
        fresh = [i for i, r in enumerate(raw) if r is None]
        if fresh:
            if len(self.known) + 2 * len(fresh) > self.limit:
                short = {p: v for p, v in self.known.items() if len(p) <= 6}  # mostly frequent words; long ones are mostly met once
                self.known = short if len(short) < self.limit // 2 else {"": b""}
            self._learn([pieces[i] for i in fresh])
            for i in fresh:
                raw[i] = self.known[pieces[i]]
        return raw

    def _learn(self, fresh: list[str]) -> None:
        known = self.known
        # a word and a mark after it are coded apart, so a word need be met with one of them only
        marks, marked, bare = self.marks, [], set()
        for p in fresh:
            if p[-1] in marks and (w := p[:-1]).isalpha():
                marked.append((p, w))
                bare.add(w)
            else:
                bare.add(p)
        joined = [w for w in bare if w not in known and self.may_join(w)]
        for i in range(0, len(joined), 2000):
            self._learn_joined(joined[i : i + 2000])
        words = [w for w in bare if w not in known]
        if words:
            for w, e in zip(words, self.library.encode_batch_fast([self.shown(w) for w in words], add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        known.update([(p, known[w] + marks[p[-1]]) for p, w in marked])

    def joined(self, pieces: list[str]) -> bytes:
        own = dict.fromkeys(pieces)
        own = dict(zip(own, self.looked_up(list(own))))
        return b"".join(map(own.__getitem__, pieces))

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of several texts (null: none); their unknown pieces are learnt together."""
        out, plain, cut = [_NONE] * len(texts), [], []
        for k, t in enumerate(texts):
            if t:
                if (form := self.common_form(t)) is None:
                    out[k] = self.whole(t)
                else:
                    plain.append(k)
                    cut.append(form)
        if not plain:
            return out
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), " ")
        pieces = lists.flatten().dictionary_encode()
        raw = self.looked_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        bounds = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) >> 2, out=bounds[1:])
        known = pa.LargeListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(raw), dtype="<u4")))
        taken = known.take(pieces.indices)
        ids, ends = taken.flatten().to_numpy(), taken.offsets.to_numpy()
        bounds = (ends - ends[0])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for k, a, b in zip(plain, bounds[:-1], bounds[1:]):
            out[k] = self.finished(texts[k], ids[a:b])
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return self.ids_of([text])[0]

    def common_form(self, text: str) -> str | None:
        """The text with its pieces parted by blanks, or None."""
        raise NotImplementedError

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text that is not of the common form."""
        return np.frombuffer(self.encoded(text), dtype="<u4")

    def finished(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The ids of a text from those of its pieces."""
        return ids

    def _learn_joined(self, words: list[str]) -> None:
        """Encode words as one text and cut its ids at the borders; where a cut is not as long as its word, none is learnt."""
        ids = np.array(self.library.encode_batch_fast([self.text_of(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = self.cuts(np.flatnonzero(self.borders[ids]), len(ids))
        if len(cuts) == len(words) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
            wide = np.fromiter((len(w) if w.isascii() else len(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.int64, count=len(words))
            if (np.add.reduceat(self.widths[ids], cuts[:-1]) == wide + self.extra).all():
                raw, cuts = ids.tobytes(), (4 * cuts).tolist()
                self.known.update(zip(words, map(raw.__getitem__, map(slice, cuts[:-1], cuts[1:]))))

    #: Bytes of a piece in a joined text besides the word's.
    extra = 0

    def is_border(self, token: str) -> bool:
        raise NotImplementedError

    def may_join(self, piece: str) -> bool:
        raise NotImplementedError

    def text_of(self, words: list[str]) -> str:
        raise NotImplementedError

    def cuts(self, at: np.ndarray, n: int) -> np.ndarray:
        raise NotImplementedError


class ByteTokens(_Tokens):
    """A byte-level vocabulary that keeps white space.

    A piece stands for itself after a blank, or for itself where it starts with a line feed.
    """

    extra = 1

    def shown(self, piece: str) -> str:
        return piece if piece[:1] == "\n" else " " + piece

    def is_border(self, token: str) -> bool:
        return token[:1] == "Ġ"  # how the vocabulary shows a blank

    def may_join(self, piece: str) -> bool:
        return piece != "" and piece[0] != "\n"

    def text_of(self, words: list[str]) -> str:
        return " " + " ".join(words)

    def cuts(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.append(at, n)

    def common_form(self, text: str) -> str | None:
        if any(c in text for c in (_ASCII_RARE if text.isascii() else RARE_SPACE)) or any(s in text for s in self.special):
            return None
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n":
            return None
        first = text.replace("\n", " \n")
        at = first.find(" ")
        return first[at:] if at >= 0 else ""  # the first piece has no blank before it

    def finished(self, text: str, ids: np.ndarray) -> np.ndarray:
        first = re.match(r"[^ \n]*", text)[0]
        return np.concatenate([np.frombuffer(self.encoded(first), dtype="<u4"), ids])

    def whole(self, text: str) -> np.ndarray:
        if any(c in text for c in RARE_SPACE) or any(s in text for s in self.special):
            return super().whole(text)
        return np.frombuffer(b"".join(map(self._run, _RUNS.findall(text))), dtype="<u4")

    def _run(self, run: str) -> bytes:
        """A white-space run with the word after it."""
        if run[0] == " " and len(run) > 1 and run[1] not in " \n":
            return self.joined([run[1:]])
        return self.encoded(run)


class WordTokens(_Tokens):
    """A vocabulary with word ends that drops white space and case."""

    def is_border(self, token: str) -> bool:
        return token.endswith("</w>")

    def may_join(self, piece: str) -> bool:
        return piece.isalpha()

    def text_of(self, words: list[str]) -> str:
        return " ".join(words)

    def cuts(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.append(0, at + 1)

    def common_form(self, text: str) -> str | None:
        if "Σ" in text:
            return None  # capital sigma alone is lowered by its place
        lowered = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        if any(s in lowered for s in self.special) or not lowered.isascii() and not unicodedata.is_normalized("NFC", lowered):
            return None
        return lowered.replace("\n", " ")


def shared(kind: type[_Tokens], path: str, limit: int = 600_000) -> _Tokens:
    """One for each worker process, so that later tasks find what earlier ones have learnt."""
    return common.kept((kind, path, limit), lambda: kind(path, limit))
