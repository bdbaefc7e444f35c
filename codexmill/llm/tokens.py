"""Token ids of whole texts, exactly as the tokenizers library gives them, at several times its speed."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose pieces are told apart at a time, and pieces that are put together at a time.
SLICE_BYTES, GATHER_PIECES = 6 << 20, 1 << 17
#: Words whose ids a worker remembers; when there are more, those of the slice at hand stay.
KNOWN_WORDS = 400_000
#: Pieces to a call of the library, which takes some hundred bytes for a token; eight times as many words.
CALL_PIECES = 2048
#: What may end a piece and be encoded apart from the letters before it.
_MARKS = ",.;:!?"
#: A word of letters below U+0530 (Latin, Greek, Cyrillic), which are letters in any version of Unicode.
_EARLY = r"^[\x{0}-\x{52F}]*$"

# the white space of Python's \s, in RE2's terms
_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
_UNEVEN = rf"{_WHITE}[ \n]|[ \n]{_WHITE}|^[ \n]|[ \n]$"
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Pool:
    """Ids of different pieces, one after the other, and where each piece's lie."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The first place of each of the pieces whose ids are appended."""
        first = self.size + np.cumsum(counts) - counts
        self.parts.append(ids)
        self.size += len(ids)
        return first

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)


class PieceEncoder:
    """Encodes texts piece by piece, each different piece of a slice once.

    Holds for byte-level BPE whose pre-tokenizer attaches one space to the word after it, and splits
    letters from what isn't one: there no token spans the place before a space or line feed that stands
    alone between two other characters, nor that between a letter and a mark, and what precedes such a
    place doesn't influence what follows. So texts are cut there, each different piece is encoded once
    by the library, and the ids are joined. A text that holds one of the vocabulary's special tokens is
    left whole, for the library to find them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [x.content for x in self._tokenizer.get_added_tokens_decoder().values() if x.content]
        # a second one for pieces of letters alone, whose bytes are spelled as the vocabulary spells them
        self._letters = Tokenizer.from_file(path)
        self._letters.encode_special_tokens = True
        self._letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelling = {b: spelled.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for b in range(128, 256):  # taken from characters whose UTF-8 form has the byte, lead or continuation
            try:
                text = bytes([b, 0xA0 if b != 0xF4 else 0x80] + [0x80] * (b >= 0xE0) + [0x80] * (b >= 0xF0)).decode() if b >= 0xC2 else bytes([0xC3, b]).decode() if b < 0xC0 else ""
            except UnicodeDecodeError:
                text = ""
            if text:
                spelling[b] = spelled.pre_tokenize_str(text)[0][0][0 if b >= 0xC2 else 1]
        self._spelling = spelling | {10: " "}  # a line feed stands between two words
        self._size = np.array([len(self._letters.id_to_token(i) or "") for i in range(self._letters.get_vocab_size())], np.int64)
        self._known = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some pieces as the library gives them, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(pieces), CALL_PIECES):
            found = [x.ids for x in self._tokenizer.encode_batch_fast(pieces[a : a + CALL_PIECES], add_special_tokens=False)]
            counts.append(np.array([len(x) for x in found], np.int64))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids that are known, and where those of some different words of letters lie among them and how many they are."""
        known, ids, counts = self._known
        if len(known) > KNOWN_WORDS:
            known, ids, counts = known[:0], ids[:0], counts[:0]
        at = pc.index_in(words, value_set=known)
        new = words.filter(pc.is_null(at))
        more, more_counts = self._words(new)
        places = at.fill_null(0).to_numpy().astype(np.int64)
        places[at.is_null().to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(new))
        self._known = pa.concat_arrays([known, new]), np.concatenate([ids, more]), np.concatenate([counts, more_counts])
        first = np.cumsum(self._known[2]) - self._known[2]
        return self._known[1], first[places], self._known[2][places]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of letters, some with a space before them."""
        found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        found += [self._joined(words.slice(a, 8 * CALL_PIECES)) for a in range(0, len(words), 8 * CALL_PIECES)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same in one call, of which each word's ids are told apart by the lengths of their spelling."""
        spelled = "\n".join(words.to_pylist()).encode().decode("latin-1").translate(self._spelling)
        ids = np.array(self._letters.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.uint32)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.searchsorted(np.cumsum(self._size[ids]), np.cumsum(sizes)) + 1
        return ids, np.diff(ends, prepend=0)

    def _cut(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """The pieces of the texts, which stand in another order, and each one's place among the texts."""
        whole = np.zeros(len(texts), bool)
        for x in self._special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False) & ~whole
        even = ~whole & ~uneven
        plain = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(even)), "\n", " \n"), " ")
        by_hand = [_LONE_SPACE.split(x) for x in texts.filter(pa.array(uneven)).to_pylist()] + [[x] for x in texts.filter(pa.array(whole)).to_pylist()]
        places = np.concatenate([np.flatnonzero(even), np.flatnonzero(uneven), np.flatnonzero(whole)])
        return pa.concat_arrays([plain, pa.array(by_hand, pa.list_(pa.string()))]), places

    def _encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        lists, places = self._cut(texts)
        offsets, values = lists.offsets.to_numpy().astype(np.int64), lists.values
        heads = offsets[:-1]
        is_head = np.zeros(len(values), bool)
        is_head[heads] = True
        coded = values.filter(pa.array(~is_head)).dictionary_encode()
        different, piece = coded.dictionary, coded.indices.to_numpy()

        # a piece is a line feed or none, letters, marks; or it is something else, and encoded as it is
        pool, fed = _Pool(), pc.starts_with(different, "\n")
        body = pc.if_else(fed, pc.utf8_slice_codeunits(different, 1), different)
        word = pc.utf8_rtrim(body, _MARKS)
        lettered = pc.and_(pc.utf8_is_alpha(word), pc.match_substring_regex(word, _EARLY))
        stems = pc.if_else(fed, word, pc.binary_join_element_wise(" ", word, "")).filter(lettered).dictionary_encode()
        is_marked = pc.and_(lettered, pc.not_equal(pc.binary_length(word), pc.binary_length(body)))
        marked = [x[len(y) :] for x, y in zip(body.filter(is_marked).to_pylist(), word.filter(is_marked).to_pylist(), strict=True)]
        marks = pa.array(marked, pa.string()).dictionary_encode()
        fed, lettered, is_marked = (x.to_numpy(zero_copy_only=False) for x in (fed, lettered, is_marked))
        first, n = np.zeros((len(different), 3), np.int32), np.zeros((len(different), 3), np.int32)

        def place(rows: np.ndarray, column: int, coded: tuple[np.ndarray, np.ndarray], which: np.ndarray | slice) -> None:
            ids, counts = coded
            first[rows, column], n[rows, column] = pool.add(ids, counts)[which], counts[which]

        ids, at, counts = self._remembered(stems.dictionary)
        pool.add(ids, np.array([len(ids)]))  # the first of the pool, so that the places hold there
        which = stems.indices.to_numpy()
        first[lettered, 1], n[lettered, 1] = at[which], counts[which]
        place(is_marked, 2, self._plain(marks.dictionary.to_pylist()), marks.indices.to_numpy())
        place(fed & lettered, 0, self._plain(["\n"]), np.zeros(int((fed & lettered).sum()), np.int64))
        others = different.filter(pa.array(~lettered)).to_pylist()
        place(~lettered, 0, self._plain([x if x[:1] == "\n" else " " + x for x in others]), slice(None))
        # what begins a text, and what ends it
        ids, counts = self._plain(values.take(pa.array(heads)).to_pylist())
        head_first, head_n = pool.add(ids, counts), counts
        end_first = pool.add(np.array([end], np.uint32), np.array([1]))[0]
        known = pool.ids()

        # every text is its head, its other pieces' parts, and the end
        out, lengths = [], np.zeros(len(heads), np.int64)
        sizes, a = np.diff(offsets), 0
        while a < len(heads):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + GATHER_PIECES, side="right")) - 1)
            stops = np.cumsum(3 * sizes[a:b] - 1)
            starts = np.concatenate([[0], stops[:-1]])
            at, m = np.empty(stops[-1], np.int32), np.empty(stops[-1], np.int32)
            inner = np.ones(len(at), bool)
            inner[starts] = inner[stops - 1] = False
            # of the pieces that are no heads, so many come before this run's
            these = piece[offsets[a] - a : offsets[b] - b]
            at[starts], at[stops - 1], at[inner] = head_first[a:b], end_first, first[these].ravel()
            m[starts], m[stops - 1], m[inner] = head_n[a:b], 1, n[these].ravel()
            before = np.cumsum(m, dtype=np.int32) - m
            out.append(known[np.repeat(at - before, m) + np.arange(before[-1] + m[-1], dtype=np.int32)])
            lengths[a:b] = np.add.reduceat(m, starts)
            a = b
        flat = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return _reordered(flat, lengths, places)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by `end`, as one array of uint32, and how many each text has. Null is empty."""
        texts = pc.fill_null(texts, "")
        return self._encode(texts, end) if len(texts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _reordered(flat: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of lengths in `flat` in the order of their places."""
    if (np.diff(places) > 0).all():
        return flat, lengths
    order = np.argsort(places)
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    return np.concatenate([flat[cuts[i] : cuts[i + 1]] for i in order]), lengths[order]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for a vocabulary file, made once."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
