"""Token ids of whole Arrow text columns, by a given tokenizer file.

A text is cut before white space that follows something else. No piece that the supplied tokenizers match crosses
such a place, so the ids of a text are those of its cuts in order. Where a tokenizer parts letters from signs, texts are also cut
before a sign that follows a letter; where it drops white space and case, cuts that differ in these alone are one. Each different
cut is encoded once per worker while it stays in a bounded store. Texts with unusual white space, control characters or the tokenizer's special
tokens (such as ``<|endoftext|>``, one id each unless ``special_as_text``) are encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import repeat
from operator import itemgetter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from voltmes.llm.text import KEPT, SPACE, Block

#: Cuts that a worker remembers, some 80 MB; beyond that it forgets those it met in one block only. Longer cuts aren't remembered.
#: Where cuts are of words, half as many will do.
REMEMBERED = 500_000
LONGEST = 64
_UNUSUAL = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f]|\xc2[\x80-\xa0\xad]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf")
#: The only bytes that those begin with.
_SUSPECT = 8
_SUSPECTS = [*range(9), *range(14, 32), 127, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]


class Encoder:
    def __init__(self, path: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        #: Never matches if there are none.
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added) or rb"(?!)")
        spec = json.loads(self.tokenizer.to_str())
        self.widths, self.word_widths = _widths(spec), _word_widths(spec)
        #: Whether letters and the sign behind them are always apart, and a line's end before either is an id of its own.
        self.parted = self.widths is not None and spec["pre_tokenizer"]["use_regex"]
        self.most = REMEMBERED if self.word_widths is None else REMEMBERED // 2
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.int32), 0
        self.starts, self.lengths, self.met = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64), np.zeros(1 << 18, np.int32)

    def _thin(self) -> None:
        """Only what was met in several blocks stays, what was met most if that is over half."""
        flat, starts, lengths, met = self.flat, self.starts, self.lengths, self.met[:len(self.known)]
        at, half = np.flatnonzero(met > 1), self.most // 2
        if len(at) > half:
            at = np.sort(at[np.argsort(-met[at], kind="stable")[:half]])
        cuts = list(self.known)
        cuts = [cuts[i] for i in at.tolist()]
        self._forget()
        if cuts:
            self._keep(cuts, lengths[at], flat[ragged(starts[at], lengths[at])])
            self.met[:len(at)] = met[at] // 2

    def _keep(self, cuts: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> None:
        first, total = len(self.known), len(ids)
        self.flat = _room(self.flat, self.used, total)
        self.starts, self.lengths, self.met = (_room(x, first, len(cuts)) for x in (self.starts, self.lengths, self.met))
        self.flat[self.used:self.used + total] = ids
        self.starts[first:first + len(cuts)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:first + len(cuts)] = lengths
        self.met[first:first + len(cuts)] = 0
        self.used += total
        self.known.update(zip(cuts, range(first, first + len(cuts))))

    def _encoded(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each cut, and all ids. The cuts end otherwise than with white space, so they join to one text."""
        if self.parted:
            # What doesn't begin with white space gets an id before it, which goes again.
            more = np.fromiter((c[0] not in _SPACES for c in cuts), np.int64, len(cuts))
            lengths, ids = self._joined([b"\n" + c if m else c for c, m in zip(cuts, more.tolist())])
            return lengths - more, np.delete(ids, (np.cumsum(lengths) - lengths)[more > 0])
        # Otherwise cuts begin with white space, or are of words where white space stands for nothing.
        return self._joined(cuts if self.word_widths is None else [b" " + c for c in cuts])

    def _joined(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(cuts)
        widths = self.widths if self.word_widths is None else None if _resized(joined) else self.word_widths
        if widths is not None:
            ids = np.array(self.tokenizer.encode_batch_fast([joined.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int32)
            ends, bounds = np.cumsum(widths[ids]), np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)))
            if self.word_widths is not None:
                bounds = np.cumsum(~SPACE[np.frombuffer(joined, np.uint8)])[bounds - 1]
            last = np.searchsorted(ends, bounds)
            # Ids that don't make up the bytes of each cut are not told apart by their widths.
            if len(ids) and ends[-1] == bounds[-1] and np.array_equal(ends[last], bounds):
                return np.diff(last, prepend=-1), ids
        texts = [c.decode("utf-8", "replace") for c in cuts]
        whole = "".join(texts)
        if not is_normalized("NFC", whole) or len(whole.lower()) != len(whole):
            # A normalizer may move characters, and then the places of ids don't tell their cuts.
            each = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter(map(len, each), np.int64, len(each)), np.array([i for ids in each for i in ids], np.int32)
        begins = np.cumsum([0, *map(len, texts)])
        found = self.tokenizer.encode(whole, add_special_tokens=False)
        at = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(found))
        owner = np.searchsorted(begins, at, side="right") - 1
        return np.bincount(owner, minlength=len(cuts)), np.array(found.ids, np.int32)

    def _learn(self, cuts: list[bytes]) -> np.ndarray:
        """Where the ids of each of some different cuts are kept."""
        if len(self.known) + len(cuts) > self.most:
            self._thin()
        places = np.fromiter(map(self.known.get, cuts, repeat(-1)), np.int64, len(cuts))
        new = np.flatnonzero(places < 0)
        places[new] = np.arange(len(self.known), len(self.known) + len(new))
        for at in range(0, len(new), 4096):
            some = [cuts[i] for i in new[at:at + 4096]]
            self._keep(some, *self._encoded(some))
        self.met[places] += 1
        return places

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and the index of each text's first id (one more for the end)."""
        data, bounds = block
        n = len(data)
        raw = data.tobytes()
        kinds = np.frombuffer(raw.translate(_KINDS), np.uint8)
        meets = kinds[1:] & np.frombuffer(raw.translate(_AFTER), np.uint8)[:-1]
        opens = np.zeros(n, bool)
        opens[1:] = meets & (_SPACE | _CUT if self.parted or self.word_widths is not None else _SPACE)
        if self.parted:
            opens[_after_wide(data, np.flatnonzero(meets & _WIDE) + 1)] = True
        given = data
        if self.word_widths is not None:
            data = _eased(given)
            raw = data.tobytes()
        odd = bool(self.added.search(raw) or kinds.max(initial=0) >= _SUSPECT and _UNUSUAL.search(raw))
        if odd:
            for low, high in zip(bounds[:-1], bounds[1:]):
                if _UNUSUAL.search(raw, low, high) or self.added.search(raw, low, high):
                    opens[low:high] = False
                    if data is not given:
                        data[low:high] = given[low:high]
            raw = raw if data is given else data.tobytes()
        opens[bounds[bounds < n]] = True
        begins = np.flatnonzero(opens)
        ends = np.append(begins, n)
        cuts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        coded = cuts.dictionary_encode()
        # Cuts that join to one text are remembered; those with white space at the end are not, and where letters and signs
        # aren't parted, nor are those without it before.
        _, places, content = coded.dictionary.buffers()
        places = np.frombuffer(places, np.int64)[coded.dictionary.offset:][:len(coded.dictionary) + 1]
        content = np.frombuffer(content, np.uint8) if len(coded.dictionary) else np.zeros(0, np.uint8)
        joined, at = content.tobytes(), places.tolist()
        different = [joined[a:b] for a, b in zip(at, at[1:])]
        first, last = content[places[:-1]], content[places[1:] - 1]
        usual = (np.diff(places) <= LONGEST) & ((first <= 32) | self.parted | (self.word_widths is not None)) & (last > 32)
        if odd:
            if self.parted:
                usual &= SPACE[first] | (first > 32) & (first < 127)
            usual &= np.fromiter(
                ((c[-1] < 128 or not c.decode("utf-8", "replace")[-1].isspace()) and not self.added.search(c) for c in different), bool, len(different))
        kept, rare = np.flatnonzero(usual).tolist(), np.flatnonzero(~usual).tolist()
        places = np.empty(len(different), np.int64)
        places[kept] = self._learn([different[i] for i in kept])
        starts, lengths, flat = self.starts, self.lengths, self.flat
        if rare:
            found = [e.ids for i in range(0, len(rare), 64) for e in self.tokenizer.encode_batch(
                [different[j].decode("utf-8", "replace") for j in rare[i:i + 64]], add_special_tokens=False)]
            more = np.fromiter(map(len, found), np.int64, len(found))
            known = len(self.known)
            places[rare] = np.arange(known, known + len(rare))
            starts = np.concatenate([starts[:known], self.used + np.cumsum(more) - more])
            lengths = np.concatenate([lengths[:known], more])
            flat = np.concatenate([flat[:self.used], np.array([i for ids in found for i in ids], np.int32)])
        place = places[coded.indices.to_numpy()]
        length = lengths[place]
        return flat[ragged(starts[place], length)], np.concatenate([[0], np.cumsum(length)])[np.searchsorted(begins, bounds)]


#: Where a byte and the one before it share one of these, white space begins, or a mark follows a letter or digit, or a wide byte.
_SPACE, _CUT, _WIDE = 1, 2, 4
_SPACES = frozenset(np.flatnonzero(SPACE).tolist())
_LETTERS = frozenset([*range(48, 58), *range(65, 91), *range(97, 123)])
_KINDS = bytes(
    _SPACE if b in _SPACES else _SUSPECT if b in _SUSPECTS else _CUT | _WIDE if 32 < b < 127 and b not in _LETTERS else 0 for b in range(256))
_AFTER = bytes(0 if b in _SPACES else _SPACE | _CUT if b in _LETTERS else _SPACE | _WIDE if b > 127 else _SPACE for b in range(256))
#: First bytes of Latin and Cyrillic letters: of 64 characters each, all letters but the signs of multiplication and division.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True
#: What becomes of each byte where case and kind of white space don't matter.
_EASED = np.arange(256, dtype=np.uint8)
_EASED[65:91] += 32
_EASED[SPACE] = 32
#: The only normalizers and cut with which words are lower-cased and spelled byte for byte, white space left out.
_WORD_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORD_CUT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _after_wide(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of some places of marks behind a wide byte follow a letter of two bytes, as far as whole rows of the code chart are letters."""
    at = at[at > 1]
    lead, tail = data[at - 2], data[at - 1]
    return at[_LEADS[lead] & (tail < 192) & ((lead != 0xC3) | (tail & 0xDF != 0x97))]


def _widths(spec: dict) -> np.ndarray | None:
    """Bytes that each id stands for, where ids spell the bytes of the text one for one; else None."""
    cut = spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and not (cut["add_prefix_space"] or spec["normalizer"] or spec["model"].get("end_of_word_suffix"))
    return _spelled(spec) if plain else None


def _word_widths(spec: dict) -> np.ndarray | None:
    """The same where ids spell the bytes of lower-cased words, and nothing but white space is left out."""
    return _spelled(spec) if spec["normalizer"] == _WORD_NORMALIZER and spec["pre_tokenizer"] == _WORD_CUT else None


def _spelled(spec: dict) -> np.ndarray | None:
    model = spec["model"]
    if model["type"] != "BPE" or any([spec["truncation"], spec["padding"], *map(model.get, ("continuing_subword_prefix", "unk_token", "dropout"))]):
        return None
    widths = np.zeros(1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]), np.int64)
    for token, number in model["vocab"].items():
        widths[number] = len(token.removesuffix(model.get("end_of_word_suffix") or ""))
    return widths


def _eased(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case and all white space as spaces, which is all one to words; a letter that a mark may follow stays."""
    eased = _EASED[data]
    eased[:-1] = np.where(data[1:] < 128, eased[:-1], data[:-1])
    return eased


def _resized(raw: bytes) -> bool:
    """Whether normal form or lower case may give a character another number of bytes."""
    if raw.isascii():
        return False
    text = raw.decode("utf-8", "replace")
    lower = np.frombuffer(text.lower().encode(), np.uint8)
    data = np.frombuffer(raw, np.uint8)
    return not is_normalized("NFC", text) or not np.array_equal(data & 0xC0 == 0x80, lower & 0xC0 == 0x80)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of runs with these starts and lengths, one run after the other."""
    after = np.cumsum(lengths)
    return np.repeat(starts - (after - lengths), lengths) + np.arange(after[-1] if len(after) else 0)


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    larger = np.empty(max(2 * len(array), used + more), array.dtype)
    larger[:used] = array[:used]
    return larger


@lru_cache(1)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One per worker and file, until a task of another kind of step lets it go."""
    KEPT.append(encoder.cache_clear)
    return Encoder(path, special_as_text)


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id ``end`` after each text."""
    closed = np.insert(ids, bounds[1:], end)
    return closed, bounds + np.arange(len(bounds))
