"""Batch encoding with a public tokenizer file, for Arrow functions on executors.

A text is cut at *safe boundaries*, places where the tokenizer always starts a new
pre-token whatever stands on either side, so the ids of a text are the ids of its
pieces one after another.  A batch then encodes each distinct piece once, and a
very long text costs no more memory than its pieces.
"""

import json
import os
import re
from hashlib import blake2b
from itertools import chain

import numpy as np

# letters and digits in every version of Unicode that a tokenizer may be built on, without
# the dotted capital I, whose lower case ends with a combining mark
_PLAIN = "A-Za-z0-9À-ÖØ-öø-įı-ɏ"
# before a single space between two visible characters; around a single line feed
# between two; before a comma or full stop that follows a plain letter or digit
_SAFE = re.compile(rf"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[{_PLAIN}])(?=[,.])")
_IRREGULAR = re.compile(rf"\s\s|[^{_PLAIN}][,.]|\x01|\A[,.\s]|\s\Z")
MAX_PIECES = 1 << 20
MAX_BYTES = 3 << 25  # of the pieces and ids that are kept, with PIECE_BYTES
PIECE_BYTES = 44  # that a piece takes beside its ids: hashes, place and length of its ids, slots
BATCH_BYTES = 1 << 20
LEARNT = 1 << 11  # pieces that are encoded at once
LONG_PIECE = 255  # bytes of a piece that is hashed by a digest
_NONE = np.zeros(0, np.int64)


def _byte_tables():
    """Marks and random numbers per byte, and two random multipliers per place."""
    marks = np.zeros(256, np.uint8)
    marks[[32, 10, 44, 46]] |= 1  # a piece starts here
    marks[[44, 46]] |= 2  # the same where white space is dropped
    marks[10] |= 4  # and after this byte
    marks[[32, 10]] |= 8  # the same where white space is dropped
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(9, 14), *range(28, 33)]] |= 1  # white space
    kinds[[*range(48, 58), *range(65, 91), *range(97, 123)]] |= 2  # plain letter or digit
    kinds[[44, 46]] |= 4
    kinds[[0xC2, 0xE1, 0xE2, 0xE3]] |= 8  # may lead white space of several bytes
    random = np.random.default_rng(20240601)
    values = random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values ^= np.arange(256, dtype=np.uint64) << np.uint64(1)
    places = random.integers(1, 1 << 63, (2, LONG_PIECE + 1), np.uint64) * np.uint64(2) + np.uint64(1)
    folded = values.copy()
    folded[[32, 10]] = 0
    return marks, kinds, values, folded, places


_MARKS, _KINDS, _BYTES, _BYTES_FOLDED, _PLACES = _byte_tables()


def split_safely(text: str) -> list[str]:
    """The text in pieces whose ids, one after another, are the ids of the text."""
    if _IRREGULAR.search(text):
        return _SAFE.split(text)
    # every space, line feed, comma and full stop of this text is a safe boundary
    marked = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01")
    return marked.replace(",", "\x01,").replace(".", "\x01.").split("\x01")


def irregular(raw: list[bytes]) -> np.ndarray:
    """Of each UTF-8 text, whether it may have a mark that is not a safe boundary.

    False only if no white space stands at an end or beside other white space, and
    every comma and full stop follows a plain letter or digit.
    """
    d = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    odd = np.zeros(len(raw), bool)
    if not len(d):
        return odd
    kind = _KINDS[d]
    space = (kind & 1) != 0
    bad = np.zeros(len(d), bool)
    np.logical_and(space[1:], space[:-1], out=bad[1:])
    bad |= (kind & 8) != 0  # may lead a space outside ASCII
    at = np.flatnonzero(kind & 4)
    before, lead = d[np.maximum(at - 1, 0)], d[np.maximum(at - 2, 0)]
    plain = ((_KINDS[before] & 2) != 0) | (
        (before >= 0x80) & (before <= 0xBF) & (lead >= 0xC3) & (lead <= 0xC8)
        & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7))) & ~((lead == 0xC4) & (before == 0xB0))
    )
    bad[at[~plain]] = True
    sizes = np.diff(ends, prepend=0)
    first, last = (ends - sizes)[sizes > 0], ends[sizes > 0] - 1
    bad[first] |= (kind[first] & 5) != 0
    bad[last] |= space[last]
    odd[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = True
    return odd


class _Numbers(list):
    """Texts of the pieces that have a number and no ids yet, and how many numbers were given."""

    given = 0


class BatchEncoder:
    """Encodes batches of texts; the ids of up to ``max_pieces`` pieces, and of about
    ``max_bytes`` bytes of them, are kept from batch to batch.

    A piece is known by two independent 64-bit hashes, in an open table of numbers; its
    text is dropped once it is encoded, so that even pieces met in one batch only take
    little room, and none is encoded twice until all are forgotten."""

    def __init__(self, path: str, max_pieces: int = MAX_PIECES, max_bytes: int = MAX_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # pieces are kept here
        self.max_pieces, self.max_bytes = max_pieces, max_bytes
        self.folds = _folds(rules)
        self._reset()

    def _reset(self):
        self.numbers = _Numbers()
        self.known = self.held = 0
        self.lengths = np.zeros(1 << 12, np.int32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 14, np.int32)
        self.used = 0
        self.ones = np.zeros(1 << 12, np.uint64)
        self.twos = np.zeros(1 << 12, np.uint64)
        self.slots = np.full(1 << 13, -1, np.int32)

    def _learn(self):
        for at in range(0, len(self.numbers), LEARNT):
            batch = self.numbers[at : at + LEARNT]
            encoded = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
            found = [e.ids for e in encoded]
            lengths = np.fromiter(map(len, found), np.int32, len(found))
            total = int(lengths.sum())
            self.ids = _room(self.ids, self.used + total)
            self.lengths = _room(self.lengths, self.known + len(found))
            self.starts = _room(self.starts, self.known + len(found))
            own = slice(self.known, self.known + len(found))
            self.lengths[own] = lengths
            self.starts[own] = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
            self.ids[self.used : self.used + total] = np.fromiter(
                chain.from_iterable(found), np.int32, total
            )
            self.used += total
            self.known += len(found)
            self.held += 4 * total + PIECE_BYTES * len(batch)
        self.numbers.clear()

    def _slot(self, one):
        """Where the search for pieces of these first hashes begins."""
        return (one >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, one, two):
        """Numbers of the pieces of these hashes, -1 if unknown."""
        slot = self._slot(one)
        numbers = self.slots[slot]
        other = (self.ones[numbers] != one) | (self.twos[numbers] != two)
        left = np.flatnonzero((numbers >= 0) & other)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.slots) - 1)
            found = self.slots[slot]
            numbers[left] = found
            other = (self.ones[found] != one[left]) | (self.twos[found] != two[left])
            more = np.flatnonzero((found >= 0) & other)
            left, slot = left[more], slot[more]
        return numbers.astype(np.int64)

    def _keep(self, one, two):
        """Numbers for pieces of different hashes that are not known yet."""
        first, given = self.numbers.given, self.numbers.given + len(one)
        self.ones, self.twos = _room(self.ones, given), _room(self.twos, given)
        self.ones[first:given], self.twos[first:given] = one, two
        self.numbers.given = given
        new = np.arange(first, given)
        if 2 * given > len(self.slots):  # at most half of the slots are taken
            self.slots = np.full(1 << (2 * given - 1).bit_length(), -1, np.int32)
            self._place(np.arange(given))
        else:
            self._place(new)
        return new

    def _place(self, numbers):
        slot = self._slot(self.ones[numbers])
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]
            pushed = self.slots[slot] != numbers
            numbers, slot = numbers[pushed], (slot[pushed] + 1) & (len(self.slots) - 1)

    def _pieces(self, texts):
        """Piece numbers of the texts, and how many belong to each text."""
        if self.numbers.given > self.max_pieces or self.held > self.max_bytes:
            self._reset()
        raw = [(t or "").encode() for t in texts]
        odd = irregular(raw)
        regular = [r for r, o in zip(raw, odd) if r and not o]
        numbers, counts = self._regular(regular) if regular else (_NONE, _NONE)
        if len(regular) < len(texts):
            numbers, counts = self._others(texts, odd, numbers, counts)
        self._learn()
        return numbers, counts

    def _others(self, texts, odd, numbers, counts):
        """Puts the pieces of irregular texts between those of the regular ones."""
        pieces, sizes = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text and odd[i]:
                own = split_safely(text)
                if self.folds:
                    own = [piece.strip(" \n") for piece in own]
                own = [piece.encode() for piece in own if piece]
                sizes[i] = len(own)
                pieces += own
        regular = np.fromiter((bool(t) and not o for t, o in zip(texts, odd)), bool, len(texts))
        sizes[regular] = counts
        found = np.empty(int(sizes.sum()), np.int64)
        among = np.repeat(regular, sizes)
        found[among] = numbers
        if pieces:
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            starts = np.cumsum(lengths) - lengths
            found[~among] = self._look_up(b"".join(pieces), starts, lengths, _BYTES)
        return found, sizes

    def _regular(self, raw):
        """The same for encoded texts in which every mark is a safe boundary."""
        if self.folds:
            raw = [r.lower() if r.isascii() and b"<" not in r else r for r in raw]
        data = b"".join(raw)
        d = np.frombuffer(data, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        first = np.zeros(len(d), bool)
        kind = _MARKS[d]
        np.not_equal(kind & (2 if self.folds else 1), 0, out=first)
        first[1:] |= (kind[:-1] & (8 if self.folds else 4)) != 0
        first[0] = True
        first[ends[:-1]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(d)))
        values = _BYTES_FOLDED if self.folds else _BYTES
        numbers = self._look_up(data, starts, lengths, values)
        counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
        return numbers, counts

    def _look_up(self, data, starts, lengths, values):
        """Numbers of the pieces that begin at these bytes; unknown ones are to be learnt."""
        d = np.frombuffer(data, np.uint8)
        place = np.arange(len(d)) - np.repeat(starts, lengths)
        np.minimum(place, LONG_PIECE, out=place)
        values = values[d]
        one = np.add.reduceat(values * _PLACES[0][place], starts)
        two = np.add.reduceat(values * _PLACES[1][place], starts)
        for i in np.flatnonzero(lengths >= LONG_PIECE):
            digest = blake2b(data[starts[i] : starts[i] + lengths[i]], digest_size=16).digest()
            one[i], two[i] = np.frombuffer(digest, np.uint64)
        numbers = self._find(one, two)
        missed = np.flatnonzero(numbers < 0)
        if len(missed):
            both = one[missed] ^ two[missed] * np.uint64(0x9E3779B97F4A7C15)
            _, at, back = np.unique(both, return_index=True, return_inverse=True)
            new = missed[at]
            begin = starts[new].tolist()
            end = (starts[new] + lengths[new]).tolist()
            cut = (data[a:b].decode() for a, b in zip(begin, end))
            if self.folds:
                cut = (piece.strip(" \n") for piece in cut)
            self.numbers += cut
            numbers[missed] = self._keep(one[new], two[new])[back]
        return numbers

    def counts(self, texts: list) -> np.ndarray:
        """Number of ids of each text; null counts as empty."""
        parts = []
        for some in by_size(texts):
            numbers, counts = self._pieces(some)
            parts.append(_sums(self.lengths[numbers], counts))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def encode(self, texts: list):
        """(ids of all texts one after another, number of ids of each text)."""
        all_ids, all_counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for some in by_size(texts):
            numbers, counts = self._pieces(some)
            lengths = self.lengths[numbers].astype(np.int64)
            total = int(lengths.sum())
            before = np.cumsum(lengths) - lengths
            at = np.repeat(self.starts[numbers] - before, lengths) + np.arange(total)
            all_ids.append(self.ids[at])
            all_counts.append(_sums(lengths, counts))
        return np.concatenate(all_ids), np.concatenate(all_counts)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    if n <= len(values):
        return values
    more = np.empty(len(values) + n, values.dtype)  # what is not used yet takes no memory
    more[: len(values)] = values
    return more


def _folds(rules: dict) -> bool:
    """Whether a tokenizer lower-cases texts and drops white space between words.

    ASCII text without a special token may then be lower-cased ahead of it.
    """
    steps = rules.get("normalizer") or {}
    cuts = rules.get("pre_tokenizer") or {}
    lower = any(s.get("type") == "Lowercase" for s in steps.get("normalizers", [steps]))
    first = cuts.get("pretokenizers", [cuts])[0]
    words = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(lower and words)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    totals = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return totals[ends] - totals[ends - counts]


def by_size(texts: list, most: int = BATCH_BYTES):
    """Consecutive slices of about equal UTF-8 size; a text above it is a slice alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = 0 if not text else len(text) if text.isascii() else len(text.encode())
        if i > start and size + n > most:
            yield texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield texts[start:]


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]
