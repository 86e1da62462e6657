"""Token ids of whole texts by the tokenizers library, with the ids of words kept per worker.

A byte-level tokenizer cuts text before each single space that stands between two characters that
aren't white space. So a text without runs of white space can be encoded word by word, and each
distinct word goes through the library once per worker, until its table is full and starts anew. All
other texts go through the library whole: those with runs, those that hold the string of an added
token (which the library finds before it cuts words), and all texts of a tokenizer of another kind,
which is seen from its file.

The table is made of arrays: words of up to 24 bytes (with the space before them) are three 64-bit
numbers and a length, found by hash and compared in full, for a portion of texts at once. Longer
words go through the library each time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    import numpy as np
    from tokenizers import Tokenizer

RUN = re.compile(r"\s\s")
#: After a letter and at the end of a word, one of these is a piece of its own.
MARKS = b".,;:!?"
#: Words kept per worker, about 65 MB at most, and first words of texts.
TABLE_WORDS, FIRST_WORDS = 1_000_000, 50_000
LANES = 3
#: With more added tokens than this, looking for each in each text isn't worth it.
MOST_ADDED = 32


def has_runs(text: str) -> bool:
    """Whether white space stands beside white space."""
    plain = text.replace("\n", " ")
    # Of all white space, only the space is printable.
    return "  " in plain if plain.isprintable() else RUN.search(text) is not None


def _lanes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The first 24 bytes from each start as three numbers, zero beyond size. data has 32 bytes to spare."""
    import numpy as np

    pairs = data[:-1].astype(np.uint16)
    pairs |= data[1:].astype(np.uint16) << np.uint16(8)
    fours = pairs[:-2].astype(np.uint32)
    fours |= pairs[2:].astype(np.uint32) << np.uint32(16)
    eights = fours[:-4].astype(np.uint64)
    eights |= fours[4:].astype(np.uint64) << np.uint64(32)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    out = [eights[starts] & masks[np.minimum(size, 8)]]
    for lane in range(1, LANES):
        more = np.flatnonzero(size > 8 * lane)
        own = np.zeros(len(starts), np.uint64)
        own[more] = eights[np.minimum(starts[more] + 8 * lane, len(eights) - 1)] & masks[np.clip(size[more] - 8 * lane, 0, 8)]
        out.append(own)
    return out


def _hash(lanes: list[np.ndarray], size: np.ndarray) -> np.ndarray:
    import numpy as np

    h = size.astype(np.uint64)
    for x, factor in zip(lanes, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True):
        h = (h ^ x) * np.uint64(factor)
        h ^= h >> np.uint64(29)
    return h


class WordTable:
    """Open addressing over arrays: hash, lanes and size of each word, and its ids in one long array."""

    def __init__(self, most: int) -> None:
        import numpy as np

        self.most = most
        slots = 1 << max(4, (2 * most - 1).bit_length())
        self.mask = np.uint64(slots - 1)
        self.slot = np.zeros(slots, np.int32)
        self.n = 0
        self.h = np.zeros(most, np.uint64)
        self.lanes = [np.zeros(most, np.uint64) for _ in range(LANES)]
        self.size = np.zeros(most, np.uint8)
        self.start = np.zeros(most, np.int64)
        self.count = np.zeros(most, np.int32)
        self.ids = np.zeros(max(16, 2 * most), np.uint32)
        self.used = 0

    def clear(self) -> None:
        self.slot[:] = 0
        self.n = self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry with each hash, or -1."""
        import numpy as np

        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), h & self.mask
        while len(left):
            entry = self.slot[at].astype(np.int64) - 1
            there = entry >= 0
            left, at, entry = left[there], at[there], entry[there]
            same = self.h[entry] == h[left]
            out[left[same]] = entry[same]
            left, at = left[~same], (at[~same] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, lanes: list[np.ndarray], size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """New words, each hash once; ids hold count of each, one after another. Returns their entries."""
        import numpy as np

        new = np.arange(self.n, self.n + len(h))
        self.h[new], self.size[new], self.count[new] = h, size, count
        for mine, x in zip(self.lanes, lanes, strict=True):
            mine[new] = x
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[new] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        self.n += len(h)
        left, at = new, h & self.mask
        while len(left):
            free = self.slot[at] == 0
            self.slot[at[free]] = left[free] + 1  # of those that want one slot, the last gets it
            placed = self.slot[at] == left + 1
            left, at = left[~placed], (at[~placed] + np.uint64(1)) & self.mask
        return new


def _starting_with_space(tokenizer: Tokenizer) -> np.ndarray:
    import numpy as np

    vocab = tokenizer.get_vocab()
    out = np.zeros(max(vocab.values(), default=0) + 1, bool)
    out[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True  # byte-level for a space
    return out


def _cuts_words(tokenizer: Tokenizer) -> bool:
    """Whether it is byte-level BPE with the usual pattern, and nothing changes texts before that."""
    said = json.loads(tokenizer.to_str())
    cut = said.get("pre_tokenizer") or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    plain = not any(said.get(k) for k in ("normalizer", "truncation", "padding")) and said["model"].get("type") == "BPE"
    return bool(usual and plain and not said["model"].get("dropout") and not said["model"].get("ignore_merges"))


class Encoder:
    """Texts to ids, each text as the bytes of little-endian unsigned 32-bit numbers.

    special_as_text: strings of special tokens in a text are ordinary text, not those tokens.
    """

    def __init__(self, path: str, table_words: int = TABLE_WORDS, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and special_as_text)]
        self.added = sorted(added)
        self.cuts_words = _cuts_words(self.tokenizer) and len(added) <= MOST_ADDED
        self.starts_with_space = _starting_with_space(self.tokenizer)
        self.table = WordTable(table_words)
        self.first: dict[str, bytes] = {}
        self.marks = np.zeros(256, np.int64) - 1
        for mark, ids in zip(MARKS, self.whole([chr(m) for m in MARKS]), strict=True):
            if len(ids) == 4:
                self.marks[mark] = np.frombuffer(ids, "<u4")[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        """Each text by the library."""
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids and counts of words that start with their only space: as one text, cut again at the tokens that start with a space."""
        import numpy as np

        joined = b"".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
        starts = np.flatnonzero(self.starts_with_space[ids])
        if len(starts) == len(words) and not any(w[-1] < 33 or w[-1] > 126 and w.decode()[-1].isspace() for w in words):
            return ids, np.diff(np.append(starts, len(ids)))
        each = [np.frombuffer(x, "<u4") for x in self.whole([w.decode() for w in words])]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)

    def _marked(self, buffer: np.ndarray, starts: np.ndarray, size: np.ndarray, lanes: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these unknown words are known ones with a mark at the end, and their entries now that they are added."""
        import numpy as np

        table = self.table
        last, before = buffer[starts + size - 1], buffer[starts + size - 2] | 32
        chosen = np.flatnonzero((size > 2) & (size <= 8 * LANES) & (self.marks[last] >= 0) & (before >= 97) & (before <= 122))
        stem_size = size[chosen] - 1
        stem = []
        for k, x in enumerate(lanes):
            keep = np.full(len(chosen), 0xFFFFFFFFFFFFFFFF, np.uint64)
            here = stem_size // 8 == k
            keep[here] = ~(np.uint64(0xFF) << (8 * (stem_size[here] % 8)).astype(np.uint64))
            stem.append(x[chosen] & keep)
        entry = table.find(_hash(stem, stem_size))
        same = entry >= 0
        for mine, x in zip([*table.lanes, table.size], [*stem, stem_size], strict=True):
            same &= mine[entry] == x
        chosen, entry = chosen[same], entry[same]
        count = table.count[entry].astype(np.int64)
        ends = np.cumsum(count + 1)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        inside = np.ones(len(ids), bool)
        inside[ends - 1] = False
        ids[ends - 1] = self.marks[last[chosen]]
        ids[inside] = table.ids[np.arange(int(count.sum())) + np.repeat(table.start[entry] - (np.cumsum(count) - count), count)]
        return chosen, table.add(h[chosen], [x[chosen] for x in lanes], size[chosen], ids, count + 1)

    def _known(self, data: bytes, buffer: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """For each word its first id's place, their number, and the array that they stand in; None if hashes of two words are the same."""
        import numpy as np
        import pandas as pd

        table = self.table
        lanes = _lanes(buffer, starts, size)
        short = size <= 8 * LANES
        # A longer word gets a key of its own place.
        h = np.where(short, _hash(lanes, np.minimum(size, 255)), starts.astype(np.uint64))
        code, _ = pd.factorize(h)
        word = np.empty(int(code.max()) + 1, np.int64)
        word[code] = np.arange(len(code))
        same = word[code]
        if not (all((x[same] == x).all() for x in lanes) and (size[same] == size).all() and (short[same] == short).all()):
            return None
        own, short = [x[word] for x in lanes], short[word]
        entry = np.where(short, table.find(h[word]), -1)
        there = np.flatnonzero(entry >= 0)
        at = entry[there]
        if not (all((mine[at] == x[there]).all() for mine, x in zip(table.lanes, own, strict=True)) and (table.size[at] == size[word[there]]).all()):
            return None
        new = np.flatnonzero(entry < 0)
        if len(new) > table.most:
            return None
        if table.n + len(new) > table.most:
            table.clear()
            new = np.arange(len(word))
            if len(new) > table.most:
                return None
        made, entries = self._marked(buffer, starts[word[new]], size[word[new]], [x[new] for x in own], h[word[new]])
        entry[new[made]] = entries
        new = np.delete(new, made)
        ids, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(new):
            low = starts[word[new]]
            ids, n = self.spaced([data[a:b] for a, b in zip(low.tolist(), (low + size[word[new]]).tolist(), strict=True)])
        kept = short[new]
        place, count = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        of = np.repeat(kept, n)
        entry[new[kept]] = table.add(h[word[new[kept]]], [x[new[kept]] for x in own], size[word[new[kept]]], ids[of], n[kept])
        known = entry >= 0
        place[known], count[known] = table.start[entry[known]], table.count[entry[known]]
        # The ids of words that aren't kept follow those of the table.
        long_ids, all_ids = ids[~of], table.ids
        if len(long_ids):
            all_ids = np.concatenate([table.ids[: table.used], long_ids])
            place[new[~kept]], count[new[~kept]] = table.used + np.cumsum(n[~kept]) - n[~kept], n[~kept]
        return place[code], count[code], all_ids

    def _by_words(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        heads = [t[:k] if (k := t.find(" ")) >= 0 else t for t in texts]
        if missing := [w for w in {*heads} if w not in self.first]:
            if len(self.first) + len(missing) > FIRST_WORDS:
                self.first.clear()
                missing = list({*heads})
            self.first.update(zip(missing, self.whole(missing), strict=True))
        first = [self.first[w] for w in heads]
        rest = [t[len(w) :].encode() for t, w in zip(texts, heads, strict=True)]
        data = b"".join(rest)
        if not data:
            return first
        buffer = np.frombuffer(data + b"\0" * 32, np.uint8)
        starts = np.flatnonzero(buffer[: len(data)] == 32)
        size = np.diff(np.append(starts, len(data)))
        found = self._known(data, buffer, starts, size)
        if found is None:
            return self.whole(texts)
        place, count, ids = found
        ends = np.cumsum(count)
        flat = ids[np.arange(int(ends[-1])) + np.repeat(place - (ends - count), count)].astype("<u4").tobytes()
        # Each text's words begin where its bytes do.
        text_ends = np.searchsorted(starts, np.cumsum([len(r) for r in rest]), side="left")
        cuts = [0, *(4 * np.append(0, ends)[text_ends]).tolist()]
        return [f + flat[a:b] for f, a, b in zip(first, cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts_words:
            return self.whole(texts)
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if not has_runs(t) and not any(a in t for a in self.added)]
        other = sorted(set(range(len(texts))) - set(plain))
        for chosen, by in ((plain, self._by_words), (other, self.whole)):
            if chosen:
                for i, ids in zip(chosen, by([texts[i] for i in chosen]), strict=True):
                    out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and path."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def portions(texts: Iterable[str | None], chars: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters, at least one each; null counts as empty."""
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part
