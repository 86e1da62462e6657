"""A subword tokenizer as a deterministic finite-state transducer that emits token counts.

Byte-pair merging by scores, as the sentencepiece library does it, has two properties that this rests on:

* The tokens of a text up to one of its token borders are the tokens of that part alone. So the tokens
  of each prefix are those of a shorter prefix and one last token.
* Tokens u and t stand beside each other just if merging the two alone keeps their border: merges left
  and right of a border don't depend on each other, and only the outermost symbols could join over it.

So reading a character, the last token of the longer prefix is the one vocabulary entry that ends there
and may follow the last token of the prefix before it. What this takes is finite and is the state: for
each beginning of an entry that the text ends with, the last token before it and how many fewer tokens
there were then; and the last token now. A transition is annotated with the tokens that it adds, which
may be less than none. A text's count is the sum along its path.

States and transitions are compiled when a text first needs them, and started anew beyond a bound.
Texts are read as chunks, many at once: each chunk has a map from the state at its start to the state
at its end and a count, and maps compose by a prefix scan. A chunk that starts at a space after a
word has one map for all states, as no entry reaches over such a place; another starts from the state
that its preceding characters lead to, and is read again where the scan finds that it was another.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    import numpy as np

#: The character that stands for a space.
SPACE = "▁"
#: Characters of a chunk; of one portion of texts; read before a chunk that starts within a word.
CHUNK, PORTION, WARM_UP = 128, 400_000, 32
#: States after which a portion starts with none.
MOST_STATES = 300_000
#: No token: all entries may follow.
ANY = -1
#: Bits of a code point; what is added to an emission when it is stored beside a state.
CODE_BITS, SHIFTED, EMIT_BITS = 21, 1 << 15, 16
PROBES = ["a  b\tc\n\nd ", " The  quick brown fox's 12345 <s>", "naïve Ünïcode 日本語 ▁x \U0001f44d\U0001f3fd", "\x00\x01", ""]


class Transducer:
    """counts(texts): tokens of each text, as the library gives them without begin and end tokens."""

    def __init__(self, path: str, most_states: int = MOST_STATES) -> None:
        import numpy as np
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most_states = most_states
        ids = range(library.get_piece_size())
        #: Entries that merges can make, with their scores.
        self.score = {library.id_to_piece(i): library.get_score(i) for i in ids if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))}
        self.token_of: dict[str, int] = {}
        self.tokens: list[str] = []
        self.steps: list[tuple[bool, list[tuple[float, str, str]]]] = []
        self.follows: dict[tuple[int, int], bool] = {}
        #: Pairs of characters that stand beside each other in some entry: between others no merge happens.
        self.beside = {(a, b) for p in self.score for a, b in zip(p, p[1:], strict=False)}
        self.spaces_part = not any(b == SPACE != a for a, b in self.beside)
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[int] = [ANY]
        for piece in self.score:
            at = 0
            for ch in piece:
                if ch not in self.children[at]:
                    self.children[at][ch] = len(self.children)
                    self.children.append({})
                    self.entry.append(ANY)
                at = self.children[at][ch]
            self.entry[at] = self._token(piece)
        self.np = np
        self._anew()
        if any(n != len(ids) for n, ids in zip(self.counts(PROBES), library.encode(PROBES, num_threads=1), strict=True)):
            raise ValueError(f"{path} isn't a byte-pair model with byte fallback, a leading space and no normalisation")

    def _token(self, text: str) -> int:
        if text not in self.token_of:
            self.token_of[text] = len(self.tokens)
            self.tokens.append(text)
            self.steps.append((False, []))
        return self.token_of[text]

    def _merges(self, token: int) -> list[tuple[float, str, str]] | None:
        """The merges that make a token out of its characters: score, and the first and last symbol after each. None: they make others."""
        done, found = self.steps[token]
        if not done:
            parts, found = list(self.tokens[token]), []
            while len(parts) > 1:
                joined = [self.score.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
                best = max((s for s in joined if s is not None), default=None)
                if best is None:
                    found = None
                    break
                k = joined.index(best)  # of equal scores the leftmost
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                found.append((best, parts[0], parts[-1]))
            self.steps[token] = True, found
        return found

    def _may_follow(self, u: int, t: int) -> bool:
        """Whether merging u and t as one text keeps the border between them."""
        key = u, t
        if key not in self.follows:
            left, right = (self._merges(u) if u != ANY else []), self._merges(t)
            ok = right is not None
            if ok and u != ANY:
                a, b, i, j = self.tokens[u][-1], self.tokens[t][0], 0, 0
                while True:
                    over, own, next_ = self.score.get(a + b), left[i][0] if i < len(left) else None, right[j][0] if j < len(right) else None
                    # The best score first; of equal ones the leftmost.
                    if own is not None and (over is None or own >= over) and (next_ is None or own >= next_):
                        a, i = left[i][2], i + 1
                    elif over is not None and (next_ is None or over >= next_):
                        ok = False
                        break
                    elif next_ is not None:
                        b, j = right[j][1], j + 1
                    else:
                        break
            self.follows[key] = ok
        return self.follows[key]

    def _anew(self) -> None:
        np = self.np
        self.state_of: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.follows.clear()
        self.keys, self.values, self.used = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64), 0
        #: Before a text, and at a space after a word.
        self.start = self._state([ANY])

    def _state(self, parts: list[int]) -> int:
        """parts: the last token, and (trie node, last token before it, tokens fewer) for each beginning."""
        key = array("i", parts).tobytes()
        if key not in self.state_of:
            self.state_of[key] = len(self.states)
            self.states.append(key)
        return self.state_of[key]

    def _transition(self, state: int, ch: str) -> tuple[int, int]:
        """The next state, and the tokens that the character adds."""
        parts = array("i", self.states[state])
        last = parts[0]
        if last != ANY and (self.tokens[last][-1], ch) not in self.beside:
            last = ANY
        token, total, going = ANY, 0, []
        for k in range(1, len(parts), 3):
            node = self.children[parts[k]].get(ch)
            if node is not None:
                t = self.entry[node]
                if t != ANY and self._may_follow(parts[k + 1], t):
                    token, total = t, parts[k + 2] + 1
                if self.children[node]:
                    going += [node, parts[k + 1], parts[k + 2]]
        node = self.children[0].get(ch)
        if node is not None and self.children[node]:
            going += [node, last, 0]
        if token == ANY:  # the character alone, as its bytes if it isn't an entry
            alone = ch in self.score
            token, total = self._token(ch), 1 if alone else len(ch.encode("utf-8", "surrogatepass"))
        for k in range(2, len(going), 3):
            going[k] -= total
        return self._state([token, *going]), total

    def _place(self, keys: np.ndarray) -> np.ndarray:
        np = self.np
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        np = self.np
        if 2 * (self.used + len(keys)) > len(self.keys):
            there = self.keys >= 0
            keys, values = np.concatenate([self.keys[there], keys]), np.concatenate([self.values[there], values])
            size = 1 << (4 * len(keys) - 1).bit_length()
            self.keys, self.values, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of those that want one place, the last gets it
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & (len(self.keys) - 1)
        self.used += len(keys)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys; transitions that aren't there yet are compiled."""
        np = self.np
        at = self._place(keys)
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            wrong = wrong[self.keys[at[wrong]] >= 0]
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        out = self.values[at]
        new = np.flatnonzero(self.keys[at] != keys)
        if len(new):
            missing, which = np.unique(keys[new], return_inverse=True)
            made = [self._transition(k >> CODE_BITS, chr(k & (1 << CODE_BITS) - 1)) for k in missing.tolist()]
            values = np.array([state << EMIT_BITS | emit + SHIFTED for state, emit in made], np.int64)
            self._add(missing, values)
            out[new] = values[which]
        return out

    def _read(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All chunks a character at a time: the states at their ends, and their counts."""
        np = self.np
        order = np.argsort(-size, kind="stable")
        begin, state, count = begin[order], state[order].astype(np.int64), np.zeros(len(order), np.int64)
        longest = int(size.max(initial=0))
        for k, m in enumerate(np.searchsorted(-size[order], -np.arange(longest), side="left").tolist()):
            value = self._found(state[:m] << CODE_BITS | codes[begin[:m] + k])
            state[:m] = value >> EMIT_BITS
            count[:m] += (value & (1 << EMIT_BITS) - 1) - SHIFTED
        ends, counts = np.empty_like(state), np.empty_like(count)
        ends[order], counts[order] = state, count
        return ends, counts

    def _chunks(self, codes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of chunks, and which of them start at a space after a word. borders: where texts begin, and the end."""
        np = self.np
        each = -(-np.diff(borders) // CHUNK)
        text = np.repeat(np.arange(len(each)), each)
        first = np.cumsum(each) - each
        begin = borders[text] + (np.arange(len(text)) - first[text]) * CHUNK
        inner = np.ones(len(begin), bool)
        inner[first[each > 0]] = False
        is_space = codes == ord(SPACE)
        parts = np.append(np.flatnonzero(is_space[1:] & ~is_space[:-1]) + 1 if self.spaces_part and len(codes) else np.zeros(0, np.int64), len(codes))
        next_ = parts[np.searchsorted(parts, begin)]
        free = inner & (next_ < np.minimum(begin + CHUNK, borders[text + 1]))
        return np.where(free, next_, begin), free

    def _portion(self, codes: np.ndarray, borders: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts that stand one after another: the count of each, and the state at its end; states: at their starts."""
        np = self.np
        begin, free = self._chunks(codes, borders)
        text = np.searchsorted(borders, begin, side="right") - 1
        head = np.ones(len(begin), bool)
        head[1:] = text[1:] != text[:-1]
        size = np.diff(np.append(begin, len(codes)))
        state = np.where(head, states[text], self.start)
        warm = np.flatnonzero(~free & ~head)
        low = np.maximum(begin[warm] - WARM_UP, borders[text[warm]])
        state[warm], _ = self._read(codes, low, begin[warm] - low, np.full(len(warm), self.start, np.int64))
        ends, counts = self._read(codes, begin, size, state)
        while len(wrong := np.flatnonzero(~head[1:] & ~free[1:] & (ends[:-1] != state[1:])) + 1):
            state[wrong] = ends[wrong - 1]
            ends[wrong], counts[wrong] = self._read(codes, begin[wrong], size[wrong], state[wrong])
        counts = scanned(head, counts)
        out, last = np.zeros(len(borders) - 1, np.int64), states.astype(np.int64)
        tail = np.append(head[1:], True)[: len(head)]
        out[text[tail]], last[text[tail]] = counts[tail], ends[tail]
        return out, last

    def counts(self, texts: Sequence[str]) -> list[int]:
        np = self.np
        out, waiting, length = [], [], 0

        def now() -> list[int]:
            if len(self.states) > self.most_states:
                self._anew()
            codes = np.frombuffer("".join(waiting).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            borders = np.cumsum([0, *map(len, waiting)])
            return self._portion(codes, borders, np.full(len(waiting), self.start, np.int64))[0].tolist()

        for text in texts:
            if len(text) > PORTION:
                out += now() if waiting else []
                waiting, length = [], 0
                out.append(self._long(text))
                continue
            waiting.append(SPACE + text.replace(" ", SPACE) if text else "")
            length += len(text)
            if length > PORTION:
                out += now()
                waiting, length = [], 0
        return out + (now() if waiting else [])

    def _long(self, text: str) -> int:
        """A text by portions, each from the state where the one before it ended."""
        np = self.np
        total, key = 0, array("i", [ANY]).tobytes()
        for k in range(0, len(text), PORTION):
            if len(self.states) > self.most_states:
                self._anew()
            part = (SPACE if k == 0 else "") + text[k : k + PORTION].replace(" ", SPACE)
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
            count, end = self._portion(codes, np.array([0, len(codes)]), np.array([self._state(array("i", key).tolist())]))
            total, key = total + int(count[0]), self.states[int(end[0])]
        return total


def scanned(head: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts from each text's first chunk up to each chunk: maps whose states meet, composed over twice the distance each round."""
    import numpy as np

    counts, since, far = counts.copy(), head.copy(), 1
    while not since.all():
        more = np.flatnonzero(~since[far:]) + far
        counts[more], since[more] = counts[more] + counts[more - far], since[more - far]
        far *= 2
    return counts


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each worker process and path."""
    if path not in _TRANSDUCERS:
        _TRANSDUCERS[path] = Transducer(path)
    return _TRANSDUCERS[path]
