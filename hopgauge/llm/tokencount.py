"""Exact token counts by a compiled finite-state transducer.

A byte-level BPE tokenizer splits a text by a fixed pattern into parts and merges bytes within each part. Both steps are one
deterministic transducer over the text's characters, whose transitions are annotated with the change of the token count: the sum
of the annotations along a text is the number of tokens that it would have if it ended there.

States. Within a part, the merges are followed by threads: one for each end of an earlier token from which a further token may
still be growing, with that token and the count there. A byte moves every thread down the trie of the vocabulary; where a thread
completes a token that the tokenizer would keep apart from the one before (tested with the library's own merges on just this
pair), the part so far ends with that token. The set of threads is the state, so the subsets are determinized as they are met,
and states are shared by all words that agree in them. Around that, a state knows the kind of part (letters, digits, signs,
white space, contractions begun), a last white space whose part depends on the next character, and how far the text is into a
special token's string. Tables of states are bounded (STATES) and are built anew when full.

Parallelism. Texts are cut into chunks of equal length; all chunks of a batch run through the table in step, by array operations.
Where a chunk starts, its state is unknown, so a chunk stands for a map from states to (state, count): behind its first white
space that follows other characters the map is constant, since all states agree there; the characters before are kept for
whatever state comes in. Such maps compose associatively, and a prefix scan over a text's chunks (rounds with doubling distance)
gives each chunk its incoming state.

Defined results: a null text counts as empty; null or repeated doc_ids are counted row by row; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.llm.common import table

#: States that the table of transitions holds, by DENSE characters; it is built anew when full. Transitions of further states and
#: characters, which one slice may still need, are kept one by one.
STATES, DENSE = 1 << 17, 192
#: Characters of a chunk.
CHUNK = 256
#: Chunks that an open map takes in at most; longer runs without white space are carried on in strides of as many.
FURTHEST = 8
#: Characters that are counted at once.
SLICE = 1 << 21
LETTER, DIGIT, SIGN, SPACE = "LNPS"
#: Endings that the split pattern keeps with an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Merges:
    """Threads over the trie of a byte-level BPE vocabulary. A state: (((node, token before, count), ...), count).

    Counts in the threads are relative to the state's own, so that equal situations are equal states.
    """

    def __init__(self, model, vocabulary: dict[str, int], alphabet: dict[int, str]) -> None:
        self.model, self.alphabet = model, alphabet
        back = {c: b for b, c in alphabet.items()}
        self.child: dict[int, int] = {}  # node * 256 + byte: node
        self.token: dict[int, int] = {}
        self.name: dict[int, str] = {}
        self.inner: set[int] = set()
        nodes = 1
        for word, number in vocabulary.items():
            node = 0
            if not all(c in back for c in word):
                continue  # special tokens are no merges
            for c in word:
                key = node << 8 | back[c]
                self.inner.add(node)
                if (node := self.child.get(key, 0)) == 0:
                    node = self.child[key] = nodes
                    nodes += 1
            self.token[node], self.name[number] = number, word
        self.apart: dict[tuple[int, int], bool] = {}
        self.start = ((0, -1, 0),)

    def separate(self, one: int, two: int) -> bool:
        """Whether the tokenizer gives the bytes of token one (-1: nothing) and token two just these tokens."""
        if (known := self.apart.get((one, two))) is None:
            got = [t.id for t in self.model.tokenize(self.name.get(one, "") + self.name[two])]
            known = self.apart[(one, two)] = got == ([two] if one < 0 else [one, two])
        return known

    def step(self, threads: tuple, byte: int) -> tuple[tuple, int]:
        """Threads after one more byte, and the change of the count."""
        moved, end = [], None
        for node, before, count in threads:
            if to := self.child.get(node << 8 | byte):
                moved.append((to, before, count))
                if end is None and (token := self.token.get(to)) is not None and self.separate(before, token):
                    end = (token, count + 1)
        if end is None:
            raise ValueError("the vocabulary lacks a byte")
        token, change = end
        return (*((n, b, c - change) for n, b, c in moved if n in self.inner), (0, token, 0)), change

    def run(self, threads: tuple, text: str) -> tuple[tuple, int]:
        total = 0
        for byte in text.encode("utf-8", "surrogatepass"):
            threads, change = self.step(threads, byte)
            total += change
        return threads, total


class Transducer:
    """Transitions (next state, change of the count) by state and character, built when first needed.

    A state: (kind, threads, last, since): last is a white space run's last character or the letters of an ending begun, since the
    progress in a special string, (characters matched, change of the count since it began).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        self.split = whole.pre_tokenizer
        codes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        alphabet = {b: codes.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        for c in range(0x80, 0x800):  # two-byte characters hold all other bytes but those that start longer ones
            alphabet |= dict(zip(chr(c).encode(), codes.pre_tokenize_str(chr(c))[0][0], strict=True))
        for c in (0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000, 0xE000, 0xF000, 0x10000, 0x40000, 0x80000, 0xC0000, 0x100000):
            alphabet |= dict(zip(chr(c).encode(), codes.pre_tokenize_str(chr(c))[0][0], strict=True))
        self.special = [t.content for t in whole.get_added_tokens_decoder().values()]
        if any(len(s) < 2 or s[0] in s[1:] or any(c.isspace() for c in s) for s in self.special) or len({s[0] for s in self.special}) < len(self.special):
            raise ValueError("special tokens that overlap or hold white space")
        self.merges = Merges(whole.model, {w: i for w, i in whole.get_vocab(with_added_tokens=False).items()}, alphabet)
        self.kinds: dict[str, str] = {}
        self.symbol = np.full(0x110000, -1, np.int32)
        self.chars: list[str] = []
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = [()]  # number 0 is no state
        self.next = np.zeros((STATES, DENSE), np.int32)  # memory is taken as rows are filled
        self.change = np.zeros((STATES, DENSE), np.int8)
        self.further: dict[tuple[int, int], tuple[int, int]] = {}
        if len(self.merges.apart) > 8 * STATES:
            self.merges.apart.clear()
        self.fresh = self.id_of(("", self.merges.start, "", None))

    def id_of(self, state: tuple) -> int:
        if (found := self.ids.get(state)) is None:
            found = self.ids[state] = len(self.states)
            self.states.append(state)
        return found

    def kind(self, char: str) -> str:
        """The class of a character in the split pattern, found by the tokenizer's own split."""
        if (known := self.kinds.get(char)) is None:
            joins = [k for k, before in ((LETTER, "a"), (DIGIT, "1"), (SIGN, "!")) if len(self.split.pre_tokenize_str(before + char)) == 1]
            known = self.kinds[char] = joins[0] if joins else SPACE
        return known

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        found = self.symbol[codes]
        if (found < 0).any():
            for code in np.unique(codes[found < 0]).tolist():
                self.symbol[code] = len(self.chars)
                self.chars.append(chr(code))
            found = self.symbol[codes]
        return found

    def _part(self, state: tuple, char: str) -> tuple[str, tuple, str, int]:
        """The next kind, threads and last, and the change, without regard to special strings."""
        kind, threads, last, _ = state
        run, start, new = self.merges.run, self.merges.start, self.kind(char)
        if kind == SPACE:
            if new == SPACE:
                whole = run(threads, last)[0]
                return SPACE, whole, char, run(whole, char)[1]
            # the run ends before its last character, which joins the next part if it is a blank and is a part of its own if not
            change = -run(threads, last)[1]
            if last == " ":
                to, more = run(start, " " + char)
                return new, to, "", change + more
            change += run(start, last)[1]
            kind, threads, last = "", start, ""
            to, more = run(start, char)
            return ("'" if char == "'" else new), to, "", change + more
        if new == SPACE:
            return SPACE, start, char, run(start, char)[1]
        if kind == "'" and (ending := last + char) and any(e.startswith(ending) for e in ENDINGS):
            if ending in ENDINGS:  # the apostrophe and its ending are one part, and the next starts anew
                return "", start, "", run(start, "'" + ending)[1] - run(start, "'")[1] - (run(start, last)[1] if last else 0)
            to, change = run(start, char)
            return "'", to, ending, change
        if kind == "'":
            kind = LETTER if last else SIGN
        if kind == new:
            to, change = run(threads, char)
            return new, to, "", change
        to, change = run(start, char)
        return ("'" if char == "'" else new), to, "", change

    def transition(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state and change of the count; enters them."""
        if known := self.further.get((state, symbol)):
            return known
        old, char = self.states[state], self.chars[symbol]
        kind, threads, last, change = self._part(old, char)
        since = old[3]
        at, gone = since or ("", 0)
        if since and any(s.startswith(at + char) for s in self.special):
            if at + char in self.special:  # what was counted since it began is one token
                kind, threads, last, since, change = "", self.merges.start, "", None, 1 - gone
            else:
                since = (at + char, gone + change)
        else:
            since = (char, change) if any(s[0] == char for s in self.special) else None
        to = self.id_of((kind, threads, last, since))
        if state < STATES and symbol < DENSE and -128 <= change < 128:
            self.next[state, symbol], self.change[state, symbol] = to, change
        else:
            self.further[(state, symbol)] = (to, change)
        return to, change

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes, a symbol for each state."""
        dense = len(self.states) <= STATES and len(self.chars) <= DENSE and not self.further
        inside = slice(None) if dense else (states < STATES) & (symbols < DENSE)
        to, change = np.zeros_like(states), np.zeros(len(states), np.int64)
        to[inside], change[inside] = self.next[states[inside], symbols[inside]], self.change[states[inside], symbols[inside]]
        if len(missing := np.flatnonzero(to == 0)):
            pairs, which = np.unique(states[missing].astype(np.int64) << 32 | symbols[missing], return_inverse=True)
            found = np.array([self.transition(p >> 32, p & 0xFFFFFFFF) for p in pairs.tolist()])
            to[missing], change[missing] = found[which, 0], found[which, 1]
        return to, change

    def run(self, states: np.ndarray, symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All lanes in step: lane k reads symbols[first[k]:last[k]] from states[k]. Final states and sums of changes."""
        order = np.argsort(first - last, kind="stable")  # the longest first, so that those at work are a prefix
        at, left = first[order], (last - first)[order]
        state, total = states[order].copy(), np.zeros(len(order), np.int64)
        for k in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -k, "left"))  # lanes with more than k symbols
            state[:n], change = self.advance(state[:n], symbols[at[:n] + k])
            total[:n] += change
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def counts(self, texts: list[str]) -> np.ndarray:
        """Numbers of tokens."""
        if len(self.states) > STATES:
            self.clear()
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if len(codes) == 0:
            return np.zeros(len(texts), np.int64)
        symbols = self.symbols(codes)
        ends = np.cumsum(lengths)
        # chunks: text, first and last character
        each = -(-lengths // CHUNK)
        text = np.repeat(np.arange(len(texts)), each)
        number = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        first = (ends - lengths)[text] + number * CHUNK
        last = np.minimum(first + CHUNK, ends[text])
        # a chunk's map is constant from its first reset on: white space after something else; a text's start is one, too
        space = np.array([self.kind(c) == SPACE for c in self.chars])[symbols]
        reset = np.flatnonzero(space & ~np.r_[True, space[:-1]])
        near = np.searchsorted(reset, first)
        start = np.where(near < len(reset), reset[np.minimum(near, max(len(reset) - 1, 0))] if len(reset) else last, last)
        start = np.where(number == 0, first, np.minimum(start, last))
        known = (number == 0) | (start < last)
        end, inner = self.run(np.full(len(text), self.fresh), symbols, np.where(known, start, last), last)
        # prefix scan: in each round an open map is composed with that of ``distance`` chunks before: a constant one gives its end
        # state, an open one (while distances double) the characters that it reads. A text's first chunk is never open.
        begin, distance = first.copy(), 1
        while not known.all():
            open_ = np.flatnonzero(~known)
            ready = known[open_ - distance]
            done, wait = open_[ready], open_[~ready]
            end[done] = self.run(end[done - distance], symbols, begin[done], last[done])[0]
            if distance < FURTHEST:
                begin[wait] = begin[wait - distance]
                distance *= 2
            known[done] = True
        incoming = np.where(number == 0, self.fresh, np.r_[0, end[:-1]])
        heads = self.run(incoming, symbols, first, np.where(number == 0, first, start))[1]
        return np.bincount(text, weights=inner + heads, minlength=len(texts)).astype(np.int64)


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each Python worker and tokenizer file."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens)."""
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            row = 0
            texts: list[str] = []
            size = 0
            for value in batch.column(1):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= SLICE or row + len(texts) == batch.num_rows:
                    n = machine.counts(texts)
                    n_bytes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])
                    row, texts, size = row + len(texts), [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
