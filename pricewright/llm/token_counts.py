"""Token counts of a piece vocabulary by rank-synchronous array merging.

The piece vocabulary merges neighbouring symbols whose joint piece has the best
score, the leftmost first among equals, and splits what is left unknown into
bytes.  Here a batch of pre-tokens is held as one ragged numpy array of symbols.
In each round every pre-token applies its lowest-rank pair at once, and what
survives is counted.

No piece of the vocabulary has a space mark after another character, so merges
never cross from a character to a following space; a text is therefore cut into
pre-tokens (a run of spaces with the characters up to the next space), each
distinct pre-token is merged once, and its count is remembered.

Null and empty texts have no tokens.  Pre-tokens of very many symbols, of which
each round would merge but a few, are merged pair by pair from a heap instead, by
the same ranks; nothing is truncated.  Every row is counted, repeated ones each
and those with a null id, too; an empty table gives no rows.  Other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pricewright.llm.shared import byte_texts, session_of

SPACE = "▁"
#: Distinct pre-tokens whose counts a task remembers before it starts anew.
REMEMBERED = 300_000
#: A pre-token of more symbols is merged pair by pair from a heap, and not remembered.
LONG = 200
NEVER = np.int64(1 << 40)
_PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceCounter:
    """Counts the tokens of texts as the vocabulary in ``model_file`` gives them."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space mark after another character")
        self.bytes_known = any(model.is_byte(i) for i in range(n))
        scores = np.array([model.get_score(i) for i in plain])
        # Equal scores share a rank: among them the leftmost pair goes first.
        ranks = np.unique(-scores, return_inverse=True)[1]
        rank = dict(zip(plain, ranks.tolist(), strict=True))
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        codes, joined, order = [], [], []
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                left, right = pieces.get(piece[:k]), pieces.get(piece[k:])
                if left is not None and right is not None:
                    codes.append((left << 32) | right)
                    joined.append(i)
                    order.append(rank[i])
        by = np.argsort(np.array(codes, np.int64))
        self.codes = np.append(np.array(codes, np.int64)[by], np.int64(1 << 62))
        self.joined = np.append(np.array(joined, np.int64)[by], -1)
        self.order = np.append(np.array(order, np.int64)[by], NEVER)
        self.remembered: dict[str, int] = {}

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and joint symbol by a pair's code, for long pre-tokens."""
        return dict(zip(self.codes[:-1].tolist(), zip(self.order[:-1].tolist(), self.joined[:-1].tolist(), strict=True), strict=True))

    def count_long(self, word: str) -> int:
        """Surviving symbols of one long pre-token, in time that grows with its length times its logarithm.

        The lowest-rank pair, the leftmost among equals, is taken from a heap; a
        merge puts at most two new pairs into it, and pairs that are gone are
        skipped when they come up.
        """
        word = word if word.startswith(SPACE) else SPACE + word
        found = self.single[np.frombuffer(word.encode("utf-32-le"), np.uint32)].astype(np.int64)
        count = found.size
        if self.bytes_known:
            count += sum(len(word[i].encode()) - 1 for i in np.flatnonzero(found < 0).tolist())
        rank, joint = self._pairs(found[:-1], found[1:])
        at = np.flatnonzero(rank != NEVER)
        heap = list(zip(rank[at].tolist(), at.tolist(), found[at].tolist(), found[at + 1].tolist(), joint[at].tolist(), strict=True))
        heapq.heapify(heap)
        symbols, n, pairs = found.tolist(), found.size, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if symbols[k] >= 0 and (new := pairs.get((joined << 32) | symbols[k])):
                    heapq.heappush(heap, (new[0], i, joined, symbols[k], new[1]))
            h = before[i]
            if h >= 0 and symbols[h] >= 0 and (new := pairs.get((symbols[h] << 32) | joined)):
                heapq.heappush(heap, (new[0], h, symbols[h], joined, new[1]))
        return count

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joint symbol of each pair; NEVER where there is none."""
        code = (left << 32) | right
        code[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.codes, code)
        hit = self.codes[at] == code
        return np.where(hit, self.order[at], NEVER), np.where(hit, self.joined[at], -1)

    def count_pre_tokens(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token; a missing first mark is put before it."""
        words = [w if w.startswith(SPACE) else SPACE + w for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if not lengths.sum():
            return np.zeros(len(words), np.int64)
        chars = "".join(words)
        symbols = self.single[np.frombuffer(chars.encode("utf-32-le"), np.uint32)].astype(np.int64)
        # What no piece covers becomes one token a byte, and joins with nothing.
        lost = np.flatnonzero(symbols < 0)
        of = np.repeat(np.arange(len(words)), lengths)
        extra = np.zeros(len(words), np.int64)
        if lost.size and self.bytes_known:
            np.add.at(extra, of[lost], np.fromiter((len(chars[i].encode()) - 1 for i in lost), np.int64, lost.size))
        counts = np.zeros(len(words), np.int64)
        rank, joint = np.full(symbols.size, NEVER), np.full(symbols.size, -1, np.int64)
        inner = np.flatnonzero(of[1:] == of[:-1])
        rank[inner], joint[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        while symbols.size:
            n = symbols.size
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            sizes = np.diff(np.r_[starts, n])
            best = np.minimum.reduceat(rank, starts)
            done = best == NEVER
            if done.any():
                counts[of[starts[done]]] = sizes[done]
                going = ~np.repeat(done, sizes)
                symbols, of, rank, joint = symbols[going], of[going], rank[going], joint[going]
                best, sizes = best[~done], sizes[~done]
                n = symbols.size
                if not n:
                    break
            merge = self._chosen(symbols, of, rank, joint, np.repeat(best, sizes))
            symbols[merge] = joint[merge]
            stay = np.ones(n, bool)
            stay[merge + 1] = False
            place = np.cumsum(stay) - 1
            symbols, of, rank, joint = symbols[stay], of[stay], rank[stay], joint[stay]
            # Only pairs with a new symbol have to be looked up again.
            fresh = place[merge]
            fresh = np.unique(np.r_[fresh, np.maximum(fresh - 1, 0)])
            rank[fresh], joint[fresh] = NEVER, -1
            fresh = fresh[fresh + 1 < symbols.size]
            fresh = fresh[of[fresh] == of[fresh + 1]]
            rank[fresh], joint[fresh] = self._pairs(symbols[fresh], symbols[fresh + 1])
        return counts + extra

    def _chosen(self, symbols: np.ndarray, of: np.ndarray, rank: np.ndarray, joint: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Positions whose pair merges in this round.

        All of a pre-token's pairs of the lowest rank go together, from the
        left without overlap, up to the first whose joint symbol would make a
        pair of that rank or lower: one at a time the next round would go on
        there, too.
        """
        at = np.flatnonzero(rank == best)
        # Without overlap: in a chain of neighbours every other one, from its left end.
        chain = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        place = np.arange(at.size) - np.repeat(chain, np.diff(np.r_[chain, at.size]))
        at = at[place % 2 == 0]
        n, doc, low = symbols.size, of[at], best[at]
        before = np.maximum(at - 1, 0)
        left = symbols[before]
        tied = np.r_[False, (np.diff(at) == 2) & (doc[1:] == doc[:-1])]
        left[tied] = joint[at[np.flatnonzero(tied) - 1]]
        left[(at == 0) | (of[before] != doc)] = -1
        after = np.minimum(at + 2, n - 1)
        right = symbols[after]
        right[(at + 2 >= n) | (of[after] != doc)] = -1
        new = joint[at]
        again = (self._pairs(left, new)[0] <= low) | (self._pairs(new, right)[0] <= low)
        # The number of such places to the left, within the pre-token.
        seen = np.cumsum(again) - again
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        seen = seen - np.repeat(seen[first], np.diff(np.r_[first, at.size]))
        return at[seen == 0]

    def counts(self, texts: Iterable[bytes]) -> list[int]:
        """Tokens of each text: a mark is put before it and spaces become marks."""
        cut: list[list[str]] = []
        for t in texts:
            cut.append(_pre_tokens(t.decode("utf-8", "replace")) if t else [])
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        known = self.remembered
        new = sorted({w for words in cut for w in words if w not in known}, key=len)
        long = {w: self.count_long(w) for w in new if len(w) > LONG}
        new = new[: len(new) - len(long)]
        for k in range(0, len(new), 1 << 15):
            part = new[k : k + (1 << 15)]
            known.update(zip(part, self.count_pre_tokens(part).tolist(), strict=True))
        if long:
            return [sum(long[w] if w in long else known[w] for w in words) for words in cut]
        return [sum(map(known.__getitem__, words)) for words in cut]


@functools.lru_cache(maxsize=1)
def piece_counter(model_file: str) -> PieceCounter:
    """One counter a Python worker, which goes on remembering from task to task."""
    return PieceCounter(model_file)


def _pre_tokens(text: str) -> list[str]:
    """The text with its leading mark, cut before each run of marks.

    A pre-token that begins with one mark stands without it.
    """
    if SPACE in text or "  " in text or text[0] == " ":
        return _PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))
    words = text.split(" ")
    if not words[-1]:  # a space at the end is a pre-token of its own
        words[-1] = SPACE
    return words


def counted(docs: DataFrame, model_file: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: bytes, tokens, and whether it has more than ``limit``."""
    session_of(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_file)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = byte_texts(part.column(1))
                tokens = pa.array(counter.counts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), tokens, pa.array([n > limit for n in tokens.to_pylist()], pa.bool_())],
                    names=[key, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
