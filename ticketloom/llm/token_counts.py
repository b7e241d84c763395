"""Operator 1: token counts by heap-and-linked-list byte-pair merging.

A text's count is its number of initial symbols minus the merges that apply; no identifier is made.
The lowest-rank adjacent pair merges first, and of equal ranks the leftmost.

Texts are cut between neighbouring characters that stand side by side in no piece of the vocabulary,
which changes no merge: first before a word's marker and around line feeds (if the vocabulary allows
it; else the text stays whole), then inside the words. Bounded memos keep the counts of recent words.

Defined cases: a null text counts as empty, an empty text has no tokens, characters without a piece
count one token per UTF-8 byte, repeated rows and rows with a null doc_id are counted one by one,
an empty table gives an empty result, and other columns of the table are not read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from ticketloom.llm.batches import Memo, annotate

MARK = "▁"


def remaining_symbols(symbols: list[str], rank_of: dict[str, int]) -> int:
    """How many symbols remain when every possible merge of neighbours has been made, lowest rank first.

    The list of symbols is linked by `after` and `before`; a heap holds `rank * n + position`, so equal
    ranks pop from left to right. An entry counts only while its pair still has that rank.
    """
    n = len(symbols)
    rank = rank_of.get
    ranks = [rank(a + b, -1) for a, b in zip(symbols, symbols[1:])]
    ranks.append(-1)
    heap = [r * n + i for i, r in enumerate(ranks) if r >= 0]
    heapq.heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    merges = 0
    while heap:
        lowest, left = divmod(heapq.heappop(heap), n)
        if ranks[left] != lowest:
            continue  # one of the two has merged since
        right = after[left]
        merges += 1
        symbols[left] = merged = symbols[left] + symbols[right]
        ranks[right] = ranks[left] = -1
        after[left] = follower = after[right]
        if follower < n:
            before[follower] = left
            if (r := rank(merged + symbols[follower], -1)) >= 0:
                ranks[left] = r
                heapq.heappush(heap, r * n + left)
        if (leader := before[left]) >= 0:
            ranks[leader] = r = rank(symbols[leader] + merged, -1)
            if r >= 0:
                heapq.heappush(heap, r * n + leader)
    return n - merges


class PieceCounter:
    """Counts the pieces of texts under a byte-pair model file of the sentencepiece library."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces[model.id_to_piece(i)] = model.get_score(i)
        order = {score: rank for rank, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.normalize = model.normalize
        self.rank_of = {piece: order[score] for piece, score in pieces.items()}
        self.single = {p for p in pieces if len(p) == 1}
        longer = [p for p in pieces if len(p) > 1]
        if any(c not in self.single for p in longer for c in p):
            raise ValueError("a character that merges needs a piece of its own")
        self.joined = {p[i : i + 2] for p in longer for i in range(len(p) - 1)}
        self.memo, self.inner = Memo(self._word), Memo(self._segment)
        if any(pair[1] == MARK and pair[0] != MARK or "\n" in pair for pair in self.joined):
            self.words = lambda text: [text] if text else []
        else:
            self.words = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall

    def _segment(self, segment: str) -> int:
        symbols = list(segment)
        if self.single.issuperset(symbols):
            return remaining_symbols(symbols, self.rank_of)
        in_bytes = sum(len(c.encode()) - 1 for c in symbols if c not in self.single)
        return in_bytes + remaining_symbols(symbols, self.rank_of)

    def _word(self, word: str) -> int:
        """The sum over the stretches between neighbours that no piece holds side by side."""
        joined = self.joined
        cuts = [i for i, (a, b) in enumerate(zip(word, word[1:]), 1) if a + b not in joined]
        if not cuts:
            return self.inner[word]
        return sum(self.inner[word[i:j]] for i, j in zip([0, *cuts], [*cuts, len(word)]))

    def count(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.words(self.normalize(text))))


@lru_cache(maxsize=2)
def piece_counter(model_file: str) -> PieceCounter:
    """One counter per Python worker, kept between its tasks."""
    return PieceCounter(model_file)


def token_counts(documents: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, and over_limit: more than `limit` tokens. One pass, no shuffle."""

    def prepare():
        counter = piece_counter(model_file)

        def compute(texts):
            tokens = [counter.count(t) for t in texts]
            return [[len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]]

        return compute

    return annotate(documents, ["doc_id"], "n_bytes LONG, n_tokens LONG, over_limit BOOLEAN", prepare)
