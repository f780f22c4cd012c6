"""Token counts of a unigram tokenizer, without building its tokens.

Texts are cut where no vocabulary piece can cross (before a run of word marks), and each distinct stretch is counted once.
An Aho-Corasick automaton lists all vocabulary pieces in the new stretches of a slice at once; then a Viterbi pass that
carries only the best score and the number of tokens goes through them position by position, all stretches side by side.

The vocabulary is that of a sentencepiece model. Control, unknown and byte pieces are no text and stay out of the
automaton, so a literal "<s>" is three characters. A BPE model has merge ranks instead of log probabilities; its pieces come
in order of falling frequency, so Zipf's law estimates them: the k-th of n has probability 1 / (k H(n)).

Tie rules of the tokenizer: among paths of equal score into a position the one whose last piece starts first (the longest
piece) stays; a character that no single-character piece covers may also be unknown, with a score of ten under the
lowest of the vocabulary, considered after all pieces; an unknown character counts one token for each UTF-8 byte.

The vocabulary (its path is a parameter) is read by the driver and broadcast; texts are not shuffled. Memory of a task is
a slice of texts, the matches in its new stretches, and a cache of at most CACHE stretches.

Defined results: null and empty texts have no tokens and score 0; a stretch may be of any length; equal rows give equal
results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lumaframe.llm.common import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 300_000
#: Longer stretches go through a plain loop each, so that one of them does not stretch the others' pass.
LONG = 256


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, log probability) of a sentencepiece model file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    rank = np.arange(1, len(pieces) + 1)
    return [*zip(pieces, (-np.log(rank) - np.log((1 / rank).sum())).tolist(), strict=True)]


class Counter:
    """Counts the tokens of texts under (piece, score) pairs; unknown characters fall back to a token for each byte."""

    def __init__(self, pieces: list[tuple[str, float]], cache: int = CACHE):
        names = {p for p, _ in pieces}
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece continues over a word mark")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.scores = np.array([s for _, s in pieces])
        self.lengths = np.array([len(p) for p, _ in pieces])
        self.singles = {p for p in names if len(p) == 1}
        for k, (piece, _) in enumerate(pieces):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.limit = cache
        self.cut = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known: dict[str, tuple[int, float]] = {}

    def stretches(self, text: str) -> list[str]:
        """Spaces become word marks; one is put in front unless the text starts with one."""
        marked = text.replace(" ", MARK)
        if marked[0] != MARK:
            marked = MARK + marked
        if MARK + MARK in marked:
            return self.cut(marked)
        return [MARK + w for w in marked[1:].split(MARK)]

    def one(self, stretch: str) -> tuple[int, float]:
        """(tokens, score) by a plain loop."""
        n = len(stretch)
        best, count = [0.0] + [-np.inf] * n, [0] * (n + 1)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, k in self.automaton.iter(stretch):
            ending[end].append((int(self.lengths[k]), float(self.scores[k])))
        for end in range(n):
            found = sorted(ending[end], reverse=True)
            c = stretch[end]
            if not found or found[-1][0] != 1:
                found.append((1, self.unknown))
                extra = len(c.encode("utf-8", "surrogatepass"))
            else:
                extra = 1
            for length, score in found:
                start = end + 1 - length
                if best[start] + score > best[end + 1]:
                    best[end + 1] = best[start] + score
                    count[end + 1] = count[start] + (extra if length == 1 else 1)
        return count[n], best[n]

    def many(self, stretches: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of each stretch, all of them side by side."""
        text = "".join(stretches)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        first = np.cumsum(size) - size
        place = np.arange(len(points)) - np.repeat(first, size)  # of a character in its stretch
        found = [*self.automaton.iter(text)]
        flat = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2)
        end, piece = flat[:, 0], flat[:, 1]
        length = self.lengths[piece]
        inside = length <= place[end] + 1  # else it reaches into the stretch before
        end, piece, length = end[inside], piece[inside], length[inside]
        single = np.zeros(len(points), bool)
        single[end[length == 1]] = True
        lost = (~single).nonzero()[0]
        end = np.concatenate((end, lost))
        length = np.concatenate((length, np.ones(len(lost), np.int64)))
        score = np.concatenate((self.scores[piece], np.full(len(lost), self.unknown)))
        width = 1 + (points[lost] > 0x7F) + (points[lost] > 0x7FF) + (points[lost] > 0xFFFF)
        tokens = np.concatenate((np.ones(len(piece), np.int64), width))
        longest = int(length.max(initial=1))
        order = ((place[end] * len(points) + end) * (longest + 1) + longest - length).argsort(kind="stable")
        end, length, score, tokens = end[order], length[order], score[order], tokens[order]
        # node p of a stretch is kept at first + its number + p
        base = np.arange(len(stretches)).repeat(size)
        start_node, end_node = end + 1 - length + base[end], end + 1 + base[end]
        best, count = np.zeros(len(points) + len(stretches)), np.zeros(len(points) + len(stretches), np.int64)
        turns = np.searchsorted(place[end], np.arange(int(size.max(initial=0)) + 1)).tolist()
        for i, j in zip(turns, turns[1:], strict=False):
            to, start = end_node[i:j], start_node[i:j]
            candidate = best[start] + score[i:j]
            new = np.r_[True, to[1:] != to[:-1]]
            heads = new.nonzero()[0]
            most = np.maximum.reduceat(candidate, heads)
            wins = (candidate == most.repeat(np.diff(np.r_[heads, len(to)]))).nonzero()[0]
            wins = wins[np.r_[True, to[wins][1:] != to[wins][:-1]]]  # of equal ones the first, which starts first
            best[to[heads]] = most
            count[to[heads]] = count[start[wins]] + tokens[i:j][wins]
        last = first + size + np.arange(len(stretches))
        return [*zip(count[last].tolist(), best[last].tolist(), strict=True)]

    def __call__(self, texts: list[str | None]) -> list[tuple[int, float]]:
        cut = [self.stretches(t) if t else [] for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        new = set().union(*cut).difference(known)
        long = [s for s in new if len(s) > LONG]
        short = [s for s in new if len(s) <= LONG]
        known.update((s, self.one(s)) for s in long)
        for k in range(0, len(short), 20_000):
            known.update(zip(short[k : k + 20_000], self.many(short[k : k + 20_000]), strict=True))
        out = []
        for stretches in cut:
            found = [*map(known.__getitem__, stretches)]
            out.append((sum(n for n, _ in found), sum((s for _, s in found), 0.0)))
        return out


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score): tokens and log score of the best segmentation of each text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches):
        count = Counter(shared.value)
        for part in slices(batches):
            found = count(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
