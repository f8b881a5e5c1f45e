r"""Count-only Viterbi for a unigram vocabulary.

The vocabulary is a table of pieces with scores; a text is a blank mark and its characters with blanks written as that mark. The best
segmentation has the greatest sum of scores. Ties go as in the reference tokenizers' lattice: starts are
processed from left to right and an end keeps its first best start, so of equal ones the longest last piece stays. A character
without a piece of its own is unknown at the least score less 10. If the vocabulary has byte pieces, an unknown character counts
one piece per UTF-8 byte (byte fallback); if not, neighbouring unknowns count as one piece.

An Aho-Corasick automaton enumerates the pieces that end at each place, longest first; the dynamic programme carries best score and
piece count only. As no piece holds a blank mark behind another character, texts fall apart before each run of blanks; each
distinct part is solved once and remembered (a bounded number of them).

Defined cases: null and empty texts have no pieces and score 0; repeated rows are counted each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 300_000


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a vocabulary file; control, unknown, unused and byte pieces never match text."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {p.IdToPiece(i): p.GetScore(i) for i in range(p.GetPieceSize()) if not (p.IsControl(i) or p.IsUnknown(i) or p.IsUnused(i) or p.IsByte(i))}


def has_byte_pieces(path: str) -> bool:
    """Whether unknown characters are spelt by byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return any(p.IsByte(i) for i in range(p.GetPieceSize()))


class Counter:
    def __init__(self, pieces: dict[str, float], byte_fallback: bool = False):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.apart = MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.singles = {p for p in pieces if len(p) == 1}
        self.counts: dict[str, int] = {}
        self.scores: dict[str, float] = {}

    def solve(self, part: str) -> tuple[int, float]:
        if not self.singles.issuperset(part):
            return self.solve_with_unknowns(part)
        # every place has a match; matches come by their end, and of one end longest first
        score, count, last = [0.0] * (len(part) + 1), [0] * (len(part) + 1), -1
        for end, (size, s) in self.automaton.iter(part):
            start = end + 1 - size
            s += score[start]
            if end != last or s > score[end + 1]:
                last = end
                score[end + 1] = s
                count[end + 1] = count[start] + 1
        return count[-1], score[-1]

    def solve_with_unknowns(self, part: str) -> tuple[int, float]:
        n = len(part)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(part):
            ends[end].append(match)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(n):
            best, start, single = None, 0, False
            for size, s in sorted(ends[i], reverse=True):
                single |= size == 1
                s += score[i + 1 - size]
                if best is None or s > best:
                    best, start = s, i + 1 - size
            lone = False
            if not single and (best is None or self.unknown + score[i] > best):
                best, start, lone = self.unknown + score[i], i, True
            score[i + 1], unknown[i + 1] = best, lone
            if lone and self.byte_fallback:
                count[i + 1] = count[start] + len(part[i].encode())
            else:
                count[i + 1] = count[start] + (not (lone and unknown[start]))
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.apart:
            return self.solve(MARK + text.replace(" ", MARK))
        if text[0] == " " or "  " in text or MARK in text:
            parts = PARTS.findall(MARK + text.replace(" ", MARK))
        else:
            parts = text.split(" ")
        counts, scores = self.counts, self.scores
        new = set(parts).difference(counts)
        for part in new:
            counts[part], scores[part] = self.solve(MARK + part)
        got = sum(map(counts.__getitem__, parts)), sum(map(scores.__getitem__, parts), 0.0)
        for part in new:
            if len(part) >= 100:
                del counts[part], scores[part]
        if len(counts) > REMEMBERED:
            counts.clear()
            scores.clear()
        return got


#: What follows the first mark of a run of marks, up to the next run.
PARTS = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")


def _counts(path: str):
    def run(batches):
        counter = Counter(read_pieces(path), has_byte_pieces(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                got = [counter.count(t) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], names=["id", "n_pieces", "score"])

    return run


def count_pieces(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_pieces, score: a row per document, without a shuffle."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return docs.mapInArrow(_counts(model_path), f"id {docs.schema['id'].dataType.simpleString()}, n_pieces long, score double").withColumnRenamed("id", id_col)
