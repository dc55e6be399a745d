"""Count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import Memory, map_batches

MARK = "▁"  # stands for a blank and begins each text
UNKNOWN_PENALTY = 10.0
# Results of parts of text that a worker keeps in each generation of its memory, and the longest part that it keeps.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 40


class Counter:
    """Piece counts of texts for the vocabulary of a model file.

    The best path is the one with the highest sum of scores. Rules for ties: of two ways to
    reach a place, the one whose last piece begins first stays; a character that is no piece itself may be unknown, at 10 below
    the least score, and gives as many pieces as it has UTF-8 bytes. Control, byte and unknown pieces are never
    matched in a text. Blanks become marks, a mark is put before a text that begins with none, and each mark begins a new part. No piece
    has a mark after its first place, so the parts are independent and their counts add up.
    """

    def __init__(self, model: str) -> None:
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(file.get_piece_size())
        plain = [i for i in ids if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i))]
        pieces = [(file.id_to_piece(i), file.get_score(i)) for i in plain]
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if MARK not in piece[1:]:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # A line feed in no piece splits a part as well: nothing can cross it.
        self.split_lines = not any("\n" in p for p, _ in pieces)
        self.seen = Memory(CACHE_ENTRIES)  # parts that a mark is put before
        self.seen_lines = Memory(CACHE_ENTRIES // 8)  # what follows a line feed

    def part(self, part: str) -> int:
        """Pieces of the best path through one part."""
        n = len(part)
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        done = 0

        def close(upto: int) -> None:
            """Ends without any match: their last character is unknown."""
            nonlocal done
            while done < upto:
                char = part[done]
                score[done + 1] = score[done] + self.unknown
                count[done + 1] = count[done] + len(char.encode())
                done += 1

        at, best, pieces = -1, None, 0

        def settle() -> None:
            nonlocal done
            if at < 0:
                return
            char = part[at]
            value, number = best, pieces
            if char not in self.single and score[at] + self.unknown > value:
                value, number = score[at] + self.unknown, count[at] + len(char.encode())
            score[at + 1], count[at + 1], done = value, number, at + 1

        for end, (length, piece_score) in self.automaton.iter(part):
            if end != at:
                settle()
                close(end)
                at, best = end, None
            begin = end + 1 - length
            value = score[begin] + piece_score
            if best is None or value > best:  # longer pieces come first
                best, pieces = value, count[begin] + 1
        settle()
        close(n)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(MARK, " ")
        parts = (text[1:] if text[0] == " " else text).split(" ")  # a mark is put only where none stands
        seen = self.seen
        counts = list(map(seen.young.get, parts))
        if None in counts:
            for i, (part, known) in enumerate(zip(parts, counts, strict=True)):
                if known is None:
                    known = seen.get(part)
                    if known is None:
                        known = self.lines(MARK + part)
                        if len(part) <= CACHE_CHARS:
                            seen.put(part, known)
                    counts[i] = known
        return sum(counts)

    def lines(self, part: str) -> int:
        if not self.split_lines or "\n" not in part:
            return self.part(part)
        first, *rest = part.split("\n")
        total = self.part(first) + len(rest)
        for line in rest:
            if line:
                known = self.seen_lines.get(line)
                if known is None:
                    known = self.part(line)
                    if len(line) <= CACHE_CHARS:
                        self.seen_lines.put(line, known)
                total += known
        return total


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a long column ``out``: pieces of the whole text (null text: 0, like the empty one).

    ``model`` is the path of a vocabulary file that every executor has. Rows are counted where they are, without a shuffle; ``out`` must be
    a free name. A worker keeps the automaton and a bounded memory of the counts of short parts.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the column {out} is taken")
    place = docs.columns.index(text)
    names = [*docs.columns, out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _COUNTERS:
            _COUNTERS[model] = Counter(model)
        counter = _COUNTERS[model]
        try:
            for batch in batches:
                counts = [counter.count(t or "") for t in batch.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names)
        finally:
            # Spark uses a worker again for other work.
            counter.seen.forget()
            counter.seen_lines.forget()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, work, f"{fields}, `{out}` long")
