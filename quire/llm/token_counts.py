"""Token counts by a count-only Viterbi over a unigram vocabulary.

A text is cut before its spaces as the tokenizer does; of each unit, an Aho-Corasick automaton over the vocabulary yields
all pieces that end at a character, and each position keeps the best score and the pieces on the way to it, no path. The
rules for ties and unknown characters are those of the tokenizers library's Unigram model with a Metaspace pre-tokenizer:
of equal scores the longest last piece wins, and an unknown character costs the least score less 10.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, PENALTY = "▁", 10.0
#: A SentencePiece model whose pieces and scores are the vocabulary; units whose counts a worker keeps.
MODEL, KEPT = "piece_bpe_32k.model", 1_000_000


class Counter(dict):
    """Unit to its number of tokens, counted when first asked for. vocabulary: (piece, score); bytes_known: unknown characters become a token per UTF-8 byte, else one per run."""

    def __init__(self, vocabulary: list[tuple[str, float]], bytes_known: bool) -> None:
        import ahocorasick

        self.automaton, self.bytes_known = ahocorasick.Automaton(), bytes_known
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - PENALTY

    def __missing__(self, unit: str) -> int:
        n = len(unit)
        best, pieces, loose, ends = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        ends[0], done, unknown = True, 0, self.unknown

        def step(i: int) -> None:  # an unknown character ends at i
            if not ends[i] or best[i - 1] + unknown > best[i]:
                best[i], ends[i], loose[i] = best[i - 1] + unknown, True, True
                pieces[i] = pieces[i - 1] + (len(unit[i - 1].encode("utf-8", "surrogatepass")) if self.bytes_known else not loose[i - 1])

        single = 0
        for end, (size, score) in self.automaton.iter(unit):  # by end, the longest piece first
            end += 1
            if end - 1 > done:  # all pieces that end before are in
                for i in range(done + 1, end):
                    if single != i:
                        step(i)
                done = end - 1
            start = end - size
            if size == 1:
                single = end
            new = best[start] + score
            if not ends[end] or new > best[end]:
                best[end], pieces[end], ends[end], loose[end] = new, pieces[start] + 1, True, False
        for i in range(done + 1, n + 1):
            if single != i:
                step(i)
        if len(self) >= KEPT:
            self.clear()
        if n < 64:
            self[unit] = pieces[n]
        return pieces[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        units = text.replace(" ", SPACE).split(SPACE)
        if not units[0]:
            units = units[1:]
        return sum(map(self.__getitem__, [SPACE + u for u in units]))


@cache
def counter(model: str) -> Counter:
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
    ids = range(sp.get_piece_size())
    words = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Counter(words, sum(map(sp.is_byte, ids)) == 256)


def counted(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs (text; any more columns are kept) with n_tokens in place of text. A null or empty text has 0 tokens."""
    keep = [c for c in docs.columns if c not in ("text", "n_tokens")]
    schema = docs.select(*keep).withColumn("n_tokens", F.lit(0).cast("long")).schema
    names, last = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([count(x.as_py()) for x in batch.column(last)], pa.int64())], names)

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
