"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each
position of a word; the dynamic programme keeps, for each position, the best
score, the number of pieces and of unknown runs on the best path, and nothing
to trace back. Words are segmented alone (pieces never cross white space), so
results are memoised per distinct word in a bounded table.

No public file of the box has a unigram vocabulary, and tokenizers are not
trained. So the pieces are those of a BPE file, whose scores are ranks and no
probabilities; pieces are listed by falling frequency, and a piece's score is
the logarithm of its share by the law of Zipf and Mandelbrot, 1 / (rank + 2.7).

Rules of the tokenizer that are kept exactly: a word is `[^\x20\x09-\x0D]+`
with the word mark U+2581 before it, unless it starts with one; scores add up as doubles from left to
right; among equal scores the piece that starts earliest wins; a character
that is no piece by itself can be read as unknown at the lowest score less 10;
neighbouring unknowns fuse into one; a fused unknown is spelled in byte pieces
if the vocabulary has all 256 of them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, as_bytes, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Mandelbrot's shift of the rank.
RANK_SHIFT = 2.7
#: Distinct words remembered in a worker, and the longest that are.
MEMO_WORDS = 200_000
MEMO_CHARS = 48


class UnigramCounter:
    """pieces: (piece, score) in the order of their ids. bytes_too: the unknown is spelled in byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_too: bool = True):
        self.scores: dict[str, float] = dict(pieces)
        self.bytes_too = bytes_too and all(f"<0x{b:02X}>" in self.scores for b in range(256))
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.trie = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.memo = lru_cache(MEMO_WORDS)(self._count)

    def _count(self, word: bytes) -> tuple[int, int, float]:
        """(tokens, unknown characters, score) of a word."""
        text = word.decode()
        if not text.startswith(MARK):
            text = MARK + text
        n = len(text)
        scores, counts, odd, fused = [0.0], [0], [0], [False]
        ends = self.trie.iter(text) if len(self.trie) else iter(())
        end, piece = next(ends, (n, None))
        for e in range(n):
            best, single = None, False
            # the automaton gives the pieces that end here longest first, that is by their start
            while end == e:
                size, score = piece
                s = e + 1 - size
                total = score + scores[s]
                if best is None or total > best:
                    best, count, unknown = total, counts[s] + 1, odd[s]
                single = size == 1
                end, piece = next(ends, (n, None))
            in_unknown = False
            if not single:
                total = self.unknown + scores[e]
                if best is None or total > best:
                    spelled = len(text[e].encode()) if self.bytes_too else 0 if fused[e] else 1
                    best, count, unknown, in_unknown = total, counts[e] + spelled, odd[e] + 1, True
            scores.append(best)
            counts.append(count)
            odd.append(unknown)
            fused.append(in_unknown)
        return counts[n], odd[n], scores[n]

    def __call__(self, word: bytes) -> tuple[int, int, float]:
        return self.memo(word) if len(word) <= MEMO_CHARS else self._count(word)


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file and their log-probabilities; control pieces match no text and are left out.

    The scores of a unigram file are log-probabilities and stay. Those of a BPE
    file (minus the rank of the merge) give the order of the pieces for Zipf
    and Mandelbrot's law; byte pieces, which have no rank, come after all others.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    held = [(p.id_to_piece(i), p.get_score(i), p.is_byte(i)) for i in range(p.get_piece_size()) if not p.is_control(i) and not p.is_unknown(i)]
    scores = [s for _, s, byte in held if not byte]
    if any(s != round(s) for s in scores):
        return [(piece, s) for piece, s, _ in held]
    order = sorted(range(len(held)), key=lambda i: (held[i][2], -held[i][1]))
    rank = dict(zip(order, range(1, len(held) + 1), strict=True))
    total = sum(1 / (r + RANK_SHIFT) for r in rank.values())
    return [(piece, -math.log((rank[i] + RANK_SHIFT) * total)) for i, (piece, _, _) in enumerate(held)]


_COUNTERS: dict[int, UnigramCounter] = {}


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]] | None = None, vocabulary: str = VOCABULARY, bytes_too: bool = True) -> DataFrame:
    """docs with n_words, n_tokens, n_unknown (characters in no piece; all long) and token_score (sum of best scores).

    docs: text and any other columns; columns of the four names are replaced.
    Row by row: repeated ids and ties of rows do not matter. Null and empty
    texts have no tokens and a score of 0. The vocabulary is read on the
    driver and broadcast; its size is that of the tokenizer, whatever the data.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((pieces if pieces is not None else load_pieces(vocabulary), bytes_too))
    key = id(shared)

    def counts(batch: pa.RecordBatch) -> list[pa.Array]:
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = UnigramCounter(*shared.value)
        words, tokens, unknown, scores = [], [], [], []
        for text in as_bytes(batch.column("text")):
            found = list(map(counter, text.split())) if text else []
            words.append(len(found))
            tokens.append(sum(x[0] for x in found))
            unknown.append(sum(x[1] for x in found))
            scores.append(sum(x[2] for x in found) if found else 0.0)
        return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64()), pa.array(scores, pa.float64())]

    long = T.LongType()
    return append_columns(docs, [T.StructField("n_words", long), T.StructField("n_tokens", long), T.StructField("n_unknown", long), T.StructField("token_score", T.DoubleType())], counts)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
