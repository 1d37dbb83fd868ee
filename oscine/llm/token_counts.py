"""Token counts (operator 4): a unigram model over the pieces of a public vocabulary. The distinct words of a batch of texts
go into a trie; the forward scores of the best segmentation are computed once for each node, so once for each prefix that
words share; the count at a word's last node is the word's.

Words are what stands between white space; each begins with the vocabulary's word mark. The vocabulary gives pieces in order
of rank; a piece's probability follows from its rank by Zipf's law, as the file has ranks and no unigram probabilities, and no
tokenizer is fitted here. The counts are those of this model, and not of the tokenizer that the vocabulary was made for; scores
of a unigram vocabulary may be given instead. A character that is no piece counts one token for each of its UTF-8 bytes. Of equally good segmentations the one with fewer tokens counts.
Null and empty texts have no words and no tokens. Texts are read whole, each row by itself, repeated rows alike; an empty
table gives an empty result; extra columns are not looked at."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C

WORD_MARK = "▁"
MODEL = "piece_bpe_32k.model"
MOST_PIECES = 1 << 20
BLOCK_NODES = 1 << 16
UNKNOWN_PENALTY = 10.0


def public_path(name: str = MODEL) -> str:
    """Where the package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece file, best rank first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in sorted(ids, key=lambda i: -model.get_score(i))]


def zipf(n: int) -> np.ndarray:
    ranks = np.arange(1, n + 1, dtype=float)
    return -np.log(ranks) - np.log((1 / ranks).sum())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _codes(points: np.ndarray) -> np.ndarray:
    return C.mix(points.astype(C.U64) * C.U64(0x9E3779B97F4A7C15) + C.U64(1))


class Pieces:
    """A vocabulary, of at most MOST_PIECES pieces."""

    def __init__(self, pieces: list[str], scores: np.ndarray):
        if not 0 < len(pieces) <= MOST_PIECES:
            raise ValueError(f"a vocabulary has 1 to {MOST_PIECES} pieces, not {len(pieces)}")
        sizes = np.array(list(map(len, pieces)))
        ends = np.cumsum(sizes)
        hashes = C.span_pairs(_codes(_points("".join(pieces))), ends - sizes, ends)[0]  # what _last_pieces builds, character by character
        order = np.argsort(hashes)
        self.hashes, self.scores = hashes[order], np.asarray(scores, float)[order]
        self.longest, self.unknown = int(sizes.max()), float(self.scores.min()) - UNKNOWN_PENALTY

    def score(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.scores[at], -np.inf)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and score of the best segmentation of each of some distinct words."""
        points = _points("".join(WORD_MARK + x for x in texts))
        sizes = np.array([len(x) + 1 for x in texts])
        begins = np.cumsum(sizes) - sizes
        codes = _codes(points)
        place = np.arange(len(points))
        depth = place - np.repeat(begins, sizes) + 1
        # the trie: one node for each distinct prefix, with the place of one of its last characters
        prefix = C.span_hashes(codes, place - depth + 1, place + 1)
        _, first, node = np.unique(prefix, return_index=True, return_inverse=True)
        level = np.argsort(depth[first], kind="stable")
        first, rank = first[level], np.argsort(level)
        node, depth = rank[node] + 1, depth[first]  # node 0 is the root
        parent = np.where(depth > 1, node[np.maximum(first, 1) - 1], 0)
        n = len(first) + 1
        best, tokens = np.full(n, -np.inf), np.zeros(n, np.int64)
        best[0] = 0
        last = points[first]
        as_bytes = 1 + (last > 0x7F).astype(np.int64) + (last > 0x7FF) + (last > 0xFFFF)
        edges = np.searchsorted(depth, np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        level = 0
        while level < len(edges) - 1:
            until = max(level + 1, int(np.searchsorted(edges, edges[level] + BLOCK_NODES, "right")) - 1)
            lo = edges[level]
            ancestor, score, more = self._last_pieces(codes, first[lo : edges[until]], depth[lo : edges[until]], parent, as_bytes, lo)
            for a, b in zip(edges[level:until], edges[level + 1 : until + 1], strict=True):
                above = ancestor[a - lo : b - lo]
                total = best[above] + score[a - lo : b - lo]
                own = total.max(1)
                best[a + 1 : b + 1] = own
                tokens[a + 1 : b + 1] = np.where(total == own[:, None], tokens[above] + more[a - lo : b - lo], 1 << 62).min(1)
            level = until
        terminal = node[begins + sizes - 1]
        return tokens[terminal], best[terminal]

    def _last_pieces(self, codes: np.ndarray, ends: np.ndarray, depth: np.ndarray, parent: np.ndarray, as_bytes: np.ndarray, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For nodes lo, lo + 1, ...: the node before a last piece of each size, the piece's score, and its tokens."""
        longest = int(min(self.longest, depth[-1]))
        ancestor, score = np.zeros((len(ends), longest), np.int64), np.full((len(ends), longest), -np.inf)
        more = np.ones((len(ends), longest), np.int64)
        at, total = np.arange(lo, lo + len(ends)) + 1, np.zeros(len(ends), C.U64)
        for size in range(1, longest + 1):
            some = depth >= size
            at = np.where(some, parent[np.maximum(at, 1) - 1], 0)
            # one character more in front of the span
            total = total * C.U64(C._MULTIPLIER) + codes[np.maximum(ends - size + 1, 0)]
            piece = np.where(some, self.score(C.mix(total + C.U64(size))), -np.inf)
            if size == 1:
                missing = np.isneginf(piece)
                piece, more[:, 0] = np.where(missing, self.unknown, piece), np.where(missing, as_bytes[lo : lo + len(ends)], 1)
            ancestor[:, size - 1], score[:, size - 1] = at, piece
        return ancestor, score, more


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            for lo, hi, buffer, offsets in C.text_slices(batch.column(1), 1 << 22):
                starts, ends, first = C.words(buffer, offsets)
                _, at, which = np.unique(C.word_hashes(buffer, starts, ends), return_index=True, return_inverse=True)
                data = buffer.tobytes()
                distinct = [data[s:e].decode("utf-8", "replace") for s, e in zip(starts[at], ends[at], strict=True)]
                tokens, _ = pieces.count(distinct) if distinct else (np.zeros(0, np.int64), None)
                sums = np.concatenate([[0], np.cumsum(tokens[which])]) if len(which) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n_words": pa.array(np.diff(first)), "n_tokens": pa.array(sums[first[1:]] - sums[first[:-1]])})

    return count


def token_counts(docs: DataFrame, pieces: list[str], scores: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each row. The vocabulary's size is checked before it is broadcast."""
    model = Pieces(pieces, zipf(len(pieces)) if scores is None else scores)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_counter(shared), "doc_id long, n_words long, n_tokens long")
