"""Quality rules (operator 10): rules vote or abstain, expectation-maximisation estimates how far each is right, and the
posterior probability of good quality decides.

Rows: one for each row of the input, copies and repeated ids included. A null or empty text has no words and fails the base
rule. Texts are read whole; extra columns of the input are not looked at. An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words

#: name, measure, votes for good up to, votes for bad from: a document between the two gets no vote from the rule.
RULES = (
    ("symbols", "symbol_share", 0.05, 0.20),
    ("repeats", "repeat_share", 0.05, 0.30),
    ("lines", "dup_line_share", 0.10, 0.40),
    ("capitals", "capital_share", 0.15, 0.50),
    ("variety", "same_next_share", 0.05, 0.20),
    ("marks", "marked_share", 0.02, 0.20),
    ("pipes", "pipe_share", 0.01, 0.15),
)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes int"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return C.mix(hashes ^ C.mix(owner.astype(C.U64) + C.U64(1)))


def measure(buffer: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts and shares of the texts in a buffer."""
    texts = len(offsets) - 1
    starts, ends, first = C.words(buffer, offsets)
    owner, n_words = C.owners(first), np.diff(first)
    hashes = C.word_hashes(buffer, starts, ends)
    points = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum(_LEAD[buffer], out=points[1:])
    chars = np.bincount(owner, points[ends] - points[starts], texts).astype(np.int64)

    # windows of words found twice or more in their text
    covered = np.zeros(len(starts) + 1, np.int64)
    grams = C.gram_hashes(hashes, REPEAT_WINDOW)
    at = np.flatnonzero(owner[: len(grams)] == owner[REPEAT_WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    _, which, times = np.unique(_keyed(grams[at], owner[at]), return_inverse=True, return_counts=True)
    at = at[times[which] > 1]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + REPEAT_WINDOW, -1)
    repeated = np.bincount(owner, np.cumsum(covered[:-1]) > 0, texts).astype(np.int64)

    # lines with a word that equal an earlier one of their text
    breaks = np.flatnonzero(buffer == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(buffer)]
    line_ends = np.concatenate([line_starts[1:], [len(buffer)]]) if len(line_starts) else line_starts
    line_ends = line_ends - (buffer[line_ends - 1] == 10)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    lines = np.bincount(line_owner, minlength=texts)
    distinct = np.unique(_keyed(C.span_hashes(C.byte_codes(buffer), line_starts, line_ends), line_owner), return_index=True)[1]
    dup_lines = lines - np.bincount(line_owner[distinct], minlength=texts)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    symbols, per_word = _counts(_SYMBOL[buffer], offsets), {}
    same = np.zeros(len(starts), bool)
    if len(starts):
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        last = buffer[ends - 1]
        lone = ends - starts == 1
        per_word = {"same": same, "marked": np.isin(last, np.frombuffer(b"!?*#$%&", np.uint8)), "pipe": lone & (last == ord("|"))}
    by_word = {k: np.bincount(owner, v, texts) for k, v in per_word.items()} or dict.fromkeys(("same", "marked", "pipe"), np.zeros(texts))
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "base_failed": (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words),
        "symbol_share": share(symbols, chars), "repeat_share": share(repeated, n_words), "dup_line_share": share(dup_lines, lines),
        "capital_share": share(_counts(_UPPER[buffer], offsets), _counts(_LETTER[buffer], offsets)),
        "same_next_share": share(by_word["same"], n_words), "marked_share": share(by_word["marked"], n_words), "pipe_share": share(by_word["pipe"], n_words),
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """Each document's votes as one number in base 3, a digit a rule: 0 bad, 1 no vote, 2 good."""
    out = np.zeros(len(found["n_words"]), np.int64)
    for _, name, good, bad in RULES:
        out = out * 3 + np.where(found[name] >= bad, 0, np.where(found[name] <= good, 2, 1))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, buffer, offsets in C.text_slices(batch.column(1)):
            found = measure(buffer, offsets)
            columns = {k: pa.array(found[k]) for k in names[1:-1]}
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(lo, hi - lo), **columns, "votes": pa.array(votes(found), pa.int32())})


def fit(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posterior of good quality for each pattern of votes, from how many documents have it. Expectation-maximisation over
    two classes in which rules vote independently; it starts from the share of good votes."""
    if not counts:
        return {}
    codes = np.array(sorted(counts), np.int64)
    weight = np.array([counts[int(c)] for c in codes], float)
    digits = np.stack([codes // 3 ** (len(RULES) - 1 - i) % 3 for i in range(len(RULES))], 1)
    bad, good = (digits == 0).sum(1), (digits == 2).sum(1)
    posterior = np.where(bad > 0, 0.9 ** (1 + good) * 0.5**bad, 1 - 0.5 ** (1 + good))
    for _ in range(rounds):
        tables = np.stack([[np.bincount(digits[:, i], weight * p, 3) + 0.1 for i in range(len(RULES))] for p in (1 - posterior, posterior)])
        tables /= tables.sum(2, keepdims=True)
        # a good vote is never taken as a sign of bad quality, nor a bad one of good
        for digit, a, b in ((2, 0, 1), (0, 1, 0)):
            low = np.minimum(tables[a, :, digit], tables[b, :, digit])
            tables[a, :, digit] = low
        prior = np.clip(np.average(posterior, weights=weight), 0.01, 0.99)
        score = [np.log(p) + sum(np.log(tables[y, i, digits[:, i]]) for i in range(len(RULES))) for y, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return {int(c): float(p) for c, p in zip(codes, posterior)}


def _votes_of(column: pa.Array) -> pa.Array:
    out = [np.zeros(0, np.int64)]
    for _, _, buffer, offsets in C.text_slices(column):
        found = measure(buffer, offsets)
        out.append(votes(found) * 2 + found["base_failed"])
    return pa.array(np.concatenate(out), pa.int32())


def keep_good(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns. The texts are measured twice rather than written once more."""
    name = next(f"__votes{k}" for k in range(len(docs.columns) + 1) if f"__votes{k}" not in docs.columns)
    voted = docs.withColumn(name, F.arrow_udf(_votes_of, "int")(F.col(text)))
    pattern = F.expr(f"{name} div 2").cast("int").alias("pattern")
    counts = {r["pattern"]: r["n"] for r in voted.groupBy(pattern).agg(F.count("*").alias("n")).collect()}
    good = [2 * k for k, p in fit(counts).items() if p >= threshold]
    return voted.where(F.col(name).isin(good)).drop(name)


def quality_rules(docs: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The counts, base verdict, posterior and verdict of each row. At most 3 ** len(RULES) patterns of votes exist, which
    bounds what the driver fits and what is broadcast."""
    spark = docs.sparkSession
    found = C.materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_measured, SCHEMA), "quality")
    counts = {r["votes"]: r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    fitted = spark.createDataFrame(list(fit(counts).items()) or [(-1, 0.0)], "votes int, quality double")
    judged = found.join(F.broadcast(fitted), "votes", "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), F.round("quality", 6).alias("quality"),
    )
