"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Each rule looks at a whole document and votes good (1), bad (-1) or abstains (0). Documents with the same votes are one
pattern; there are at most 3^rules patterns, so the counts of patterns over the whole corpus are a small table that
fits the driver. EM on these counts estimates each rule's accuracies and the share of good documents; a document's
posterior is a function of its pattern.

Null and empty texts have no words and fail the base rule. Copies get equal results; an empty table gives an empty one.
Other columns pass through, but for those named like the added ones, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.textvec import NOT_NEWLINE, NOT_SPACE, SAME, Runs, flat_bytes, row_sums, run_hash, slices, tagged, windows

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was were will with "
    "auf das dem den der des die ein eine für im in ist mit nicht sich sie und von zu "
    "au avec dans de des du elle en est et la le les pas pour que qui sur un une "
    "al con de del el en es la las lo los no para por que se su un una y"
).split()
_FUNCTION = np.unique(np.array([run_hash(x, fold=SAME)[0] for w in FUNCTION_WORDS for x in (w, w.capitalize(), w.upper())], np.uint64))
_BYTES = np.arange(256)
_SYMBOL = np.isin(_BYTES, np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
_END = np.isin(_BYTES, np.frombuffer(b".!?", np.uint8))
_FIRST_OF_POINT = (_BYTES & 0xC0) != 0x80


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base signals and those only the rules use, for each text of a slice."""
    n = len(offsets) - 1
    words = Runs(data, offsets, NOT_SPACE)
    hashed = words.hashes()
    lines = Runs(data, offsets, NOT_NEWLINE)
    before = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    worded = before[lines.end] > before[lines.start]
    line_hash, line_row = lines.hashes()[worded], lines.row[worded]
    line_key = tagged(line_hash, line_row)
    order = np.argsort(line_key, kind="stable")
    again = np.zeros(len(order), bool)
    again[1:] = line_key[order][1:] == line_key[order][:-1]
    gram, first = windows(hashed, words.row, 3)
    gram = tagged(gram, words.row[first])
    by_gram = np.argsort(gram)
    same = gram[by_gram][1:] == gram[by_gram][:-1]
    twice = np.zeros(len(gram), bool)
    twice[by_gram[1:][same]] = True
    twice[by_gram[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[first[twice] + k] = True
    last = data[words.end - 1] if len(words) else np.empty(0, np.uint8)
    ends = _END[last]
    doubled = ends & (words.end - words.start > 2) & _END[data[np.maximum(words.end - 2, 0)]] if len(words) else ends
    count = lambda chosen: np.bincount(words.row[chosen], minlength=n)
    return {
        "n_words": words.per_row,
        "word_chars": row_sums(NOT_SPACE[data] & _FIRST_OF_POINT[data], offsets),
        "n_symbols": row_sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[order][again], minlength=n),
        "n_repeat_words": count(covered),
        "n_lines": np.bincount(line_row, minlength=n),
        "n_upper": row_sums(_UPPER[data], offsets),
        "n_letters": row_sums(_LETTER[data], offsets),
        "n_ends": count(ends),
        "n_doubled_ends": count(doubled),
        "n_function": count(np.isin(hashed, _FUNCTION)),
    }


def votes(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    words = np.maximum(m["n_words"], 1)

    def rule(value: np.ndarray, good: float, bad: float, given: np.ndarray | None = None) -> np.ndarray:
        """Good up to `good`, bad beyond `bad` (or the other way, if bad is the smaller); abstains between."""
        vote = np.where(value <= good, 1, np.where(value > bad, -1, 0)) if good <= bad else np.where(value >= good, 1, np.where(value < bad, -1, 0))
        return vote if given is None else np.where(given, vote, 0)

    length = m["word_chars"] / words
    return {
        "enough_words": rule(m["n_words"], 100, MIN_WORDS),
        "few_symbols": rule(m["n_symbols"] / words, 0.02, 0.1),
        "few_repeated_words": rule(m["n_repeat_words"] / words, 0.2, 0.4),
        "few_repeated_lines": rule(m["n_dup_lines"] / np.maximum(m["n_lines"], 1), 0.05, 0.3, m["n_lines"] > 1),
        "word_length": rule(np.abs(length - 6), 2.5, 5),
        "few_capitals": rule(m["n_upper"] / np.maximum(m["n_letters"], 1), 0.15, 0.4, m["n_letters"] > 0),
        "sentence_ends": rule(m["n_ends"] / words, 0.02, 0.005),
        "few_doubled_ends": rule(m["n_doubled_ends"] / words, 0.02, 0.2),
        "function_words": rule(m["n_function"] / words, 0.1, 0.03),
    }


RULES = ("enough_words", "few_symbols", "few_repeated_words", "few_repeated_lines", "word_length", "few_capitals", "sentence_ends", "few_doubled_ends", "function_words")


def pattern_of(cast: dict[str, np.ndarray]) -> np.ndarray:
    """One number for all votes of a document, base 3."""
    code = np.zeros(len(cast[RULES[0]]), np.int64)
    for name in RULES:
        code = code * 3 + cast[name] + 1
    return code


def pattern_votes(code: int) -> list[int]:
    out = []
    for _ in RULES:
        code, vote = divmod(code, 3)
        out.append(vote - 1)
    return out[::-1]


def expectation_maximisation(patterns: dict[int, int], rounds: int = 200, smooth: float = 1.0) -> tuple[dict[int, float], dict]:
    """Posterior probability of good for each pattern, and the estimates.

    A rule that votes has a chance of a good vote under good and under bad; votes are independent given the class, and a
    rule that abstains says nothing. It starts from the share of good votes in each pattern, so that good means what most rules call good.
    """
    codes = sorted(patterns)
    if not codes:
        return {}, {"good": 0.5, "votes": None}
    weight = np.array([patterns[c] for c in codes], float)
    cast = np.array([pattern_votes(c) for c in codes])
    spoken = np.maximum((cast != 0).sum(1), 1)
    good = np.clip(0.5 + 0.5 * cast.sum(1) / spoken, 0.02, 0.98)
    good = np.where((cast < 0).sum(1) >= 2, np.minimum(good, 0.3), good)
    for _ in range(rounds):
        w1, w0 = weight * good, weight * (1 - good)
        share = (w1.sum() + smooth) / (weight.sum() + 2 * smooth)
        chance = np.array([[(w[cast[:, j] > 0].sum() + smooth) / (w[cast[:, j] != 0].sum() + 2 * smooth) for j in range(len(RULES))] for w in (w0, w1)])
        score = [np.where(cast > 0, np.log(p), np.where(cast < 0, np.log(1 - p), 0)).sum(1) for p in chance]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1] + math.log((1 - share) / share), -500, 500)))
        moved, good = float(np.abs(new - good).max()), new
        if moved < 1e-9:
            break
    return dict(zip(codes, good.tolist(), strict=True)), {"good": share, "votes": {name: chance[::-1, j].tolist() for j, name in enumerate(RULES)}}


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    for batch in batches:
        data, offsets = flat_bytes(batch.column("text"))
        for i, j in slices(offsets):
            part = data[offsets[i] : offsets[j]]
            yield batch.slice(i, j - i), measure(part, offsets[i : j + 1] - offsets[i])


def pattern_counts(docs: DataFrame) -> dict[int, int]:
    """How many documents cast each pattern of votes: at most 3^rules rows, however many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m in _each_slice(batches):
            codes, counts = np.unique(pattern_of(votes(m)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {r["code"]: r["n"] for r in rows}


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds the five base signals, base_failed, quality (the posterior) and kept to documents with a `text`.

    Two passes over the texts: one counts patterns, one applies their posteriors; nothing is shuffled but the counts.
    """
    posterior, _ = expectation_maximisation(pattern_counts(docs))
    codes = np.array(sorted(posterior), np.int64)
    chance = np.array([posterior[c] for c in codes.tolist()])
    taken = {*FEATURES, "base_failed", "quality", "kept"}
    passed = docs.drop(*[c for c in docs.columns if c.lower() in taken])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in _each_slice(batches):
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            at = np.searchsorted(codes, pattern_of(votes(m)))
            quality = chance[at]
            added = [pa.array(m[f].astype(np.int64)) for f in FEATURES] + [pa.array(failed), pa.array(quality), pa.array(~failed & (quality >= threshold))]
            yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *FEATURES, "base_failed", "quality", "kept"])

    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

    schema = StructType([*passed.schema.fields])
    for name in FEATURES:
        schema = schema.add(name, LongType())
    schema = schema.add("base_failed", BooleanType()).add("quality", DoubleType()).add("kept", BooleanType())
    return passed.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the signals and the verdict of every document."""
    return judge(docs.select("doc_id", "text")).drop("text")
