"""Per-document statistics of text, and kinds of documents told apart by rules learned on them.

The statistics need each distinct word of a batch once: texts are cut at blanks and line feeds with Arrow kernels, the
properties of distinct words are looked up per occurrence, and sums run over documents and lines in numpy.  The rules
(learned in rules.py) are ordered conditions on the statistics, exported to a SQL CASE expression that Spark runs natively.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import pieces_of
from .rules import RULES, case_expression

FEATURES = (
    "mean_word_length", "symbol_ratio", "digit_ratio", "punct_line_share", "common_share", "words_per_line", "sentence_rate", "more_sentence_rate", "distinct_pair_share", "distinct_line_share",
    "cell_line_share", "short_line_share", "letter_word_share", "top_word_share", "vowel_word_share", "comma_word_share", "lower_word_share",
)
COUNTS = ("n_words", "n_lines")
_BREAK, _CELL = "\n", "\x04"
_SENTENCE = regex.compile(r"\p{L}{2}[\p{L}\p{N})\]»”\"’']*[.!?…][)\]»”\"’']*\Z")
_PUNCT = regex.compile(r"[.!?…:;][)\]»”\"’']*\Z")
_VOWEL = regex.compile(r"[aeiouyäöüàâéèêëîïôùûæœ]", regex.I)
_INNER = regex.compile(r"[,;|](?=\S)")
_TAGS = regex.compile(r"(?:<[^<>]*>)+\Z")
#: Words of a line up to which it is short.
SHORT_LINE = 8
#: Words whose properties a task remembers.
REMEMBERED = 1_000_000


class Memory:
    """Properties of the words a task has met; emptied when it holds REMEMBERED words."""

    def __init__(self, common: frozenset[str]):
        self.common, self.row, self.rows = common, {}, np.zeros((0, 11))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.row) > REMEMBERED:
            self.row, self.rows = {}, self.rows[:0]
        fresh = [w for w in words if w not in self.row]
        if fresh:
            self.row.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, _properties(fresh, self.common)])
        return self.rows[np.fromiter((self.row[w] for w in words), np.int64, len(words))]


def _properties(words: list[str], common: frozenset[str]) -> np.ndarray:
    """Per distinct word: length, symbols, digits, common, sentence end, line-end punctuation, letters only, vowel and consonant, inner separators, ends in comma, lower case."""
    out = np.zeros((len(words), 11), np.float64)
    for i, w in enumerate(words):
        if w[-1:] == ">":  # mark-up at the end of a word is not part of it
            w = _TAGS.sub("", w) or w
        n = len(w)
        if not n or w == _BREAK or w == _CELL:
            continue
        letters = sum(map(str.isalpha, w))
        digits = sum(map(str.isdigit, w))
        bare = w.strip(".,;:!?()[]«»“”\"'’…").lower()
        out[i] = (
            n, n - letters - digits, digits, bare in common, letters > 1 and bool(_SENTENCE.search(w)), not w[-1].isalnum() and bool(_PUNCT.search(w)),
            letters >= 0.8 * n, bool(_VOWEL.search(w)) and letters > 1, len(_INNER.findall(w, 1)), w[-1] == ",", w.islower(),
        )
    return out


def _per(total: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.divide(total, by, out=np.zeros(len(by)), where=by > 0)


def text_statistics(texts: pa.Array, memory: Memory) -> dict[str, np.ndarray]:
    """Statistics of each text; a word is a run of characters without white space, blank lines are no lines."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    for old, new in (("\r\n", "\n"), ("\r", "\n"), (" ", "\n"), (" ", " "), (" ", " "), (" ", " "), ("　", " "), (_CELL, " "), ("\t", f" {_CELL} "), ("\n", f" {_BREAK} ")):
        t = pc.replace_substring(t, old, new)
    lists = pc.split_pattern(t, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.dictionary_encode(lists.flatten())
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = encoded.dictionary.to_pylist()
    prop = memory(words)
    n = len(counts)
    doc = np.repeat(np.arange(n), counts)
    code_of = {w: i for i, w in enumerate(words)}
    is_break, is_cell, is_empty = (codes == code_of.get(x, -1) for x in (_BREAK, _CELL, ""))
    line = np.cumsum(is_break | np.r_[True, doc[1:] != doc[:-1]]) - 1 if len(codes) else codes
    n_line_ids = int(line[-1]) + 1 if len(line) else 0
    line_doc = np.zeros(n_line_ids, np.int64)
    line_doc[line] = doc
    word = ~(is_break | is_cell | is_empty)
    wc, wd, wl = codes[word], doc[word], line[word]
    n_words = np.bincount(wd, minlength=n).astype(float)
    sums = [np.bincount(wd, prop[wc, k], n) for k in range(prop.shape[1])]
    in_line = np.bincount(wl, minlength=n_line_ids)
    lines = in_line > 0
    n_lines = np.bincount(line_doc[lines], minlength=n).astype(float)
    last = np.zeros(n_line_ids, np.int64)
    last[wl] = wc  # the last word of a line stays
    # gaps of several blanks, tabs and separators within words part a line into cells; gaps before its first word do not count
    first = np.full(n_line_ids, len(codes))
    at = np.flatnonzero(word)
    np.minimum.at(first, wl, at)
    gap = (is_cell | (is_empty & ~np.r_[False, is_empty[:-1]])) & (np.arange(len(codes)) > first[line]) if len(codes) else is_cell
    after = np.zeros(n_line_ids, np.int64)
    after[wl] = at
    gap &= np.arange(len(codes)) < after[line] if len(codes) else gap
    cells = np.bincount(line[gap], minlength=n_line_ids) + np.bincount(wl, prop[wc, 8], n_line_ids) + np.bincount(wl, np.fromiter((w == "|" for w in words), float, len(words))[wc], n_line_ids)
    pick = np.random.default_rng(7).integers(1, 2**62, len(words) + 1, dtype=np.uint64)
    step = np.arange(len(wc), dtype=np.uint64)
    began = np.r_[0, np.cumsum(in_line)[:-1]].astype(np.uint64) if n_line_ids else step
    mark = np.zeros(n_line_ids, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(mark, wl, pick[wc] * (2 * (step - began[wl]) + 1))
    seen_lines = np.unique(np.stack([line_doc[lines].astype(np.uint64), mark[lines]]), axis=1)
    # words in order of document and code, by one stable sort
    size = len(words) + 1
    by_word = np.sort(wd * size + wc)
    edges = np.flatnonzero(np.r_[True, by_word[1:] != by_word[:-1]]) if len(by_word) else by_word
    top = np.zeros(n)
    np.maximum.at(top, by_word[edges] // size, np.diff(np.r_[edges, len(by_word)]))
    followed = wd[1:] == wd[:-1]
    follower = np.where(followed, wc[1:], size - 1) if len(wc) > 1 else wc[:0]
    with np.errstate(over="ignore"):
        mixed = (pick[wc[:-1]] * np.uint64(3) + pick[follower]) % np.uint64(2**40) if len(wc) > 1 else pick[:0]
    seen = np.sort(mixed.astype(np.int64) * max(n, 1) + wd[: len(mixed)])
    seen_pairs = seen[np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]])] if len(seen) else seen
    by_line = lambda flag: np.bincount(line_doc[lines], flag[lines].astype(float), n)
    return {
        "n_words": n_words.astype(np.int64), "n_lines": n_lines.astype(np.int64),
        "mean_word_length": _per(sums[0], n_words), "symbol_ratio": _per(sums[1], sums[0]), "digit_ratio": _per(sums[2], sums[0]),
        "punct_line_share": _per(by_line(prop[last, 5] > 0), n_lines), "common_share": _per(sums[3], n_words), "words_per_line": _per(n_words, n_lines),
        "sentence_rate": _per(sums[4], n_words), "more_sentence_rate": _per(np.maximum(sums[4] - 1, 0), n_words), "distinct_pair_share": _per(np.bincount(seen_pairs % n if n else seen_pairs, minlength=n), n_words),
        "distinct_line_share": _per(np.bincount(seen_lines[0].astype(np.int64), minlength=n), n_lines), "cell_line_share": _per(by_line(cells >= 2), n_lines),
        "short_line_share": _per(by_line(in_line <= SHORT_LINE), n_lines), "letter_word_share": _per(sums[6], n_words), "top_word_share": _per(top, n_words),
        "vowel_word_share": _per(sums[7], n_words), "comma_word_share": _per(sums[9], n_words), "lower_word_share": _per(sums[10], n_words),
    }


def _run(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(common)
        for batch in batches:
            for part in pieces_of(batch, "text"):
                found = text_statistics(part.column("text"), memory)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(found[c]) for c in (*COUNTS, *FEATURES)]], ["doc_id", *COUNTS, *FEATURES])

    return run


def common_word_set(words: DataFrame, limit: int = 100_000) -> frozenset[str]:
    """The words of the table, all languages together, as a document's language may be missing or wrong."""
    rows = words.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("the table of common words is too large")
    return frozenset(r["word"] for r in rows)


def quality_statistics(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_lines, statistics...), one row for each row of docs; all 0 for null, empty and blank texts.

    Whole texts are read, and nothing is shuffled.  Ratios are 0 where their base is 0.
    """
    shape = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run(common_word_set(words)), shape)


def document_kinds(statistics: DataFrame, rules: Sequence = RULES) -> DataFrame:
    """statistics with kind: list, table, junk or ruling; null where there are no words."""
    return statistics.withColumn("kind", F.expr(case_expression(rules, "n_words > 0", "ruling")))
