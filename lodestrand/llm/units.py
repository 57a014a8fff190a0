"""Cutting texts into units that public tokenizers encode independently of each other.

A unit is a run of white space with the run of other characters after it.  No pattern of the byte-level tokenizer and
no piece of the sentence-piece tokenizer reaches from a non-space character over into white space, so a text's ids are
the ids of its units in order.  Blanks and line feeds are cut with Arrow kernels over whole batches; the rare units that
end in white space (runs of several blanks, tabs) are joined with the unit after them.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

TOKENIZERS = "/opt/tokenizers"
#: Marks within units: one or two line feeds instead of the blank, and the start of a text, which has none.
ONE, TWO, START = "\x01", "\x02", "\x03"
_MARKS = "[\x01\x02\x03]"
_ENDS_BLANK = regex.compile(r"[\s▁]\Z")
# Fixed value: the pattern that splits a text before the merges of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _form(unit: str) -> str:
    """A unit as text; the first of a text keeps the START mark."""
    if unit[:1] == START:
        return unit
    if unit[:1] == ONE:
        return "\n" + unit[1:]
    if unit[:1] == TWO:
        return "\n\n" + unit[1:]
    return " " + unit


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct units, code of each unit in order, number of units of each text); null and empty texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.match_substring_regex(texts, _MARKS)
    plain = pc.replace_substring(pc.replace_substring(texts, "\n\n", " " + TWO), "\n", " " + ONE)
    started = pc.binary_join_element_wise(pa.scalar(START, pa.large_string()), plain, pa.scalar("", pa.large_string()))
    lists = pc.split_pattern(started, " ")
    if pc.any(marked).as_py():  # a text that holds the marks themselves is one unit
        whole = [[START + t] if m else u for t, m, u in zip(texts.to_pylist(), marked.to_pylist(), lists.to_pylist(), strict=True)]
        lists = pa.array(whole, pa.large_list(pa.large_string()))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.dictionary_encode(lists.flatten())
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    forms = [_form(u) for u in encoded.dictionary.to_pylist()]
    empty = pc.equal(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    open_end = np.fromiter((bool(_ENDS_BLANK.search(f)) or f == START for f in forms), bool, len(forms))
    last = np.zeros(len(codes), bool)
    ends = np.cumsum(counts) - 1
    last[ends] = True
    joins = open_end[codes] & ~last
    keep = np.ones(len(codes), bool)
    text_of = np.repeat(np.arange(len(counts)), counts)
    if joins.any():
        known = {f: i for i, f in enumerate(forms)}
        starts = np.flatnonzero(joins & ~np.r_[False, joins[:-1]])
        stops = np.flatnonzero(joins & ~np.r_[joins[1:], False]) + 1
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            f = "".join(forms[c] for c in codes[a : b + 1])
            code = known.get(f)
            if code is None:
                code = known[f] = len(forms)
                forms.append(f)
            codes[a] = code
            keep[a + 1 : b + 1] = False
    keep &= ~empty[text_of]
    return forms, codes[keep], np.bincount(text_of[keep], minlength=len(counts)).astype(np.int64)


class ByteUnits:
    """Ids of units by a byte-level vocabulary in rank form; strings of special tokens are ordinary text."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        import tiktoken

        with open(os.path.join(folder, name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, form: str) -> list[int]:
        return self.encoding.encode_ordinary(form[1:] if form[0] == START else form)

    def count(self, form: str) -> int:
        return len(self.ids(form))


class PieceUnits:
    """Ids of units by a sentence-piece model whose normaliser adds one blank at the start of a text."""

    def __init__(self, name: str = "piece_bpe_32k", folder: str = TOKENIZERS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, name + ".model"))
        self.size = self.model.get_piece_size()
        self.blank = self.model.piece_to_id("▁")

    def ids(self, form: str) -> list[int]:
        if form[0] == "\n":  # the model sets its blank before the line feed; it is not part of the unit
            return self.model.encode(form)[1:]
        return self.model.encode(form[1:]) or [self.blank] * (form[0] != START)

    def count(self, form: str) -> int:
        return len(self.ids(form))


def tokenizer(name: str, folder: str = TOKENIZERS):
    return PieceUnits(name, folder) if os.path.exists(os.path.join(folder, name + ".model")) else ByteUnits(name, folder)
