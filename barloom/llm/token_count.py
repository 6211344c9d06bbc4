"""Token counts by section: encode each document once, then attribute tokens by their spans."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import renamed, sliced

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("majority", "first", "last")
#: White space as the pattern means it. A longer run than LONG_RUN goes round the pattern, which would
#: run out of stack: all of it but the last character is one part, or the whole run at the end of a text.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 2000
_long_run = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")

_encoders: dict[str, tuple[tiktoken.Encoding, np.ndarray]] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and its tokens' lengths in bytes; one per process and vocabulary."""
    key = str(hash(ranks))
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        size = np.zeros(max(table.values()) + 1, np.int64)
        for piece, i in table.items():
            size[i] = len(piece)
        _encoders[key] = (tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), size)
    return _encoders[key]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The tokens of the whole text, however long a run of white space it has."""
    out: list[int] = []
    at = 0
    for m in _long_run.finditer(text):
        end = m.end() - (m.end() < len(text))
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def record_sections(values: tuple[str, ...]) -> list[tuple[int, str]]:
    """The default sections of a record: (field number, part) whose parts join up to the encoded text.

    Each field but the last is one section with the space that ends it; the last one is cut into
    lines, each with the line feed that ends it.
    """
    parts = [(i, v + " ") for i, v in enumerate(values[:-1])]
    lines = values[-1].split("\n")
    return parts + [(len(values) - 1, x + "\n") for x in lines[:-1]] + [(len(values) - 1, lines[-1])]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses): sections end at ``bounds``, ascending, and begin where the last one ended."""
    first = np.searchsorted(bounds, starts, side="right")
    last = np.searchsorted(bounds, ends, side="left")
    owner, crossing = (last if rule == "last" else first).copy(), first != last
    if rule == "majority":
        for i in np.flatnonzero(crossing):
            edge = np.clip(bounds[first[i] : last[i] + 1], starts[i], ends[i])
            owner[i] = first[i] + np.argmax(np.diff(edge, prepend=starts[i]))  # ties: the earlier section
    return owner, crossing


def sections_of(values: tuple[str, ...], enc: tiktoken.Encoding, size: np.ndarray, split: Callable, rule: str) -> list[np.ndarray]:
    """Per section: field number, start and end in code points, tokens it owns, and those of them that cross one of its edges."""
    fields, parts = zip(*split(values))
    text = "".join(parts)
    chars = np.cumsum([len(p) for p in parts])
    ends = np.cumsum(size[encode(enc, text)])
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    if not text.isascii():  # from bytes to the characters that they are in
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        starts, ends = char[starts], char[ends - 1] + 1
    owner, crossing = attribute(starts, ends, chars, rule)
    n = len(parts)
    return [np.array(fields), chars - [len(p) for p in parts], chars, np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)]


def _count(shared, names: tuple[str, ...], split: Callable, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(shared.value)
        for batch in sliced(batches, f"_{len(names) - 1}"):
            values = zip(*([x or "" for x in batch.column(f"_{i}").to_pylist()] for i in range(len(names))))
            found = [sections_of(v, enc, size, split, rule) for v in values]
            n = [len(x[0]) for x in found]
            field, *rest = map(np.concatenate, zip(*found))
            at = np.concatenate([np.arange(k) for k in n])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n))),
                    pa.array(at.astype(np.int64)), pa.array(names, pa.string()).take(pa.array(field)), *(pa.array(x.astype(np.int64)) for x in rest),
                ],
                names=["doc_id", "section", "field", "start", "end", "n_tokens", "n_crossing"],
            )

    return run


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("source", "lang", "text"), vocabulary: str = VOCABULARY,
    rule: str = "majority", split: Callable = record_sections,
) -> DataFrame:
    """One row per document and section: doc_id, section (from 0), field, start, end (code points), n_tokens, n_crossing.

    The fields of a row make one record, the last one being the text; it is encoded once, whole, and
    token spans, in characters, are joined to section spans. ``split`` cuts a record into sections
    (see record_sections). A token that holds a part of a character spans that character; a token
    over a boundary belongs to the section that has most of its characters, the earlier one in a tie
    (rule majority), or to that of its first or last character; n_crossing counts those. So n_tokens sums to the tokens of the record. Null fields count as empty; an
    empty text is one empty section. Very long texts, long runs of one character too, take time in
    proportion to their length. Rows are taken one by one: repeated rows give repeated sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = renamed(docs, doc_id=id_col, **{f"_{i}": f for i, f in enumerate(fields)})
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, section long, field string, start long, `end` long, n_tokens long, n_crossing long"
    return rows.mapInArrow(_count(shared, tuple(fields), split, rule), schema)
