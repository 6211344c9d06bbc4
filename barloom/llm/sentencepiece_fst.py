"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

The model file compiles into three machines: the normaliser (states with arcs for the space and for
any other character), the pieces (a trie whose paths from the root spell the pieces) and the byte
fallback (a character without a piece becomes its bytes). A text goes through the normaliser and
composes with the pieces and the fallback into a lattice, made state by state as the search reaches
it; the shortest path in the (min, +) semiring is the encoding. A lattice state is a position and
what the machine remembers of the last piece. Unigram models remember nothing and weigh an arc with
minus the piece's score. Merge (BPE) models remember the last piece: the arc of piece b after piece a
has weight 0 if merging a+b alone leaves a and b, else infinity, so a text has exactly one finite
path, the merge result.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, sliced, typed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model file's format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
INFINITY = float("inf")
#: What the machine remembers before the first piece. Labels of arcs are piece ids, or -2 - code point
#: for a character without a piece.
START = -1
#: Positions after which the search puts out the part of the path that can no longer change.
BLOCK = 4096
#: Parts up to this length are remembered with their ids.
SHORT = 48


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protocol-buffer message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class Memo(dict):
    """Remembers a function's results for frequent arguments: two generations of at most ``most`` entries."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        self[key] = value = self.function(key) if value is None else value
        return value


class Row(dict):
    """Weights of the arcs after one remembered piece, by label."""

    __slots__ = ("rows", "memory")

    def __init__(self, rows: "Rows", memory: int):
        super().__init__()
        self.rows, self.memory = rows, memory

    def __missing__(self, label: int) -> float:
        w = self[label] = self.rows.machine.weight(self.memory, label)
        self.rows.held += 1
        return w


class Rows(dict):
    """The arc weights found so far, by remembered piece; begun anew when there are ``most``."""

    def __init__(self, machine: "Transducer", most: int = 500_000):
        super().__init__()
        self.machine, self.most, self.held = machine, most, 0

    def __missing__(self, memory: int) -> Row:
        if self.held > self.most:
            self.clear()
            self.held = 0
        row = self[memory] = Row(self, memory)
        return row


class Normaliser:
    """A machine over characters: in each state an arc for the space and one for all other characters.

    An arc is (next state, output); the arc of another character puts out that character after it.
    States: 0 at the start, 1 inside, 2 behind spaces that are put out as one if a character follows.
    """

    def __init__(self, prefix: bool, squeeze: bool):
        lead = MARK if prefix else ""
        self.space = {0: (0, ""), 1: (2, ""), 2: (2, "")} if squeeze else {0: (1, lead + MARK), 1: (1, MARK)}
        self.other = {0: (1, lead), 1: (1, ""), 2: (1, MARK)}
        self.loops = {k for k, (to, _) in self.space.items() if to == k == self.other[k][0]}

    def __call__(self, text: str) -> str:
        out, state = [], 0
        for at, c in enumerate(text):
            if state in self.loops:  # never left again: all its arcs at once
                out.append(text[at:].replace(" ", self.space[state][1]))
                break
            state, put = self.space[state] if c == " " else self.other[state]
            out.append(put if c == " " else put + c)
        return "".join(out)


class Transducer:
    """The compiled machines of one model file's bytes."""

    def __init__(self, data: bytes, cache: int = 80_000):
        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.kinds: list[int] = []
        self.kind, self.fallback, self.unknown = UNIGRAM, False, 0
        self.prefix, squeeze = True, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self._piece(f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.fallback, self.unknown = f.get(3, UNIGRAM), bool(f.get(35, 0)), f.get(40, 0)
            elif number == 3:
                f = dict(_fields(value))
                self.prefix, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
                if f.get(2) or not f.get(5, 1):
                    raise ValueError("only identity normalisers that escape spaces are supported")
        if self.kind not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("only unigram and merge models without user-defined pieces are supported")
        if self.kind == UNIGRAM and max(self.score.values(), default=0.0) > 0:
            raise ValueError("scores of a unigram model must not be above 0")
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.score.values(), default=0.0)
        self.normal = Normaliser(self.prefix, squeeze)
        self.cut = self._cuts()
        self.rows = Rows(self)
        self.known = Memo(self._ids, cache)
        self.plain = {i for i, k in enumerate(self.kinds) if k == NORMAL}
        self.remembers = self.kind == BPE
        if self.remembers:
            self._compile_merges()
        self.trie = self._compile_pieces(self.stands if self.remembers else self.ids)
        #: Characters that only longer pieces hold.
        self.odd = {c for p in self.ids for c in p} - {p for p in self.ids if len(p) == 1}

    def _piece(self, piece: str, score: float, kind: int) -> None:
        at = len(self.pieces)
        self.pieces.append(piece)
        self.kinds.append(kind)
        if kind in (NORMAL, USER, UNUSED):
            self.ids[piece], self.score[piece] = at, score
        elif kind == BYTE:
            self.byte_id[int(piece[3:5], 16)] = at

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": None, "known": self.known.most}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.rows, self.known = Rows(self), Memo(self._ids, state["known"])

    def _cuts(self) -> re.Pattern:
        """Parts into which every lattice falls: a part ends in front of a mark, and behind a letter, digit
        or _ in front of another sign, except where a piece has such a pair inside."""
        if any(MARK in p.lstrip(MARK) for p in self.ids) or not self.fallback:  # unknown pieces in a row are one, over parts too
            return re.compile("(?s).+")
        sign = rf"[^\w{MARK}]"
        pair = re.compile(rf"(?=(\w){sign})")
        bound = re.escape("".join(sorted({x for p in self.ids for x in pair.findall(p)})))
        more = rf"(?:(?<=[{bound}]){sign}+\w*)*" if bound else ""
        return re.compile(rf"(?:{MARK}+{sign}*\w*|{sign}+\w*|\w+){more}")

    def _compile_merges(self) -> None:
        """Each piece's last merge, as (left, right), and its rank among the merges.

        ``stands`` are the pieces that merging alone makes; only those can be in an encoding.
        """
        self.rank = {piece: i for i, piece in enumerate(sorted(self.ids, key=lambda p: -self.score[p]))}
        self.split: dict[str, tuple[str, str]] = {}
        self.stands: set[str] = set()
        for piece in self.ids:
            parts = self._merged(piece, keep=2)
            if len(piece) == 1 or len(parts) == 2:
                self.stands.add(piece)
                if len(piece) > 1:
                    self.split[piece] = (parts[0], parts[1])

    def _compile_pieces(self, pieces) -> dict:
        """The pieces as a machine: a node maps a character to (node, arcs), the arcs being (length, id) of
        every piece on the way here. The first arc is always the character's own: its piece or its fallback."""
        root: dict = {}
        for piece in sorted(pieces, key=len):  # shorter ones first, so that the way there is complete
            node, found = root, ((1, -2 - ord(piece[0])),)
            for c in piece[:-1]:
                node, found = node.setdefault(c, ({}, found))
            arc = (len(piece), self.ids[piece])
            node[piece[-1]] = (node.get(piece[-1], ({},))[0], (arc,) if len(piece) == 1 else (*found, arc))
        return root

    def _merged(self, s: str, keep: int = 1) -> list[str]:
        """The merges of a short string, best score first, leftmost in a tie, down to ``keep`` parts."""
        parts = list(s)
        while len(parts) > keep:
            best = None
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best[0]):
                    best = (score, i)
            if best is None:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _follows(self, a: str, b: str) -> bool:
        """Whether merging a+b leaves a and b, that is, the arc of b after a has weight 0.

        Both pieces are taken apart along their last merges, the later one first; wherever the two
        inner edges could themselves merge before the merge just undone, the pair breaks. Runs of
        marks merge with equal scores, by place; those pairs are merged outright.
        """
        if MARK in b or a[-1] == MARK or len(a) == 1 and a not in self.ids or len(b) == 1 and b not in self.ids:
            return self._merged(a + b) == [a, b]
        return self._apart(a, b)

    def _apart(self, a: str, b: str) -> bool:
        rank, split = self.rank, self.split
        limit = len(rank)  # merges of rank below this happen before the merge that was undone last
        while True:
            joint = rank.get(a + b)
            if joint is not None and joint < limit:
                return False
            ra, rb = (rank[a] if a in split else -1), (rank[b] if b in split else -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, split[a][1]
            else:  # a merge on the left goes first in a tie, so one of the same rank still breaks the pair
                limit, b = rb + 1, split[b][0]

    def weight(self, memory: int, label: int) -> float:
        """The weight of an arc after what the machine remembers."""
        if not self.remembers:
            return -self.score[self.pieces[label]] if label >= 0 else UNKNOWN_PENALTY - self.least
        if memory == START:
            return 0.0
        a, b = (self.pieces[x] if x >= 0 else chr(-2 - x) for x in (memory, label))
        alone = memory < 0 and a not in self.odd or label < 0 and b not in self.odd  # in no piece, so never merged
        return 0.0 if alone or self._follows(a, b) else INFINITY

    def arcs(self, s: str, at: int) -> tuple[tuple[int, int], ...]:
        """The lattice's arcs that leave a position: (length, label) of the pieces that begin here, shortest first."""
        node, found = self.trie, None
        for c in s[at : at + self.longest]:
            step = node.get(c)
            if step is None:
                break
            node, found = step
        return found or ((1, -2 - ord(s[at])),)

    def shortest_path(self, s: str) -> list[int]:
        """The labels of the shortest path over a normalised string; ties: the longer piece at the last difference.

        States are taken by least cost, among equals the farthest first, until the end is reached
        (weights are never negative). All finite ways to a position remember the same piece, so each
        position holds one state: [cost, position before, label]. Long strings are swept instead, and arcs of merge
        models are weighed late.
        """
        n = len(s)
        if n > BLOCK:
            return self._swept(s)
        if self.remembers:
            return self._shortest_merges(s)
        rows, arcs = self.rows, self.arcs
        ways: list = [None] * (n + 1)
        queue: list[tuple[float, int]] = []
        cost, at, memory = 0.0, 0, START
        while at < n:
            row = rows[memory]
            for size, label in arcs(s, at):
                w = row[label]
                if w != INFINITY:
                    end, total = at + size, cost + w
                    have = ways[end]
                    if have is None or total < have[0]:
                        ways[end] = (total, at, label)
                        heappush(queue, (total, -end))
                    elif total == have[0] and at < have[1]:
                        ways[end] = (total, at, label)
            while True:
                cost, at = heappop(queue)
                way = ways[-at]
                if cost == way[0]:
                    break
            at = -at
        out = []
        while at:
            _, at, label = ways[at]
            out.append(label)
        return out[::-1]

    def _shortest_merges(self, s: str) -> list[int]:
        """The same where every finite weight is 0 and a position has one finite way at most.

        All states cost the same, so the farthest comes first, and an arc is weighed only when its end is the farthest
        of all that are open; a state's shorter arcs wait in the queue: (-end, position, arcs left, arcs, memory).
        """
        n, rows, root, longest = len(s), self.rows, self.trie, self.longest
        ways: list = [None] * (n + 1)
        queue: list[tuple] = []
        at, memory = 0, START
        while at < n:
            node, found = root, None
            for c in s[at : at + longest]:
                step = node.get(c)
                if step is None:
                    break
                node, found = step
            if found is None:
                found = ((1, -2 - ord(s[at])),)
            row, left = rows[memory], len(found)
            while True:
                if left:
                    size, label = found[left - 1]
                    end = at + size
                    if queue and queue[0][0] < -end:
                        _, at, left, found, memory = heapreplace(queue, (-end, at, left, found, memory))
                        row = rows[memory]
                        continue
                    left -= 1
                    if row[label] != INFINITY:
                        break
                else:
                    _, at, left, found, memory = heappop(queue)
                    row = rows[memory]
            if left:
                heappush(queue, (-at - found[left - 1][0], at, left, found, memory))
            ways[end] = (at, label)
            at, memory = end, label
        out = []
        while at:
            at, label = ways[at]
            out.append(label)
        return out[::-1]

    def _swept(self, s: str) -> list[int]:
        """The same by position: after every block all open ways are traced back to where they meet, and what
        lies before is put out, so that memory stays small."""
        out: list[int] = []
        ahead: dict[int, list] = {0: [0.0, None, START, 0]}
        for at in range(len(s)):
            way = ahead.pop(at, None)
            if way is not None:
                row = self.rows[way[2] if self.remembers else START]
                for size, label in self.arcs(s, at):
                    total, have = way[0] + row[label], ahead.get(at + size)
                    if total < (INFINITY if have is None else have[0]):
                        ahead[at + size] = [total, way, label, at + size]
            if at % BLOCK == BLOCK - 1 or at == len(s) - 1:
                open_ = {w[3]: w for w in ahead.values()}
                while len(open_) > 1:
                    before = open_.pop(max(open_))[1]
                    open_[before[3]] = before
                (end,) = open_.values()
                found, way = [], end
                while way[1] is not None:
                    found.append(way[2])
                    way = way[1]
                end[1] = None
                out += found[::-1]
        return out

    def _spelled(self, label: int) -> list[int]:
        """The output of an arc: a piece, the bytes of a character, or the unknown piece."""
        if label >= 0:
            return [label]
        return [self.byte_id[b] for b in chr(-2 - label).encode("utf-8", "replace")] if self.fallback else [self.unknown]

    def _ids(self, part: str) -> bytes:
        """The ids of the shortest path over one part of a text, as 32-bit numbers; unknown pieces in a row are one."""
        path = self.shortest_path(part)
        if min(path, default=0) < 0:
            if not self.fallback:
                path = [x for x, before in zip(path, [0, *path]) if x >= 0 or before >= 0]
            path = list(chain.from_iterable(map(self._spelled, path)))
        return struct.pack(f"={len(path)}i", *path)

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut.findall(self.normal(text))
        known = self.known
        return np.frombuffer(b"".join([known[p] if len(p) <= SHORT else self._ids(p) for p in parts]), np.int32)

    def decode(self, ids: list[int]) -> str:
        ids = ids if isinstance(ids, list) else list(map(int, ids))
        pieces, kinds = self.pieces, self.kinds
        if not self.plain.issuperset(ids):
            out: list[str] = []
            run = bytearray()
            for i in ids:
                if kinds[i] == BYTE:
                    run.append(int(pieces[i][3:5], 16))
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                if kinds[i] == UNKNOWN:
                    out.append(" ⁇ ")
                elif kinds[i] != CONTROL:
                    out.append(pieces[i])
            out.append(run.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join(map(pieces.__getitem__, ids))
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _encode(shared, column: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Transducer = shared.value
        low, high = (min(m.byte_id.values()), max(m.byte_id.values())) if m.byte_id else (0, -1)
        for batch in sliced(batches, column, 1 << 20):
            collects = gc.isenabled()
            gc.disable()  # encoding makes no cycles, and its many short-lived tuples would have the tables traversed
            try:
                ids = [m.encode(t or "") for t in batch.column(column).to_pylist()]
            finally:
                if collects:
                    gc.enable()
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            n_bytes = [int(((x >= low) & (x <= high)).sum()) for x in ids]
            texts = [pa.array([m.decode(x.tolist()) for x in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(n_bytes, pa.int64()), *texts],
                names=[*batch.schema.names, "ids", "n_byte_pieces", *["decoded"] * decoded],
            )

    return run


def _decode(shared, column: str, to: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Transducer = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                col = batch.column(column)
                flat, ends = col.flatten().to_numpy(), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in col)])
                texts = [m.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(ends, ends[1:], col.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return run


def encode_documents(docs: DataFrame, text_col: str = "text", model: str = MODEL, decoded: bool = False) -> DataFrame:
    """Add ids (array of int) and n_byte_pieces to every row: the encoding of the whole text; with
    ``decoded`` also the text that the ids stand for, in the same pass.

    Null or empty text has no ids and decodes to the empty text. Columns of docs stay; ids,
    n_byte_pieces and decoded are replaced if docs has them. Rows are encoded one by one, so
    repeated rows get equal ids. A very long text, with or without breaks, takes time in proportion
    to its length, and memory for its own ids and pieces.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Transducer(read_model(model)))
    rows = docs.drop("ids", "n_byte_pieces", *["decoded"] * decoded)
    schema = [*typed(rows), "ids array<int>", "n_byte_pieces long", *["decoded string"] * decoded]
    return rows.mapInArrow(_encode(shared, text_col, decoded), ", ".join(schema))


def decode_documents(encoded: DataFrame, ids_col: str = "ids", to: str = "decoded", model: str = MODEL) -> DataFrame:
    """Add the text of an array of ids; null ids give null, no ids the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Transducer(read_model(model)))
    rows = encoded.drop(to)
    return rows.mapInArrow(_decode(shared, ids_col, to), ", ".join([*typed(rows), f"`{to}` string"]))
