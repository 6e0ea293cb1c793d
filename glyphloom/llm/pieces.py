"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file gives the pieces, the normaliser's switches and the byte pieces. Three machines are made from them once a worker:

* the normaliser N: an arc without input that writes U+2581 (the dummy prefix), one from the space to U+2581, and one from
  every other character to itself (a model with a character map of its own is refused);
* the pieces P: a tree of character arcs; where a piece is spelled out, an arc back to the root writes its id;
* byte fallback B: for a character in no piece of its own, an arc from root to root that writes it, later as the ids of its
  UTF-8 bytes.

N is composed with the closure of P and B when they are compiled: every arc that reads U+2581 in the tree also gets the raw space
as its input. ``Transducer.lattice`` composes that machine with an input: its arcs are (start, end, symbol). The weights are a fourth machine
over pairs of symbols: for a byte-pair model an arc weighs 0 after a symbol that merging would leave untouched next to it and
``PENALTY`` otherwise. (Scores as weights would give another result, the best-scored segmentation.) The output is the path with the least sum of weights, the tropical semiring's (min, +) shortest distance,
found place by place: a state is a place and the symbol that ends there, as an arc's weight depends on both. First only arcs of
weight 0 are relaxed, which is exact if they reach the end, and they do in every text tried; else all are. Of equal paths the one whose last
symbol is longer stays.

No piece has U+2581 after another character, so the lattice falls apart before each run of U+2581, and the shortest path is the
concatenation of the parts' shortest paths. Those of short parts are kept in two generations of bounded size.

Defined cases: a null or empty text has no ids; U+2581 in a text reads as a space, as in the library; repeated rows each get
their row; an empty table gives no rows; other columns, whatever their names, are ignored. A text's ids and its decoded form are held
whole, one text at a time.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glyphloom.llm.shared import Tidy, keep, text_rows

SPACE = "▁"
CACHE = 120_000  # parts in a generation
PAIRS = 300_000  # weights kept
CACHED_LENGTH = 40  # longer parts are seldom met again
PENALTY = 1.0
PLACES = 22  # bits of a symbol: ids, then characters without one
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
_PARTS = re.compile(f"[{SPACE} ]*[^{SPACE} ]+|[{SPACE} ]+")


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not m.trainer_spec.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback and no character map are supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        kinds = [p.type for p in m.pieces]
        self.spelling = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.encode() if p.type in (NORMAL, USER) else b"" for p in m.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.names = {i: p.piece for i, p in enumerate(m.pieces) if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.names.values()):
            raise ValueError("a piece spans words")
        long = {p: -m.pieces[i].score for i, p in self.names.items() if len(p) > 1}
        turns = {v: i for i, v in enumerate(sorted(set(long.values())))}
        self.rank = {p: turns[v] for p, v in long.items()}  # when a merge's turn comes
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[int, float] = {}
        self.codes: dict[int, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.many = len(kinds)
        self.single = {p: i for i, p in self.names.items() if len(p) == 1}
        self.arcs = self._compile()
        self.heads = {chr(k): (self._symbol(chr(k)), to) for k, (to, _) in self.arcs.items() if k < 1 << PLACES}
        self.inside = {p[i : i + 2] for p in self.names.values() for i in range(len(p) - 1)}

    # -- the machines -----------------------------------------------------------------------------------------------

    def _compile(self) -> dict[int, tuple[int, int]]:
        """Arcs of N composed with P: by (state, character), the next state and the piece that is spelled there, or -1.

        The machine is reversed, so that from a place it finds the arcs that enter it. A piece that merging can't make is on no
        path, so it gets no arcs.
        """
        arcs, states = {}, 1
        for i, piece in self.names.items():
            if len(piece) > 1 and not self._halves(piece):
                continue
            state = 0
            for k, char in enumerate(reversed(piece), 1):
                key = state << PLACES | ord(char)
                to, symbol = arcs.get(key, (0, -1))
                if not to:
                    to = states
                    states += 1
                for label in (SPACE, " ") if char == SPACE else (char,):
                    arcs[state << PLACES | ord(label)] = (to, i if k == len(piece) else symbol)
                state = to
        return arcs

    def _symbol(self, char: str) -> int:
        """A character's own piece, or the arc of byte fallback that writes it."""
        char = SPACE if char == " " else char
        return self.single.get(char, self.many + ord(char))

    def _name(self, symbol: int) -> str:
        return self.names[symbol] if symbol < self.many else chr(symbol - self.many)

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """What the last merge of a piece puts together; None if merging its characters doesn't make it."""
        if piece not in self.halves:
            parts, last = list(piece), None
            while len(parts) > 1:
                best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None), default=None)
                if best is None:
                    break
                last = (parts[best[1]], parts[best[1] + 1])
                parts[best[1] : best[1] + 2] = [last[0] + last[1]]
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def _untouched(self, a: str, b: str) -> bool:
        """Whether at no time merging had a merge across the border of a and b.

        Going back in time, the piece made last is undone; what then touched the border could have merged across it only
        before that, at the same turn only if it stood further left.
        """
        rank, until = self.rank, len(self.rank)
        while True:
            across = rank.get(a + b)
            if across is not None and across < until:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra > rb:
                until, a = ra, self._halves(a)[1]
            elif rb >= 0:
                until, b = rb + 1, self._halves(b)[0]
            else:
                return True

    def weight(self, before: int, symbol: int) -> float:
        """An arc's weight after a symbol; the first arc of a path weighs nothing."""
        key = before << PLACES | symbol
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = 0.0 if self._untouched(self._name(before), self._name(symbol)) else PENALTY
        return got

    # -- composition and shortest path ------------------------------------------------------------------------------

    def lattice(self, part: str, end: int) -> list[tuple[int, int]]:
        """The arcs (start, symbol) of the composition with ``part`` that enter one place, shorter ones first."""
        at = end - 1
        out, state = [(at, self._symbol(part[at]))], self.arcs.get(ord(part[at]), (None,))[0]
        while state is not None and at:
            at -= 1
            state, symbol = self.arcs.get(state << PLACES | ord(part[at]), (None, -1))
            if symbol >= 0:
                out.append((at, symbol))
        return out

    def shortest(self, part: str) -> tuple[float, list[int]]:
        """The least weight of a path through the lattice, and its symbols.

        Here the arcs of ``lattice`` are followed and relaxed in one. No weight is below 0, so a place reached at 0 is final; merging
        has one result for each prefix, so only one symbol ends there at 0.
        """
        follow, heads, weigh = self.arcs.get, self.heads, self.pairs.get
        points, last, back = [ord(c) for c in part], [-1], [0]
        for end, char in enumerate(part, 1):
            at = end - 1
            head = heads.get(char)
            symbol, state = (self.many + ord(char), 0) if head is None else head
            while True:
                if symbol >= 0:
                    if not at:
                        break
                    before = last[at]
                    if before >= 0:
                        w = weigh(before << PLACES | symbol)
                        if w is None:
                            w = self.weight(before, symbol)
                        if not w:
                            break
                if not state or not at:
                    symbol = -1
                    break
                at -= 1
                arc = follow(state << PLACES | points[at])
                if arc is None:
                    symbol = -1
                    break
                state, symbol = arc
            last.append(symbol)
            back.append(at)
        if symbol < 0:
            return self._relaxed(part)
        out, at = [], len(part)
        while at:
            out.append(last[at])
            at = back[at]
        return 0.0, out[::-1]

    def _relaxed(self, part: str) -> tuple[float, list[int]]:
        """The same with arcs of any weight: every state is a place and the symbol that ends there."""
        states: list[dict[int, tuple[float, int, int]]] = [{-1: (0.0, 0, -1)}]
        for end in range(1, len(part) + 1):
            states.append({})
            for start, symbol in self.lattice(part, end):
                states[end][symbol] = min((w + (self.weight(before, symbol) if start else 0.0), start, before) for before, (w, _, _) in states[start].items())
        at = len(part)
        total, _, symbol = min((state[0], state[1], s) for s, state in states[at].items())
        out = []
        while at:
            out.append(symbol)
            _, at, symbol = states[at][symbol]
        return total, out[::-1]

    def _code(self, symbol: int) -> bytes:
        ids = [symbol] if symbol < self.many else [self.bytes[b] for b in chr(symbol - self.many).encode("utf-8", "surrogatepass")]
        if len(self.codes) >= CACHE:
            self.codes.clear()
        got = self.codes[symbol] = np.asarray(ids, "<u4").tobytes()
        return got

    def _part(self, part: str) -> bytes:
        codes = self.codes
        return b"".join([codes.get(s) or self._code(s) for s in self.shortest(part)[1]])

    def _word(self, word: str) -> bytes:
        """The part of a space and a word, kept under the word."""
        got = self.young.get(word) or self.old.get(word)
        if got is None:
            if len(word) > 2 and word[-1] in ",." and word[-2:] not in self.inside:  # no arc spans such a place either
                got = self._word(word[:-1]) + (self.tails.get(word[-1]) or self.tails.setdefault(word[-1], self._part(word[-1])))
            else:
                got = self._part(" " + word)
            if len(word) > CACHED_LENGTH:
                return got
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text or not self.prefix:
            return np.frombuffer(b"".join([self._part(p) for p in _PARTS.findall(self.prefix + text)]), "<u4")
        words = text.split(" ")  # each is a part with a space before it
        out = list(map(self.young.get, words))
        for i in [i for i, got in enumerate(out) if got is None]:
            out[i] = self._word(words[i])
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """The inverse: runs of bytes become characters, the dummy prefix goes."""
        text = b"".join(map(self.spelling.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
        keep("pieces", _loaded.clear)
    return _loaded[path]


@dataclass(frozen=True)
class _Encode:
    path: str
    keep_ids: bool

    def __call__(self, batches):
        t, schema = transducer(self.path), _schema(self.keep_ids)
        for batch in batches:
            columns = [[] for _ in schema]
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = t.encode(text)
                back = t.decode(ids.tolist())
                row = (len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text.replace(SPACE, " "), ids.view(np.int32))
                for column, value in zip(columns[1:], row, strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(schema)[1:], strict=True))], schema=schema)


def _schema(keep_ids: bool) -> pa.Schema:
    fields = [("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())]
    return pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, checksums of the ids and of the text decoded from them, whether that is the text, and the ids if asked for."""
    columns = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + (", ids array<int>" if keep_ids else "")
    return text_rows(docs).mapInArrow(Tidy(_Encode(model, keep_ids), "pieces"), columns)
