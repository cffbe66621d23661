"""SentencePiece BPE encoding and decoding by a table of prefixes: for every prefix of a string, the one token that the
merge order leaves last. Tokens that end at a place come from an automaton; a token is the last of a prefix if the
prefix before it has a last token and the two are compatible, that is, no merge would ever cross their boundary. Ids are
then read backwards from the end.

Texts are cut first where no piece of the vocabulary holds the two neighbouring bytes, since no merge can cross there;
a task encodes each distinct stretch once and gathers ids of whole blocks with numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.textblock import Words, blocks

#: The sign that stands for a blank in pieces; in a text it means a blank as well.
BLANK = "▁"
_BLANK = BLANK.encode()


@lru_cache(maxsize=2)
def _library(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def merged(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Plain BPE: merge the best pair, leftmost first, until none is left; the symbols and the last pair merged.

    The definition, used for the vocabulary's own pieces and wherever ranks tie.
    """
    symbols, last = list(symbols), None
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            return symbols, last
        i = best[1]
        last = (symbols[i], symbols[i + 1])
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@dataclass
class PieceModel:
    """Pieces of a BPE model with byte fallback: texts, ranks (0: merged first) and for each piece the last pair merged.

    Its size is the vocabulary's.
    """

    path: str
    end_id: int
    ids: dict[str, int]
    rank: dict[str, int]
    parts: dict[str, tuple[str, str] | None]
    plain: set[str]
    bytes_at: list[int]
    memo: dict[tuple[str, str], bool] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        sp = _library(path)
        n = sp.vocab_size()
        bytes_at = [i for i in range(n) if sp.is_byte(i)]
        if len(bytes_at) != 256 or any(sp.id_to_piece(i) != f"<0x{b:02X}>" for b, i in enumerate(bytes_at)):
            raise ValueError(f"{path}: a model without byte fallback")
        ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        score = {p: sp.get_score(i) for p, i in ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        if not {c for p in ids for c in p} <= set(ids):
            raise ValueError(f"{path}: pieces hold characters that are no pieces")
        ties: dict[int, int] = {}
        for p, r in rank.items():
            ties[r] = ties.get(r, 0) + (len(p) > 1)
        parts: dict[str, tuple[str, str] | None] = {}
        for p in ids:
            left, last = merged(list(p), rank)
            if len(left) == 1:  # the others are never made by merging
                parts[p] = last
        # pieces with a rank of their own that is later than those of their parts
        plain = {p for p, two in parts.items() if two is None or (ties[rank[p]] == 1 and all(len(x) == 1 or rank[x] < rank[p] for x in two))}
        while True:
            good = {p for p in plain if parts[p] is None or set(parts[p]) <= plain}
            if len(good) == len(plain):
                break
            plain = good
        return cls(path, sp.eos_id(), ids, rank, parts, plain, bytes_at)

    def spine(self, piece: str, side: int) -> list[tuple[str, int, float]]:
        """The symbols that stand at one end of a piece while it is merged: (symbol, made at, gone at), outermost first."""
        out, gone = [], float("inf")
        while True:
            two = self.parts[piece]
            made = self.rank[piece] if two else -1
            out.append((piece, made, gone))
            if not two:
                return out
            piece, gone = two[side], made

    def compatible(self, a: str, b: str) -> bool:
        """Whether BPE of a + b ends in these two tokens: no merge crosses the boundary before either side is complete.

        Answers are kept, 300,000 at most at a time.
        """
        known = self.memo.get((a, b))
        if known is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            if a not in self.ids:  # a character that no merge touches
                known = True
            elif a in self.plain and b in self.plain:
                known = True
                for x, made_x, gone_x in self.spine(a, 1):
                    for y, made_y, gone_y in self.spine(b, 0):
                        r = self.rank.get(x + y)
                        # alive together, and merged before either is used up; of equal ranks the left merge is first
                        if r is not None and max(made_x, made_y) < min(gone_x, gone_y) and r < gone_x and r <= gone_y:
                            known = False
            else:
                known = merged(list(a + b), self.rank)[0] == [a, b]
            self.memo[(a, b)] = known
        return known

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in self.parts:
            a.add_word(p, p)
        a.make_automaton()
        return a

    def neighbours(self) -> np.ndarray:
        """256 x 256: whether some piece holds the two bytes side by side; a blank is one byte here."""
        out = np.zeros((256, 256), bool)
        for p in self.ids:
            b = np.frombuffer(p.replace(BLANK, " ").encode(), np.uint8)
            out[b[:-1], b[1:]] = True
        return out


def encode_stretch(text: str, model: PieceModel, automaton) -> list[int]:
    """Ids of one stretch, blanks already as their sign: the table of last tokens by prefix, read from the end."""
    n = len(text)
    last: list[str | None] = [None] * n
    if not model.ids.keys() >= set(text):
        for i, c in enumerate(text):
            if c not in model.ids:
                last[i] = c  # no merge touches it: it is last wherever the prefix before it ends in a token, as all do
    memo, test = model.memo, model.compatible
    for end, piece in automaton.iter(text):
        before = end - len(piece)
        if before < 0:
            last[end] = piece
        else:
            known = memo.get((last[before], piece))
            if test(last[before], piece) if known is None else known:
                last[end] = piece
    out: list[int] = []
    at = n - 1
    while at >= 0:
        piece = last[at]
        i = model.ids.get(piece)
        if i is None:
            out += [model.bytes_at[b] for b in reversed(piece.encode())]
        else:
            out.append(i)
        at -= len(piece)
    return out[::-1]


class Stretches(Words):
    """A block cut into stretches that merges do not leave; each non-empty text has a blank put in front."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, near: np.ndarray):
        full = offs[1:] > offs[:-1]
        self.raw = raw = np.insert(raw, offs[:-1][full], 32)
        offs = offs + np.concatenate(([0], np.cumsum(full)))
        self.inside = np.ones(len(raw), bool)
        edge = np.zeros(len(raw), bool)
        edge[1:] = ~near[raw[:-1], raw[1:]] & ((raw[1:] & 0xC0) != 0x80)
        edge[offs[:-1][full]] = True
        self.starts = np.flatnonzero(edge)
        self.ends = np.append(self.starts[1:], len(raw)) if len(self.starts) else self.starts
        self.first = np.searchsorted(self.starts, offs)


class Encoder:
    """Ids of the stretches met so far in a task, by 64-bit hash; it starts anew beyond `most` ids."""

    def __init__(self, model: PieceModel, most: int = 2_000_000):
        self.model, self.automaton, self.near, self.most = model, model.automaton(), model.neighbours(), most
        self.clear()

    @staticmethod
    @lru_cache(maxsize=1)
    def of(path: str) -> Encoder:
        """One encoder a worker, which its later tasks find warm."""
        return Encoder(PieceModel.load(path))

    def clear(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _add(self, keys: np.ndarray, stretches: list[bytes]) -> None:
        found = [encode_stretch(s.decode().replace(" ", BLANK), self.model, self.automaton) for s in stretches]
        count = np.fromiter(map(len, found), np.int64, len(found))
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *(np.array(x, np.int32) for x in found)])
        keys, start, count = (np.concatenate(x) for x in ((self.keys, keys), (self.start, start), (self.count, count)))
        order = np.argsort(keys)
        self.keys, self.start, self.count = keys[order], start[order], count[order]

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block in order, and offsets by text; without end ids."""
        if (raw == _BLANK[0]).any():
            texts = [raw[a:b].tobytes().replace(_BLANK, b" ") for a, b in zip(offs, offs[1:], strict=False)]
            offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            raw = np.frombuffer(b"".join(texts), np.uint8)
        cut = Stretches(raw, offs, self.near)
        if not len(cut):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        uniq, where, back = np.unique(cut.hashes(), return_index=True, return_inverse=True)
        if len(self.ids) > self.most:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        new = self.keys[at] != uniq if len(self.keys) else np.ones(len(uniq), bool)
        if new.any():
            self._add(uniq[new], cut.bytes_of(where[new]))
        at = np.searchsorted(self.keys, uniq)[back]
        count, start = self.count[at], self.start[at]
        into = np.cumsum(count) - count
        ids = self.ids[np.arange(int(count.sum())) - np.repeat(into - start, count)]
        return ids, np.concatenate(([0], np.cumsum(count)))[cut.first]


class Decoder:
    """Texts of id lists: the pieces' bytes one after another, blanks for their sign, less the blank put in front."""

    def __init__(self, path: str):
        sp = _library(path)
        texts = []
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                texts.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
            elif sp.is_control(i):
                texts.append(b"")
            elif sp.is_unknown(i):
                texts.append(sp.decode([i]).encode())
            else:
                texts.append(sp.id_to_piece(i).replace(BLANK, " ").encode())
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.blank = np.array([t.startswith(b" ") and not sp.is_byte(i) for i, t in enumerate(texts)])
        self.silent = np.array([sp.is_control(i) for i in range(len(texts))])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of one list of ids; bytes that make no character become U+FFFD, one for each byte."""
        ids = ids[~self.silent[ids]]
        if not len(ids):
            return b""
        size = self.size[ids]
        into = np.cumsum(size) - size
        out = self.data[np.arange(int(size.sum())) - np.repeat(into - self.start[ids], size)].tobytes()
        out = out[1:] if self.blank[ids[0]] else out
        try:
            out.decode()
        except UnicodeDecodeError:
            out = out.decode(errors="surrogateescape").encode("utf-16", "surrogatepass").decode("utf-16", "surrogatepass")
            out = "".join("�" if "\udc80" <= c <= "\udcff" else c for c in out).encode()
        return out


def agrees(path: str) -> bool:
    """Whether both ways agree with the library on the vocabulary's own pieces, side by side and alone, and odd texts."""
    sp, encoder, decoder = _library(path), Encoder.of(path), Decoder(path)
    pieces = [p.replace(BLANK, " ") for p in encoder.model.ids]
    texts = ["", " ", "  a", "a  b   c \n\t x", f"{BLANK}x {BLANK}{BLANK}", "\U0001f9ff\u0001͸ <0x41></s>", "".join(pieces), "".join(reversed(pieces)), *pieces[::7]]
    encoder.clear()
    whole = [t.encode() for t in texts]
    ids, at = encoder.encode(np.frombuffer(b"".join(whole), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in whole]))))
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    return got == sp.encode(texts) and all(decoder.decode(np.array(x, np.int64)).decode() == sp.decode(x) for x in got)


def piece_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of whole texts, and with_ids the ids and the decoded text themselves.

    A null or empty text has only the end id. A text may hold any characters: those without a piece become bytes. Very
    long texts are blocks of their own and very long stretches take time in proportion; repeated rows give repeated
    rows, an empty table none; other columns play no part. A model that is not BPE with byte fallback, or whose
    normaliser changes more than blanks, is refused.
    """
    if not agrees(model_path):
        raise ValueError(f"{model_path}: not the kind of model that this operator encodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder.of(model_path), Decoder(model_path)
        tail = np.array([encoder.model.end_id] if end else [], np.int32)
        for batch in batches:
            for a, b, raw, offs in blocks(batch.column(1)):
                ids, at = encoder.encode(raw, offs)
                n, sha, back, lists, texts = [], [], [], [], []
                for i in range(b - a):
                    mine = np.concatenate((ids[at[i] : at[i + 1]], tail))
                    text = decoder.decode(mine)
                    n.append(len(mine))
                    sha.append(hashlib.sha256(" ".join(map(str, mine.tolist())).encode()).hexdigest())
                    back.append(hashlib.sha256(text).hexdigest())
                    if with_ids:
                        lists.append(mine)
                        texts.append(text.decode())
                arrays = [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(lists, pa.list_(pa.int32())), pa.array(texts)], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    more = ", ids array<int>, decoded string" if with_ids else ""
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)
