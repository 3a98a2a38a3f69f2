"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan over chunks.

A text is a path through the lattice of its pieces. A piece has a weight, two neighbouring pieces have one: 0 if merging
the two alone gives back the same two, minus infinity if not. For a merge vocabulary exactly one path has a finite
weight, and it is the encoding (a sequence of pieces is the merge result if and only if every neighbouring pair is).

Texts up to ``CHUNK`` characters are encoded whole. Longer ones are cut into chunks anywhere, also inside a word:

1. the *states* of a boundary are the pieces that may cover or touch it, known from the few characters around it;
2. each chunk yields its *transfer matrix* over max and plus: the weight of the best path from each state of its left
   boundary to each state of its right one;
3. matrices of a document are combined by max-plus products, an associative operation; a backward pass picks the state
   at every boundary;
4. each chunk is *backtraced* between its two states, independently of all others.

Chunks of all documents are spread over the cluster in steps 2 and 4; step 3 sees only small matrices. Inside a chunk no
piece goes over the start of a word, so the stretch between its first and last word start is encoded by the
SentencePiece library and only the ends need the lattice. A chunk without a word start is all lattice.

The model must keep text as it is (identity normaliser with a space put in front) and have no piece with a space mark after
another character; ``Pieces`` checks this. Its file is a parameter.

Edge cases: a null or empty text has no ids and decodes to the empty text; characters without a piece become byte
pieces; a space mark in the text itself is read as a space, as the library does; null ids and repeated rows are encoded
like any other row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrix.llm.common import documents, shuffle_partitions, stored

CHUNK = 16_384
MARK = "▁"
NEVER = -np.inf


class Pieces:
    """The vocabulary of a model, which pieces can follow each other, and the library's processor."""

    def __init__(self, model_file: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(size)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        self.ids = {names[i]: i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.small = "<u2" if size <= 1 << 16 else "<u4"  # ids on their way to be joined
        self.unknown = m.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids) or m.decode(m.encode("a  b")) != "a  b":
            raise ValueError("the model joins words or changes spaces")
        self.text = [bytes([int(names[i][3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
        self.stable: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the neighbours of best score, the leftmost of equals, until none can be merged."""
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def piece(self, text: str) -> bool:
        """Whether a string can be one piece of an encoding: any single character, or what its characters merge to."""
        if len(text) == 1:
            return True
        if text not in self.ids:
            return False
        if text not in self.stable:
            self.stable[text] = self.merged(text) == [text]
        return self.stable[text]

    def follows(self, left: str, right: str) -> bool:
        if right[0] == MARK and left[-1] != MARK:
            return True
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        if (left, right) not in self.pairs:
            self.pairs[left, right] = self.merged(left + right) == [left, right]
        return self.pairs[left, right]

    def numbers(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def words(self, text: str) -> list[int]:
        """Ids of a stretch that starts at a word."""
        return self.model.encode(text[1:].replace(MARK, " ")) if text else []

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


#: A state of a boundary: start and end of the piece that begins before it, relative to the boundary.
State = tuple[int, int]


def states(pieces: Pieces, text: str, at: int) -> list[State]:
    """Pieces that begin before position ``at`` and end there or after it."""
    found = []
    for a in range(max(0, at - pieces.longest), at):
        for e in range(at, min(len(text), a + pieces.longest) + 1):
            if pieces.piece(text[a:e]) and MARK not in text[a:e].lstrip(MARK):
                found.append((a - at, e - at))
    return found


class Lattice:
    """All paths through text[lo:hi] from some source pieces, which end at or after lo."""

    def __init__(self, pieces: Pieces, text: str, sources: list[State] | None, lo: int, hi: int):
        """``sources``: spans in the text; None: the text begins anew at lo, as one source."""
        self.pieces, self.text, self.sources = pieces, text, sources
        count = len(sources) if sources is not None else 1
        #: by end position: span -> best weight from each source
        self.ends: dict[int, dict[State, np.ndarray]] = {}
        for i, (a, e) in enumerate(sources or []):
            unit = np.full(count, NEVER)
            unit[i] = 0.0
            self.ends.setdefault(e, {})[a, e] = unit
        for p in range(lo, hi):
            before = self.ends.get(p, {})
            if not before and not (sources is None and p == lo):
                continue
            for e in range(p + 1, min(len(text), p + pieces.longest) + 1):
                part = text[p:e]
                if MARK in part.lstrip(MARK):
                    break
                if not pieces.piece(part):
                    continue
                if sources is None and p == lo:
                    best = np.zeros(1)
                else:
                    best = np.full(count, NEVER)
                    for (a, _), weight in before.items():
                        if pieces.follows(text[a:p], part):
                            best = np.maximum(best, weight)
                if best.max() > NEVER:
                    self.ends.setdefault(e, {})[p, e] = best

    def weight(self, span: State) -> np.ndarray:
        count = len(self.sources) if self.sources is not None else 1
        return self.ends.get(span[1], {}).get(span, np.full(count, NEVER))

    def path(self, source: int, span: State, lo: int) -> list[State]:
        """Spans after the source up to and with ``span``, in order."""
        out = []
        while span[0] >= lo and not (self.sources is not None and span == self.sources[source]):
            out.append(span)
            if self.sources is None and span[0] == lo:
                break
            options = [(w[source], s) for s, w in self.ends.get(span[0], {}).items() if w[source] > NEVER and self.pieces.follows(self.text[s[0] : s[1]], self.text[span[0] : span[1]])]
            span = max(options)[1]
        return out[::-1]


class Chunk:
    """One chunk: its characters with the context of both boundaries. ``lo`` and ``hi`` are its own part of the text."""

    def __init__(self, pieces: Pieces, text: str, lo: int, hi: int, first: bool, last: bool):
        self.pieces, self.text, self.lo, self.hi = pieces, text, lo, hi
        self.entry = None if first else [(a + lo, e + lo) for a, e in states(pieces, text, lo)]
        self.exit = [(a + hi, e + hi) for a, e in states(pieces, text, hi) if not last or e == 0]
        begins = [p for p in range(max(lo, 1), hi) if text[p] == MARK != text[p - 1]]
        if first:
            begins = [0, *begins]
        self.inner = (begins[0], begins[-1]) if begins else None
        f, g = self.inner or (hi, hi)
        self.head = None if first else Lattice(pieces, text, self.entry, lo, f)
        self.tail = Lattice(pieces, text, None, g, hi) if self.inner else None

    def matrix(self) -> np.ndarray:
        """Best weight from each entry state (one, if the text begins here) to each exit state."""
        if self.tail is None:
            return np.stack([self.head.weight(x) for x in self.exit], axis=1) if self.exit else np.zeros((len(self.entry), 0))
        out = np.array([self.tail.weight(x)[0] for x in self.exit])
        return self.into()[:, None] + out[None, :]

    def into(self) -> np.ndarray:
        """Best weight from each entry state to the first word start."""
        if self.head is None:
            return np.zeros(1)
        return np.max([np.full(len(self.entry), NEVER), *self.head.ends.get(self.inner[0], {}).values()], axis=0)

    def ids(self, entry: int, leave: int) -> list[int]:
        """Ids of the pieces that begin in this chunk, on the path between two states."""
        spans = lambda found: [n for a, e in found for n in self.pieces.numbers(self.text[a:e])]
        if self.tail is None:
            return spans(self.head.path(entry, self.exit[leave], self.lo))
        f, g = self.inner
        out = []
        if self.head is not None:
            last = max((w[entry], s) for s, w in self.head.ends[f].items())[1]
            out = spans(self.head.path(entry, last, self.lo))
        out += self.pieces.words(self.text[f:g])
        return out + spans(self.tail.path(0, self.exit[leave], g))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """Entry and exit state of every chunk of a document: prefix products, then the best states backwards."""
    prefix = [matrices[0]]
    for m in matrices[1:]:
        prefix.append(product(prefix[-1], m))
    leave = int(prefix[-1][0].argmax())
    found = []
    for k in range(len(matrices) - 1, -1, -1):
        enter = int((prefix[k - 1][0] + matrices[k][:, leave]).argmax()) if k else 0
        found.append((enter, leave))
        leave = enter
    return found[::-1]


def _summary(ids: bytes, pieces: Pieces) -> tuple[int, int, str]:
    return len(ids) // 4, zlib.crc32(ids), hashlib.sha256(pieces.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest()


_ROW = "doc_id long, uid string, n_ids long, ids_crc32 long, decoded_sha256 string"
_CHUNK = ", k int, lo int, hi int, last boolean, chunk string"


def _cut(model_file: str, size: int, with_ids: bool):
    """Encodes short texts; cuts long ones into chunks with context."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if len(text or "") < size:
                    ids = np.array(pieces.model.encode(text or ""), "<u4").tobytes()
                    rows.append((doc, None, *_summary(ids, pieces), None, None, None, None, None, *([np.frombuffer(ids, "<i4")] if with_ids else [])))
                    continue
                whole, uid = MARK + text.replace(" ", MARK), uuid.uuid4().hex
                for k, at in enumerate(range(0, len(whole), size)):
                    end = min(at + size, len(whole))
                    a, e = max(0, at - pieces.longest - 1), min(len(whole), end + pieces.longest + 1)
                    rows.append((doc, uid, None, None, None, k, at - a, end - a, end == len(whole), whole[a:e], *([None] if with_ids else [])))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()] + [pa.list_(pa.int32())] * with_ids
            a = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, kinds)], ["doc_id", "uid", "n_ids", "ids_crc32", "decoded_sha256", "k", "lo", "hi", "last", "chunk", "ids"][: len(kinds)])
    return cut


def _transfer(model_file: str):
    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        for batch in batches:
            rows = []
            for uid, k, lo, hi, last, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "k", "lo", "hi", "last", "chunk"))):
                m = Chunk(pieces, text, lo, hi, k == 0, last).matrix()
                i, j = np.nonzero(m > NEVER)
                rows.append((uid, k, *m.shape, i.tolist(), j.tolist(), m[i, j].tolist()))
            a = list(zip(*rows)) or [()] * 7
            kinds = pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(a, kinds)], ["uid", "k", "rows", "columns", "i", "j", "w"])
    return transfer


def _combine(table: pa.Table) -> pa.Table:
    table = table.sort_by("k")
    matrices = []
    for n, m, i, j, w in zip(*(table[c].to_pylist() for c in ("rows", "columns", "i", "j", "w"))):
        matrices.append(np.full((n, m), NEVER))
        matrices[-1][i, j] = w
    enter, leave = zip(*boundary_states(matrices))
    return pa.table({"uid": table["uid"], "k": table["k"], "enter": pa.array(enter, pa.int32()), "leave": pa.array(leave, pa.int32())})


def _backtrace(model_file: str):
    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        for batch in batches:
            ids = [np.array(Chunk(pieces, text, lo, hi, k == 0, last).ids(a, e), pieces.small).tobytes()
                   for k, lo, hi, last, text, a, e in zip(*(batch.column(c).to_pylist() for c in ("k", "lo", "hi", "last", "chunk", "enter", "leave")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), batch.column("k"), pa.array(ids, pa.binary())], ["doc_id", "uid", "k", "part"])
    return backtrace


def _joined(model_file: str, with_ids: bool):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        for batch in batches:
            whole = [np.frombuffer(b"".join(p["part"] for p in parts), pieces.small).astype("<u4").tobytes() for parts in batch.column("parts").to_pylist()]
            n, crc, sha = zip(*(_summary(x, pieces) for x in whole)) if whole else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), *([pa.array([np.frombuffer(x, "<i4") for x in whole], pa.list_(pa.int32()))] if with_ids else [])],
                                             ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "ids"][: 4 + with_ids])
    return joined


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256[, ids]): one row per input row; the digest is of the decoded ids."""
    more = ", ids array<int>" if with_ids else ""
    table = stored(documents(docs, id_col, text_col).mapInArrow(_cut(model_file, chunk, with_ids), _ROW + _CHUNK + more), "pieces")
    out = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", *(["ids"] if with_ids else [])]
    short = table.where("uid is null").select(*out)
    parts = max(4 * shuffle_partitions(docs.sparkSession), 1)
    chunks = table.where("uid is not null").select("doc_id", "uid", "k", "lo", "hi", "last", "chunk").repartition(parts, "uid", "k")
    matrices = chunks.drop("doc_id").mapInArrow(_transfer(model_file), "uid string, k int, rows int, columns int, i array<int>, j array<int>, w array<double>")
    ways = stored(matrices.groupBy("uid").applyInArrow(_combine, "uid string, k int, enter int, leave int"), "ways")
    traced = (chunks.join(ways, ["uid", "k"]).select("doc_id", "uid", "k", "lo", "hi", "last", "chunk", "enter", "leave")
              .mapInArrow(_backtrace(model_file), "doc_id long, uid string, k int, part binary"))
    whole = traced.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts")).select("doc_id", "parts")
    return short.unionByName(whole.mapInArrow(_joined(model_file, with_ids), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string" + more))


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, int)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(decoded, "doc_id long, text string")
