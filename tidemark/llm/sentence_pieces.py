"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text is read once, character by character. An automaton over the pieces tells at each boundary
which pieces end there, and each boundary keeps its best way back to an earlier one. Only boundaries
within the longest piece's length of the newest can still be built on: that is the window. Once all
ways back out of the window run through one boundary, the ids before it are final and are given out,
so memory is bounded by the window and by how far back ways differ, not by the text.

What "best" means comes from the model file. For a unigram model it is the largest sum of scores.
A BPE model's text is what its merges make; a row of pieces is that result exactly if each two
neighbours would come out as they are if merged alone (merges happen in order of rank, and nothing
but the two neighbours decides whether one happens across their boundary). So for a BPE model a
way is ruled out unless its last two pieces may follow each other, and exactly one is left at each boundary.

All ways meet before a space mark that follows another character if no piece reaches over one. What
lies between two such places, a stretch, has the same ids whatever is around it, so a worker keeps
the ids of stretches that it met lately; every other stretch is searched.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bounds on what a worker keeps: stretches whose ids it knows (as Remembered counts them), pairs of pieces.
KNOWN_BYTES, KNOWN_PAIRS = 40_000_000, 600_000
#: What a character outside all pieces costs beside the lowest score of a unigram model.
UNKNOWN_COST = 10.0


@dataclass(frozen=True)
class PieceModel:
    """pieces: piece to (id, score). byte_ids: id of each byte's piece, or none. texts: bytes of each id."""

    bpe: bool
    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    unknown: int
    texts: tuple[bytes, ...]


def read_model(path: str = MODEL) -> PieceModel:
    """The model in a file; what this module does not do raises ValueError (see ``_check_supported``)."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    _check_supported(proto)
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece.Type
    pieces, raw, unknown, texts = {}, {}, 0, []
    for i, p in enumerate(proto.pieces):
        text = b""
        if p.type == kind.NORMAL:
            pieces[p.piece] = (i, p.score)
            text = p.piece.replace(SPACE, " ").encode()
        elif p.type == kind.BYTE:
            raw[int(p.piece[3:5], 16)] = i
            text = bytes([int(p.piece[3:5], 16)])
        elif p.type == kind.UNKNOWN:
            unknown, text = i, " ⁇ ".encode()
        elif p.type != kind.CONTROL:
            raise ValueError(f"pieces of type {p.type} are not supported")
        texts.append(text)
    bytes_known = tuple(raw[b] for b in range(256)) if len(raw) == 256 else ()
    return PieceModel(proto.trainer_spec.model_type == 2, pieces, bytes_known, unknown, tuple(texts))


def _check_supported(proto) -> None:
    """Unigram and BPE models without a character map, with a space put in front and all white space kept."""
    rules, trainer = proto.normalizer_spec, proto.trainer_spec
    wrong = {
        "model type": trainer.model_type not in (1, 2),
        "character map": bool(rules.precompiled_charsmap or rules.normalization_rule_tsv),
        "no space in front": not rules.add_dummy_prefix,
        "white space removed": rules.remove_extra_whitespaces,
        "white space not marked": not rules.escape_whitespaces,
        "space mark as suffix": trainer.treat_whitespace_as_suffix,
    }
    if any(wrong.values()):
        raise ValueError("not supported: " + ", ".join(k for k, v in wrong.items() if v))


class Automaton:
    """Which pieces end after each character read, in one step a character.

    ``step[state][char]`` is the next state; where it is missing, failure links are followed and the
    answer is added. ``ends[state]``: (length, number) of pieces, longest first.
    """

    def __init__(self, pieces: list[str]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.link = [0]
        own = [-1]
        depth = [0]
        for number, piece in enumerate(pieces):
            state = 0
            for char in piece:
                if char not in self.step[state]:
                    self.step[state][char] = len(self.step)
                    self.step.append({})
                    self.ends.append(())
                    self.link.append(0)
                    own.append(-1)
                    depth.append(depth[state] + 1)
                state = self.step[state][char]
            own[state] = number
        tree = [dict(s) for s in self.step]
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for char, child in tree[state].items():
                at = self.link[state]
                while state and char not in tree[at] and at:
                    at = self.link[at]
                self.link[child] = tree[at].get(char, 0) if state else 0
                shorter = self.ends[self.link[child]]
                self.ends[child] = ((depth[child], own[child]), *shorter) if own[child] >= 0 else shorter
                queue.append(child)
        self.tree = tree

    def after(self, state: int, char: str) -> int:
        """The next state where ``step`` has none yet."""
        at = state
        while at and char not in self.tree[at]:
            at = self.link[at]
        found = self.tree[at].get(char, 0)
        if found:  # a character outside all pieces is not remembered: there may be very many
            self.step[state][char] = found
        return found


class Encoder:
    """A model's search. ``encode`` gives the ids of a text as bytes of int32."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        # BPE: the outermost symbols of each piece that merges make; of a unigram model every piece counts.
        edges = {p: self._edges(p) if model.bpe else ([], []) for p in model.pieces}
        made = [p for p in model.pieces if edges[p] is not None]
        self.edges = [edges[p] for p in made]
        self.ids = [model.pieces[p][0] for p in made]
        self.scores = [model.pieces[p][1] for p in made]  # of equal sums the one with the longest last piece counts
        self.lengths = [*map(len, made), 1]
        self.other = len(made)  # the number of a character that no piece holds
        self.longest = max(self.lengths)
        self.lowest = min(self.scores, default=0.0) - UNKNOWN_COST
        self.automaton = Automaton(made)
        # No piece reaches over a space mark that follows another character: words are apart.
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in made)
        self.follows: dict[int, bool] = {}
        self.known = Remembered(self._known_word, KNOWN_BYTES)
        self.searched = 0

    # BPE: how a piece's outermost symbols come about, and whether two pieces stay apart.

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """The symbols at the piece's left and right end over time, None if merges do not make the piece.

        A symbol is (piece, key): key tells when it is made, first by the highest rank of all merges
        that it needs, then by the rank of its own.
        """
        symbols = [(c, (0.0, 0.0)) for c in piece]
        left, right = [symbols[0]], [symbols[-1]]
        while len(symbols) > 1:
            at, rank = -1, 0.0
            for i in range(len(symbols) - 1):
                found = self.model.pieces.get(symbols[i][0] + symbols[i + 1][0])
                if found and (at < 0 or -found[1] < rank):
                    at, rank = i, -found[1]
            if at < 0:
                break
            (a, x), (b, y) = symbols[at : at + 2]
            made = (a + b, (max(x[0], y[0], rank), rank))
            symbols[at : at + 2] = [made]
            if at == 0:
                left.append(made)
            if at == len(symbols) - 1:
                right.append(made)
        return (left, right) if len(symbols) == 1 else None

    def _may_follow(self, pair: int) -> bool:
        """Whether the merges leave the pieces of ``pair`` (two numbers, the first times that of all pieces) apart."""
        first, second = divmod(pair, len(self.lengths))
        if len(self.follows) >= KNOWN_PAIRS:
            self.follows.clear()
        apart = first == self.other or second == self.other or self._apart(self.edges[first][1], self.edges[second][0])
        self.follows[pair] = apart
        return apart

    def _apart(self, right: list, left: list) -> bool:
        i = j = 0
        while True:
            (x, x_key), (y, y_key) = right[i], left[j]
            x_ends = right[i + 1][1] if i + 1 < len(right) else None
            y_ends = left[j + 1][1] if j + 1 < len(left) else None
            found = self.model.pieces.get(x + y)
            if found:
                rank = -found[1]
                made = (max(x_key[0], y_key[0], rank), rank)
                # Of equal merges the leftmost is first: that at the right end of the first piece.
                if (x_ends is None or made < x_ends) and (y_ends is None or made <= y_ends):
                    return False
            if x_ends is None and y_ends is None:
                return True
            if y_ends is None or (x_ends is not None and x_ends <= y_ends):
                i += 1
            else:
                j += 1

    # The search.

    def search(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """Where in ``text`` (spaces already marked) a run of pieces begins and their numbers, as soon as they are certain.

        ``back[k]`` is the number of the piece that ends at boundary ``given + k``.
        """
        self.searched += 1
        step, ends, after = self.automaton.step, self.automaton.ends, self.automaton.after
        follows, other, lengths, longest, bpe = self.follows, self.other, self.lengths, self.longest, self.model.bpe
        scores, lowest, many = self.scores, self.lowest, len(self.lengths)
        back: list[int] = [other]
        total = [0.0]
        given = state = end = 0
        look = 4 * longest
        for char in text:
            state = step[state].get(char) or after(state, char)
            end += 1
            way = other
            if bpe:
                for size, number in ends[state]:
                    at = end - size
                    if at:
                        pair = back[at] * many + number
                        fits = follows.get(pair)
                        if fits is None:
                            fits = self._may_follow(pair)
                        if not fits:
                            continue
                    elif given:
                        continue
                    way = number
                    break
            else:
                best, alone = None, False
                for size, number in ends[state]:
                    alone = alone or size == 1
                    if end >= size and (best is None or total[end - size] + scores[number] > best):
                        best, way = total[end - size] + scores[number], number
                if not alone and (best is None or total[end - 1] + lowest > best):
                    best, way = total[end - 1] + lowest, other
                total.append(best)
            back.append(way)
            if end >= look:
                meet = self._meeting(back, end)
                if meet:
                    yield given, self._path(back, meet)
                    del back[:meet]
                    if not bpe:
                        del total[:meet]
                    given += meet
                    end -= meet
                look = end + 4 * longest
        yield given, self._path(back, end)

    def _meeting(self, back: list[int], end: int) -> int:
        """The last boundary that every way back from the window runs through, counted from what was given."""
        ways = set(range(max(0, end - self.longest + 1), end + 1))
        while len(ways) > 1:
            top = max(ways)
            ways.remove(top)
            ways.add(top - self.lengths[back[top]])
        return ways.pop()

    def _path(self, back: list[int], end: int) -> list[int]:
        out = []
        lengths = self.lengths
        while end > 0:
            number = back[end]
            out.append(number)
            end -= lengths[number]
        out.reverse()
        return out

    def _known_word(self, word: str) -> bytes:
        """Ids of a stretch; without a space mark in front it stands for itself with one."""
        return self.stretch_ids(word if word[0] == SPACE else SPACE + word)

    def stretch_ids(self, stretch: str) -> bytes:
        out = array("i")
        ids, other, model = self.ids, self.other, self.model
        unknown = False
        for at, numbers in self.search(stretch):
            if other not in numbers:
                out.extend([ids[n] for n in numbers])
                unknown = False
                continue
            for number in numbers:
                if number != other:
                    out.append(ids[number])
                elif model.byte_ids:
                    out.extend([model.byte_ids[b] for b in stretch[at].encode("utf-8", "surrogatepass")])
                elif not unknown:  # neighbours that no piece holds are one unknown id
                    out.append(model.unknown)
                at, unknown = at + self.lengths[number], number == other
        return out.tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.words_apart:
            return self.stretch_ids(marked)
        parts = marked.split(SPACE)[1:]
        # Nearly always single spaces: then a word's key is the word without its mark.
        return b"".join(map(self.known.__getitem__, parts if all(parts) else self._words(marked)))

    @staticmethod
    def _words(marked: str) -> Iterator[str]:
        """Each run of space marks with what follows it."""
        parts = marked.split(SPACE)
        if parts[0]:
            yield parts[0]
        marks = 0
        for part in parts[1:]:
            marks += 1
            if part:
                yield SPACE * marks + part
                marks = 0
        if marks:
            yield SPACE * marks


def decode(ids: np.ndarray, texts: tuple[bytes, ...]) -> bytes:
    """The UTF-8 bytes of the text of ids: pieces joined, without the space put before the first."""
    return b"".join(map(texts.__getitem__, ids.tolist())).removeprefix(b" ")


_built: dict[int, Encoder] = {}


def _encoder(model: PieceModel) -> Encoder:
    if id(model) not in _built:
        _built.clear()
        _built[id(model)] = Encoder(model)
    return _built[id(model)]


def encode_documents(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``doc_id, ids, decoded_crc32``: the ids of each whole text, and the checksum of the UTF-8 text that they decode to.

    * Null and empty texts have no ids, and decode to nothing (checksum 0). A character that no piece
      holds becomes ids of its UTF-8 bytes (or the unknown id, if the model has no byte pieces).
    * A text of any length is searched as a whole; what is kept of it is the window, its ids and its bytes.
    * The model is read once, on the driver, and broadcast: its size does not depend on the data. A model
      that needs what is not supported raises ValueError on the driver.
    * One row per row, repeated ones too; a null doc_id stays null. Only doc_id and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, texts = _encoder(model.value), model.value.texts
        for batch in batches:
            made = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            flat = np.frombuffer(b"".join(made), dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in made])]).astype(np.int32)
            sums = [zlib.crc32(decode(flat[a:b], texts)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(sums, pa.int64())], names=["doc_id", "ids", "decoded_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        encode, "doc_id long, ids array<int>, decoded_crc32 long"
    )


def count_column(spark: SparkSession, model_path: str = MODEL):
    """A column function from a text to the number of its ids; none for a null or empty text."""
    model = spark.sparkContext.broadcast(read_model(model_path))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        encoder = _encoder(model.value)
        return pd.Series([len(encoder.encode(t or "")) // 4 for t in texts], dtype="int64")

    return counted


def decoded_column(spark: SparkSession, model_path: str = MODEL):
    """A column function from ids to their text; null ids: null. Ids that make no whole characters give U+FFFD for them."""
    texts = spark.sparkContext.broadcast(read_model(model_path).texts)

    @F.pandas_udf("string")
    def decoded(ids):
        return ids.map(lambda x: None if x is None else decode(x, texts.value).decode("utf-8", "replace"))

    return decoded


def op6_sentencepiece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, how many they are, and the checksum of the text that they decode to."""
    encoded = encode_documents(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_crc32")
