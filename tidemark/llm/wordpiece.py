"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces form two tries, of pieces that begin a word and of those that continue
one. Each state has a failure link, to the state that is reached once the longest pieces of what was
read are popped, and the number of pieces popped on the way. A word is read once, character by
character; adding up these numbers gives how many pieces greedy longest match makes of it, and no
piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, table

#: Where the vocabulary is read from by default: a public SentencePiece file; see ``read_vocabulary``.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Pieces that begin words (marked so in the file), and pieces that continue them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    begin = sorted({p[1:] for p in plain if p.startswith(WORD_MARK) and len(p) > 1 and WORD_MARK not in p[1:]})
    return begin, sorted({p for p in plain if WORD_MARK not in p})


class LongestMatch:
    """The automaton. State 0 begins a word, state 1 continues it."""

    def __init__(self, begin: list[str], carry_on: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}, {}]
        self.link: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        whole = [False, False]
        for root, pieces in enumerate((begin, carry_on)):
            for piece in pieces:
                state = root
                for char in piece:
                    if char not in self.next[state]:
                        self.next[state][char] = len(self.next)
                        self.next.append({})
                        self.link.append(-1)
                        self.popped.append(0)
                        whole.append(False)
                    state = self.next[state][char]
                whole[state] = True
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for char, state in self.next[parent].items():
                queue.append(state)
                if whole[state]:
                    self.link[state], self.popped[state] = 1, 1
                    continue
                at, popped = self.link[parent], self.popped[parent]
                while at >= 0 and char not in self.next[at]:
                    popped += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[state], self.popped[state] = self.next[at][char], popped

    def count(self, word: str) -> int:
        """Pieces of a word, or 0 if greedy longest match does not get through it."""
        state = pieces = 0
        for char in word:
            while char not in self.next[state]:
                if self.link[state] < 0:
                    return 0
                pieces += self.popped[state]
                state = self.link[state]
            state = self.next[state][char]
        while state != 1:
            if self.link[state] < 0:
                return 0
            pieces += self.popped[state]
            state = self.link[state]
        return pieces


_built: dict[int, Remembered] = {}


def _known_words(vocabulary: tuple[list[str], list[str]]) -> Remembered:
    """Pieces of words as bytes of UTF-8, by an automaton that a worker builds once."""
    known = _built.get(id(vocabulary))
    if known is None:
        _built.clear()
        automaton = LongestMatch(*vocabulary)
        known = _built[id(vocabulary)] = Remembered(lambda word: automaton.count(word.decode("utf-8", "surrogatepass")))
        known.vocabulary = vocabulary  # kept, so that its id stays its own
    return known


def _count(text: str | None, known: Remembered) -> tuple[int, int, int]:
    found = list(map(known.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))
    unknown = found.count(0)
    return len(found), sum(found) + unknown, unknown


def count_column(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A column function from a text to its number of tokens, as ``token_counts`` has it."""
    pieces = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        known = _known_words(pieces.value)
        return pd.Series([_count(t, known)[1] for t in texts], dtype="int64")

    return counted


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown``.

    * Words are runs of anything but ASCII white space. A word that greedy longest match does not
      get through is one unknown token. Null, empty and blank texts have none of either.
    * Texts and words of any length are read as a whole, in time in proportion to their length.
    * The vocabulary is read once, on the driver, and broadcast: its size does not depend on the data.
    * One row per row, repeated ones too; a null doc_id stays null. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _known_words(pieces.value)
        for batch in batches:
            rows = [_count(text, known) for text in batch["text"]]
            counted = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), counted], axis=1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(
        count, "doc_id long, n_words long, n_tokens long, n_unknown long"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
