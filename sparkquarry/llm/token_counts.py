"""Token counts by a whole-token shortcut over a piece vocabulary.

A sentencepiece BPE without prefix-suffix surprises turns each space into U+2581 and puts one in front. If every
vocabulary piece has U+2581 only at its start, no merge can cross from a character to a following U+2581, so the
segments ``(U+2581)+ (other)*`` encode independently. A segment that is itself proven to encode as one token costs
a dictionary lookup; only the other distinct segments are merged, by the library, and kept in a bounded table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, memory_returned, small_batches, text_or_empty

MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
#: Merged segments that one Python worker keeps during a task.
KEPT = 400_000
#: Characters of a segment that is kept.
LONG = 100


def independent(pieces: list[str]) -> bool:
    """True if U+2581 occurs only at the start of pieces, hence segments encode independently."""
    return all(MARK not in p.lstrip(MARK) for p in pieces)


def whole_tokens(processor) -> dict[str, int]:
    """The vocabulary strings, without their leading U+2581, that are proven to encode alone as one token."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    proven = {w: 1 for w, ids in zip(words, processor.encode(words, num_threads=1)) if len(ids) == 1}
    if processor.id_to_piece(processor.piece_to_id(MARK)) == MARK:
        proven[""] = 1
    return proven


class SegmentCounts(dict):
    """Segment without its leading U+2581 -> number of tokens; proven ones stay, merged ones are bounded."""

    def __init__(self, processor):
        self.processor, self.whole = processor, whole_tokens(processor)
        super().__init__(self.whole)

    def __missing__(self, segment: str) -> int:
        n = len(self.processor.encode(segment))
        if len(self) > KEPT:
            self.forget()
        if len(segment) <= LONG:
            self[segment] = n
        return n

    def forget(self) -> None:
        self.clear()
        self.update(self.whole)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text or "  " in text or text[0] == " ":
            segments = (s[1:] for s in SEGMENT.findall(MARK + text.replace(" ", MARK)))
        else:
            segments = text.split(" ")
        return sum(map(self.__getitem__, segments))


def counts_of(model_file: str) -> SegmentCounts:
    def load() -> SegmentCounts:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if not independent([processor.id_to_piece(i) for i in range(processor.get_piece_size())]):
            raise ValueError("pieces with U+2581 after another character: segments do not encode independently")
        return SegmentCounts(processor)

    return held(("tokens", model_file), load)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, as the library counts whole texts without added tokens.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids give a row each; other columns of the
    input are ignored; an empty table gives an empty table. One narrow pass, no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        table = counts_of(model_file)
        for batch in batches:
            n = [table.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])
        table.forget()
        memory_returned()

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.octet_length(text_or_empty(text_col)).cast("long").alias("n_bytes"))
    counted = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
