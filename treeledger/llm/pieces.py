"""SentencePiece encoding and decoding through a table of distinct chunks.

In the given model no piece has a whitespace marker behind another character (checked when the model is loaded), so a
merge never crosses from a word into the marker that begins the next one.  A text is therefore cut before every run of
markers, each distinct chunk is segmented once, and the ids come together again by position.  The table belongs to a
worker process and is emptied when it holds ``TABLE_ROWS`` chunks, so memory doesn't grow with the corpus; nothing is
shuffled.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are encoded one by one;
texts of any length are encoded whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packed

TABLE_ROWS = 300_000
SLICE_CHARS = 1 << 20
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_tables: dict[str, ChunkTable] = {}


class ChunkTable:
    """ids: the decimal ids of a chunk, joined with commas; text: what they decode to.

    A chunk with one marker has the word as its key, one with several is its own key.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [p for i in range(self.model.get_piece_size()) if MARK in (p := self.model.id_to_piece(i)).lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces of {path} cross whitespace markers: {crossing[:3]}")
        self.clear()

    def clear(self) -> None:
        lone = self.model.piece_to_id(MARK)  # a last space by itself: the library encodes it only behind other text
        self.ids: dict[str, str] = {MARK: str(lone)}
        self.text: dict[str, str] = {MARK: ""}

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        return [x[1:] if x[1:2] not in ("", MARK) else x for x in _CHUNK.findall(MARK + MARK.join(words))]

    def learn(self, texts: list[list[str]]) -> None:
        """Segments the chunks that the table lacks."""
        if len(self.ids) > TABLE_ROWS:
            self.clear()
        new = list(set().union(*texts).difference(self.ids))
        # the library adds the first marker by itself
        got = self.model.encode([x[1:].replace(MARK, " ") if x[0] == MARK else x for x in new], num_threads=1)
        self.ids.update(zip(new, (str(x)[1:-1].replace(" ", "") for x in got), strict=True))
        self.text.update(zip(new, self.model.decode(got, num_threads=1) if got else [], strict=True))


def table(path: str) -> ChunkTable:
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]


def encode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encodes docs.text without begin and end ids.

    outputs: any of ids (array of int), ids_text (the ids in decimal, joined with commas) and decoded (their text);
    doc_id and n_tokens always come first.
    """
    kinds = {"ids": "array<int>", "ids_text": "string", "decoded": "string"}
    unknown = set(outputs) - set(kinds)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE_CHARS):
                    size += len(texts[hi])
                    hi += 1
                cut = [t.cut(x) for x in texts[lo:hi]]
                t.learn(cut)
                ids = [",".join(map(t.ids.__getitem__, x)) for x in cut]
                cols = [b.column(0).slice(lo, hi - lo), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())]
                for name in outputs:
                    if name == "ids":
                        cols.append(pa.array([list(map(int, x.split(","))) if x else [] for x in ids], pa.list_(pa.int32())))
                    elif name == "ids_text":
                        cols.append(pa.array(ids, pa.string()))
                    else:  # each chunk but the first has kept its first marker, a space
                        cols.append(pa.array([" ".join(map(t.text.__getitem__, x)) for x in cut], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", *outputs])
                lo = hi

    return packed.arrow_map(docs.select("doc_id", "text"), run, ", ".join(["doc_id long, n_tokens long", *(f"{x} {kinds[x]}" for x in outputs)]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table(path).model
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return packed.arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("ids_text", "decoded"))
    return got.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
