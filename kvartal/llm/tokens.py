"""Encoding of texts with a public byte-level tokenizer, long ones in overlapping chunks."""

from __future__ import annotations

import base64
import functools
import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.sources.tables import stored

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 8192
OVERLAP_CHARS = 512


@functools.cache
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The tokenizer of a rank file, loaded once in a process."""
    import tiktoken

    with open(os.path.join(folder, name + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode(ids, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> bytes:
    """Raw bytes of token ids."""
    e = encoding(name, folder)
    return b"".join(e.decode_single_token_bytes(i) for i in ids)


def _starts(text: str, base: int, last: bool) -> list[int]:
    """Positions after something other than white space at which pre-tokens start; without those that the end of an unfinished chunk may have made.

    White space looks ahead to what follows it, so no piece may end with it.
    """
    import regex

    spans = [m.span() for m in regex.finditer(PATTERN, text)]
    return [base + a for a, b in spans if a and (last or b < len(text)) and not regex.match(r"\s", text[a - 1])]


def _boundaries(chunk: int, overlap: int):
    def run(batches):
        for pdf in batches:
            heads, tails = [], []
            for i, text, last in zip(pdf["i"], pdf["chunk"], pdf["last"]):
                base = i * chunk
                starts = _starts(text, base, last)
                heads.append([s for s in starts if s < base + overlap])
                tails.append([s for s in starts if s >= base + chunk])
            yield pd.DataFrame({"doc": pdf["doc"], "i": pdf["i"], "head": heads, "tail": tails})

    return run


def _encode_pieces(name: str, folder: str):
    def run(batches):
        e = encoding(name, folder)
        for pdf in batches:
            ids = e.encode_ordinary_batch([t if t is not None else "" for t in pdf["piece"]], num_threads=1)
            yield pd.DataFrame({"doc": pdf["doc"], "i": pdf["i"], "ids": ids})

    return run


def _encode_whole(name: str, folder: str):
    def run(batches):
        e = encoding(name, folder)
        for batch in batches:
            texts = [t if t is not None else "" for t in batch.column("text").to_pylist()]
            ids = e.encode_ordinary_batch(texts, num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc", "ids"])

    return run


def token_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(``doc_id``, ids): token ids of each text, without special tokens; none for an empty and for a NULL text.

    Texts longer than a chunk are cut into chunks that overlap.  Each chunk is
    split into pre-tokens from wherever it begins; where two neighbours start a
    pre-token at the same place in their overlap they agree from there on, and
    the texts between these places are encoded on their own and put together.
    Documents with a pair of chunks that never agrees (one word longer than the
    overlap) go round again with chunks and overlaps eight times as long, and at
    last in one piece.  The result is that of encoding each text whole.
    ``doc_id`` must be unique; other columns are ignored.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    out = d.where(size <= chunk + overlap).mapInArrow(_encode_whole(name, folder), f"doc {id_type}, ids array<int>")
    left = d.where(size > chunk + overlap)
    while not left.isEmpty():
        cut = left.select("doc", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("i"), F.length("text").alias("n"))
        cut = cut.select("doc", "i", F.expr(f"substring(text, i * {chunk} + 1, {chunk + overlap})").alias("chunk"), ((F.col("i") + 1) * chunk >= F.col("n")).alias("last"))
        marks = cut.mapInPandas(_boundaries(chunk, overlap), f"doc {id_type}, i int, head array<int>, tail array<int>")
        # The tail of a chunk meets the head of the next one.
        none = F.lit(None).cast("array<int>")
        sides = F.explode(F.array(F.struct("i", "tail", none.alias("head")), F.struct((F.col("i") - 1).alias("i"), none.alias("tail"), "head")))
        met = marks.select("doc", sides.alias("s")).where("s.i >= 0").groupBy("doc", "s.i").agg(F.first("s.tail", True).alias("tail"), F.first("s.head", True).alias("head"))
        ends = met.select("doc", "i", F.col("head").isNull().alias("final"), F.array_min(F.array_intersect("tail", "head")).alias("end"))
        ends = stored(ends, "chunk-ends")
        apart = ends.where(~F.col("final") & F.col("end").isNull()).select("doc").distinct()
        starts = ends.select(F.col("doc").alias("d3"), (F.col("i") + 1).alias("i3"), F.col("end").alias("start"))
        spans = ends.join(apart, "doc", "left_anti").join(starts, (F.col("doc") == F.col("d3")) & (F.col("i") == F.col("i3")), "left")
        spans = spans.select("doc", "i", F.coalesce("start", F.lit(0)).alias("start"), "end")
        piece = F.expr(f"CASE WHEN end IS NULL THEN substring(chunk, start - i * {chunk} + 1) ELSE substring(chunk, start - i * {chunk} + 1, end - start) END")
        pieces = cut.join(spans, ["doc", "i"]).select("doc", "i", piece.alias("piece"))
        encoded = pieces.mapInPandas(_encode_pieces(name, folder), f"doc {id_type}, i int, ids array<int>")
        whole = encoded.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("p")).select("doc", F.flatten("p.ids").alias("ids"))
        out = out.unionByName(whole)
        left = left.join(apart, "doc", "left_semi")
        chunk, overlap = chunk * 8, overlap * 8
        short = left.where(F.length("text") <= chunk + overlap)
        out = out.unionByName(short.mapInArrow(_encode_whole(name, folder), f"doc {id_type}, ids array<int>"))
        left = left.where(F.length("text") > chunk + overlap)
    return out.withColumnRenamed("doc", doc_id)
