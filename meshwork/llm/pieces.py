"""SentencePiece encoding and decoding through a table of distinct chunks.

The normalised text is '▁' + the text with each space as '▁'. A chunk is a run of '▁' and what follows
up to the next '▁'. Where no piece of the model has '▁' after another character, no merge crosses a chunk's
start, so a text's ids are its chunks' ids one after the other. Each distinct chunk of a batch is segmented
once, by the library, and ids and decoded text are joined back by position; a bounded table carries chunks
from batch to batch. Nothing is shuffled. The model travels as bytes (about 0.5 MB), so executors need no file.

Defined results: null and empty texts have no ids and decode to the empty text; any white space but the
space belongs to its chunk; texts with '▁' decode with spaces, as the library does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.text import slices

MARK = "▁"
#: Chunks that a worker keeps between batches.
KEEP = 200_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Segmenter:
    """A model, and its table of chunks already segmented."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        check_model(self.sp)
        self.guard = self.sp.piece_to_id("a")
        self.known: dict[str, tuple[str, str, int]] = {}

    def learn(self, chunks: list[str]) -> list[tuple[str, str, int]]:
        """(ids joined by commas, text, number of ids) of distinct chunks; each starts with '▁', which encode() adds itself."""
        known = self.known
        if len(known) > KEEP:
            known.clear()
        if new := [c for c in chunks if c not in known]:
            ids = self.sp.encode([c[1:] for c in new], num_threads=1)
            # a lone '▁' is the empty text to encode(), which then adds nothing
            ids = [i if len(c) > 1 else [self.sp.piece_to_id(MARK)] for c, i in zip(new, ids, strict=True)]
            texts = self.sp.decode([[self.guard, *i] for i in ids])
            for c, i, t in zip(new, ids, texts, strict=True):
                known[c] = (",".join(map(str, i)), t[1:], len(i))
        return [known[c] for c in chunks]

    def first(self, ids: str) -> str:
        """The text of a document's first chunk: decode() itself drops the mark that encode() added."""
        return self.sp.decode([int(i) for i in ids.split(",")])


def check_model(sp: sentencepiece.SentencePieceProcessor) -> None:
    """Chunks are independent only if no piece crosses a mark and the normaliser keeps and marks every space."""
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
        raise ValueError("the model has pieces that cross a whitespace mark")
    if sp.encode("  a b ", out_type=str) != [*sp.encode("  a", out_type=str), *sp.encode("b ", out_type=str)] or sp.decode(sp.encode("  a")) != "  a":
        raise ValueError("the model's normaliser changes spaces")


def _chunks(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, index of each chunk in order, chunks by text) of non-empty texts."""
    marked = pc.replace_substring(pc.binary_join_element_wise("", texts, MARK), " ", MARK)
    if pc.any(pc.match_substring(marked, MARK * 2)).as_py():
        each = [_CHUNK.findall(t) for t in marked.to_pylist()]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        flat = pa.array(list(chain.from_iterable(each)), pa.string()).dictionary_encode()
        return flat.dictionary.to_pylist(), flat.indices.to_numpy(), counts
    parts = pc.split_pattern(pc.utf8_slice_codeunits(marked, 1), MARK)
    flat = parts.flatten().dictionary_encode()
    return [MARK + w for w in flat.dictionary.to_pylist()], flat.indices.to_numpy(), np.diff(parts.offsets.to_numpy())


def encode_texts(seg: Segmenter, texts: pa.Array) -> Iterator[tuple[str, str, int]]:
    """(ids joined by commas, decoded text, number of ids) by text."""
    texts = pc.fill_null(texts, "")
    full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if not full.any():
        yield from (("", "", 0) for _ in range(len(texts)))
        return
    names, index, counts = _chunks(texts.filter(pa.array(full)))
    ids, words, sizes = zip(*seg.learn(names), strict=True)
    ids, words, sizes = np.array(ids, object), np.array(words, object), np.array(sizes)
    ends = np.cumsum(counts)
    of, total = index, sizes[index]
    at = 0
    ends = iter(ends.tolist())
    for has in full.tolist():
        if not has:
            yield "", "", 0
            continue
        end = next(ends)
        mine = of[at:end]
        one = ids[mine].tolist()
        yield ",".join(one), seg.first(one[0]) + "".join(words[mine[1:]].tolist()), int(total[at:end].sum())
        at = end


def encode(docs: DataFrame, model_path: str, digests: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens and either digests of ids and decoded text, or both themselves."""
    with open(model_path, "rb") as f:
        model = f.read()
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            at = 0
            for part in slices(b.column(1)):
                n, left, right = [], [], []
                for ids, text, size in encode_texts(seg, part):
                    n.append(size)
                    left.append(sha(ids) if digests else [int(i) for i in ids.split(",") if i])
                    right.append(sha(text) if digests else text)
                kind = pa.string() if digests else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(left, kind), pa.array(right, pa.string())], schema.replace(",", " ").split()[::2])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
