"""Problem 6: token ids of whole texts by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where vocabulary files are found; every function takes another one.
TOKENIZERS = os.environ.get("THICKET_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Code points of a leaf of the tree, and from which on a text takes several rows.
LEAF, SEGMENT = 1 << 14, 1 << 18

Ids = list[int]


@functools.cache
def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The tokenizer without special tokens, once for each process."""
    import importlib.util

    import tiktoken

    ranks = {}
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(folder, "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    return tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def join_ids(left: Ids, right: Ids, encode: Callable[[str], Ids], decode: Callable[[Ids], bytes], window: int = 16) -> Ids:
    """Ids of the text of which ``left`` and ``right`` encode the halves.

    The text of a window around the join is encoded anew and grows until both its ends agree with the halves: its first and
    its last ``agree`` tokens are those that stood there before, and among them is a place where pre-tokens part whatever
    surrounds them. Up to that place the left half's ids hold, from the last such place on the right half's, and between both
    the window saw the whole text. A text without such places is in the end encoded as a whole, so the result is always exact.
    """
    while True:
        agree = max(4, window // 4)
        a, b = max(0, len(left) - window), min(len(right), window)
        while True:  # a window must start and end between characters
            try:
                text = decode(left[a:] + right[:b]).decode("utf-8")
                break
            except UnicodeDecodeError:
                if a == 0 and b == len(right):
                    raise
                a, b = max(0, a - 1), min(len(right), b + 1)
        new = encode(text)
        head = a == 0 or (new[:agree] == left[a : a + agree] and len(new) >= 2 * agree and _parts(decode(new[:agree])))
        tail = b == len(right) or (
            new[-agree:] == right[b - agree : b] and len(new) >= 2 * agree and b >= agree and _parts(decode(new[-agree:]))
        )
        if head and tail:
            return left[:a] + new + right[b:]
        window *= 2


def _parts(piece: bytes) -> bool:
    """Whether a letter follows a space that follows another character: a place where pre-tokens always part."""
    text = piece.decode("utf-8", "replace")
    return any(b == " " and a.isalnum() and c.isalnum() for a, b, c in zip(text, text[1:], text[2:]))


def encode_tree(text: str, encode: Callable[[str], Ids], decode: Callable[[Ids], bytes], leaf: int = LEAF) -> Ids:
    """Ids of ``text`` by halves: leaves are encoded by themselves and joined pairwise."""
    if len(text) <= leaf:
        return encode(text)
    half = len(text) // 2
    return join_ids(encode_tree(text[:half], encode, decode, leaf), encode_tree(text[half:], encode, decode, leaf), encode, decode)


def coder(folder: str = TOKENIZERS, name: str = VOCABULARY) -> tuple[Callable[[str], Ids], Callable[[Ids], bytes]]:
    e = encoding(folder, name)
    return e.encode_ordinary, e.decode_bytes


def token_ids(
    documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, segment: int = SEGMENT, leaf: int = LEAF
) -> DataFrame:
    """(doc_id, ids array<int>): one row for each row of ``documents(doc_id, text)``; null and empty texts get an empty list.

    Most texts are encoded in the scan's own stage. A text longer than ``segment`` code points is cut into rows that are encoded
    in parallel and then joined in order; only such texts are shuffled. A repeated doc_id keeps its rows apart.
    """
    out = "doc_id bigint, ids array<int>"
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = coder(folder, name)
        for batch in batches:
            ids = [encode_tree(t, encode, decode, leaf) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, schema.field("ids").type)], schema=schema)

    whole = source.filter(F.coalesce(F.length("text"), F.lit(0)) <= segment).mapInArrow(short, out)
    cuts = F.sequence(F.lit(0), F.ceil(F.length("text") / segment).cast("int") - 1)
    rows = (
        source.filter(F.length("text") > segment)
        .withColumn("copy", F.monotonically_increasing_id())
        .select("doc_id", "copy", "text", F.explode(cuts).alias("k"))
        .select("doc_id", "copy", "k", F.expr(f"substring(text, k * {segment} + 1, {segment})").alias("text"))
        .repartition("doc_id", "copy", "k")
    )

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, decode = coder(folder, name)
        for batch in batches:
            ids = [encode_tree(t, encode, decode, leaf) for t in batch["text"]]
            yield batch[["doc_id", "copy", "k"]].assign(ids=pd.Series(ids, index=batch.index, dtype=object))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        encode, decode = coder(folder, name)
        parts = [list(map(int, x)) for x in group.sort_values("k")["ids"]]
        while len(parts) > 1:
            parts = [
                join_ids(*parts[i : i + 2], encode, decode) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)
            ]
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "ids": parts})

    long = (
        rows.mapInPandas(pieces, "doc_id bigint, copy bigint, k int, ids array<int>")
        .groupBy("doc_id", "copy")
        .applyInPandas(joined, out)
    )
    return whole.unionByName(long)


def decoded(ids: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the texts that ``ids(doc_id, ids)`` stand for; an empty list is an empty text."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, decode = coder(folder, name)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [decode(list(map(int, x))).decode("utf-8", "replace") for x in batch["ids"]]})

    return ids.mapInPandas(texts, "doc_id bigint, text string")
