"""Token counts (operator 10): lengths only, from Arrow functions.

A text is cut at ASCII white space where the tokenizer's splitter always cuts
too (:func:`cuts_at_space` tries it on probes), so a long text needs no long call and no token can span a cut.  In a
slice of at most `slice_bytes` of text every distinct word is encoded once and
its length is summed over its places.  With tokenizers that keep white space, whole texts are encoded,
a long one by itself.

A very long text is a slice by itself.  Nulls count as empty texts (0 bytes, 0 tokens); rows with a null or repeated
id are counted like any other; other columns are not looked at.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cuts, id_array, ids_of, ship, slices, utf8

#: A tokenizer file is sent to the executors; larger ones are refused.
MAX_TOKENIZER_BYTES = 64 << 20
#: Bytes of whole texts in one call, or one text.
WHOLE_BYTES = 1 << 20
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def json_lengths(tokenizer, texts: list[str]) -> np.ndarray:
    return np.fromiter((len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)), np.int64, len(texts))


#: Texts on which whole and cut encodings are compared: all ASCII white space, alone, repeated and at the ends, beside letters, digits, marks and other scripts.
PROBES = [a + gap + b for gap in (" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", " \n ") for a in ("", "a", "The", "12", "x.", "é", "中", "'s", "(") for b in ("", "b", "cat", "34", ",", "è", "文", "s", ")")]


def load_json(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cuts_at_space(tokenizer) -> bool:
    """Whether a text has as many tokens as its words at ASCII white space together."""
    if any(set(x.content) & set(" \t\n\r\x0b\x0c") or x.lstrip or x.rstrip for x in tokenizer.get_added_tokens_decoder().values()):
        return False
    parts = [WORDS.findall(x) for x in PROBES]
    each = json_lengths(tokenizer, [y for x in parts for y in x])
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return bool((np.diff(np.concatenate([[0], np.cumsum(each)])[ends]) == json_lengths(tokenizer, PROBES)).all())


def _counter(kind: str, cut: bool, model, limit: int, slice_bytes: int):
    def run(batches):
        if kind == "json":
            tokenizer = load_json(model.value)
        else:
            import sentencepiece

            tokenizer = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for piece in slices(batches, slice_bytes):
            _, offsets = utf8(piece.column(1))
            n_bytes = np.diff(offsets)
            text = piece.column(1).fill_null("")
            if cut:
                words = pc.ascii_split_whitespace(text)
                coded = words.flatten().dictionary_encode()
                lengths = json_lengths(tokenizer, coded.dictionary.to_pylist())
                each = lengths[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
                ends = np.asarray(words.offsets)
                sums = np.concatenate([[0], np.cumsum(each)])
                n_tokens = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
            elif kind == "json":
                n_tokens = np.concatenate([np.zeros(0, np.int64), *(json_lengths(tokenizer, text.slice(a, b - a).to_pylist()) for a, b in cuts(offsets, WHOLE_BYTES))])
            else:  # pieces may hold white space: whole texts, one at a time
                n_tokens = np.array([len(tokenizer.encode(x, num_threads=1)) for x in text.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [id_array(ids_of(piece.column(0))), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 8 << 20) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens without added special ones, and whether they exceed `limit`.

    `.json` files are counted by tokenizers, `.model` files by sentencepiece."""
    spark = docs.sparkSession
    ship(spark)
    size = os.path.getsize(tokenizer_path)
    if size > MAX_TOKENIZER_BYTES:
        raise ValueError(f"a tokenizer of {size} bytes is too large to send")
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    model = spark.sparkContext.broadcast(data)
    kind = "json" if tokenizer_path.endswith(".json") else "model"
    cut = kind == "json" and cuts_at_space(load_json(data))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_counter(kind, cut, model, limit, slice_bytes), SCHEMA)
