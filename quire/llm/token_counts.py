"""Token counts of whole texts: batches go to the tokenizer's library, only lengths come back.

A task cuts long texts where no token can reach across, deals the parts to
batches of about equal bytes, and adds the lengths up by document.  What is
held at once is one batch, whatever the length of a text.

Cuts need a vocabulary whose splitter drops white space (`word_bpe_49k.json`).
Its parts end before white space, before an ASCII digit, which is a piece of
its own, or between an ASCII letter or digit and a mark that no added token
holds; normalising does not reach across any of these.  Other vocabularies
join white space to words, so their texts go to the library whole.

Defined results: a null text counts as the empty one (0 bytes, 0 tokens).  Rows
are independent of one another: repeated rows repeat, a null identifier is
carried along, other columns are not looked at, an empty table gives no rows.
A text without a safe place for a cut is one part, however long.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import trimmed

#: Bytes of a part of a long text, and of the parts that the library gets at once.
PART_BYTES, CALL_BYTES = 64_000, 1_000_000
#: Tokens that fit a document; more are over the limit.
LIMIT = 2048
#: Places before which a text may be cut.
SAFE = re.compile(rb"(?=[ \t\n\r])|(?<=[!-~])(?=[0-9])|(?<=[0-9A-Za-z])(?=[!-/:;=?@])")
#: Fixed value: the splitter of vocabularies that drop white space.
DROPS_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_of(text: bytes, most: int = PART_BYTES) -> Iterator[bytes]:
    """``text`` in parts of about ``most`` bytes, cut at the first safe place from there on."""
    at = 0
    while len(text) - at > most and (cut := SAFE.search(text, at + most)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@lru_cache(2)
def load(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Lengths of a batch by the vocabulary file's library, and whether texts may be cut."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: list(map(len, model.encode(texts, num_threads=1))), False
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: list(map(len, model.encode_batch_fast(texts, add_special_tokens=False))), _drops_space(model)


def _drops_space(model) -> bool:
    """Whether the splitter is the one that `SAFE` is made for, and the added tokens are cut out of the raw text."""
    spec = json.loads(model.to_str())
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) and re.fullmatch(r"<\|[a-z]+\|>", x["content"]) for x in spec["added_tokens"])
    splits = bool(steps) and steps[0].get("pattern") == {"Regex": DROPS_SPACE} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    return plain and splits and normal == ["NFC", "Replace", "Lowercase"]


def count_texts(texts: list[bytes], lengths: Callable[[list[str]], list[int]], cuts: bool, part: int = PART_BYTES, call: int = CALL_BYTES) -> np.ndarray:
    """Tokens of each text; a call to the library gets about ``call`` bytes."""
    counts = np.zeros(len(texts), dtype=np.int64)
    owners: list[int] = []
    held: list[str] = []
    size = 0

    def flush() -> None:
        nonlocal size
        np.add.at(counts, owners, lengths(held))
        owners.clear()
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        for x in parts_of(text, part) if cuts else (text,):
            owners.append(i)
            held.append(x.decode("utf-8", "replace"))
            size += len(x)
            if size >= call:
                flush()
    if held:
        flush()
    return counts


def _count_batches(path: str, part: int, call: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, cuts = load(path)
        for batch in batches:
            texts = batch.column(1)
            counts = count_texts(texts.to_pylist(), lengths, cuts, part, call)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(
    df: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", part: int = PART_BYTES, call: int = CALL_BYTES
) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row; ``tokenizer`` is a .json or .model file."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(trimmed(_count_batches(tokenizer, part, call)), f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
