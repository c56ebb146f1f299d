"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
#: Texts longer than this many characters are cut, each batch holds about so many bytes.
CHUNK_CHARS = 16_384
BATCH_BYTES = 262_144
#: One plain space between two characters that are neither spaces nor the library's own space mark.
#: No piece of the vocabulary holds a space mark behind another character, so no merge crosses it.
SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")

_loaded: dict = {}


def _processor(path: str):
    import sentencepiece

    if path not in _loaded:
        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def _resolve(model: str) -> str:
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def crosses_spaces(path: str) -> bool:
    """Whether any piece holds the space mark behind another character (then long texts stay whole)."""
    sp = _processor(path)
    return any(re.search("[^▁]▁", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def split_safely(text: str, chunk: int = CHUNK_CHARS) -> list[str]:
    """Cut ``text`` at safe boundaries into parts of about ``chunk`` characters.

    The space at a cut goes: the encoder puts one before every part. Where no safe boundary follows,
    the part is longer. The parts' token counts add up to the whole text's.
    """
    if len(text) <= chunk:
        return [text]
    parts, at = [], 0
    while len(text) - at > chunk:
        cut = SAFE.search(text, at + chunk)
        if not cut:
            break
        parts.append(text[at : cut.start()])
        at = cut.end()
    parts.append(text[at:])
    return parts


def lengths(texts: list[str], path: str, chunk: int = CHUNK_CHARS, batch: int = BATCH_BYTES, sizes: list[int] | None = None) -> list[int]:
    """Token counts of ``texts``, encoded in batches of about ``batch`` bytes; ``sizes``: the texts' bytes, else their characters count."""
    sp, counts = _processor(path), [0] * len(texts)
    owners: list[int] = []
    parts: list[str] = []
    held = 0

    def flush() -> None:
        for owner, ids in zip(owners, sp.encode(parts, num_threads=1), strict=True):
            counts[owner] += len(ids)
        owners.clear()
        parts.clear()

    for i, text in enumerate(texts):
        for part in split_safely(text, chunk):
            owners.append(i)
            parts.append(part)
            held += len(part) * sizes[i] // max(1, len(text)) if sizes else len(part)
            if held >= batch:
                flush()
                held = 0
    flush()
    return counts


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Null texts count as empty (zero tokens); null ids stay null; repeated rows each give a row; other
    columns are not read. ``model`` is a file name of the tokenizer package or a path on the workers.
    One narrow stage, no shuffle: only ids and lengths leave a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _resolve(model)
        chunk = 1 << 62 if crosses_spaces(path) else CHUNK_CHARS
        for rows in batches:
            texts = pc.fill_null(rows.column(1), "")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n = lengths(texts.to_pylist(), path, chunk, sizes=n_bytes.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), n_bytes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
