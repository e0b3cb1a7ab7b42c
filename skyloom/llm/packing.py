"""Cost-balanced packing of token streams into sequences of fixed length.

A document becomes the ids of the public byte-level BPE vocabulary followed by one
separator. Each task packs blocks of bounded size on its own, so nothing is shuffled and
a lost task is simply run again. Within a block

* whole sequences are cut from documents that are longer than a sequence;
* the remaining pieces, longest first, go to the sequence of lowest cost that still has
  room, where a piece of n tokens costs ``linear * n + quadratic * n * n`` (attention does
  not cross pieces);
* pieces that fit nowhere are cut over the rooms left, cheapest sequence first.

The rooms of a block add up to its tokens: full sequences, and the powers of two that sum
to the rest, so a block ends without padding.

Null texts count as empty, repeated rows are packed each on its own, an empty table gives
no pieces, columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.text import read, tidy

NAME = "op2_cost_balanced_packing"
ORACLE_SQL = None  # tokenisation and the heap of costs are beyond SQL

SEQUENCE = 2048
SEPARATOR = 1
# The added token of the vocabulary, which in a text is this one id.
ADDED = {"<|endoftext|>": 50256}
BLOCK_TOKENS = 1 << 20

_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

_encoders: dict = {}


def encoder(ranks_file: str | None = None):
    """The vocabulary read as ranks, with the added token of its other file form: the same ids, several times faster."""
    if ranks_file not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_file] = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _encoders[ranks_file]


@functools.cache
def _plain(vocabulary_file: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_file or public_tokenizers.path("byte_bpe_50k.json"))


def ids(text: str, ranks_file: str | None = None, vocabulary_file: str | None = None) -> np.ndarray:
    """The ids of a whole text; runs of white space too long for the fast matcher take the slow one."""
    try:
        return encoder(ranks_file).encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
    except ValueError:
        return np.array(_plain(vocabulary_file).encode(text, add_special_tokens=False).ids, "<u4")


def rooms(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Sequence lengths that sum to ``tokens``: full ones, then falling powers of two."""
    rest = tokens % sequence
    return [sequence] * (tokens // sequence) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], sequence: int = SEQUENCE, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths.

    Every token lies in one piece and every sequence is filled from its offset 0 on.
    """
    out, pieces, n = [], [], 0
    for d, length in enumerate(lengths):
        whole = length // sequence
        out += [(d, k * sequence, sequence, n + k, 0) for k in range(whole)]
        n += whole
        if length % sequence:
            pieces.append((length % sequence, d, whole * sequence))
    left = np.array(rooms(sum(p[0] for p in pieces), sequence), dtype=np.int64)
    full, cost = left.copy(), np.zeros(len(left))
    late = []
    for size, d, start in sorted(pieces, key=lambda p: (-p[0], p[1])):
        at = int(np.where(left >= size, cost, np.inf).argmin())
        if left[at] < size:
            late.append((size, d, start))
            continue
        out.append((d, start, size, n + at, int(full[at] - left[at])))
        left[at] -= size
        cost[at] += linear * size + quadratic * size * size
    for size, d, start in late:
        while size:
            at = int(np.where(left > 0, cost, np.inf).argmin())
            part = min(size, int(left[at]))
            out.append((d, start, part, n + at, int(full[at] - left[at])))
            left[at] -= part
            cost[at] += linear * part + quadratic * part * part
            size, start = size - part, start + part
    return out


def _packer(id_type: pa.DataType, ranks_file: str | None, vocabulary_file: str | None, block_tokens: int, with_ids: bool):
    def run(batches):
        task = TaskContext.get()
        base, used = (task.partitionId() if task else 0) << 32, 0
        names, streams, tokens = [], [], 0
        schema = pa.schema([("doc_id", id_type), *_FIELDS] + [("ids", pa.list_(pa.int32()))] * with_ids)

        def flush():
            nonlocal names, streams, tokens, used
            done = pack([len(s) for s in streams])
            cols = list(zip(*done)) if done else [()] * 5
            cut = [streams[d][s : s + n] for d, s, n, _, _ in done]
            data = [pa.array([names[d] for d in cols[0]], id_type), cols[1], cols[2], [zlib.crc32(c.tobytes()) for c in cut], [len(streams[d]) for d in cols[0]], [base + used + s for s in cols[3]], cols[4]]
            data = [data[0]] + [pa.array(x, pa.int64()) for x in data[1:]] + [pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32()))] * with_ids
            used += max(cols[3], default=-1) + 1
            names, streams, tokens = [], [], 0
            return pa.RecordBatch.from_arrays(data, schema=schema)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                own = ids(text, ranks_file, vocabulary_file) if text else np.empty(0, np.uint32)
                streams.append(np.append(own, np.uint32(SEPARATOR)))
                names.append(keys[k].as_py())
                tokens += len(streams[-1])
                if tokens >= block_tokens:
                    yield flush()
            tidy()
        if streams:
            yield flush()
        tidy()

    return run


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_file: str | None = None, vocabulary_file: str | None = None, block_tokens: int = BLOCK_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece; ``ids`` are its tokens where asked for."""
    from pyspark.sql.pandas.types import to_arrow_type

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return narrow.mapInArrow(_packer(to_arrow_type(kind), ranks_file, vocabulary_file, block_tokens, with_ids), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), with_ids=False)
