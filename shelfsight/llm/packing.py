"""Hierarchical multi-length packing into sequences of 256, 512, 1024 and 2048 tokens.

Documents are tokenised and packed chunk by chunk where they are read, without a shuffle; a chunk is a
bounded number of tokens. Whole long windows of a document stand alone; its rest is
routed to the smallest tier it fits. Long rests open a window of the longest tier and shorter tiers
fill the gaps, best fit first, then a cut piece. What is left in a shorter tier is cut to fill
that tier's sequences, and a chunk's last tokens are split into powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import table

TIERS = (256, 512, 1024, 2048)
END_ID = 1
ID_BYTES = 4
CHUNK_TOKENS = 4_000_000
STEP_TOKENS = 1 << 15
#: Added tokens of byte_bpe_50k.json: they stand for themselves inside texts, as in `tokenizers` by default.
SPECIAL = {"<|endoftext|>": 50256}


def token_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, special: dict[str, int] | None = None):
    """Text -> its ids as little-endian 32-bit bytes, by the vocabulary of a tiktoken rank file.

    Names in `special` become their one id; without it they are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special or {})
    return lambda text: bpe.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()


def pack(lengths: list[int], tiers=TIERS) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences of a chunk: (tier, [(document, start, length)]); every token of every document once.

    Sequences are full, but for the last few of a chunk, whose lengths are powers of two below the
    smallest tier.
    """
    top = tiers[-1]
    lower = tiers[:-1]
    waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in lower}  # (length, document, start)
    long = []
    for doc, n in enumerate(lengths):
        for at in range(0, n - top + 1, top):
            yield top, [(doc, at, top)]
        if rest := n % top:
            tier = next(t for t in tiers if rest <= t)
            (long if tier == top else waiting[tier]).append((rest, doc, n - rest))
    for pieces in waiting.values():
        pieces.sort()
    for rest, doc, start in sorted(long, reverse=True):
        sequence, gap = [(doc, start, rest)], top - rest
        for tier in reversed(lower):
            while gap and waiting[tier] and (k := bisect_right(waiting[tier], (gap, 1 << 62, 0))):
                n, d, s = waiting[tier].pop(k - 1)
                sequence.append((d, s, n))
                gap -= n
        for tier in lower:  # the gap is shorter than any piece left: cut one
            if gap and waiting[tier]:
                n, d, s = waiting[tier].pop()
                sequence.append((d, s, gap))
                waiting[tier].append((n - gap, d, s + gap))
                waiting[tier].sort()
                gap = 0
        if gap:
            waiting[lower[0]] += [(n, d, s) for d, s, n in sequence]
        else:
            yield top, sequence
    left: list[tuple[int, int, int]] = []
    for tier in reversed(lower):
        left = yield from _fill(waiting[tier] + left, tier)
    size = lower[0] // 2
    while left:
        left = yield from _fill(left, size)
        size //= 2


def _fill(pieces: list[tuple[int, int, int]], size: int):
    """Sequences of exactly `size` tokens from pieces in order, cut where one is full; returns what is left."""
    sequence, gap = [], size
    stack = pieces[::-1]
    while stack:
        n, d, s = stack.pop()
        take = min(n, gap)
        sequence.append((d, s, take))
        gap -= take
        if n > take:
            stack.append((n - take, d, s + take))
        if not gap:
            yield size, sequence
            sequence, gap = [], size
    return [(n, d, s) for d, s, n in sequence]


OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, tier int, step_group long, row_id long"


def pack_documents(docs: DataFrame, *, path: str | None = None, tiers=TIERS, end_id: int = END_ID, chunk_tokens: int = CHUNK_TOKENS, special: dict[str, int] = SPECIAL) -> DataFrame:
    """Pieces of the packed sequences of `docs` (doc_id, text; other columns are not read).

    Columns: doc_id (of its own type), start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group, row_id. Null text
    is an empty text, one end id. Repeated rows, and null doc_ids, are packed as rows of their own, which row_id tells apart. `special`
    names tokens that are one id inside a text. A chunk's sequences of one tier are split into the fewest step groups of STEP_TOKENS
    tokens at most, whose numbers of sequences differ by one at most.
    An empty table gives no pieces. `path` is a tiktoken rank file.
    """
    path = path or token_file()
    mark = end_id.to_bytes(ID_BYTES, "little")
    kinds = [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("tier", pa.int32()), ("step_group", pa.int64()), ("row_id", pa.int64())]

    def packed(keys: list, ids: list[bytes], base: int, key_type: pa.DataType) -> pa.RecordBatch:
        rows: list[tuple] = []
        filled: dict[int, int] = {}
        sequences = list(pack([len(x) // ID_BYTES for x in ids], tiers))
        total = Counter(tier for tier, _ in sequences)
        groups = {tier: -(-n // max(1, STEP_TOKENS // tier)) for tier, n in total.items()}
        for k, (tier, sequence) in enumerate(sequences):
            filled[tier] = filled.get(tier, 0) + 1
            group = (base << 24) + (tier << 12) + (filled[tier] - 1) * groups[tier] // total[tier]
            at = 0
            for doc, start, n in sequence:
                crc = zlib.crc32(memoryview(ids[doc])[start * ID_BYTES : (start + n) * ID_BYTES])
                rows.append((keys[doc], start, n, crc, len(ids[doc]) // ID_BYTES, (base << 24) + k, at, tier, group, (base << 24) + doc))
                at += n
        batch = pa.schema([("doc_id", key_type), *kinds])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), batch)], schema=batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = encoder(path, special)
        base, keys, ids, n = TaskContext.get().partitionId() << 16, [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(key)
                ids.append(ids_of(text or "") + mark)
                n += len(ids[-1]) // ID_BYTES
                if n >= chunk_tokens:
                    yield packed(keys, ids, base, b.column(0).type)
                    base, keys, ids, n = base + 1, [], [], 0
        if keys:
            yield packed(keys, ids, base, b.column(0).type)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {OUT}")


def op9_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
