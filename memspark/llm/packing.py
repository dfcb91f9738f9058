"""Best-fit packing by minimum bin slack.

Documents become token sequences, cut into pieces of at most one bin. Pieces of equal length are interchangeable, so the
bins are planned on the number of pieces per length, a table of at most ``capacity`` numbers: for the longest length left,
a subset-sum dynamic program over bitsets finds the fullest feasible combination of the lengths still available; that
combination is removed as often as the numbers allow, and so on. The plan then goes back to the pieces by their rank within
their length. No token and no piece leaves the executors, only counts do.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.llm import common

#: Pieces of one length are ranked in this many hash groups, so that a common length is not one task.
SALTS = 64
#: Texts of so many bytes are encoded together; one longer text is encoded alone.
SLICE_BYTES = 2 << 20
#: Byte values that count as white space to the vocabulary's splitting pattern, and lead bytes of white space beyond ASCII.
ASCII_SPACE = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
WIDE_SPACE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
#: The special token of the default vocabulary: its string in a text is one id.
SPECIAL = {b"<|endoftext|>": 50256}
_encoders: dict = {}


def _encoder(vocabulary: str):
    """(encode, bytes of each id) of a rank file, once per worker."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            widths[i] = len(token)
        _encoders[vocabulary] = (encoding.encode_ordinary, widths)
    return _encoders[vocabulary]


def _byte_sets() -> tuple[np.ndarray, np.ndarray]:
    white, lead = np.zeros(256, bool), np.zeros(256, bool)
    white[list(ASCII_SPACE)] = True
    lead[list(WIDE_SPACE_LEADS)] = True
    return white, lead


def _encode_distinct(chunks: pa.Array, encode, widths: np.ndarray, special: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks in a row, ids per chunk). Chunks that begin with a cut and end before one are encoded joined, as
    the pattern cuts between them again; their ids are told apart by bytes. The others are encoded one by one. Chunks in
    ``special`` have the one id that it gives them."""
    white, lead = _byte_sets()
    offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
    start, end = offsets[:-1], offsets[1:]
    joined = (end - start > 4) & (data[start] == 32)
    one = np.flatnonzero(joined)
    last = data[end[one] - 1]
    joined[one] = ~(white[data[start[one] + 1]] | lead[data[start[one] + 1]] | white[last]
                    | ((last >= 0x80) & (last < 0xB0) & (lead[data[end[one] - 2]] | lead[data[end[one] - 3]])))
    sizes = np.zeros(len(chunks), np.int64)
    alone = {}
    for i in np.flatnonzero(~joined).tolist():
        raw = data[start[i]:end[i]].tobytes()
        alone[i] = [special[raw]] if special and raw in special else encode(raw.decode())
        sizes[i] = len(alone[i])
    one = np.flatnonzero(joined)
    picked = chunks.take(pa.array(one))
    keep = picked.buffers()[2].to_pybytes()[:int((end[one] - start[one]).sum())] if len(one) else b""
    ids = np.array(encode(keep.decode()), np.int64)
    ends = np.cumsum(widths[ids])
    upto = np.searchsorted(ends, np.cumsum(end[one] - start[one]), side="right")
    sizes[one] = np.diff(upto, prepend=0)
    flat = np.empty(int(sizes.sum()), np.uint32)
    place = np.cumsum(sizes) - sizes
    n = sizes[one]
    flat[np.repeat(place[one] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    for i, own in alone.items():
        flat[place[i]:place[i] + len(own)] = own
    return flat, sizes


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where the texts in ``data`` can be cut without changing their ids: text starts, and single spaces between
    two characters that are no white space. The vocabulary's pattern starts a new pre-token at each of these."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < len(data) - 1)]
    follows, before = data[at + 1], data[at - 1]
    white, lead = _byte_sets()
    wide_end = (before >= 0x80) & (lead[data[at - 2]] | lead[data[at - 3]]) & (before < 0xB0)
    cut = np.zeros(len(data) + 1, bool)
    cut[at[~(white[follows] | lead[follows] | white[before] | wide_end)]] = True
    cut[starts] = True
    return np.flatnonzero(cut[:-1])


def _marker_bounds(data: np.ndarray, special: dict[bytes, int]) -> np.ndarray:
    """Starts and ends of special tokens' strings in the bytes of all texts; text bounds fall inside none of them."""
    raw, out = data.tobytes(), []
    for marker in special:
        at = raw.find(marker)
        while at >= 0:
            out += [at, at + len(marker)]
            at = raw.find(marker, at + len(marker))
    return np.array(out, np.int64)


def encode_texts(texts: pa.Array, vocabulary: str, end_id: int | None, special: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each text). Equal chunks of a batch are encoded once. The strings in
    ``special`` become one id each wherever they occur, and what is between them is encoded by itself."""
    encode, widths = _encoder(vocabulary)
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    known = offsets[:-1][offsets[:-1] < offsets[-1]]
    if special:
        bounds = _marker_bounds(data, special)
        known = np.concatenate([known, bounds[bounds < len(data)]])
    starts = chunk_starts(data, np.unique(known))
    ends = np.append(starts[1:], len(data))
    chunk_offsets = np.append(starts, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(chunk_offsets), pa.py_buffer(data.tobytes())])
    coded = chunks.dictionary_encode()
    flat, sizes = _encode_distinct(coded.dictionary, encode, widths, special)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    which = coded.indices.to_numpy()
    lengths = sizes[which]
    total = int(lengths.sum())
    at = np.repeat(first[which] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total) if total else np.zeros(0, np.int64)
    ids = flat[at]
    # ids per text: chunks belong to the text they start in
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    n = np.bincount(text_of, weights=lengths, minlength=len(offsets) - 1).astype(np.int64)
    if end_id is None:
        return ids, n
    out = np.full(total + len(n), end_id, np.uint32)
    out[np.arange(total) + np.repeat(np.arange(len(n)), n)] = ids
    return out, n + 1


def token_pieces(df: DataFrame, key: str, text: str, vocabulary: str, capacity: int, end_id: int, special: dict[bytes, int]) -> DataFrame:
    """(key, text_crc, piece, start, length, ids_crc32): each text's ids and the end id, cut into pieces of ``capacity``;
    the first piece takes the remainder. A null text counts as empty."""
    key_type = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, SLICE_BYTES):
            ids, n = encode_texts(batch.column(1), vocabulary, end_id, special)
            raw = ids.astype("<u4").view(np.uint8)
            pieces = -(-n // capacity)
            first = n - (pieces - 1) * capacity
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            base = (np.cumsum(n) - n)[row] + start
            view = memoryview(raw)
            crc = [zlib.crc32(view[4 * b:4 * (b + m)]) for b, m in zip(base.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        cut, f"key {key_type}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: list[int], capacity: int, first: int) -> list[int]:
    """The fullest combination of available lengths that holds ``first``, as a list of lengths, longest first."""
    space = capacity - first
    reached, steps = 1, []
    mask = (1 << (space + 1)) - 1
    for length in range(min(first, space), 0, -1):
        have = counts[length] - (length == first)
        have = min(have, space // length)
        k = 1
        while have > 0:  # multiples in powers of two
            k = min(k, have)
            steps.append((reached, length, k))
            reached |= (reached << (length * k)) & mask
            have -= k
            k *= 2
        if reached >> space & 1:
            break
    filled = reached.bit_length() - 1
    taken = [first]
    for before, length, k in reversed(steps):
        if not before >> filled & 1:
            taken += [length] * k
            filled -= length * k
    return sorted(taken, reverse=True)


def plan_bins(counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, end rank, first bin, offset) for every place of every combination, and the number of bins."""
    counts = list(counts)
    used = [0] * (capacity + 1)
    plan, bins = [], 0
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return plan, bins
        combination = fullest(counts, capacity, longest)
        need = {x: combination.count(x) for x in set(combination)}
        times = min(counts[x] // m for x, m in need.items())
        offset = 0
        for x in combination:
            plan.append((x, used[x], used[x] + times, bins, offset))
            used[x] += times
            counts[x] -= times
            offset += x
        bins += times


def pack(df: DataFrame, key: str, text: str, vocabulary: str, capacity: int = 1024, end_id: int = 2,
         special: dict[bytes, int] = SPECIAL) -> DataFrame:
    """Pack every row into bins of ``capacity`` tokens.

    Returns per piece: ``key``, piece, start, length, ids_crc32, sequence_id (from 0), offset. Null and empty texts are one
    end token. Repeated rows and rows with a null key are packed as rows of their own. An empty table gives no rows. Other
    columns are not read. ``vocabulary`` is the path of a byte-pair rank file that every executor can read, ``special`` has the
    ids of its special tokens' strings, which a rank file does not list.
    """
    spark = df.sparkSession
    salt = F.pmod(F.xxhash64("key", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    pieces = common.stored(token_pieces(df, key, text, vocabulary, capacity, end_id, special).withColumn("salt", salt))
    groups = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    heads = common.stored(groups.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    counts = [0] * (capacity + 1)
    for r in heads.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    plan, _ = plan_bins(counts, capacity)
    places = spark.createDataFrame(plan, "length long, first long, last long, first_bin long, offset long")
    order = Window.partitionBy("length", "salt").orderBy("key", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("at", F.row_number().over(order)).join(
        F.broadcast(heads.drop("n")), ["length", "salt"])  # at most capacity * SALTS rows
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at") - 1)
    placed = ranked.join(F.broadcast(places), "length").where("rank >= first and rank < last")
    return placed.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
                         (F.col("first_bin") + F.col("rank") - F.col("first")).cast("long").alias("sequence_id"),
                         "offset")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


