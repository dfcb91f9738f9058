"""Bounded-load ring, fair-queue mixing and bin-slack packing: laws, plain versions and edge cases."""

import collections
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from memspark.llm import mixing, packing, sharding

ROWS = [(i, f"word{i % 7} " * (i % 11) + ("x" * (i % 5)), f"s{i % 3 if i % 4 else 0}") for i in range(200)]
EDGES = [(None, None, None), (None, None, None), (500, "", "s0"), (501, "a", None), (501, "a", None), (502, "long " * 5000, "s1")]
DDL = "id long, text string, source string, key string, size int, shard int, copies int, segment int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], DDL).repartition(3)


def ring_by_hand(positions, n_shards, nodes, limits):
    """Keys one by one: all take their own shard while it has room, in ring order; what is left over then walks on clockwise."""
    segments = sharding.ring_segments(n_shards, nodes)
    load, left = [0] * n_shards, []
    owner = {}
    for key, p in sorted(positions.items(), key=lambda x: x[1]):
        i = next(j for j, s in enumerate(segments) if s[1] <= p < s[2])
        if load[segments[i][3]] < limits[segments[i][3]]:
            owner[key] = segments[i][3]
            load[segments[i][3]] += 1
        else:
            left.append((i, key))
    queue = collections.deque()
    for turn in range(2):
        for i, s in enumerate(segments):
            while queue and load[s[3]] < limits[s[3]]:
                owner[queue.popleft()] = s[3]
                load[s[3]] += 1
            if turn == 0:
                queue.extend(k for j, k in left if j == i)
    return owner


def test_shards_are_even_and_follow_the_ring(spark):
    df = table(spark, ROWS)
    got = {r["id"]: r for r in sharding.shard(df, "id", "text", 7, virtual_nodes=3).collect()}
    loads = collections.Counter(r["shard"] for r in got.values())
    assert max(loads.values()) - min(loads.values()) <= 1 and len(got) == len(ROWS)
    for s in loads:
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(loads[s]))
    for i, text, _ in ROWS:
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
    at = {r["id"]: r["p"] for r in df.selectExpr("id", "pmod(xxhash64(0, id, cast(null as bigint)), 4294967296) AS p").collect()}
    want = ring_by_hand(at, 7, 3, sharding.bounds(len(ROWS), 7, 1.0))
    assert {i: r["shard"] for i, r in got.items()} == want


def test_loose_bound_moves_fewer_rows(spark):
    df = table(spark, ROWS)
    moved = []
    for factor in (1.0, 1.5):
        rows = sharding.shard(df, "id", "text", 5, load_factor=factor).collect()
        assert max(collections.Counter(r["shard"] for r in rows).values()) <= factor * len(ROWS) / 5 + 1
        moved.append(sum(r["shard"] != r["home_shard"] for r in rows))
    assert moved[1] <= moved[0]


def test_shard_edges(spark):
    rows = sharding.shard(table(spark, EDGES), "id", "text", 4).collect()
    assert len(rows) == len(EDGES) and sorted(collections.Counter(r["shard"] for r in rows).values()) == [1, 1, 2, 2]
    assert sharding.shard(table(spark, EDGES).limit(0), "id", "text", 4).collect() == []


def targets_by_hand(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        free -= full
    return target


def test_mix_meets_its_targets(spark):
    rows = ROWS + EDGES[2:]
    df = table(spark, rows)
    got = mixing.mix(df, "id", "text", "source").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5), "id", "text", "source").collect()), key=str)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    want, taken, largest = targets_by_hand(sizes), collections.Counter(), collections.Counter()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["source_size"] == sizes[r["mix_source"]]
        assert r["target"] == pytest.approx(want[r["mix_source"]])
        taken[r["mix_source"]] += r["taken"]
        largest[r["mix_source"]] = max(largest[r["mix_source"]], r["size"])
    assert len(got) == len(rows) and sum(taken.values()) <= sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(largest.values())


def test_mix_edges(spark):
    assert mixing.mix(table(spark, ROWS).limit(0), "id", "text", "source").collect() == []
    only_empty = mixing.mix(table(spark, [EDGES[0], EDGES[2]]), "id", "text", "source").collect()
    assert {(r["size"], r["target"], r["copies"]) for r in only_empty} == {(0, 0.0, 0)}


TEXTS = [None, "", " ", "a  b", " lead", "tail ", "it's  a\t b\n\nc ", "x\x85y  z 　 q", "é è à ö", "日本 語", "<|endoftext|>",
         "The quick brown fox " * 300, "1234 5678", "a\x1c b", "emoji 😀 here", "x" * 3000,
         "one doc <|endoftext|> next doc", "<|endoftext|><|endoftext|>", "a<|endoftext|>b  <|endoftext|>  c <|endoftext", "x\n<|endoftext|>\n"]


def test_ids_equal_the_public_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for special in (packing.SPECIAL, None):
        t.encode_special_tokens = special is None
        ids, n = packing.encode_texts(pa.array(TEXTS, pa.string()), packing.default_vocabulary(), None, special)
        want = [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_pack_is_whole_and_gapless(spark):
    rows = list(enumerate(TEXTS * 9)) + [(None, "a b"), (None, "a b"), (3, "again")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "id long, text string, length int, salt int")
    got = packing.pack(df, "id", "text", packing.default_vocabulary(), capacity=64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cut = (len(ids) - 1) % 64 + 1
        pieces = [ids[:cut]] + [ids[i:i + 64] for i in range(cut, len(ids), 64)]
        start = 0
        for i, p in enumerate(pieces):
            want[(k, i, start, len(p), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p)))] += 1
            start += len(p)
    assert collections.Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 1


def test_fullest_against_brute_force():
    import itertools
    import random

    r = random.Random(1)
    for _ in range(60):
        lengths = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        counts = [0] * 25
        for x in lengths:
            counts[x] += 1
        first = max(lengths)
        rest = list(lengths)
        rest.remove(first)
        best = max(first + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if first + sum(c) <= 24)
        found = packing.fullest(counts, 24, first)
        assert sum(found) == best and not collections.Counter(found) - collections.Counter(lengths)


def test_pack_empty_table(spark):
    assert packing.pack(table(spark, ROWS).limit(0), "id", "text", packing.default_vocabulary()).collect() == []
