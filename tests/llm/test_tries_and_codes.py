"""Vector codes, the prefix trie and window packing against brute force on small tables with awkward rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from infospan.llm import exact_dedup, prefix_trie, queries, rans, tokens, vector_codes, window_packing

SF = "/root/testdata/sf0.001"
WORDS = tokens.public_path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_prefix_trie"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLES[name]).df()
    cell = lambda v: None if v is None or v is pd.NA or v != v else v if isinstance(v, str) else float(v)
    rows = lambda df: sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert rows(found) == rows(wanted)


# Window packing


def packed(spark, rows, parts=3, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, ids int, low int").repartition(parts)
    return window_packing.pack(frame, WORDS, **options)


def check_packing(pieces, texts, capacity, slack=0):
    """Every id of every document in one piece, sequences without gaps; returns the padding."""
    from tokenizers import Tokenizer

    library, by_doc, by_sequence = Tokenizer.from_file(WORDS), defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    wanted = defaultdict(list)
    for key, text in texts:
        wanted[key].append([*library.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(by_doc) == set(wanted)
    for key, lists in wanted.items():
        total = sum(map(len, lists))
        assert sum(p["length"] for p in by_doc[key]) == total
        if len(lists) == 1:
            at, ids = 0, lists[0]
            for p in sorted(by_doc[key], key=lambda p: p["start"]):
                assert (p["start"], p["doc_tokens"]) == (at, len(ids))
                assert np.frombuffer(p["ids"], "<u4").tolist() == ids[at : at + p["length"]]
                at += p["length"]
    padding = 0
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


AWKWARD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (4, "word " * 5000), (5, "日本語 ünï"), (6, " \n\t "), (7, "<|endoftext|> x"), (8, "tail " * 97)]


@pytest.mark.parametrize(("capacity", "open_windows"), [(64, 1), (64, 4), (100, 3), (2048, 64), (1, 1)])
def test_window_packing(spark, capacity, open_windows):
    draw = random.Random(capacity)
    texts = AWKWARD + [(100 + i, " ".join(draw.choice("alpha beta gamma delta".split()) for _ in range(draw.randrange(90)))) for i in range(150)]
    if capacity == 1:
        texts = [t for t in texts if t[0] != 4][:30]
    rows = [(k, t, "s", 1, 2) for k, t in texts]
    pieces = packed(spark, rows, capacity=capacity, open_windows=open_windows).collect()
    assert check_packing(pieces, texts, capacity) == 0


def test_window_packing_with_slack_cuts_less(spark):
    draw = random.Random(5)
    texts = [(i, "alpha " * draw.randrange(5, 60)) for i in range(400)]
    rows = [(k, t, "s", 1, 2) for k, t in texts]
    tight, loose = (packed(spark, rows, parts=1, capacity=128, open_windows=8, slack=s).collect() for s in (0, 6))
    assert check_packing(tight, texts, 128) == 0
    assert check_packing(loose, texts, 128) <= 0.05 * sum(p["length"] for p in loose)
    assert len(loose) < len(tight)


def test_window_packing_of_no_rows(spark):
    assert packed(spark, []).count() == 0


def test_one_task_packs_as_a_plain_version():
    """Best fit among a bounded number of windows, item by item."""
    draw, capacity, most = random.Random(1), 50, 4
    lengths = [draw.randrange(1, 120) for _ in range(500)]
    windows, found = window_packing.OpenWindows(capacity, most), []
    for i, n in enumerate(lengths):
        found += [(w.used, tuple(w.pieces)) for w in windows.place(i, n)]
        assert len(windows.rooms) <= most
    open_, wanted = [], []  # (room, order, pieces)
    order = 0
    for i, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:
            wanted.append((capacity, ((i, start, capacity),)))
            start += capacity
        while start < n:
            fits = [w for w in open_ if w[0] >= n - start]
            if fits:
                w = min(fits, key=lambda w: w[:2])
                open_.remove(w)
            elif len(open_) < most:
                w = [capacity, None, []]
            else:
                w = min(open_, key=lambda w: w[:2])
                open_.remove(w)
            taken = min(w[0], n - start)
            w[2].append((i, start, taken))
            w[0] -= taken
            start += taken
            if w[0]:
                order += 1
                w[1] = order
                open_.append(w)
            else:
                wanted.append((capacity, tuple(w[2])))
    assert found == wanted
    full, last = windows.drain()
    assert all(w.used == capacity for w in full) and last.used < capacity
    assert sum(n for _, p in found for *_, n in p) + sum(w.used for w in [*full, last]) == sum(lengths)


def test_sequences(spark):
    texts = [(i, "alpha beta " * i) for i in range(40)]
    pieces = packed(spark, [(k, t, "s", 1, 2) for k, t in texts], capacity=64).persist()
    rows = window_packing.sequences(pieces).collect()
    assert sum(r["n_tokens"] for r in rows) == pieces.agg(F.sum("length")).first()[0]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    first = {(p["sequence_id"], p["offset"]): p["ids"] for p in pieces.collect()}
    assert all(r["ids"].startswith(bytes(first[r["sequence_id"], 0])) for r in rows)


# Vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """Lloyd's rounds with all distances, in Python's integers."""
    kept = [(k, label, [math.floor(scale * int(x)) if abs(x) > 1e15 else math.floor(scale * x) for x in v], v) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    book = [[cut(s[2], p) for s in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(seeds)), key=lambda k: (far(cut(v, p), book[p][k]), k))
    for _ in range(rounds):
        own = [[nearest(r[2], p) for p in range(parts)] for r in kept]
        for p in range(parts):
            for k in range(len(seeds)):
                members = [cut(r[2], p) for r, o in zip(kept, own, strict=True) if o[p] == k]
                if members:
                    book[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [(r[0], r[1], [nearest(r[2], p) for p in range(parts)]) for r in kept]
    return sorted(((k, label, e, sum(far(cut(r[2], p), book[p][e[p]]) for p in range(parts))) for (k, label, e), r in zip(found, kept, strict=True)), key=repr), book


def vectors(n, seed, length=8, grid=None):
    draw = random.Random(seed)
    value = (lambda: draw.choice(grid)) if grid else lambda: draw.gauss(0, 1)
    return [(i, [float(np.float32(value())) for _ in range(length)], draw.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        vectors(400, 1),
        vectors(300, 2, grid=[0.0, 0.25, -0.25, 0.5]),  # ties in most places
        vectors(5, 3),
        [(7, [0.5] * 8, None)] * 40 + [(7, [0.25] * 8, 3), (None, [1.0] * 8, 1), (8, None, 1), (9, [math.nan] + [0.0] * 7, 1), (10, [math.inf] + [0.0] * 7, 2), (11, [None] + [0.0] * 7, 2)],
        [*vectors(60, 4), (1000, [1e9, -1e9] * 4, 5), (1001, [3e5, -3e5] * 4, 5)],
        [],
    ],
)
def test_vector_codes_against_all_distances(spark, rows):
    frame = spark.createDataFrame([(*r, 0, "k") for r in rows], "vec_id long, embedding array<float>, label int, entry int, kind string").repartition(3)
    coded = vector_codes.code(frame, parts=4, entries=16, rounds=6)
    as32 = [(k, v and [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    wanted, book = plain_codes(as32, 4, 16, 6, 4096)
    found = sorted(((r["id"], r["label"], list(r["entry"]), r["error"]) for r in coded.rows.collect()), key=repr)
    assert found == [(k, label, e, x if x < 1 << 63 else None) for k, label, e, x in wanted or []]
    assert [[list(e) for e in p] for p in coded.book.entries] == book
    sums = defaultdict(int)
    for _, label, _, x in wanted or []:
        sums[label] += x
    for r in vector_codes.with_label_errors(coded.rows).collect():
        assert r["label_error"] == (sums[r["label"]] if sums[r["label"]] < 1 << 63 else None)


def test_bounds_leave_out_most_distances(spark):
    draw = random.Random(9)
    centres = [[draw.gauss(0, 4) for _ in range(8)] for _ in range(16)]
    rows = [(i, [x + draw.gauss(0, 0.1) for x in centres[i % 16]], 1) for i in range(2000)]
    coded = vector_codes.code(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=16)
    assert 2000 * 2 * 8 < coded.computed[0] <= 2000 * 2 * 16
    assert max(coded.computed[2:]) < 0.1 * coded.computed[0]


def test_vectors_of_another_length_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="must have 8 components"):
        vector_codes.code(rows)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.code(rows.where("vec_id = 2"))


# The prefix trie


def plain_trie(conversations):
    """conversations: {id: [(role, text), ...]}; rows as the query returns them."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for node, ids in members.items():
        below = [k for k in members if k[: len(node)] == node]
        inner = {k[:-1] for k in members if k}
        ends = ",".join(map(str, sorted(c for c in ids if len(conversations[c]) == len(node))))
        rows.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(k) == len(node) + 1 for k in below),
            sum(k not in inner for k in below), sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def plain_rebuilt(rows):
    kept = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            kept[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in kept.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return rebuilt


def conversations(kind):
    draw = random.Random(kind)
    if kind == "random":
        return [(c, t, draw.choice(["user", "bot"]), draw.choice("abc")) for c in draw.sample(range(-50, 400), 120) for t in range(draw.randrange(7))]
    if kind == "awkward":
        return [
            (None, 1, "user", "x"), (5, None, "user", "first"), (5, 2, None, None), (5, 2, "", ""), (5, 1, "user", "é" * 50), (6, 1, "user", "é" * 50), (6, 1, "user", "é" * 50), (7, 3, "a", "bc"), (8, 3, "ab", "c"),
            *[(10, t, "user", str(t)) for t in range(700)], *[(11, t, "user", str(t)) for t in range(699)], (12, 0, "user", "0"), (-7, 0, "x", "y"), (-5, 0, "x", "z"),
        ]
    if kind == "hot":  # one conversation and its beginnings over all tasks
        return [(c, t, "user", f"turn {t}") for c in range(0, 4000, 5) for t in range(3 + c % 2)] + [(c, t, "user", f"turn {t}") for c in range(1, 3000, 5) for t in range(9)]
    return []


@pytest.mark.parametrize("chunk", [8192, 30])
@pytest.mark.parametrize("kind", ["random", "awkward", "hot", "empty"])
def test_prefix_trie(spark, kind, chunk):
    rows = conversations(kind)
    frame = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, id string, size int").repartition(3)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        h = F.crc32(F.col("id").cast("string").cast("binary")) % 9
        arrays = prefix_trie.grafted(prefix_trie.turn_arrays(frame), F.col("id") - F.col("id") % 5, h, most=8)
        found = prefix_trie.trie(arrays, chunk).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    wanted = plain_trie(plain_rebuilt(rows)) if kind != "awkward" else None
    if kind == "awkward":  # brute force over long arrays, the long ones' nodes by their own count
        rebuilt = plain_rebuilt(rows)
        short = {c: t[:40] for c, t in rebuilt.items()}
        by_depth = {(r[0], r[1]): r for r in plain_trie(short)}
        assert len(found) == len({tuple(t[:d]) for t in rebuilt.values() for d in range(len(t) + 1)})
        assert all(by_depth[r["conv_id"], r["depth"]][2:4] == (r["parent_conv_id"], r["n_convs"]) for r in found if r["depth"] <= 40)
        root = next(r for r in found if r["depth"] == 0)
        leaves = {tuple(t) for t in rebuilt.values()}
        assert root["n_leaves"] == sum(not any(len(o) > len(t) and o[: len(t)] == t for o in leaves) for t in leaves)
        return
    assert sorted((tuple(r) for r in found), key=repr) == wanted


# Bounds and widths of earlier operators


def test_exact_dedup_lets_go_of_many_equal_rows(spark):
    rows = exact_dedup.ROWS_HELD + 1000
    many = spark.range(rows).coalesce(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    parts = exact_dedup._partial(many, "doc_id", "text", "bigint", 1 << 26)
    assert parts.where("content IS NOT NULL").count() == 2  # a representative for each time
    found = exact_dedup.groups(many, "doc_id", "text").groupBy("keep_id", "group_size").count().collect()
    assert [tuple(r) for r in found] == [(0, rows, rows)]


def test_ids_over_16_bits_come_back(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = [f"w{i}" for i in range(70_000)]
    wide = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="w0"))
    wide.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "wide.json")
    wide.save(path)
    assert rans.largest_id(path, 2) == 69_999
    texts = [(1, "w69999 w5 w65536"), (2, "w65541"), (3, None)]
    found = rans.round_trip(spark.createDataFrame(texts, "doc_id long, text string"), path, end_id=2).collect()
    ids = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in found}
    assert ids == {1: [69_999, 5, 65_536, 2], 2: [65_541, 2], 3: [2]}
