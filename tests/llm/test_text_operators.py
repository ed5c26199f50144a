"""The text operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from framewright.llm import chat, decontaminate, fingerprints, language_id, minhash, packing, queries, secrets, sharding, token_files, tokens, warc
from framewright.llm.common import FILES, Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, key string, shard string, row string, id string, h string"


def words(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def edited(draw, text, share):
    return " ".join(f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split(" "))


def texts():
    draw = random.Random(11)
    base = [words(draw, n) for n in (3, 4, 5, 30, 80, 200, 200, 300)]
    near = [edited(draw, base[6], s) for s in (0.01, 0.02, 0.03, 0.05) for _ in range(4)]
    exact_ = [base[5]] * 6 + [base[5].upper(), f"\t{base[5]}  "]
    odd = [None, None, "", "", "   ", "...", "one", "One", "é ß Ü naïve", "你好 世界", "x" * 5000, words(draw, 9000), "It's <|endoftext|> 'tis", 'token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"', "secret=token:abcdefghij AKIAABCDEFGHIJKL token==x"]
    return base + near + exact_ + odd


def table(spark, rows=None, extra=()):
    rows = [(n, t) for n, t in enumerate(texts())] if rows is None else rows
    rows = [*rows, *extra]
    full = [(i, t, None if k % 7 == 0 else ("en", "fr")[k % 2], None if k % 5 == 0 else f"s{k % 3}", None, "clash", 1, "clash", "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


EDGES = [(None, "a row without an id has words enough"), (5, texts()[5]), (5, "another text under the same id, quite unlike")]


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = word_list(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= percent * either:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_are_brute_force(spark, k):
    rows = [(n, t) for n, t in enumerate(texts())]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark), words=k).collect()}
    want = brute_components(rows, k, 80)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_copies_of_one_text_lose_no_link(spark):
    draw = random.Random(5)
    base = words(draw, 160, 10**6)
    rows = [(n, edited(draw, base, draw.choice([0.01, 0.03, 0.05, 0.06, 0.08]))) for n in range(90)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), words=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_small_tables_go_to_few_files_of_many_partitions(spark, monkeypatch):
    draw, files, write = random.Random(5), {}, Scratch.write
    base = words(draw, 160, 10**6)
    rows = [(n, edited(draw, base, draw.choice([0.01, 0.03, 0.05, 0.06, 0.08]))) for n in range(90)]

    def counted(scratch, df, name, *most):
        out = write(scratch, df, name, *most)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), words=4).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_components(rows, 4, 80)
    small = ("classes", "members", "weights", "first_pairs", "scored", "joined_0", "joined_1", "placed", "groups", "classed")
    assert {name: files[name] for name in small if files[name] > FILES} == {}


def test_rows_without_id_and_repeated_rows(spark):
    rows = minhash.near_duplicates(table(spark, [], EDGES + [(9, "same text here now ok"), (9, "same text here now ok")]), words=4).collect()
    assert len(rows) == 5 and [r.kept for r in rows if r.doc_id is None] == [True] and all(r.component_id == 9 for r in rows if r.doc_id == 9)
    kept = minhash.deduplicated(table(spark, [(1, "a b c d e f g"), (2, "A B c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g")])).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1] and kept[0].key == "clash"


CLASHES = ["__kept", "__text", "__spans", "__clean", "__language", "__score", "__leaking", "id", "h", "h1", "h2", "doc", "mark", "row", "clean", "no_id", "lang_pred", "salt"]


def clashing(spark, rows):
    """Rows with columns whose names the stages use themselves."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(c).alias(c) for c in CLASHES])


def test_stages_take_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g"), (2, "A B c d e f g"), (3, "see " + "Ab1" + "Xy9" * 8 + " end"), (4, None), (None, "a b c d e f g"), (None, None), (5, "the other text of some words")]
    docs, bench = clashing(spark, rows), spark.createDataFrame([(1, "the other text of some words")], "item_id long, text string")
    for frame, ids in (
        (minhash.deduplicated(docs), [1, 3, 4, 5, None, None]),
        (secrets.redact(docs), [1, 2, 3, 4, 5, None, None]),
        (decontaminate.without_leaks(docs, bench), [1, 2, 3, 4, None, None]),
        (language_id.known_language(docs), [1, 2, 3, 5, None]),
    ):
        got = frame.collect()
        assert frame.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i in ids)
        assert all(r[c] == c for r in got for c in CLASHES)


def test_unlabelled_corpora_stay_whole(spark):
    docs = clashing(spark, [(1, "one text"), (2, None), (3, "123")]).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in language_id.known_language(docs).collect()) == [1, 2, 3]


def test_a_pivot_of_very_many_pairs_is_salted(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_A_TASK", 3)
    draw = random.Random(15)
    base = words(draw, 160, 10**6)
    rows = [(n, edited(draw, base, draw.choice([0.01, 0.05, 0.08, 0.3]))) for n in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), words=4).collect()}
    assert got == brute_components(rows, 4, 80)


def shuffled_bytes(spark, action):
    """What action returns, and the bytes that its stages wrote for shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        listed = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return [listed.apply(k) for k in range(listed.size())]

    last = max((s.stageId() for s in stages()), default=-1)
    out = action()
    return out, sum(s.shuffleWriteBytes() for s in stages() if s.stageId() > last)


def test_comparisons_move_few_sets_besides_their_own(spark):
    draw, rows = random.Random(21), []
    for _ in range(8):  # all sets are needed at first, and after that those of a few members that are apart from their pivot
        base = words(draw, 4000, 10**6)
        rows += [(len(rows) + k, edited(draw, base, share)) for k, share in enumerate((0, 0.01, 0.015, 0.02, 0.06, 0.08))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, moved = shuffled_bytes(spark, lambda: {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), words=4).collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == brute_components(rows, 4, 80)
    sets = 8 * sum(n for n, _ in got.values())
    assert moved < 10 * sets


def test_maps_that_are_full_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MAP_BITS", 64)
    monkeypatch.setattr(minhash, "MOST_BITS", 64)
    assert minhash.map_bits(10**6) == 64
    draw = random.Random(22)
    bases = [words(draw, 120, 10**6) for _ in range(12)]
    rows = [(n, edited(draw, bases[n % 12], draw.choice([0.01, 0.03, 0.05, 0.08]))) for n in range(96)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), words=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_maps_grow_with_their_ids():
    assert minhash.map_bits(0) == minhash.MAP_BITS and minhash.map_bits(10**9) == minhash.MOST_BITS
    assert 16 * 10**6 <= minhash.map_bits(10**6) <= 32 * 10**6


def test_parts_of_one_text_are_no_links_but_their_copies_are(spark):
    draw = random.Random(16)
    whole = words(draw, 400, 10**6).split(" ")
    rows = [(0, " ".join(whole))]
    for k in range(12):  # parts that are contained in one text, some nearly equal to each other
        a = draw.randrange(0, 200)
        rows += [(3 * k + 1, " ".join(whole[a : a + 200])), (3 * k + 2, " ".join(whole[a + 4 : a + 206])), (3 * k + 3, edited(draw, " ".join(whole[a : a + 200]), 0.02))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, rows), words=4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_signatures_estimate_similarity():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(7919)
    s = minhash.super_minhash(np.concatenate([minhash.mix(a[:900]), minhash.mix(a[100:])]), np.array([900, 900]), 240)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08
    one = minhash.super_minhash(np.array([5, 5], dtype=np.uint64), np.array([1, 1]), 240)
    assert (one[0] == one[1]).all() and (one != minhash.EMPTY).all()


def test_empty_tables(spark):
    none = table(spark, [])
    path = queries.vocabulary()
    for frame in (
        minhash.near_duplicates(none), minhash.deduplicated(none), packing.pack(none, path), sharding.shard_documents(none), token_files.token_files(none, path),
        secrets.find_secrets(none), secrets.redact(none), language_id.language_id(none), language_id.known_language(none), fingerprints.fingerprints(none),
        decontaminate.leaks(none, none.select(F.col("doc_id").alias("item_id"), "text")), warc.archive_round_trip(none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))),
        chat.read_back(chat.format_conversations(none.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("text").alias("role"), "text"))),
    ):
        assert frame.count() == 0


def reference_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(reference_ids, "coder"):
        reference_ids.coder = Tokenizer.from_file(queries.vocabulary())
        reference_ids.coder.encode_special_tokens = True
    return reference_ids.coder.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_word_encoder_is_the_library():
    draw = random.Random(2)
    alphabet = "aAzZéÉßÀÿµªº²'’sStTdDllre09 .,;!|<>́İΣς你  \x1c\n_-"
    cases = texts() + ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    flat, starts = tokens.word_encoder(queries.vocabulary()).column(pa.array(cases, pa.string()))
    for k, t in enumerate(cases):
        assert flat[starts[k] : starts[k + 1]].tolist() == reference_ids(t), t


def test_token_files_round_trip(spark):
    got = token_files.token_files(table(spark, None, EDGES), queries.vocabulary(), shard_tokens=300).collect()
    order = sorted([(n, t) for n, t in enumerate(texts())] + EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = reference_ids(t) + [2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert [tuple(r)[:4] for r in got if r.doc_id is None] == want[:1]
    assert len({(r.part, r.shard) for r in got}) > 5


def test_wavelet_matrix():
    draw = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 1), (700, 9), (5000, 70000)):
        ids = draw.integers(0, top, n).astype(np.uint32)
        raw = token_files.encode_shard(ids, np.array([n]), np.array([1]))
        shard = token_files.WaveletShard(lambda a, b, raw=raw: raw[a : a + b])
        assert (shard.decode() == ids).all()
        for i in range(0, n, 37):
            assert shard.access(i) == ids[i]
            assert shard.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
            k = int((ids[:i] == ids[i]).sum())
            assert shard.select(int(ids[i]), k) == i
        assert shard.count(top + 1) == 0


def test_packing(spark):
    got = packing.pack(table(spark, None, EDGES), queries.vocabulary(), capacity=64, keep_ids=True)
    rows = got.collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)):
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and r.length == len(r.ids) // 4 and r.start == 64 * r.piece
    for i, t in enumerate(texts()):
        if i != 5:
            ids = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece))
            assert np.frombuffer(ids, "<u4").tolist() == reference_ids(t) + [0]
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    made = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(got).collect()}
    assert made == {s: sum(n for _, n in p) for s, p in whole.items()}


def test_plans_use_every_piece_and_few_sequences():
    draw = np.random.default_rng(4)
    for scale, most in ((1, 30), (40, 30), (3000, 200)):
        counts = np.zeros(129, dtype=np.int64)
        for length in draw.integers(1, 129, most):
            counts[length] += draw.integers(1, scale + 1)
        rows = packing.plan_rows(counts, packing.fit_patterns(counts, 100))
        used = Counter()
        fill = Counter()
        for length, a, b, base, copies, offset in rows:
            assert (b - a) % copies == 0 and offset + copies * length <= 128
            used[length] += b - a
            for s in range((b - a) // copies):
                fill[base + s] += copies * length
        assert {k: v for k, v in used.items() if v} == {k: int(v) for k, v in enumerate(counts) if v}
        assert max(fill.values()) <= 128 and len(fill) <= 1.25 * -(-sum(fill.values()) // 128) + 2


def test_patterns_carry_most_pieces_of_a_large_histogram():
    draw = np.random.default_rng(8)
    counts = np.bincount(np.minimum(512, draw.lognormal(4.2, 1.0, 40_000).astype(np.int64) + 1), minlength=513)
    plan = packing.fit_patterns(counts)
    used = np.zeros(513, dtype=np.int64)
    for lengths, n in plan:
        assert sum(lengths) == 512 and len(lengths) <= 3 and n > 0
        for v in lengths:
            used[v] += n
    assert (used <= counts).all() and len(plan) <= packing.THINNING[-1][1] * 512 + 1
    long = np.arange(513) > 512 // 3  # a pattern of three lengths has one of these
    assert used[long].sum() >= 0.8 * counts[long].sum()
    rows = packing.plan_rows(counts, plan)
    sequences = max(r[3] + (r[2] - r[1]) // r[4] for r in rows)
    assert sequences <= -(-int((counts * np.arange(513)).sum()) // 512) + 2


def test_numbering_in_cells_by_count(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL_PIECES", 2)  # so that most lengths have many cells
    rows = packing.pack(table(spark, [(k, words(random.Random(k % 9), 3 + k % 9)) for k in range(300)]), queries.vocabulary(), capacity=64).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for parts in ends.values():
        assert [0, *(e for _, e in sorted(parts))][:-1] == [a for a, _ in sorted(parts)] and max(parts)[1] <= 64
    assert len(rows) >= 300 and any(r.in_pattern for r in rows)


def test_shards(spark):
    rows = sharding.shard_documents(table(spark, None, EDGES), shards=7).collect()
    assert len(rows) == len(texts()) + 3
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and 0 <= s < 7
    of = {}
    for r in rows:
        of.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    by = {n: t for n, t in enumerate(texts())}
    assert all(r["size"] == len((by[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in rows if r.doc_id not in (None, 5))


def test_shards_have_the_least_capacity(spark):
    draw = random.Random(29)
    rows = [(n, words(draw, draw.choice([1, 5, 60, 400])) if n % 9 else texts()[5]) for n in range(150)] + [(200, None), (201, "")]
    frame = table(spark, rows)
    order = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64(F.col("text").isNull(), "text").alias("h")).collect()}
    for shards in (3, 7, 40):
        got = sharding.shard_documents(frame, shards=shards).collect()
        groups = {}
        for r in got:
            groups.setdefault(order[r.doc_id], []).append(r)
        sizes = [sum(r["size"] for r in groups[h]) for h in sorted(groups)]

        def needed(capacity):
            n, held = 1, 0
            for size in sizes:
                n, held = (n + 1, size) if held + size > capacity else (n, held + size)
            return n

        least = next(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)
        held = Counter()
        for r in got:
            held[r.shard] += r["size"]
        assert max(held.values()) <= least
        numbers = [{r.shard for r in groups[h]} for h in sorted(groups)]
        assert all(len(n) == 1 for n in numbers) and [min(n) for n in numbers] == sorted(min(n) for n in numbers)


def test_minimax_is_least():
    draw = np.random.default_rng(0)
    for t in range(150):
        n, k = int(draw.integers(1, 60)), int(draw.integers(1, 9))
        size = draw.integers(1, 100, n)
        size[draw.integers(n)] *= 1 + 5 * (t % 2)
        cells = sharding.Cells(np.arange(n), np.full(n, 64), size, np.ones(n, bool))
        capacity = cells.least(k, False)

        def fits(c):
            shards, held = 1, 0
            for s in size:
                if s > c:
                    return False
                if held + s > c:
                    shards, held = shards + 1, 0
                held += s
            return shards <= k

        assert fits(capacity) and not fits(capacity - 1)
        cuts = [0, *cells.cuts(capacity, k), n]
        assert max(size[a:b].sum() for a, b in zip(cuts, cuts[1:])) <= capacity


def test_secrets(spark):
    own = "Ab1" + "Xy9" * 8
    extra = [(100, f"see {own} end"), (101, "password: 'commonexample1'"), (102, "password: 'commonexample1'"), (103, "PassWd=commonexample1"), (104, "api-key apikey = \"é\" api_key:abcdefgh1 deadbeef" + "0" * 40)]
    frame = table(spark, None, extra)
    got = {r.doc_id: r for r in secrets.find_secrets(frame).collect()}
    kinds = (
        ("assign", re.compile("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    )
    for i, t in [*enumerate(texts()), *extra]:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in p.finditer(t or "") if len(m.group(g)) >= least)
        joined = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(","))
    assert got[100].spans == f"owned:4:{4 + len(own)}"
    clean = {r.doc_id: r for r in secrets.redact(frame).collect()}
    assert clean[100].text == "see [SECRET] end" and clean[3].text == texts()[3] and len(clean) == len(texts()) + 5
    assert clean[100].key == "clash" and clean[100].n_chars == len(clean[100].text)


def test_very_many_matches_in_one_text(spark):
    def seconds(n):
        text = " ".join(f"token=value{k:07d} é" for k in range(n))
        docs = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
        began = time.time()
        found = secrets.find_secrets(docs).first()
        clean = secrets.redact(docs).first().text
        assert found.n_assign == n and clean == " ".join(["[SECRET] é"] * n)
        return time.time() - began

    seconds(10)
    assert seconds(32_000) < 4 * seconds(8_000) + 5  # in proportion, with some seconds of overhead


def test_spans_that_touch_and_overlap(spark):
    long = "Ab1" + "Xy9" * 8
    texts_ = [f"{long} {long}", f"token={long}", f"x{long}=token:{long}", f"AKIA{'B' * 12}{'a' * 40} {long}", f"{'0' * 40}token={'1' * 40}", f"é{long}é", f"secret={'f' * 32}.{long} {long}"]
    docs = spark.createDataFrame([(k, t, "s", "en") for k, t in enumerate(texts_)], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    owned = re.compile(secrets.OWNED)
    for k, t in enumerate(texts_):
        base = [(m.start(), n, m.end()) for n, p in enumerate((secrets.ASSIGN, secrets.ACCESS, secrets.HEX)) for m in re.finditer(p.replace("\\x20", " "), t) if n or len(m.group(2)) >= 8]
        more = [(m.start(), 3, m.end()) for m in owned.finditer(t) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert got[k] == ",".join(f"{secrets.KINDS[n]}:{a}:{b}" for a, n, b in sorted(base + more)), t


def test_redaction_takes_what_one_owner_has_in_many_repositories(spark):
    own, common = "Ab1" + "Xy9" * 8, "Cd2" + "Zw8" * 8
    rows = [(k, f"see {own} end", "one", lang) for k, lang in enumerate(("en", "fr", "de", None))] + [(k, f"see {common} end", f"s{k % 2}", "en") for k in (10, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {k: "see [SECRET] end" if k < 10 else t for k, t, *_ in rows}
    assert all(r.spans == "" for r in secrets.find_secrets(docs).collect())  # as its SQL says


def test_leaks(spark):
    draw = random.Random(9)
    items = [(1, words(draw, 40, 10**6)), (2, words(draw, 20, 10**6) + ". Last, one!"), (3, "too short"), (None, "x"), (4, None)]
    first = items[0][1].split(" ")
    docs = [
        (1, words(draw, 50) + " " + items[0][1].upper() + " " + words(draw, 50)),
        (2, " ".join(first[20:]) + " between " + " ".join(first[:20])),  # two halves in the other order
        (3, " ".join(first[:15])),
        (4, None), (5, ""), (6, words(draw, 3000)), (7, items[1][1].replace(".", " ;")), (None, items[0][1]),
    ]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id): (r.tiles, r.coverage) for r in decontaminate.leaks(table(spark, docs), bench).collect()}
    assert found == {(1, 1): (1, 1.0), (2, 1): (2, 1.0), (7, 2): (1, 1.0), (None, 1): (1, 1.0)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(table(spark, docs), bench).collect()) == [3, 4, 5, 6]


def test_leaks_in_capitals_with_accents(spark):
    draw = random.Random(12)
    said = [f"{draw.choice(['ción', 'éonle', 'ñandú', 'žluť', 'над'])}{draw.choice('àêïõüç')}{draw.randrange(10**6)}" for _ in range(40)]
    capitals = [w.upper() for w in said]
    docs = [
        (1, words(draw, 50) + " " + " ".join(capitals) + " " + words(draw, 50)),
        (2, " ".join(capitals[20:]) + " between " + " ".join(capitals[:20])),
        (3, " ".join(capitals[:15])),
    ]
    for item in (said, capitals):
        bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
        found = {(r.doc_id, r.item_id): (r.tiles, r.coverage) for r in decontaminate.leaks(table(spark, docs), bench).collect()}
        assert found == {(1, 1): (1, 1.0), (2, 1): (2, 1.0)}
        lower = table(spark, [(i, t.lower()) for i, t in docs])
        assert [r.doc_id for r in decontaminate.without_leaks(lower, bench).collect()] == [3]


def test_clean_rows_without_id_or_of_a_leaking_id_stay(spark):
    draw = random.Random(13)
    item = words(draw, 30, 10**6)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = [(None, item), (None, "clean, without an id"), (None, None), (4, item), (4, "clean, of the same id"), (4, item + " again"), (5, "clean")]
    kept = decontaminate.without_leaks(table(spark, docs), bench)
    assert kept.columns == table(spark, docs).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "clean, without an id"), (4, "clean, of the same id"), (5, "clean")]


def brute_tiles(item, doc, least):
    """Again and again the longest unmarked match; of equal ones that which starts first in the item, then in the doc."""
    marked_i, marked_d, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and a + n not in marked_i and b + n not in marked_d:
                    n += 1
                best = max(best, (n, -a, -b))
        if best[0] < least:
            return tiles
        tiles.append((-best[1], -best[2], best[0]))
        marked_i |= set(range(-best[1], -best[1] + best[0]))
        marked_d |= set(range(-best[2], -best[2] + best[0]))


def test_tiling_is_brute_force():
    draw = random.Random(1)
    many = 0
    for trial in range(400):
        item, doc = (np.array([draw.randrange(2 + trial % 4) for _ in range(draw.randint(0, 22))], dtype=np.uint64) for _ in "ab")
        want = brute_tiles(item.tolist(), doc.tolist(), 1 + trial % 3)
        assert decontaminate.tile(minhash.mix(item), minhash.mix(doc), 1 + trial % 3) == want
        many += len(want) > 2
    assert many > 100


def test_tiling_of_one_repeated_word_is_no_product():
    item, doc = np.full(3000, 7, dtype=np.uint64), np.full(200_000, 7, dtype=np.uint64)
    assert decontaminate.tile(item, doc, 5) == [(0, 0, 3000)]


def test_leaks_are_brute_force(spark):
    draw = random.Random(19)
    pool = [words(draw, 12, 9) for _ in range(6)]  # few words, so that many runs are shared
    items = [(k, " ".join(draw.sample(pool, 2)) if k else "w1 w2 w3") for k in range(5)] + [(4, "two")]
    docs = [(k, " ".join(draw.choice([*pool, words(draw, 8, 9), "w1 w2 w3"]) for _ in range(draw.randint(0, 4)))) for k in range(40)] + [(50, "only two"), (50, "only two"), (51, "w1 w2")]
    want = []
    for i, t in docs:
        for j, u in items:
            a, b = u.split(), t.split()
            n = min(5, len(a))
            size = sum(x[2] for x in brute_tiles(a, b, n))
            if size >= len(a) / 2 and (len(a) >= 5 or size == len(a)):
                want.append((i, j, size))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.tiled_words) for r in got) == sorted(want) and len(want) > 20
    kept = decontaminate.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs if not any(i == w[0] and len(dict(items[:5])[w[1]].split()) >= 5 for w in want if w[1] != 4 or w[2] > 1))


def brute_features(text):
    """Counts of the hashed n-grams of one text, by plain loops."""
    points = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()}  "]
    counts = Counter()
    for at in range(len(text.lower()) + 1):
        h = 0
        for k in range(3):
            h = (h + points[at + k] + k + 1) * 0x9E3779B1 % 2**32
            h ^= h >> 15
            counts[(h * 0x85EBCA6B % 2**32) >> (32 - language_id.FEATURE_BITS)] += 1
    return counts


def brute_language_model(rows):
    """(doc_id, text, lang) -> scores by language of any text: TF-IDF, FTRL, elastic net and temperature with plain loops."""
    learn = [(i, t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 4 != 2 and g and t and any(c.isalpha() for c in t)]
    langs = sorted({g for _, _, g in learn})
    df = Counter(f for _, t, _ in learn for f in brute_features(t))
    idf = lambda f: math.log((1 + len(learn)) / (1 + df[f])) + 1

    def vector(t):
        counts = brute_features(t)
        total = sum(counts.values())
        return {f: language_id.SCALE * n / total * idf(f) for f, n in sorted(counts.items())} | {-1: 1.0}

    draws = {i: xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42) >> 1 for i, _, _ in learn}
    sample = sorted(learn, key=lambda r: (r[2], draws[r[0]]))
    fit = [(vector(t), langs.index(g)) for k, (_, t, g) in enumerate(sample) if k % language_id.CALIBRATION]
    rest = [(vector(t), langs.index(g)) for k, (_, t, g) in enumerate(sample) if k % language_id.CALIBRATION == 0]
    z, n = {}, {}

    def weight(f, k):
        zs = z.get((f, k), 0.0)
        if abs(zs) <= language_id.L1:
            return 0.0
        return -(zs - math.copysign(language_id.L1, zs)) / ((language_id.BETA + math.sqrt(n.get((f, k), 0.0))) / language_id.ALPHA + language_id.L2)

    def chances(x, heat=1.0):
        said = [sum(v * weight(f, k) for f, v in x.items()) / heat for k in range(len(langs))]
        e = [math.exp(a - max(said)) for a in said]
        return [a / sum(e) for a in e]

    order = np.random.default_rng(1)
    for _ in range(language_id.PASSES):
        for j in order.permutation(len(fit)):
            x, label = fit[j]
            p = chances(x)
            now = {(f, k): weight(f, k) for f in x for k in range(len(langs))}
            for f, v in x.items():
                for k in range(len(langs)):
                    g = v * (p[k] - (k == label))
                    old = n.get((f, k), 0.0)
                    n[f, k] = old + g * g
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(n[f, k]) - math.sqrt(old)) / language_id.ALPHA * now[f, k]
    loss = lambda heat: -sum(math.log(max(chances(x, heat)[k], 1e-12)) for x, k in rest)
    heats = [math.exp(math.log(0.05) + s * (math.log(20) - math.log(0.05)) / 60) for s in range(61)]
    best = min(heats, key=loss)
    return langs, lambda t, heat: chances(vector(t), heat), best, loss


def test_language_model_is_brute_force(spark):
    draw = random.Random(4)
    tongues = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "mnopéñab"}
    say = lambda g: " ".join("".join(draw.choice(tongues[g]) for _ in range(draw.randint(2, 6))) for _ in range(draw.randint(2, 12)))
    rows = [(k, say(g := draw.choice(list(tongues))), g if draw.random() < 0.9 else None) for k in range(80)] + [(90, None, "xx"), (91, "12 ..", "yy"), (92, "", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    langs, chances, heat, loss = brute_language_model(rows)
    model = language_id.train(language_id.Scratch(spark, "test"), docs)
    assert model.languages == langs and loss(model.temperature) <= loss(heat) + 1e-6
    for r in language_id.language_id(docs).collect():
        text = rows[r.doc_id][1] if r.doc_id < 80 else None
        if text:
            p = chances(text, model.temperature)
            assert r.score == pytest.approx(max(p), abs=2e-4) and r.lang_pred == langs[p.index(max(p))]
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_predictions_do_not_depend_on_the_neighbours():
    texts_ = pa.array(["abc def", "", None, "zzz", "x" * 50, "é"])
    weights = np.random.default_rng(0).normal(size=(3, 1 << language_id.FEATURE_BITS)).astype(np.float32)
    model = language_id.Model(["a", "b", "c"], weights, np.zeros(3))
    together, _ = model.logits(texts_)
    for k in range(len(texts_)):
        assert np.allclose(model.logits(texts_.slice(k, 1))[0][0], together[k], atol=1e-5)


def test_sample_is_bounded_and_takes_repeated_rows_once(spark):
    rows = [(k, f"text {k}", "xx") for k in range(500)] + [(7, "text 7", "yy")] * 300 + [(8, "text 8", "yy")]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    last = language_id.last_buckets(learn, 50)
    chosen = learn.where((F.col("lang") == "xx") & (language_id.bucket_of(F.col("draw")) <= last["xx"])).count()
    assert 40 <= chosen <= 50 and set(last) == {"xx", "yy"}


def test_language_id(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.lit("clash").alias("score"), F.lit("clash").alias("lang_pred"))
    got = language_id.language_id(frame).join(frame.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id % 1 for r in got} == {0} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    odd = frame.unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "123 ...", "en"), (-3, "", None)], "doc_id long, text string, lang string"), allowMissingColumns=True)
    assert {r.lang_pred for r in language_id.language_id(odd).where("doc_id < 0").collect()} == {"und"}
    kept = language_id.known_language(odd)
    assert kept.columns == odd.columns and kept.where("doc_id < 0").count() == 0 and kept.count() >= 0.98 * frame.count()


def test_fingerprints(spark):
    rows = [(n, t) for n, t in enumerate(texts())]
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(spark)).collect()}
    prints = {}
    for k, (i, t) in enumerate(rows):
        t, other = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + other[:n]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        prints.setdefault(t, set()).add(got[i].fingerprint)
        if other == t:
            assert got[i].near_next == 1
    assert all(len(p) == 1 for p in prints.values())
    again = fingerprints.fingerprints(table(spark, [(1, "a b c"), (1, "a b c"), (None, "d e"), (None, None)]))
    assert sorted(r.n_chars for r in again.collect()) == [0, 3, 5, 5]


def spark_hash(values):
    """Spark's xxhash64 of a string, or of an array of longs: each element's hash seeds the next one's."""
    if isinstance(values, str):
        return xxhash.xxh64_intdigest(values.encode(), seed=42)
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return seed


def brute_prints(rows, edits):
    """For each text and its edit the entries by plain loops, None where a subset has no term."""
    split = lambda t: {spark_hash(w) >> 4 for w in re.split(r"[ \t-\r!-/:-@\[-`{-~]+", t.lower()) if w}
    sets = [split(t) for t in rows]
    df = Counter(m for s in sets for m in s)
    n = len(rows)
    band = {m for m, c in df.items() if max(2, n / fingerprints.MANY) <= c <= max(2, n / fingerprints.FEW)}

    def entries(terms):
        held = sorted(terms & band)
        out = [spark_hash(held) >> 33 if held else None, None if held else spark_hash(sorted(terms)) >> 33]
        for p in fingerprints.PATTERNS:
            some = [m for m in held if m & p == 0]
            out.append(spark_hash(some) >> 33 if some else None)
        return out

    return [entries(s) for s in sets], [entries(split(t)) for t in edits]


def brute_likeness(a, b):
    either = sum(x is not None or y is not None for x, y in zip(a, b))
    return sum(x is not None and x == y for x, y in zip(a, b)) / either


def test_fingerprints_are_brute_force(spark):
    draw = random.Random(21)
    rows = [t or "" for t in texts()] + [words(draw, draw.choice([5, 40, 300, 2000]), 3000) for _ in range(40)]
    edits = []
    for k, t in enumerate(rows):
        other, n = rows[(k + 1) % len(rows)], len(t) // 4
        edits.append(t[: len(t) - n] + other[:n])
    own, edited_ = brute_prints(rows, edits)
    said = lambda entries: "".join("-" if e is None else f"{e:08x}" for e in entries)
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(spark, list(enumerate(rows)))).collect()}
    for k in range(len(rows)):
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (said(own[k]), said(edited_[k]))
        assert got[k].near_edited == pytest.approx(brute_likeness(own[k], edited_[k]))
        assert got[k].near_next == pytest.approx(brute_likeness(own[k], own[(k + 1) % len(rows)]))
    assert sum(e is not None for e in own[-1]) > 20


def test_an_edit_keeps_more_entries_than_another_text_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mean = fingerprints.fingerprints(docs).agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    assert mean[0] > 0.2 and mean[1] < 0.02 and mean[2] > 0.9


def test_smallest_doc_id_is_no_null(spark):
    low = -(1 << 63)
    got = fingerprints.fingerprints(table(spark, [(low, "a b c"), (None, "d e f"), (0, "g h")])).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 0, 5), (True, low, 5), (True, 0, 3)]


def test_long_and_short_texts_have_the_same_subsets(spark):
    name = lambda *parts: "q" + "x".join(map(str, parts))
    base = lambda p, n: [name(p, k) for k in range(n)]
    rows = []
    for p in range(8):  # two long texts that differ in one term; the third one puts both terms in the lexicon
        rows += [base(p, 250) + ["only" + name(p, "a")], base(p, 250) + ["only" + name(p, "b")], ["only" + name(p, "a"), "only" + name(p, "b"), "filler" + name(p)]]
    rows += [base(20, 185), base(20, 205), base(20, 205)[185:] + ["q"]]  # about as long, on both sides of 192 terms
    rows += [[f"unique{k}", f"single{k}"] for k in range(40)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(table(spark, [(k, " ".join(t)) for k, t in enumerate(rows)])).collect()}
    joined = [" ".join(t) for t in rows]
    own, _ = brute_prints(joined, joined)
    for k in [*range(0, 24, 3), 24]:  # the likeness of overlapping subsets, the same for texts of any length
        assert got[k].fingerprint != got[k + 1].fingerprint
        assert got[k].near_next == pytest.approx(brute_likeness(own[k], own[k + 1])) and 0.4 < got[k].near_next < 1
    assert len({r.fingerprint for r in got.values()}) == len(rows)


def test_archives(spark):
    draw = random.Random(3)
    pages = [(n, f"http://x/{n}", draw.choice(["<p>é</p>", "", None, words(draw, 500)])) for n in range(60)] + [(None, None, "<p>é</p>"), (3, "http://x/3\r\ny", "twice"), (3, "http://x/3\r\ny", "twice"), (99, None, "\r\n\r\nWARC/1.1")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    got = warc.archive_round_trip(frame).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted((i if i is not None else -1, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.ranges([(0, 10), (10, 5), (10**6, 5), (10**6 + 5, 9 << 20)]) == [(0, 2, 15), (2, 3, 5), (3, 4, 9 << 20)]


def test_selected_records_are_read_through_the_index(spark):
    draw = random.Random(17)
    pages = [(n, f"http://x/{n}", draw.choice(["same", words(draw, 50), f"<p>{n}</p>"])) for n in range(300)]
    scratch = warc.Scratch(spark, "warc-test")
    index = scratch.write(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), scratch.uri("archives")), "index")
    chosen = index.where((F.col("page_id") % 7 == 3) & (F.col("record_type") == "response"))
    want = {r.page_id for r in chosen.collect()}
    got = {r.page_id: r.payload.decode() for r in warc.read_records(chosen, payloads=True).collect()}
    assert got == {i: h for i, _, h in pages if i in want} and len(got) > 20
    rows = sorted((r.file, r.offset, r.length) for r in index.collect())
    name = rows[0][0]
    store, path = warc.file_system(name)
    with store.open_input_file(path) as f:  # every record of the first file is a member by itself, at its place
        for _, offset, length in [r for r in rows if r[0] == name]:
            f.seek(offset)
            assert zlib.decompress(f.read(length), 31).startswith(b"WARC/1.1")


def test_chat_round_trip(spark):
    draw = random.Random(6)
    nasty = ["<|im_end|>", "<\\|im_start|>", "<\\\\|x", "<|", "a\nb", "", None, "é" * 50, "\\", "<\\"]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "a\n<|b\\"]), "".join(draw.choice(nasty) or "" for _ in range(3)) if draw.random() < 0.9 else None) for c in range(20) for t in range(draw.randint(1, 9))]
    rows += [(7, None, None, "no turn"), (None, 0, "assistant", "no conversation"), (8, 0, "user", "twice"), (8, 0, "user", "twice")] + [(50, t, "assistant", words(draw, 30)) for t in range(3000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(3)
    pieces = chat.format_conversations(frame)
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c)
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert sum(r.formatted_chars for r in got.values()) == pieces.agg(F.sum(F.length("formatted"))).first()[0]


def brute_redaction(rows):
    """Texts of (doc_id, text, source) with their secrets replaced, by plain loops."""
    assign, access, hex_, owned = (re.compile(p.replace("\\x20", " ")) for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.OWNED))
    spans, owners = {}, {}
    for i, t, source in rows:
        base = [(m.start(), 0, m.end(), m.group(2)) for m in assign.finditer(t) if len(m.group(2)) >= secrets.LEAST_ASSIGNED]
        base += [(m.start(), k, m.end(), m[0]) for k, p in ((1, access), (2, hex_)) for m in p.finditer(t)]
        mixed = [m for m in owned.finditer(t) if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
        spans[i] = sorted(base + [(m.start(), 3, m.end(), m[0]) for m in mixed if not any(a < m.end() and m.start() < b for a, _, b, _ in base)])
        for *_, value in spans[i]:
            owners.setdefault(value, set()).add(source)
    out = {}
    for i, t, _ in rows:
        clean, at = "", 0
        for a, kind, b, value in spans[i]:
            n = len(owners[value])
            if kind == 3 and n > 1:
                continue
            if a >= at:
                clean += t[at:a] + ("[EXAMPLE-CREDENTIAL]" if n >= secrets.COPIED_OWNERS else "[SECRET]")
            at = max(at, b)
        out[i] = clean + t[at:]
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    given, folder = "/root/testdata/sf0.001", str(tmp_path)
    docs = spark.read.parquet(f"{given}/documents.parquet")
    some = docs.where("length(text) between 400 and 3000 and lang = 'en'").orderBy("doc_id").limit(6).collect()
    said = ["token = abcdefgh12345", "AKIA" + "Q7" * 8, "0123456789abcdef" * 3, "Zq9" * 9 + "xY", "password: 'correct-horse'", "password: 'correct-horse'"]
    planted = [(9000 + k, " ".join([*reversed(r.text.split(" ")), t]), r.lang, f"s{k}", 0) for k, (r, t) in enumerate(zip(some, said))]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{given}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {r.doc_id: r for r in docs.collect()}
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    spoken = {i: r.text for i, r in held.items() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, folder).collect()} == set(spoken)  # all of them are plainly of one language
    keep = {i for i, (_, c) in brute_components(list(spoken.items()), 5, 80).items() if i == c}
    clean = set()
    for i in keep:
        said = re.findall(r"[^\s!-/:-@\[-`{-~]+", spoken[i].lower())
        runs = {tuple(said[k : k + 5]) for k in range(len(said) - 4)}
        near = [x for x in items if len(x) >= 5 and any(tuple(x[k : k + 5]) in runs for k in range(len(x) - 4))]
        if not any(sum(t[2] for t in brute_tiles(x, said, 5)) >= len(x) / 2 for x in near):
            clean.add(i)
    want = brute_redaction([(i, spoken[i], held[i].source) for i in sorted(clean)])
    rows = corpus_pipeline.run(spark, folder).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == clean and sum("[SECRET]" in t for t in want.values()) >= 6
    for i, parts in pieces.items():
        ids = reference_ids(want[i]) + [0]
        assert [(r.start, r.length, r.ids_crc32) for r in sorted(parts, key=lambda r: r.piece)] == [(a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for a in range(0, len(ids), 2048)]
    ends = {}
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for parts in ends.values():
        assert [a for a, _ in sorted(parts)] == [0, *(b for _, b in sorted(parts))][:-1] and max(parts)[1] <= 2048
