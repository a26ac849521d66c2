"""Encoding, packing, deduplication, sharding and repeats against plain versions, on small and odd tables."""

import hashlib
import random
import struct
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.llm import bpe, chaining, exact, packing, sharding, simhash, suffix
from caseloom.llm.common import default_vocabulary

CODEC = bpe.Codec(open(default_vocabulary(), encoding="utf-8").read())
ODD = [None, "", " \t\n", "the same text", "the same text", "The  same\ttext", "a", "'LL 's <|endoftext|> <|start", "ΣΑΣ ſ İ",
       "naïve café ÀÉ 12½ ²", "x" * 30_000, "thing " * 5000, "₏἟ 漢字 \U0001f600"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(default_vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def texts(seed, n, long=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, long))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        text = rnd.choice(base) if i % 3 else " ".join(rnd.choice(words) for _ in range(rnd.randint(0, long)))
        out.append(text + (" " + rnd.choice(words) if i % 5 == 0 else ""))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, some of them repeated, with columns named like those of the operators."""
    rows = [(i, t, 1, "x", 2, "y", 3) for i, t in enumerate(ODD)] + [(3, ODD[3], 1, "x", 2, "y", 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row_id int, _text string, ids int, kept string, "
                                       "shard int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def table(spark, some):
    return spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")


def ids_of(data):
    return list(struct.unpack(f"<{len(data) // 4}I", data))


def test_ids_are_those_of_the_library(library):
    for text in [*ODD, *texts(1, 60)]:
        ids = ids_of(CODEC.encode(text))
        assert ids == library.encode(text or "", add_special_tokens=False).ids
        assert CODEC.decode(CODEC.encode(text)) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer
    library = test_ids_of_any_text.__dict__.setdefault("library", Tokenizer.from_file(default_vocabulary()))
    text = text.encode("utf-8", "ignore").decode()
    assert ids_of(CODEC.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_fragments_are_cut_where_no_token_reaches():
    # cutting at pairs that no token contains must not change what whole-word merging gives
    for word in ["zzxqjvk", "thqqing", "ééßß", "a1b2"]:
        raw = word.encode()
        symbols = [*CODEC.inner[list(raw[:-1])].tolist(), int(CODEC.last[raw[-1]])]
        assert ids_of(CODEC.encode_words([word])[0]) == CODEC.merge_long(symbols)


def test_caches_forget_without_changing_ids(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 7)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 50)
    small = bpe.Codec(open(default_vocabulary(), encoding="utf-8").read())
    some = texts(2, 40)
    assert list(small.encode_texts(some)) == [CODEC.encode(t) for t in some]


def test_encode_and_decode_columns(spark, odd, none):
    both = bpe.decode(bpe.encode(odd, default_vocabulary()), default_vocabulary())
    rows = both.collect()
    assert len(rows) == len(ODD) + 1 and "kept" in both.columns
    assert all(r.ids == CODEC.encode(r.text) and r.decoded == CODEC.decode(r.ids) for r in rows)
    assert bpe.encode(none, default_vocabulary()).count() == 0


def test_packing(spark, odd, none):
    pieces = packing.with_crc(packing.pack(odd, default_vocabulary()))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = sorted((tuple(r[n] for n in names) for r in pieces.collect()), key=lambda r: (r[5], r[6]))
    order, seen = [], set()
    for r in rows:  # the order of documents follows from the pieces
        if r[1] == 0:
            order.append(r[0])
    texts_ = dict(enumerate(ODD))
    assert sorted(order) == sorted([*range(len(ODD)), 3])
    assert rows == brute.packed([(n, [*ids_of(CODEC.encode(texts_[n])), 1]) for n in order])
    whole = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(r.length == 2048 == len(r.ids) // 4 for r in whole[:-1]) and not seen
    assert b"".join(r.ids for r in whole) == b"".join(CODEC.encode(texts_[n]) + b"\1\0\0\0" for n in order)
    assert packing.pack(none, default_vocabulary()).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak, tmp_path):
    some = [*texts(3, 90), *ODD[:8], "a b", "ab", " ab "]
    # a digest of one byte makes different texts share digests, so that full texts decide
    digest = (lambda t: F.substring(exact.digest_of(t), 1, 1)) if weak else exact.digest_of
    table(spark, some).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = exact.deduplicate(docs, digest=digest, files_per_batch=1 if weak else None).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found}
    want = brute.exact(list(enumerate(some)))
    assert len(found) == len(some) and got == {n: w[:3] for n, w in want.items()}
    if not weak:
        assert {r.doc_id: r.digest.hex() for r in found} == {n: w[3] for n, w in want.items()}


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    folder, state = str(tmp_path / "records"), str(tmp_path / "state")
    first = exact.located(table(spark, ["a b", "c"]), "text", "doc_id", None)
    exact.records(first).write.parquet(folder)
    assert {r.n for r in exact.take_in(spark, folder, state).collect()} == {1}
    late = table(spark, ["x", "y", "ab  "]).where("doc_id = 2")
    exact.records(exact.located(late, "text", "doc_id", None)).write.mode("append").parquet(folder)
    assert {(r.n, r.id) for r in exact.take_in(spark, folder, state).collect()} == {(1, 1), (2, 2)}


def test_exact_dedup_of_odd_rows(spark, odd, none, tmp_path):
    odd.coalesce(1).write.parquet(str(tmp_path / "odd"))
    found = exact.deduplicate(spark.read.parquet(str(tmp_path / "odd"))).collect()
    assert len(found) == len(ODD) + 1
    assert sum(r.kept for r in found) == len({r.digest for r in found})
    assert exact.deduplicate(none).count() == 0


def test_masks_cover_all_pairs_within_the_radius():
    rnd = random.Random(4)
    for free in ((1 << 64) - 1, rnd.getrandbits(64), 0b1111, 0b101, 0):
        places = [i for i in range(64) if free >> i & 1]
        all_masks = simhash.masks(free)
        assert all_masks and all(m & ~free == 0 for m in all_masks)
        for _ in range(300):
            differ = sum(1 << p for p in rnd.sample(places, min(3, len(places))))
            assert any(m & differ == 0 for m in all_masks)


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_of_fingerprints(spark, bucket):
    rnd = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        seed = rnd.getrandbits(64)
        prints |= {seed ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(12)}
    rows = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print bigint")
    edges = simhash.links(rows, bucket=bucket).collect()
    unsign = lambda x: x & (1 << 64) - 1
    assert all((unsign(e.a) ^ unsign(e.b)).bit_count() <= 3 for e in edges)
    pairs = {frozenset((unsign(e.a), unsign(e.b))) for e in edges}
    order = sorted(prints)
    assert brute.groups(order, lambda a, b: frozenset((a, b)) in pairs) == brute.groups(
        order, lambda a, b: (a ^ b).bit_count() <= 3)


def test_simhash(spark, odd, none):
    some = [*texts(6, 60), *ODD]
    rows = simhash.near_duplicates(table(spark, some)).select(
        "doc_id", simhash.as_hex("print").alias("p"), "component_id").collect()
    prints = {n: brute.fingerprint(t) for n, t in enumerate(some)}
    assert {r.doc_id: r.p for r in rows} == {n: f"{p:016x}" for n, p in prints.items()}
    want = brute.groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert simhash.near_duplicates(odd).count() == len(ODD) + 1
    assert simhash.near_duplicates(none).count() == 0


def test_shards(spark, odd, none):
    rnd = random.Random(7)
    some = ["w" * rnd.randint(0, 400) + str(rnd.randint(0, 300)) for _ in range(2000)] + ["heavy " * 40] * 150 + [None, ""]
    rows = sharding.assign(table(spark, some)).collect()
    size, slots, homes = [0] * 8, [[] for _ in range(8)], {}
    for r in rows:
        body = (some[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes.setdefault(body, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots) and len(rows) == len(some)
    assert max(size) - min(size) < 0.02 * sum(size) / 8 and all(len(h) == 1 for h in homes.values())
    # a group larger than a shard is spread
    rows = sharding.assign(table(spark, ["same text"] * 600 + ["u%d" % i for i in range(900)])).collect()
    size = [sum(r.size for r in rows if r.shard == k) for k in range(8)]
    assert max(size) < 1.3 * sum(size) / 8
    assert sharding.assign(odd).count() == len(ODD) + 1 and sharding.assign(none).count() == 0


def test_matching_statistics():
    rnd = random.Random(8)
    for _ in range(150):
        text = bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randint(1, 50)))
        n = len(text)
        longest = [max((next((k for k in range(n) if max(i, j) + k >= n or text[i + k] != text[j + k]), 0)
                        for j in range(n) if j != i), default=0) for i in range(n)]
        assert suffix.matching_statistics(np.frombuffer(text, np.uint8)).tolist() == longest


@pytest.mark.parametrize("window, anchor, bucket", [(40, 8, 1024), (40, 12, 1), (30, 29, 2)])
def test_repeats(spark, window, anchor, bucket):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(20, 90))) for _ in range(6)]
    some = ["".join(rnd.choice([*base, "x" * rnd.randint(1, 80), "ab" * rnd.randint(1, 30),
                                "".join(rnd.choice("abcdefgh") for _ in range(25))]) for _ in range(rnd.randint(0, 6)))
            for _ in range(60)] + [None, "", base[0] * 2]
    rows = suffix.remove_repeats(table(spark, some), window=window, length=anchor, bucket=bucket).collect()
    want = brute.without_repeats(some, window)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows} == dict(enumerate(want))


def test_repeats_of_odd_rows(spark, odd, none):
    rows = suffix.remove_repeats(odd).collect()
    want = brute.without_repeats([*ODD, ODD[3]], 200)
    assert sorted((r.doc_id, r.n_removed) for r in rows) == sorted(
        (n, w[1]) for n, w in zip([*range(len(ODD)), 3], want))
    assert suffix.remove_repeats(none).count() == 0


def test_anchors_of_stretches_are_those_of_the_whole(monkeypatch):
    rnd = random.Random(10)
    data = np.array([rnd.choice(b"abcdef") for _ in range(5000)], dtype=np.uint8)
    whole = suffix.anchors(data)
    monkeypatch.setattr(suffix, "STRETCH", 700)
    assert all((a == b).all() for a, b in zip(whole, suffix.anchors(data)))


def brute_chain(pos, at):
    """Best chain score, looking at all predecessors; the best one is that of the highest score less the gap."""
    weight, best = (chaining.SEED + chaining.WINNOW) / 2, []
    for j in range(len(pos)):
        before = max(((best[k] + chaining.GAP * (pos[k] + at[k]), k) for k in range(j) if pos[k] < pos[j] and at[k] < at[j]),
                     default=(-1e9, -1))
        gain, k = before[0] - chaining.GAP * (pos[j] + at[j]), before[1]
        best.append(gain + min(weight, pos[j] - pos[k], at[j] - at[k]) if gain > 0 else weight)
    return max(best)


def test_chains_are_in_order_and_best():
    rnd = random.Random(11)
    for _ in range(100):
        links = sorted({(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(rnd.randint(2, 25))})
        pos, at = [p for p, _ in links], [a for _, a in links]
        found = chaining.chains(pos, at)
        for _, chain in found:
            assert all(pos[a] < pos[b] and at[a] < at[b] for a, b in zip(chain, chain[1:]))
        if brute_chain(pos, at) > (chaining.SEED + chaining.WINNOW) / 2:  # more than one link
            assert found[0][0] == pytest.approx(brute_chain(pos, at))


def test_common_words():
    x, y = np.array([1, 2, 3, 4, 5], np.uint16), np.array([9, 1, 3, 4, 8, 5, 7], np.uint16)
    assert chaining.common_words(x, y) == 4 and chaining.common_words(x, x[:0]) == 0


def test_shared_passages(spark, odd, none):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    passages = [some(rnd.randint(70, 110)) for _ in range(4)]
    docs, planted = [], {}
    for i in range(80):
        body = some(rnd.randint(20, 150))
        if i % 2:
            passage = [rnd.choice(words) if rnd.random() < 0.03 else w for w in passages[i % 4 - 1 if i % 4 else 0]]
            at = rnd.randint(0, len(body))
            planted[i] = (len(" ".join([*body[:at], ""])), len(" ".join([*body[:at], *passage])))
            body = body[:at] + passage + body[at:]
        docs.append(" ".join(body))
    docs += [docs[0], None]
    rows = {r.doc_id: r for r in chaining.shared_passages(table(spark, docs)).collect()}
    for i in range(1, 80):
        if i in planted:
            low, high = planted[i]
            hit = sum(max(0, min(b, high) - max(a, low)) for a, b in zip(rows[i].starts, rows[i].stops))
            assert hit > 0.9 * (high - low) and rows[i].n_removed - hit < 60 and rows[i].partner_id % 2 == 1
        else:
            assert rows[i].n_spans == 0 and rows[i].partner_id is None and bytes(rows[i].kept) == docs[i].encode()
    words_of_copy = len(docs[0].split())
    assert (rows[0].class_id, rows[80].class_id) == (0, 0)
    assert rows[0].n_removed == (len(docs[0]) if words_of_copy >= 50 else 0)
    assert chaining.shared_passages(odd).count() == len(ODD) + 1
    assert chaining.shared_passages(none).count() == 0


def test_chains_are_aligned_without_shuffling_texts(spark, monkeypatch):
    """However many chains there are, blocks of hashes go to them, not the texts."""
    from caseloom.llm import common
    monkeypatch.setattr(common, "FEW_ENTRIES", 0)
    rnd = random.Random(5)
    word = lambda: rnd.randbytes(100).hex()
    passage = [word() for _ in range(80)]
    texts = [[word() for _ in range(150)] + passage, passage + [word() for _ in range(150)],
             *([word() for _ in range(230)] for _ in range(20))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row_id bigint, _text string")
    chained = spark.createDataFrame([(1, 0, 1, [160, 200], [10, 50])],
                                    "chain bigint, row_id bigint, other bigint, pos array<int>, at array<int>")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages, n = store.stageList(None, False, False, none, None).iterator(), 0
        while stages.hasNext():
            n += stages.next().shuffleWriteBytes()
        return n

    before, threshold = shuffled(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        found = {tuple(r) for r in chaining.aligned(chained, docs, chaining.SEED, 50, 0.8).collect()}
    finally:
        spark.conf.unset(threshold)
    assert found == {(0, 150, 230, 1), (1, 0, 80, 0)}
    assert shuffled() - before < sum(len(" ".join(t)) for t in texts) / 10


def test_passages_on_both_sides_of_a_gap(spark):
    """Pairs of documents with an exact header and footer and other words between."""
    rnd = random.Random(13)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(50_000)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    docs, planted = [], []
    for size, between in [(60, 35), (60, 40), (60, 45), (60, 60), (100, 60), (100, 75), (100, 90)] * 3:
        header, footer = some(size), some(size)
        for _ in range(2):
            middle = some(between)
            docs.append(" ".join(header + middle + footer))
            planted.append((len(" ".join(header)), len(" ".join([*header, *middle, ""]))))
    rows = {r.doc_id: r for r in chaining.shared_passages(table(spark, docs)).collect()}
    for i, (stop, start) in enumerate(planted):
        assert rows[i].partner_id == i ^ 1 and rows[i].n_spans == 2
        assert abs(rows[i].stops[0] - stop) < 25 and abs(rows[i].starts[1] - start) < 25
        assert (rows[i].starts[0], rows[i].stops[1]) == (0, len(docs[i]))


def test_runs_are_the_longest():
    rnd = random.Random(14)
    for _ in range(300):
        n = rnd.randint(1, 12)
        pos = sorted(rnd.sample(range(100), n))
        gain = np.cumsum([0, *(rnd.randint(-3, 2) for _ in range(n - 1))])
        low = rnd.randint(0, n - 1)
        a, b = chaining.longest_run(low, n - 1, gain, pos, -1.0)
        assert low <= a <= b and gain[b] - gain[a] >= -1
        assert pos[b] - pos[a] == max(pos[j] - pos[i] for i in range(low, n) for j in range(i, n) if gain[j] - gain[i] >= -1)


def test_digest_columns_of_the_queries(spark):
    from caseloom.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, folder).collect():
        ids = CODEC.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(CODEC.decode(ids).encode()).hexdigest()
    want = brute.without_repeats([docs[n] for n in sorted(docs)], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix"](spark, folder).collect()}
    assert got == {n: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for n, w in zip(sorted(docs), want)}


def test_all_holders_of_a_seed_are_compared(spark):
    """A passage whose halves stand in other documents too, which come before and after; and one of many documents, some of
    which share more than the others."""
    rnd = random.Random(15)
    words = [f"w{i}" for i in range(50_000)]
    some = lambda n: [rnd.choice(words) for _ in range(n)]
    one, two, line, more = some(30), some(30), some(30), some(60)
    held = {1: one, 9: one, 5: one + two, 6: one + two, 2: two, 8: two, 4: line + more, 11: line + more}
    docs = {k: " ".join(some(60) + held.get(k, line if k > 11 else []) + some(60)) for k in range(1, 40)}
    rows = {r.doc_id: r for r in chaining.shared_passages(spark.createDataFrame(
        list(docs.items()), "doc_id bigint, text string")).collect()}
    assert {k: r.partner_id for k, r in rows.items() if r.n_spans} == {5: 6, 6: 5, 4: 11, 11: 4}
    for k in (5, 6, 4, 11):
        text = " ".join(held[k])
        at = docs[k].index(text)
        assert abs(rows[k].starts[0] - at) < 25 and abs(rows[k].stops[0] - at - len(text)) < 25


def test_pairs_of_blocks_are_all_pairs(spark, monkeypatch):
    """Every pair with two seeds in common has all its links, whatever its commonest seeds are and however it is dealt."""
    monkeypatch.setattr(chaining, "BLOCK", 3)
    rnd = random.Random(16)
    held = {d: {p * 3: rnd.choice([0, 0, 0, 1, 1, 2, *range(3, 30)]) for p in range(rnd.randint(1, 6))} for d in range(40)}
    seeds = spark.createDataFrame([(h, d, p) for d, places in held.items() for p, h in places.items()],
                                  "h bigint, row_id bigint, pos int")
    found = {}
    for r in chaining.links_of(seeds, 12).collect():
        found.setdefault((r.row_id, r.other), set()).add((r.pos, r.at))
    n = 0
    for a in held:
        for b in held:
            if a >= b:
                continue
            want = {(p, q) for p, h in held[a].items() for q, g in held[b].items() if h == g}
            some = [h for h in set(held[a].values()) if min(sum(g == h for g in x.values()) for x in (held[a], held[b])) > 2]
            if some or len({held[a][p] for p, _ in want}) < 2:  # linked in order; one seed in common
                continue
            n += 1
            assert found[a, b] == want
    assert n > 40
