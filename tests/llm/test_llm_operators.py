"""Each operator against a brute-force version on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import bpe, html_extract, language_id, licenses, packing, quality, simhash, tokenio, tokens, topk, unigram
from quarry.llm.tokens import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 97} and the {i}th of them." for i in range(6000))
TEXTS = [
    None, "", " ", "\n\n\t", "a", "The quick brown fox jumps over the lazy dog near the river bank today.",
    "The quick brown fox jumps over the lazy dog near the river bank today.", "the QUICK brown fox jumps over the lazy dog near the river bank today!",
    "Élan vital   and\x1cmore　text <|endoftext|> tail  ", "x" * 700, LONG, "one two three four five six seven eight nine " * 8,
    "line one here\nline one here\nother\n\n other \nline one here", "numbers 1 22 333 #*$%&|<>", "é combining ́start \U0001f600 emoji\r\nwin",
    "Released under the MIT License.", "ta ta ta ta", "\x01mark", " lead", "trail ", "a  b", "a \n b", "'s 'll don't", "0", "ßẞ İı",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ["en", "fr", None][i % 3], f"s{i}", 7) for i, t in enumerate(TEXTS)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, kept int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("name,drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_piece_encoder_is_the_library(name, drops):
    import random

    rnd = random.Random(5)
    parts = ["a", "The ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "　", "'s", "<|endoftext|>", "<|startoftext|>", "é", "é", "ß", "Σ", "中文", "12", "%%%", "!!", "\U0001f600", "İ", "ﬁ", "\x01", "word", " word", ".\nNext"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(600)]
    own = tokens.PieceEncoder(tokenizer_path(name), drops, keep=50, longest=8, at_once=500)
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_bytes(texts)] == want


@pytest.mark.parametrize("bits,least,most", [(3, 4, 32), (9, 128, 4096)])
def test_chunks_are_repaired_to_the_library(bits, least, most):
    texts = [t or "" for t in TEXTS] * 2
    own = bpe.ChunkEncoder(tokenizer_path("byte_bpe_50k.json"), bits, least, most)
    want = [e.ids for e in library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
    assert own.reused > 0
    assert all("".join(own.chunks(t)) == t for t in texts)


def test_op4_encode_and_decode(spark, docs):
    lib = library("byte_bpe_50k.json")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in rows_of(docs):
        ids = lib.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert got == want and bpe.encode_digests(docs).count() == docs.count()
    assert bpe.encode_digests(empty(spark)).count() == 0
    for r in bpe.encode_documents(docs).collect():
        assert r.decoded == dict(rows_of(docs))[r.doc_id]


def test_op7_files(spark, docs, tmp_path):
    lib = library("byte_bpe_50k.json")
    folder = f"file://{tmp_path}/store"
    tokenio.write(docs, folder, block=5000)
    got = sorted((r.doc_id, r.start, r.n_tokens, tuple(r.ids)) for r in tokenio.read(spark, folder).collect())
    start, want = 0, []
    for i, t in sorted(rows_of(docs)):
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), tuple(ids)))
        start += len(ids)
    assert got == want
    digests = {(r.doc_id, r.start, r.ids_crc32) for r in tokenio.round_trip(docs).collect()}
    assert digests == {(i, s, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, _, ids in want}
    assert tokenio.round_trip(empty(spark)).count() == 0
    with_null = spark.createDataFrame([(None, "b"), (2, None), (1, "a")], "doc_id long, text string")
    assert [r.doc_id for r in sorted(tokenio.round_trip(with_null).collect(), key=lambda r: r.start)] == [None, 1, 2]


def test_control_bytes_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rnd.integers(0, 2**32, n, dtype=np.uint64) >> rnd.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (tokenio.unpack(*tokenio.pack(v), n) == v).all()
        ids, lengths, values = tokenio.read_block(tokenio.write_block([5, -3], [n, 0], v))
        assert ids.tolist() == [5, -3] and lengths.tolist() == [n, 0] and (values == v).all()


def test_op8_packing(spark, docs):
    lib, most = library("word_bpe_49k.json"), 2048
    out = packing.pack(docs).collect()
    want = Counter()
    for i, t in rows_of(docs):
        ids = lib.encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), most):
            want[(i, k // most, k, len(ids[k : k + most]), zlib.crc32(np.array(ids[k : k + most], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    full: dict = {}
    for r in out:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in full.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= most
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_places_every_piece(seed):
    rnd, most = np.random.default_rng(seed), 64
    lengths = np.minimum(most, 1 + rnd.geometric([0.05, 0.3, 0.02, 0.1][seed], 3000))
    counts = np.bincount(lengths, minlength=most + 1)
    plan = packing.plan(counts, most)
    ranks = np.zeros(len(lengths), dtype=np.int64)
    for v in range(1, most + 1):
        at = np.flatnonzero(lengths == v)
        ranks[at] = np.arange(len(at))
    sequence, offset = plan.at(lengths, ranks)
    cells = {(s, o + k) for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist()) for k in range(n)}
    assert len(cells) == lengths.sum() and max(c for _, c in cells) < most
    bound = -(-int(lengths.sum()) // most)
    assert bound <= plan.n_sequences <= bound * 1.02 + 1


@pytest.mark.parametrize("pieces", [10_000, 200_000])
def test_patterns_pack_most_pieces_and_no_worse_than_best_fit(pieces):
    rnd, most = np.random.default_rng(pieces), 2048
    lengths = np.clip(rnd.lognormal(6.2, 1.0, pieces).astype(int), 1, most)
    counts = np.bincount(lengths, minlength=most + 1)
    turns = list(packing.by_patterns(counts, most))
    for groups, left in turns:  # patterns and rest are the histogram, and patterns fill their sequences
        used = np.zeros(most + 1, dtype=np.int64)
        for n, parts in groups:
            assert sum(length * times for length, times in parts) == most
            for length, times in parts:
                used[length] += n * times
        assert (used + left == counts).all()
    assert turns[-1][1].sum() <= 0.1 * pieces
    plain = sum(n for n, _ in packing.best_fit(counts, most))
    assert -(-int(lengths.sum()) // most) <= packing.plan(counts, most).n_sequences <= plain


def test_patterns_are_all_exact_fills():
    most, counts = 24, np.zeros(25, dtype=np.int64)
    counts[[3, 4, 5, 6, 8, 9, 12, 15, 24]] = 7
    have = set(np.flatnonzero(counts).tolist())
    want = {tuple(sorted(x for x in (a, b, most - a - b) if x)) for a in have for b in have | {0} if most - a - b in have | {0}}
    want |= {tuple(sorted([a] * n + ([most - n * a] if most - n * a else []))) for a in have for n in range(1, most // a + 1) if most - n * a in have | {0}}
    found = packing.patterns(counts, most)
    got = [tuple(sorted(int(v) for v, m in zip(vs, ms) for _ in range(m))) for vs, ms in zip(found.lengths, found.times)]
    assert len(got) == len(set(got)) and set(got) == {w for w in want if sum(w) == most}


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op5_simhash(spark, docs):
    base = LONG.split()[:400]
    near = [" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]) for k in range(0, 400, 9)] + [" ".join(base)] * 3
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(near)], "doc_id long, text string"))
    rows = [(r.doc_id, brute_fingerprint(r.text or "")) for r in many.collect()]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if (a ^ b).bit_count() <= 2:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.group(many).collect()}
    assert got == {(i, f"{f:016x}", root(i)) for i, f in rows}
    assert simhash.group(empty(spark)).count() == 0


def test_covering_masks_meet_every_pair():
    tables = simhash.masks()
    for i in range(64):
        for j in range(i, 64):
            d = 1 << i | 1 << j
            assert any(not d & m for m in tables)


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_op6_top_k(spark):
    rnd = np.random.default_rng(3)
    vecs = [(i, np.round(rnd.normal(size=8), 1).tolist()) for i in range(400)]
    vecs += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.0] * 8), (450, [0.0] * 8), (None, [0.1] * 8), (405, [1.0, 2.0]), (500, vecs[50][1]), (501, vecs[50][1]), (501, vecs[50][1]), (550, [1e20] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), k=5, size=64).collect())
    good = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in vecs if i is not None and v is not None and None not in v and np.isfinite(v).all() and max(v) < 1e13]
    want = []
    for q, a in good:
        if q % 50 == 0:
            s = sorted((-int(a @ b), i) for i, b in good if i != q and len(b) == len(a))[:5]
            want += [(q, r, i, -x) for r, (x, i) in enumerate(s, 1)]
    assert got == sorted(want)
    none = df.filter("vec_id < 0")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(df, none).count() == 0


def test_threshold_stops_early():
    rnd = np.random.default_rng(0)
    v = rnd.integers(-20, 20, (2000, 3))
    v[7] = 100
    ids, scores = topk.SortedLists(np.arange(2000), v).search(np.array([1, 1, 1]), None, 1)
    assert ids.tolist() == [7] and scores.tolist() == [300]


def test_op3_base_rules(spark, docs):
    got = sorted(tuple(r)[:7] for r in quality.assess(docs).collect())
    want = []
    for i, t in rows_of(docs):
        w = WORD.findall(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = Counter(windows)
        n_repeat = len({j for k, x in enumerate(windows) if twice[x] > 1 for j in range(k, k + 8)})
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, n_repeat, len(w) < 20 or 100 * n_repeat > 30 * len(w)))
    assert got == sorted(want)
    assert quality.assess(empty(spark)).count() == 0


def test_op3_rejects_noise_and_keeps_prose(spark):
    import random

    rnd = random.Random(2)
    vocab = ["".join(rnd.choice(["ba", "ko", "ri", "ten", "lu", "sha"]) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(150)), "en") for i in range(300)]
    rows += [(900 + i, " ".join("".join(rnd.choice("qxzjwv#%") for _ in range(7)) for _ in range(150)), "en") for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(kept[900 + i] for i in range(5)) and sum(kept[i] for i in range(300)) >= 297


def test_op3_bands_stand_copies_and_small_languages(spark):
    import random

    rnd = random.Random(3)
    vocab = ["".join(rnd.choice(["ba", "ko", "ri", "ten", "lu", "sha"]) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    prose = [" ".join(rnd.choice(vocab) for _ in range(150)) for _ in range(310)]
    shuffled = prose[0].split()
    rnd.shuffle(shuffled)
    rows = [(i, t, "en") for i, t in enumerate(prose[:300])] + [(1000 + i, prose[0], "en") for i in range(900)] + [(2000 + i, " ".join(shuffled), "en") for i in range(300)]
    rows += [(3000 + i, t, ["fr", None][i % 2]) for i, t in enumerate(prose[300:])]
    rows += [(4000 + i, " ".join("".join(rnd.choice("qxzjwv#%") for _ in range(7)) for _ in range(150)), "en") for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(kept[i] for i in range(300)) >= 297 and not any(kept[4000 + i] for i in range(5))
    assert all(kept[3000 + i] for i in range(10))


def _histories(text):
    """(word or border that it belongs to, place in it, what the model sees before it, character) for every scored
    character, by definition."""
    before = None
    for w in WORD.findall(text):
        last = None if before is None else before[-2:] if len(before) > 1 else f" {before}"
        for j, c in enumerate(w + " "):
            if j > 1:
                yield w, j, f" {w}"[: j + 1][-4:], c
            else:
                yield (last, f"{w} "[:2]), j, ("\n" + w[:j] if last is None else f"{last} {w[:j]}")[-4:], c
        before = w


def _distinct(texts):
    """(what is seen, character) of each scored character of every distinct word and border."""
    return [x[2:] for x in {x for t in texts for x in _histories(t)}]


class BruteKneserNey:
    def __init__(self, texts):
        grams = [Counter() for _ in range(6)]
        for seen, c in _distinct(texts):
            for n in range(1, min(5, len(seen) + 1) + 1):
                grams[n][seen[len(seen) - n + 1 :] + c] += 1
        self.raw, self.a, self.d = grams, [{} for _ in range(6)], [None] * 6
        for n in range(1, 6):
            before = Counter(g[1:] for g in grams[n + 1]) if n < 5 else {}
            self.a[n] = {g: c if n == 5 or g[0] == "\n" else max(1, before.get(g, 0)) for g, c in grams[n].items()}
            of = Counter(self.a[n].values())
            n1, n2, n3, n4 = (max(1, of[k]) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            self.d[n] = [min(max(x, lo), hi) for x, lo, hi in ((1 - 2 * y * n2 / n1, 0.1, 0.9), (2 - 3 * y * n3 / n2, 0.2, 1.8), (3 - 4 * y * n4 / n3, 0.3, 2.7))]
        self.follow = [{} for _ in range(6)]
        for n in range(1, 6):
            for g, c in self.a[n].items():
                self.follow[n].setdefault(g[:-1], []).append(c)

    def p(self, seen, c, n=None):
        n = min(5, len(seen) + 1) if n is None else n
        lower = 1 / (len(self.a[1]) + 1) if n == 1 else self.p(seen, c, n - 1)
        context = seen[len(seen) - n + 1 :]
        counts = self.follow[n].get(context)
        if not counts:
            return lower
        off = lambda k: self.d[n][min(k, 3) - 1]
        own = self.a[n].get(context + c, 0)
        return ((own - off(own) if own else 0) + sum(map(off, counts)) * lower) / sum(counts)


@pytest.mark.parametrize("shard", [4_000_000, 60])
def test_op3_perplexity_and_verdict_are_brute_force(spark, monkeypatch, shard):
    import math
    import random

    monkeypatch.setattr(quality, "SHARD", shard)
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice(["ba", "ko", "ri", "té", "l", "中", "'s", "a"]) for _ in range(rnd.randrange(1, 4))) for _ in range(60)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(20, 50))) for _ in range(130)]
    texts += [None, "", "a b", texts[0], texts[0], " ".join("xq#zw" for _ in range(30)), "\n\tone\x0btwo  " * 3, " ".join("".join(rnd.choice("qxzjw") for _ in range(6)) for _ in range(40))]
    rows = [(i, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    brute = BruteKneserNey([t or "" for t in texts])
    mean = {}
    for i, t, _ in rows:
        logs = [math.log(brute.p(seen, c)) for _, _, seen, c in _histories(t or "")]
        assert (got[i].perplexity is None) == (not logs)
        if logs:
            mean[i] = -sum(logs) / len(logs), len(logs)
            assert math.log(got[i].perplexity) == pytest.approx(mean[i][0], abs=2e-5)
    # the bands over distinct texts that pass the base rules
    lang = {i: x or "" for i, _, x in rows}
    at = lambda v, q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]
    distinct = {}
    for i, (m, n) in mean.items():
        if not got[i].base_failed:
            distinct.setdefault((lang[i], n, round(m, 6)), m)
    median = {x: at([m for (y, *_), m in distinct.items() if y == x], 0.5) for x in {k[0] for k in distinct}}
    away = [(x, (m - median[x]) * math.sqrt(n)) for (x, n, _), m in distinct.items()]
    pooled = -at([d for _, d in away], 0.25) / 0.6745  # no language here has enough texts for a spread of its own
    checked = 0
    for i, (m, n) in mean.items():
        if not got[i].base_failed:
            d = (m - median[lang[i]]) * math.sqrt(n)
            if abs(d - quality.UPPER * pooled) > 1e-3 and abs(d + quality.LOWER * pooled) > 1e-3:
                checked += 1
                assert got[i].kept == (-quality.LOWER * pooled <= d <= quality.UPPER * pooled), (i, d, pooled)
    assert checked > 120 and any(not got[i].kept for i in mean if not got[i].base_failed)


def test_op3_no_two_ngrams_share_a_count(spark):
    import random

    rnd = random.Random(6)
    words = ["".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(10)) for _ in range(3000)]
    text = " ".join(words + words[:7])
    counted = quality.count_grams(spark.createDataFrame([(text,)], "text string")).collect()
    want = [Counter() for _ in range(6)]
    for seen, c in _distinct([text]):
        for n in range(1, min(5, len(seen) + 1) + 1):
            want[n][seen[len(seen) - n + 1 :] + c] += 1
    assert sorted(r.c for r in counted if r.n == quality.ORDER) == sorted(want[quality.ORDER].values())
    for n in range(1, quality.ORDER):  # of the lower ones only those at a text's start count in full
        assert sum(r.n == n for r in counted) == len(want[n])
        assert sorted(r.c for r in counted if r.n == n and r.starts) == sorted(c for g, c in want[n].items() if g[0] == "\n")


def test_op3_query_counts_ngrams_as_often_as_they_stand_there(spark, tmp_path):
    """the query's model is by occurrences. One word far more frequent than another is far likelier."""
    import math
    import random

    from quarry.llm import queries

    rnd = random.Random(21)
    vocab = ["ba", "koriten", "l", "sha", "a", "téa", "中文字", "xyxyx"]
    texts = [" ".join(rnd.choices(vocab, [40, 20, 9, 9, 5, 3, 2, 1], k=40)) for _ in range(20)] + [None, "", "a b", "ba ba ba"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.perplexity for r in queries.op3_quality_rules(spark, str(tmp_path)).collect()}

    stands = [x for t in texts for x in _histories(t or "")]
    grams, in_full = [Counter() for _ in range(6)], set()
    for _, _, seen, c in stands:
        for n in range(1, min(5, len(seen) + 1) + 1):
            grams[n][seen[len(seen) - n + 1 :] + c] += 1
        in_full.add(seen + c)  # nothing is seen before it
    brute = BruteKneserNey([])
    brute.raw, brute.follow = grams, [{} for _ in range(6)]
    for n in range(1, 6):
        before = Counter(g[1:] for g in grams[n + 1]) if n < 5 else {}
        brute.a[n] = {g: c if n == 5 or g in in_full else max(1, before.get(g, 0)) for g, c in grams[n].items()}
        of = Counter(brute.a[n].values())
        brute.d[n] = quality._discounts(*(of[k] for k in (1, 2, 3, 4)))
        for g, c in brute.a[n].items():
            brute.follow[n].setdefault(g[:-1], []).append(c)
    for i, t in enumerate(texts):
        logs = [math.log(brute.p(seen, c)) for _, _, seen, c in _histories(t or "")]
        assert (got[i] is None) == (not logs)
        if logs:
            assert math.log(got[i]) == pytest.approx(-sum(logs) / len(logs), abs=2e-5)


def test_op3_ngrams_are_dealt_out_by_their_characters(spark):
    """No hashes are written to disk for each task's n-grams, and every n-gram has its own afterwards."""
    texts = ["ba koriten ba \U0001f600\u0301x \0\0y \0", "téa ba 中文字 xyxyx", "l", None]
    grams = quality.count_grams(spark.createDataFrame([(t,) for t in texts], "text string"), once=False)
    plan = grams._jdf.queryExecution().executedPlan().toString()
    assert [x.split("(")[1].split("#")[0] for x in plan.split("hashpartitioning")[1:]] == ["gram", "block"]
    want = Counter(seen[len(seen) - n + 1 :] + c for t in texts for _, _, seen, c in _histories(t or "") for n in range(1, min(5, len(seen) + 1) + 1))
    part = lambda x: int(quality.Hashes(quality._codes([x])[0]).at(len(x), np.array([len(x) - 1]))[0]) if x else 0
    got = {(r.n, r.h): r for r in grams.collect()}
    assert set(got) == {(len(g), part(g)) for g in want}
    assert all((r := got[len(g), part(g)]).suffix == part(g[1:]) and r.context == part(g[:-1]) for g in want)
    assert all(got[5, part(g)].c == c for g, c in want.items() if len(g) == 5)


def test_kneser_ney_is_a_distribution(spark):
    text = "aa ab ba abc abc abb cab " * 3
    model = quality.fit(spark.createDataFrame([(text,)], "text string"))
    # after each context the known characters and an unknown one have probability one in all
    for seen in ("\n", "\na", " ", " a", " ab", "ab ", " b a", "zz"):
        total = np.exp(model.score([seen + c for c in "abc z"], np.full(5, len(seen)))).sum()
        assert total == pytest.approx(1, abs=1e-3)


def test_op2_language(spark, docs):
    import random

    rnd = random.Random(4)
    words = {"en": ["the", "and", "river", "house", "walking", "thought"], "fr": ["le", "et", "maison", "rivière", "pensée", "avec"], "de": ["der", "und", "haus", "fluss", "gedanke", "über"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(12)), lang) for i in range(400) for lang in [["en", "fr", "de"][i % 3]]]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "²", "fr"), (1003, "", None), (1004, "rivières pensées", None), (1005, "zzzz qqqq", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:400]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert {got[i].lang_pred for i in (1000, 1001, 1002, 1003)} == {"und"}
    assert got[1004].lang_pred == "fr" and got[1005].lang_pred in words
    assert language_id.identify(docs).count() == docs.count()
    assert language_id.identify(empty(spark)).count() == 0


def brute_language_scores(rows, text):
    """Sum of the words' scores by language, by definition."""
    langs = sorted({lang for _, t, lang in rows if lang is not None and t is not None})
    words = {lang: Counter(w for _, t, x in rows if x == lang and t for w in language_id.words_of(t)) for lang in langs}
    known = set().union(*words.values()) if langs else set()
    grams = {}
    for n in range(1, 6):
        grams[n] = {lang: Counter() for lang in langs}
        for lang in langs:
            for w, c in words[lang].items():
                for j in range(len(w) + 2 - n + 1):
                    grams[n][lang][f"^{w}$"[j : j + n]] += c
    out = np.zeros(len(langs))
    for w in language_id.words_of(text or ""):
        if w in known:
            out += [np.log((words[x][w] + 0.5) / (sum(words[x].values()) + 0.5 * (len(known) + 1))) for x in langs]
            continue
        for n in (5, 4, 3, 2, 1):
            kinds = set().union(*grams[n].values())
            found = [g for j in range(len(w) + 2 - n + 1) if (g := f"^{w}$"[j : j + n]) in kinds]
            if len(found) > (2 if n == 1 else 0):
                out += [np.mean([np.log((grams[n][x][g] + 0.5) / (sum(grams[n][x].values()) + 0.5 * (len(kinds) + 1))) for g in found]) for x in langs]
                break
    return langs, out


def test_op2_is_brute_force(spark):
    import random

    rnd = random.Random(8)
    parts = {"aa": ["ba", "ko", "ri", "té"], "bb": ["ten", "lu", "sha", "ko"], "cc": ["中", "文", "字", "ri"]}
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 5)))
    rows = []
    for i in range(120):
        lang = rnd.choice(list(parts))
        rows.append((i, " ".join(word(lang) for _ in range(rnd.randrange(1, 30))), rnd.choice([lang, lang, None])))
    rows += [(200, "x" * 500 + " " + "tenlu" * 90, "bb"), (201, "zz 12 QQ", None), (202, None, "aa"), (203, "", "bb"), (204, "lu_ri 9ten", None), (None, "bako rité", "aa")]
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(4)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    learned, seen = [], set()
    for i, t, lang in rows:  # distinct texts of a language, held-out rows apart
        if (i is None or zlib.crc32(str(i).encode()) % 4 != 2) and (t, lang) not in seen:
            seen.add((t, lang))
            learned.append((i, t, lang))
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, t, _ in rows:
        langs, scores = brute_language_scores(learned, t)
        n = len(language_id.words_of(t or ""))
        if not n:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        s = scores * min(1.0, 20 / n)
        best = s.max()
        assert got[i].score == pytest.approx(1 / np.exp(s - best).sum(), abs=1e-3)
        assert s[langs.index(got[i].lang_pred)] == pytest.approx(best, abs=1e-3)
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
    # a memo that starts anew in the middle of a text changes nothing
    model = language_id.fit(df)
    small, large = language_id.Scorer(model, keep=40), language_id.Scorer(model)
    for _, t, _ in rows:
        words = [f"{w}{k}x".translate(str.maketrans("0123456789", "abcdefghij")) for k, w in enumerate(language_id.words_of(t or "") * 3)]
        assert small.of(words) == pytest.approx(large.of(words), abs=1e-3)


def test_op2_sample_is_bounded_and_blind_to_copies(spark):
    rows = [(i, f"{chr(97 + i % 26)}wort{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[i // 260]} und so weiter", "de") for i in range(2000)]
    rows += [(5000 + i, "the hot copy of many words", "en") for i in range(3000)] + [(9000, "another one", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    small = language_id.fit(df, per_language=6000)
    learned = [w for w in small.words if "wort" in w]
    assert 100 < len(learned) < 400 and "hot" in small.words and "another" in small.words
    assert small.words == language_id.fit(df.repartition(7), per_language=6000).words
    assert len([w for w in language_id.fit(df).words if "wort" in w]) == 2000


def test_op9_licenses(spark, docs):
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(1, f"{LONG[:900]}\n{apache}\n{LONG[:900]}"), (2, apache.upper().replace(",", " ;")), (3, "licensed under the apache"), (4, "all rights\nreserved and RELEASED under the mit license"), (5, None), (6, "")]
    rows += [(7, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version")]
    rows += [(8, "Permission is hereby granted, free of charge, to any human obtaining a copy of this software and associated documentation files")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0", 2: "apache-2.0", 3: "", 4: "mit,all-rights-reserved", 5: "", 6: "", 7: "gpl-text", 8: ""}
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(docs, templates={}).filter("n_licenses > 0").count() == 0


def test_op9_against_brute_force_containment(spark):
    import random

    rnd = random.Random(9)
    split = lambda s: [w for w in re.split(r"[^\w]|_", s.lower()) if w]
    rows = []
    for i in range(120):
        name, text = rnd.choice(list(licenses.TEMPLATES.items()))
        w = text.split()
        if i % 3 == 0 and len(w) > 6:
            w[rnd.randrange(len(w))] = "altered"
        rows.append((i, " ".join(rnd.choices(LONG.split(), k=rnd.randrange(60)) + w + rnd.choices(LONG.split(), k=rnd.randrange(60)))))
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w, want = split(text), set()
        for name, t in licenses.TEMPLATES.items():
            tw = split(t)
            k = min(5, len(t.split()))
            own = {tuple(tw[j : j + k]) for j in range(len(tw) - k + 1)}
            have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if len(own & have) / len(own) >= 0.8:
                want.add(name)
        assert got[i] == want, text


def test_op9_plan_is_native(spark):
    plan = licenses.scan(spark.range(9).selectExpr("id as doc_id", "cast(id as string) as text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_op10_unigram(spark, docs):
    scores = unigram.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    low = min(scores.values()) - 10

    def brute(word):
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            c = []
            for b in range(max(0, e - 20), e):
                piece = word[b:e]
                if piece in scores:
                    c.append((best[b][0] + scores[piece], -best[b][1] - 1))
                elif e - b == 1:
                    c.append((best[b][0] + low, -best[b][1] - len(piece.encode())))
            top = max(c)
            best.append((top[0], -top[1]))
        return best[-1][1]

    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in unigram.count_tokens(docs).collect()}
    for i, t in rows_of(docs):
        w = tokens.WORDS.findall(t)
        assert got[i] == (len(w), sum(brute("▁" + x) for x in w))
    small = unigram.TrieCounter(scores, nodes=40, keep=3)
    words = sorted(set(LONG.split()))
    for _ in range(2):
        assert [small.counts([w])[0] for w in words] == [(1, brute("▁" + w)) for w in words]
    assert unigram.count_tokens(empty(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy now</div><div class="cookie-notice">We use cookies</div>{main}<aside>Side</aside><form><label>Mail</label><button>Go</button></form>
<section id="comments"><p>First!</p></section><footer>&copy; host</footer></body></html>"""


def test_op1_articles(spark):
    article = "<article><h1>Title &amp; more</h1><p><b>Some  text\n here<br><p>Second &lt;b&gt; &#233;&nbsp;x</p><div class='share'>Share</div></article>"
    rows = [(1, "http://h.com/en/1", PAGE.format(main=article)), (2, "http://h.com/en/2?x=1", PAGE.format(main=article)), (3, "http://h.com/en/2", None), (4, None, PAGE.format(main=article)), (5, "http://h.com/en/9", ""), (6, "http://h.com/en/9", "plain < text > here"), (6, "http://h.com/en/9", "plain < text > here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(2)
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df, parts=3).collect()))
    want = "Title & more\nSome text here\nSecond <b> é x"
    assert got[0] == (1, want, len(want)) and got[1][1] == want and got[3][1] == want
    assert got[2] == (3, "", 0) and got[4] == (5, "", 0) and len(got) == len(rows)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_op1_deletes_lines_shared_with_the_nearest_page(spark):
    page = lambda body: f"<html><body><div>Site name</div><div>All topics</div>{body}<div>Imprint line</div></body></html>"
    rows = [(i, f"http://h.com/a/{i:02d}", page(f"<div>Story {i}</div><div>Only here {i * i}</div>")) for i in range(30)]
    rows += [(100 + i, "http://copy.com/p", page("<div>Copy</div>")) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 2, 7):
        got = {r.page_id: r.text for r in html_extract.extract(df, parts=parts).collect()}
        assert all(got[i] == f"Story {i}\nOnly here {i * i}" for i in range(30))
        assert got[100] == got[101] == "Site name\nAll topics\nCopy\nImprint line"


@pytest.mark.parametrize("source,text", [
    ('<article><header class="entry-header"><h1>Title</h1></header><p>Body</p></article>', "Title\nBody"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title\nBody"),
    ('<article><h1 class="article-header">Title</h1><p>Body</p></article>', "Title\nBody"),
    ('<div class="layout no-sidebar"><article><p>Body</p></article></div>', "Body"),
    ('<div class="search-open"><article><p>Body</p></article></div>', "Body"),
    ('<form id="page-form"><div class="sidebar">s</div><main><p>Body</p></main></form>', "Body"),
    ('<div class="widget"><h1>Title</h1><p>Body</p></div><footer>f</footer>', "Title\nBody"),
    ('<article><p>Body</p><section id="comments"><article class="comment"><p>me too</p></article></section></article>', "Body"),
    ('<article><p>Body</p><div class="related-posts"><h3>More</h3><a>x</a></div></article>', "Body"),
    ('<article><p>Body <span class="ad">buy</span> more</p><aside><h1>no</h1></aside></article>', "Body\nmore"),
    ('<aside><article><p>teaser</p></article></aside><div><p>Body</p></div>', "Body"),
    ('<header><h1>Site</h1></header><article><p>Body</p></article><div class="cookieBanner">c</div>', "Body"),
])
def test_marks_never_cost_an_article_its_text(source, text):
    lines = html_extract.lines_of(f"<html><body>{source}</body></html>")
    assert html_extract.main_text(html_extract.Page(1, "u", [x for _, x in lines], [k for k, _ in lines]), None) == text


def test_op1_alignment_decides_inside_articles_too(spark):
    def page(i):
        return f"""<body><article><h1>Story {i}</h1><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul><div>Read our terms</div>
            <p>Only here {i * i}</p><p>Quoted by all.</p><div>Box of {i}</div></article></body>"""

    rows = [(i, f"http://h.com/a/{i:02d}", page(i)) for i in range(12)] + [(90, "http://alone.com/", page(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, parts=3).collect()}
    # shared links and boxes go, shared prose stays
    assert all(got[i] == f"Story {i}\nOnly here {i * i}\nQuoted by all.\nBox of {i}" for i in range(12))
    assert got[90] == "Story 0\nHome\nNews\nRead our terms\nOnly here 0\nQuoted by all.\nBox of 0"


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_op1_is_brute_force_over_all_pages(spark, parts):
    import random

    rnd = random.Random(parts)
    boxes = ["<div>menu</div>", "<div>terms</div>", "<p>shared prose</p>", "<div class='ad'>buy</div>", "<footer>end</footer>", "<a>link</a>"]
    rows = []
    for k in range(160):
        body = "".join(rnd.choice(boxes) if rnd.random() < 0.7 else f"<p>own {rnd.randrange(40)}</p>" for _ in range(rnd.randrange(9)))
        url = None if rnd.random() < 0.05 else f"http://{rnd.choice(['a.com', 'www.a.com', 'b.org', 'C.net'])}/{rnd.choice(['x/', 'y/', 'x/y/', ''])}{rnd.randrange(30)}"
        rows.append((rnd.choice([None, k, -k, 7]), url, None if rnd.random() < 0.05 else f"<article>{body}</article>" if rnd.random() < 0.5 else body))
    rows += rows[:9]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(5)
    order = sorted(((*html_extract.split_url(u), i is not None, i or 0, u or "", h) for i, u, h in rows), key=lambda r: r[:5])
    want = []
    lines = [html_extract.lines_of(r[5]) for r in order]
    for k, r in enumerate(order):
        near = [j for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == r[0]]
        best = max(near, key=lambda j: html_extract._near(r[1], order[j][1]), default=None)
        mine, theirs = lines[k], lines[best] if best is not None else []
        shared = html_extract.shared_lines([x for _, x in mine], [x for _, x in theirs])
        kinds = [x for x, _ in mine]
        own = [i for i, x in enumerate(kinds) if (x in (html_extract.ARTICLE, html_extract.BOXED) if {html_extract.ARTICLE, html_extract.BOXED} & set(kinds) else x == html_extract.OTHER)]
        left = [i for i in own if i not in shared or kinds[i] == html_extract.ARTICLE] if set(own) - shared else own
        want.append((r[:5], "\n".join(mine[i][1] for i in left)))
    alike = Counter(k for k, _ in want)  # rows of one key come in any order, and so do their neighbours
    key = lambda i, u: (*html_extract.split_url(u), i is not None, i or 0, u or "")
    got = html_extract.extract(df, parts=parts).collect()
    single = lambda found: sorted((k, t) for k, t in found if all(alike[o[:5]] < 2 for o in order if o[:2] == k[:2]))
    assert Counter(key(r.page_id, r.url) for r in got) == alike and all(r.n_chars == len(r.text) for r in got)
    assert single((key(r.page_id, r.url), r.text) for r in got) == single(want) and len(single(want)) > 20


@pytest.mark.parametrize("source,lines", [
    ("<p>a<p>b", ["a", "b"]), ("<div><p>a</div>b", ["a", "b"]), ("<ul><li>x<li>y</ul>", ["x", "y"]), ("a<br>b <i>c</i>d", ["a b cd"]),
    ('<p title="a>b">t</p><a href="broken>u</a>', ["t", "u"]), ("<!-- x <p>no</p>", []), ("<script>var a='<p>';", []), ("x < y &lt; z &amp", ["x < y < z &"]),
    ("<body><div id='sidebar'>no<div>no</div></div><main>yes</main>", ["no", "no", "yes"]), ("<p>&nbsp;\u3000</p>", []),
])
def test_blocks_of_odd_html(source, lines):
    assert [x for _, x in html_extract.lines_of(source)] == lines


def test_longest_common_subsequence():
    import random

    rnd = random.Random(1)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(400):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randrange(12))] for _ in range(2))
        got = html_extract.shared_lines(a, b)
        assert len(got) == length(a, b)
        it = iter(b)
        assert all(a[i] in it for i in sorted(got))
