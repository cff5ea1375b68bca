"""Operators against plain versions on small inputs."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweft.llm import bpe, links, mixing, multiindex, ppm, quality, simhash, substrings, tokens, toxicity, winnow
from logweft.llm.common import bucket_of, table

DOCS = "doc_id bigint, text string"


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# -- links -----------------------------------------------------------------


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    pairs += [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(150)]
    plain = Sets()
    for a, b in pairs:
        plain.join(a, b)
    frame = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(4)
    got = {r["node"]: r["root"] for r in links.components(frame).collect()}
    assert {n: got.get(n, n) for n in plain.up} == {n: plain.find(n) for n in plain.up}


# -- simhash ---------------------------------------------------------------


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", "One", "a b", "a B c", "x " * 9, "the Cat sat on the mat é z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("group", [64, 2])
def test_all_links_within_three_bits(spark, monkeypatch, group):
    rnd = random.Random(group)
    prints = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        for _ in range(4):
            prints.add(base)
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                base ^= 1 << bit
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    plain = Sets()
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                plain.join(a, b)
    monkeypatch.setattr(simhash, "GROUP", group)
    crowd = spark.createDataFrame([(p,) for p in prints], "a bigint")
    found = simhash._crowd_links(crowd) if group == 2 else simhash.print_links(crowd.toDF("fingerprint"))
    got = {r["node"]: r["root"] for r in links.components(found).collect()}
    assert {p: got.get(p, p) for p in prints} == {p: plain.find(p) for p in prints}


def test_near_duplicate_documents(spark, data):
    docs = table(spark, data, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    plain, ids = Sets(), sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                plain.join(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", plain.find(i)) for i in ids}


# -- language model --------------------------------------------------------


def plain_ppm(texts, order):
    """Chances by walking dictionaries, without pruning."""
    counts = Counter()
    for t in texts:
        padded = bytes([255]) * order + t + b"\xff"
        for i in range(order, len(padded)):
            counts.update((padded[i - d : i], padded[i]) for d in range(order + 1))

    def chance(context, symbol):
        p, out = 1.0, {}
        for d in range(order, -1, -1):
            own = context[order - d :]
            seen = {s: counts[own, s] for s in range(256) if counts[own, s]}
            if not seen:
                continue
            # What the longer context knew is excluded, less the half counts that it left.
            total = sum(seen.values()) - sum(seen[s] - ppm.DISCOUNT for s in out)
            if symbol in seen:
                return p * (seen[symbol] - ppm.DISCOUNT) / total
            p *= ppm.DISCOUNT * len(seen) / total
            out = seen
        return p / (256 - len(out))

    return chance


def test_scores_equal_a_plain_walk(spark):
    texts = [b"abracadabra", b"abra cab", b"", b"zz top"]
    grams, _ = ppm.packed_grams(texts)
    rows = spark.createDataFrame([(int(k), int(n)) for k, n in Counter(grams.tolist()).items()], "key bigint, n bigint")
    trie, chance = ppm.Trie(ppm.kept_nodes(rows)), plain_ppm(texts, ppm.ORDER)
    for text in [b"abra", b"cab top", b"q", b""]:
        padded = bytes([255]) * ppm.ORDER + text + b"\xff"
        plain = sum(
            math.log10(chance(padded[i - ppm.ORDER : i], padded[i])) for i in range(ppm.ORDER, len(padded))
        )
        assert trie.score([text])[0] == pytest.approx(plain)


def test_chances_sum_to_one(spark):
    texts = [b"abracadabra", b"abra cab", b"", b"zz top"]
    grams, _ = ppm.packed_grams(texts)
    rows = spark.createDataFrame([(int(k), int(n)) for k, n in Counter(grams.tolist()).items()], "key bigint, n bigint")
    trie = ppm.Trie(ppm.kept_nodes(rows))
    some, sizes = ppm.packed_grams([b"abra", b"q", b""])
    assert sizes.tolist() == [5, 2, 1]
    for gram in some:
        context = gram >> np.uint64(8) << np.uint64(8)
        assert 10 ** trie.log10(context + np.arange(256, dtype=np.uint64)) @ np.ones(256) == pytest.approx(1)
    assert trie.score([b"abracadabra"]) > trie.score([b"arbacadarba"])


def test_pruned_tries_stay_distributions(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_NODES", 12)
    grams, _ = ppm.packed_grams([b"abracadabra abracadabra", b"banana bandana"])
    rows = spark.createDataFrame([(int(k), int(n)) for k, n in Counter(grams.tolist()).items()], "key bigint, n bigint")
    nodes = ppm.kept_nodes(rows)
    assert all(len(keys) <= 12 for keys, *_ in nodes)
    trie = ppm.Trie(nodes)
    for gram in ppm.packed_grams([b"abra ban", b"xyz"])[0]:
        context = gram >> np.uint64(8) << np.uint64(8)
        assert (10 ** trie.log10(context + np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)


@pytest.mark.parametrize("nodes", [1 << 20, 40])
def test_rare_contexts_count_in_scores(spark, monkeypatch, nodes):
    monkeypatch.setattr(ppm, "MOST_NODES", nodes)
    monkeypatch.setattr(ppm, "ASKS", 50)
    rnd = random.Random(nodes)
    rows = [(i, " ".join("".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 30)))) for i in range(40)]
    rows += [(40, "zyx " * 9), (41, "abab qqq zyx"), (42, None)]
    normal = lambda text: b" ".join((text or "").encode().lower().split())
    chance = plain_ppm([normal(t) for i, t in rows if i % 4 != 1], ppm.ORDER)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r["score"] for r in ppm.scored(docs, F.col("doc_id") % 4 != 1, F.col("doc_id") % 4 == 1).collect()}
    for i, text in rows:
        padded = bytes([255]) * ppm.ORDER + normal(text) + b"\xff"
        plain = sum(math.log10(chance(padded[j - ppm.ORDER : j], padded[j])) for j in range(ppm.ORDER, len(padded)))
        assert got[i] == pytest.approx(plain, rel=1e-9)


@pytest.mark.parametrize("frequent", [1 << 17, 40])
def test_token_shares(spark, data, monkeypatch, frequent):
    monkeypatch.setattr(ppm, "MOST_FREQUENT", frequent)
    docs = table(spark, data, "documents")
    words = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b""] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    remainder = bucket_of("doc_id", 5)
    for r in ppm.scored(docs, remainder != 1, remainder == 1).collect():
        own = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(w in counts for w in own)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0


def test_index_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 5000).astype(np.uint64))
    index = ppm.Index(keys)
    assert np.array_equal(keys[index.find(keys)], keys)
    assert (index.find(np.setdiff1d(keys + np.uint64(1), keys)) == -1).all()


# -- winnowing -------------------------------------------------------------


def chosen(spark, text):
    row = spark.createDataFrame([(1, text)], DOCS)
    return winnow.fingerprints(row).first()


def test_winnowing_guarantee_and_positions(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 7)))
    shared = [word() for _ in range(winnow.SPAN + winnow.GRAM - 1)]
    left = chosen(spark, " ".join([word() for _ in range(30)] + shared))
    right = chosen(spark, " ".join(shared + [word() for _ in range(40)]))
    assert set(left["hashes"]) & set(right["hashes"])
    assert list(left["positions"]) == sorted(left["positions"])
    gaps = np.diff(left["positions"])
    assert gaps.max() <= winnow.SPAN


def test_ties_choose_the_last(spark):
    same = chosen(spark, "x " * 40)
    grams = 40 - winnow.GRAM + 1
    assert list(same["positions"]) == list(range(winnow.SPAN - 1, grams))
    assert len(set(same["hashes"])) == 1


def test_edited_texts_and_next_documents(spark, data):
    docs = table(spark, data, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    prints = {}
    for r in winnow.edited_and_next(docs).collect():
        text, then = texts[r["doc_id"]], texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + then[:n]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if len(text) > 2000 and text != then:
            assert r["near_edited"] > 0.3 > r["near_next"]


# -- substrings ------------------------------------------------------------


@pytest.mark.parametrize("tree", [1000, 3])
def test_repeated_windows(spark, monkeypatch, tree):
    monkeypatch.setattr(substrings, "TREE", tree)
    rnd = random.Random(tree)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = [rnd.choice("abc") + str(rnd.randrange(6)) for _ in range(rnd.randrange(0, 150))]
        if i % 3 == 0:
            at, n = rnd.randrange(len(words) + 1), rnd.randrange(30, 60)
            words[at:at] = passage[:n]
        if i % 7 == 0:
            words += ["same"] * rnd.randrange(33, 80)
        rows.append((i, " ".join(words)))
    rows += rows[:6]
    windows = Counter(tuple(w[i : i + 35]) for _, t in rows for w in [t.split()] for i in range(len(w) - 34))
    want = []
    for i, text in rows:
        words = text.split()
        gone = {j for k in range(len(words) - 34) if windows[tuple(words[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        want.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    # The tree's size is read where tasks are planned, so small ones can be tested.
    got = substrings.deduplicated(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r[2] for r in want) > 1000


# -- token files and BPE ---------------------------------------------------


def test_token_files(spark, data):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    docs = table(spark, data, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "a|b | c <|endoftext|>"), (-2, None), (-3, "x y Z é")], DOCS)
    docs = docs.union(odd)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in tokens.token_files(docs, path, 2).collect()}
    start = 0
    for i in sorted(texts):
        ids = plain.encode(texts[i], add_special_tokens=False).ids + [2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_encoded_apart_equal_whole_texts():
    content = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    plain, own, rnd = Tokenizer.from_str(content), tokens.WordEncoder(content), random.Random(3)
    plain.encode_special_tokens = True
    letters = "abcéñß日ª .,!?;:*&%$#|'\"”’0123\u0301\n\t\xa0-<>sS"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["it's.", "it's", "<|endoftext|>.", "a|b."]
    texts += ["Àéï ŒUVRE ÿ Ÿ İ ŉ ſ ª º µ ¼ ³ \xad a\xadb ¡x × ÷ĸ", "  ", ""]
    texts += ["".join(chr(c) for c in rnd.choices(range(0x20, 0x180), k=20)) for _ in range(2000)]
    ids, edges = own.encode(pa.array([t.encode() for t in texts], pa.binary()), 7)
    want = plain.encode_batch(texts, add_special_tokens=False)
    assert own._merges is not None
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [[*w.ids, 7] for w in want]
    empty, at = own.encode(pa.array([], pa.binary()), 7)
    assert len(empty) == 0 and at.tolist() == [0]


RANKS = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_encoding_equals_the_library():
    own, plain, rnd = bpe.Encoder(RANKS, public_tokenizers.PATTERN), library(), random.Random(1)
    letters = "abcdeiou thnrsTHE  \n\t'’ 　\x1c\x85éèñß123.,!#日本\U0001f600́"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for text in texts + ["a" * 500, " " * 300, "\n" * 50 + "x", "'s't're'll", "<|endoftext|>"]:
        assert own.encode(text).tolist() == plain.encode_ordinary(text)


def test_few_states_give_the_same_tokens():
    many, few, rnd = bpe.Transducer(RANKS), bpe.Transducer(RANKS, most=20), random.Random(2)
    for _ in range(2000):
        piece = "".join(rnd.choice("aeinrstlhoug") for _ in range(rnd.randint(1, 18))).encode()
        assert many.encode(piece) == few.encode(piece)
    assert len(few._state) <= 20


def test_stream_decoding():
    tokens_of, text = bpe.token_list(RANKS), "naïve 日本語 \U0001f600 é"
    assert "".join(bpe.decode_stream(library().encode_ordinary(text), tokens_of)) == text
    rnd = random.Random(4)
    for _ in range(500):
        data = bytes(rnd.choice([0x61, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF]) for _ in range(9))
        stream = bpe.Utf8Stream()
        parts = [stream.feed(data[i : i + 1]) for i in range(len(data))] + [stream.close()]
        valid = data.decode("utf-8", "ignore").encode() == data
        assert not valid or "".join(parts) == data.decode()


def test_encode_and_decode(spark, data):
    docs = table(spark, data, "documents").limit(50)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    plain, texts = library(), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in encoded.collect()} == {
        i: plain.encode_ordinary(t) for i, t in texts.items()
    }
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).collect()} == texts
    for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN).collect():
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# -- mixing ----------------------------------------------------------------


def test_shards_split_the_quotas(spark, data):
    sized = mixing.sized_documents(table(spark, data, "documents"))
    targets = mixing.source_targets(sized)
    rows = {r["source_rank"]: r for r in targets.collect()}
    quotas = {r["source_rank"]: list(r["shard_ends"]) for r in mixing.shard_quotas(targets).collect()}
    draws = {k: r["whole_draws"] + (r["part_draw"] > 0) for k, r in rows.items()}
    assert {k: ends[-1] for k, ends in quotas.items()} == draws
    sizes = np.array([np.diff([0, *quotas[k]]) for k in sorted(quotas)])
    assert (sizes >= 0).all() and sizes.sum(0).max() - sizes.sum(0).min() <= 1


def test_hypergeometric_draws(spark):
    total, marked, drawn = 40, 12, 15
    column = F.expr(mixing._hypergeometric("t", "m", "d", "u"))
    rows = spark.range(4000).select(
        F.lit(total).cast("bigint").alias("t"), F.lit(marked).cast("bigint").alias("m"),
        F.lit(drawn).cast("bigint").alias("d"), ((F.col("id") + 0.5) / 4000).alias("u"),
    )
    got = Counter(r["x"] for r in rows.select(column.alias("x")).collect())
    for k in range(0, 13):
        chance = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        assert got[k] / 4000 == pytest.approx(chance, abs=1e-3)


def test_targets_stop_at_three_times_the_size(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 10, "b"), (3, "w " * 500, "c"), (4, "w " * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in mixing.taken_words(docs).collect()}
    assert [got[i]["target"] for i in (1, 2)] == [30.0, 30.0]
    assert got[3]["target"] == pytest.approx(760 * 3 / 4) and got[4]["target"] == pytest.approx(760 / 4)
    assert all(abs(r["taken"] - r["target"]) <= 2 and r["taken"] <= 3 * r["size"] for r in got.values())


def test_mixed_documents_have_the_taken_words(spark, data):
    docs = table(spark, data, "documents")
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs).collect()}
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(r["text"].encode().split())
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_pieces_of_shards_are_disjoint(spark, data):
    placed, parts = mixing.mix(table(spark, data, "documents"))
    rows = parts.collect()
    assert len({r["shard"] for r in rows}) == mixing.SHARDS
    size = {r["row_id"]: r["size"] for r in placed.collect()}
    assert all(0 <= r["first_word"] and r["first_word"] + r["n_words"] <= size[r["row_id"]] for r in rows)


# -- vectors ---------------------------------------------------------------


def test_multi_index_recall(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16))
    vectors = np.concatenate([c + 0.12 * rng.normal(size=(rng.integers(1, 40), 16)) for c in centres])
    vectors = np.concatenate([vectors, vectors[:50], rng.normal(size=(400, 16))]).astype(np.float32)
    labels = rng.integers(0, 2, len(vectors))
    rows = [(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(vectors, labels))]
    table_ = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    exact = vectors.astype(float)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    linked = (exact @ exact.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in multiindex.linked_vectors(table_).collect()}
    counts = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert len(got) == len(rows) and (counts <= linked.sum(1)).all()
    assert counts.sum() >= 0.95 * linked.sum() > 1000
    plain = Sets()
    for a, b in zip(*np.nonzero(linked)):
        plain.join(int(a), int(b))
    same = [got[i]["component_id"] == plain.find(i) for i in range(len(rows))]
    assert np.mean(same) > 0.95 and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(2)
    vectors = multiindex.unit(rng.normal(size=(200, 8)))
    grid = multiindex.Grid(vectors, 6)
    left, right = grid._both(vectors)
    sums = (left[:, :, None] + right[:, None, :]).reshape(len(vectors), -1)
    visited = np.take_along_axis(sums, grid.visits(vectors, 9), 1)
    assert np.allclose(np.sort(visited, 1), np.sort(sums, 1)[:, :9])
    assert np.array_equal(grid.visits(vectors, 1)[:, 0], grid.cell(vectors))


# -- classifiers -----------------------------------------------------------


def held_out_accuracy(scored, labels, column, modulus, remainder):
    judged = scored.join(labels.filter(F.col(column).isNotNull()), "doc_id").filter(
        bucket_of("doc_id", modulus) == remainder
    )
    rows = [(r["score"], r[column]) for r in judged.select("score", column).collect()]
    return np.mean([(score >= 0.5) == bool(label) for score, label in rows]), len(rows)


def test_quality_on_held_out_labels(spark, data):
    docs, labels = (table(spark, data.replace("sf0.001", "sf0.01"), n) for n in ("documents", "labels"))
    scored = quality.quality(docs, labels, bucket_of("doc_id", 3) != 1)
    share, n = held_out_accuracy(scored, labels, "quality", 3, 1)
    assert share > 0.95 and n > 20


def test_the_additive_model_is_a_sum_of_tables():
    rng = np.random.default_rng(3)
    features = rng.normal(size=(500, len(quality.FEATURES)))
    labels = ((features[:, 0] > 0) ^ (features[:, 1] > 0)).astype(float)
    model = quality.fit(features, labels, rounds=60)
    assert (0, 1) in model.pairs
    assert np.mean((model.score(features) >= 0.5) == labels) > 0.9
    x = features[:1]
    parts = [t[np.searchsorted(e, x[0, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables))]
    for (a, b), t in zip(model.pairs, model.pair_tables):
        cell = [np.searchsorted(model.pair_edges[f], x[0, f], side="right") for f in (a, b)]
        parts.append(t[tuple(cell)])
    assert model.margin(x)[0] == pytest.approx(model.intercept + sum(parts))


def test_toxicity_on_held_out_labels(spark, data):
    docs, labels = (table(spark, data.replace("sf0.001", "sf0.01"), n) for n in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels, bucket_of("doc_id", 5) != 0)
    share, n = held_out_accuracy(scored, labels, "toxic", 5, 0)
    assert share > 0.9 and n > 20


LEXICON = "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split()


@pytest.fixture(scope="module")
def reader(spark, data):
    general = toxicity.character_counts(table(spark, data, "documents"))
    own = toxicity.CharacterModel.of_words(dict.fromkeys(LEXICON, 1.0))
    model = toxicity.CharacterModel(general + own * general.sum() / own.sum())
    return toxicity.ToxicityModel(model, dict.fromkeys(LEXICON, 5.0))


@pytest.mark.parametrize(
    "hidden, plain",
    [
        ("1d10t", "idiot"), ("!d!ot", "idiot"), ("stuuupid", "stupid"), ("l0s3r", "loser"), ("sc*m", "scum"),
        ("tr@sh", "trash"), ("id.i.o.t", "idiot"), ("$tupid!!", "stupid"), ("id1ot.", "idiot"), ("hello", "hello"),
        ("192.168.1.1", "192.168.1.1"), ("the***", "the"),
    ],
)
def test_hidden_words_are_read(reader, hidden, plain):
    assert reader.read(hidden) == plain


def test_letters_set_apart(spark, reader):
    docs = spark.createDataFrame([(1, "You are an I D I O T and p a t h e t i c , really"), (2, None)], DOCS)
    got = {r["doc_id"]: r["text"] for r in toxicity.restored_texts(docs, reader).collect()}
    assert got == {1: "you are an idiot and pathetic really", 2: ""}
    assert reader.measure("i d i o t")[0] == 5.0 and reader.measure("")[0] == 0
