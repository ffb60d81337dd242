"""Operators on documents: edge cases of their tables, and brute-force twins."""

import base64
import hashlib
import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash

from tidemark.llm import byte_bpe, gru, langid, lm, mixing, simhash, subwords, toxicity
from tidemark.llm.components import connected_components

RANKS = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 20_000


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


ODD = [
    (1, "The cat sat on the mat.", "en", "a", 1), (2, None, "en", "a", 2), (3, "", None, "b", 3), (4, "  \t\n ", "en", None, 4),
    (None, "The cat sat on the mat.", "en", "a", 5), (1, "The cat sat on the mat.", "en", "a", 1), (7, "été ßtraße 你好 🙂 x\x00y", "fr", "b", 6),
    (8, LONG, "en", "c", 7), (9, "THE CAT sat on the mat.", "en", "c", 8),
]


# --- byte-level BPE


def reference_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_those_of_the_rank_file(spark):
    other = reference_encoding()
    rng = random.Random(3)
    alphabet = "ab cdE's\n\t  é🙂 ̀你12.,!<|endoftext|>'"
    rows = ODD + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))), None, None, 0) for i in range(300)]
    found = byte_bpe.encode(docs(spark, rows), RANKS, P.PATTERN, digests=True, offsets=True).collect()
    for (doc_id, text, *_), row in zip(rows, found, strict=True):
        ids = other.encode_ordinary(text or "")
        assert (row.doc_id, row.ids, row.n_tokens) == (doc_id, ids, len(ids))
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        at, wanted = 0, []
        data = (text or "").encode()
        place = {}
        for i, ch in enumerate(text or ""):
            for _ in ch.encode():
                place[len(place)] = i
        for token in ids:
            wanted.append(place[at])
            at += len(other.decode_single_token_bytes(token))
        assert row.starts == wanted and at == len(data)


def test_decoding_joins_split_characters(spark):
    encoded = byte_bpe.encode(docs(spark, ODD), RANKS, P.PATTERN)
    back = byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for _, t, *_ in ODD]
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [None, 0])], "k int, ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in byte_bpe.decode(nulls, RANKS, P.PATTERN).collect()] == [None, b"", b"!"]


def test_memory_of_pieces_may_overflow(spark, monkeypatch):
    with open(RANKS, "rb") as f:
        codec = byte_bpe.Codec(f.read(), P.PATTERN)
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 5)
    texts = ["one two three four five six", "one two seven " + "x" * 100, ""]
    assert codec.encode(texts) == [reference_encoding().encode_ordinary(t) for t in texts]


def test_tokens_of_an_empty_table_and_clashing_columns(spark):
    clash = docs(spark, [(1, "a b", "x")], "doc_id long, text string, n_tokens string")
    assert byte_bpe.encode(clash, RANKS, P.PATTERN).columns == ["doc_id", "n_tokens", "ids"]
    assert byte_bpe.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0


# --- SimHash


def brute_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=3):
    top = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= most:
                    top[i] = top[j] = min(top[i], top[j])
    return top


def test_fingerprints_and_components_match_brute_force(spark):
    found = simhash.near_duplicates(docs(spark, ODD)).collect()
    prints = [brute_fingerprint(t) for _, t, *_ in ODD]
    top = brute_components(prints)
    ids = [i for i, *_ in ODD]
    wanted = []
    for i in range(len(ODD)):
        known = [ids[j] for j in range(len(ODD)) if top[j] == top[i] and ids[j] is not None]
        wanted.append((ids[i], f"{prints[i]:016x}", min(known) if known else None))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))
    assert {r.component_id for r in found if r.fingerprint == "0" * 16} == {2}


def test_every_pair_within_three_bits_meets(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    rows = []
    for b in base:
        for bits in (0, 1, 2, 3, 3, 3, 4):
            rows.append(int(b) ^ sum(1 << int(p) for p in rng.choice(64, bits, replace=False)))
    rows = sorted(set(rows))
    signed = np.array(rows, np.uint64).view(np.int64).tolist()
    found = connected_components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)))
    label = {r.node: r.component for r in found.collect()}
    near = np.bitwise_count(np.array(rows, np.uint64)[:, None] ^ np.array(rows, np.uint64)) <= 3
    for i in range(len(rows)):
        for j in range(i):
            if near[i, j]:
                assert label[signed[i]] == label[signed[j]]
    assert len(set(label.values())) >= 50


def test_a_crowded_anchor_gives_a_forest():
    rng = np.random.default_rng(1)
    prints = np.unique(np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)))
    src, dst = simhash._compare(np.zeros(len(prints), np.int64), prints, 3)
    assert len(src) <= len(prints) - 1
    close = np.bitwise_count(prints[:, None] ^ prints) <= 3
    reach = np.eye(len(prints), dtype=bool) | close
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    mine = np.eye(len(prints), dtype=bool)
    for a, b in zip(src.tolist(), dst.tolist(), strict=True):
        assert close[place[a], place[b]]
        mine[place[a], place[b]] = mine[place[b], place[a]] = True
    for _ in range(8):
        mine = (mine.astype(int) @ mine.astype(int)) > 0
    assert (mine == reach).all()


def test_one_row_of_each_group_stays(spark):
    kept = simhash.keep_one(docs(spark, ODD)).collect()
    assert sorted((r.doc_id for r in kept), key=lambda x: (x is None, x)) == [1, 2, 7, 8]
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert simhash.keep_one(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [(None, "a", None, None, 1), (None, "a", None, None, 1)])).count() == 1


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / total > most * sizes[n]]
        if not over:
            return target | {n: left * weight[n] / total for n in open_}
        for n in over:
            target[n] = most * sizes[n]
            left -= target[n]
            open_.remove(n)
    return target


@pytest.mark.parametrize("range_rows", [3, 20_000])
def test_mix_matches_brute_force(spark, range_rows):
    rng = random.Random(2)
    rows = ODD + [(50 + i, "w " * rng.randrange(1, 40), "en", rng.choice(["a", "b", "c", "d", "e", None]), 0) for i in range(200)]
    found = mixing.mix(docs(spark, rows).repartition(4), range_rows=range_rows).collect()
    assert len(found) == len(rows)
    count = lambda t: len(regex.findall(mixing.WORD, t or ""))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += count(t)
    targets = brute_targets(sizes)
    taken, largest = Counter(), Counter()
    for r in found:
        assert r["__size"] == count(r.text) and r["__source_size"] == sizes[r.source]
        assert r["__target"] == pytest.approx(targets[r.source])
        assert r["__taken"] in (0, r["__size"], 2 * r["__size"])
        assert r["__taken"] >= r["__size"] * math.floor(targets[r.source] / sizes[r.source] + 1e-12)
        taken[r.source] += r["__taken"]
        largest[r.source] = max(largest[r.source], r["__size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6


def test_mix_of_nothing_and_of_wordless_texts(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    rows = mixing.mix(docs(spark, [(1, None, None, None, 0), (2, " ", None, "a", 0)])).collect()
    assert [(r["__taken"], r["__target"]) for r in rows] == [(0, 0.0), (0, 0.0)]


def test_better_documents_come_more_often(spark):
    rows = [(i, "word " * 10 if i % 2 else "w " * 10, None, "a", 0) for i in range(2000)]
    half = mixing.mix(docs(spark, rows), share=0.5).filter("__taken > 0").collect()
    good = sum(r.doc_id % 2 for r in half)
    assert good > 2 * (len(half) - good)


# --- language and toxicity


def languages(spark, n=400):
    rng = random.Random(4)
    sets = {"xx": "ba be bi bo bu bab beb".split(), "yy": "zra zre zri kro krum zzt".split(), "zz": "ñola éli ñu éñe ola".split()}
    return docs(spark, [(i, " ".join(rng.choice(sets[k]) for _ in range(rng.randrange(3, 30))), k, "s", 0) for i in range(n) for k in [list(sets)[i % 3]]])


def test_languages_are_told_apart_on_held_out_texts(spark):
    data = languages(spark)
    model = langid.fit(data.filter("doc_id % 5 <> 0"))
    found = langid.predict(data.filter("doc_id % 5 = 0"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found) and sum(r.rejected for r in found) <= 1


def test_language_of_odd_texts(spark):
    model = langid.fit(languages(spark))
    odd = [(1, None), (2, ""), (3, "123 ... 🙂"), (4, "ba " * 100_000), (5, "é")]
    clash = spark.createDataFrame([(i, t, "mine") for i, t in odd], "doc_id long, text string, score string")
    found = {r.doc_id: r for r in langid.predict(clash, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [found[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert found[4].lang_pred == "xx" and found[4].score > 0.9 and found[5].lang_pred in ("xx", "yy", "zz")
    untaught = langid.fit(docs(spark, []))
    assert {(r.lang_pred, r.rejected) for r in langid.predict(clash, untaught).collect()} == {("und", True)}


def toxic(spark, n=900):
    rng = random.Random(6)
    plain, bad = "the of and river stone cloud tree walk talk green".split(), ["nastyword", "badthing"]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), None, None, 0))
        marks.append((i, 1, int(i % 4 == 0)))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxic_words_and_their_misspellings_score_high(spark):
    data, labels = toxic(spark)
    model = toxicity.fit(data, labels.filter("doc_id % 5 <> 0"))
    found = {r.doc_id: r.score for r in toxicity.score(data, model).collect()}
    held = [i for i in found if i % 5 == 0]
    assert np.mean([(found[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.95
    fresh = docs(spark, [(1, "the river nastywordd of stone and cloud walk talk green tree " * 2, None, None, 0), (2, "the river of stone and cloud walk talk green tree " * 2, None, None, 0)])
    new = {r.doc_id: r.score for r in toxicity.score(fresh, model).collect()}
    assert new[1] > new[2] + 0.2


def test_toxicity_of_odd_tables(spark):
    data, labels = toxic(spark, 40)
    model = toxicity.fit(data, labels)
    odd = docs(spark, [(1, None, None, None, 0), (2, "", None, None, 0), (None, "nastyword " * 50_000, None, None, 0)])
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    none = toxicity.fit(data, labels.filter("false"))
    assert {r.score < 0.5 for r in toxicity.score(odd, none).collect()} == {True}
    repeated = toxicity.fit(data, labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None)], labels.schema)))
    assert toxicity.score(docs(spark, []), repeated).count() == 0


def test_subwords_of_a_batch_are_those_of_each_text():
    settings = subwords.Settings(bits=12, distinct=True, prior=3.0)
    table = np.random.default_rng(0).normal(size=(1 << 12, 2))
    texts = ["ab cd ab", "", "x", "été 12 foo", "a  b"]
    whole = subwords.means(texts, table, settings)
    for i, t in enumerate(texts):
        assert whole[i] == pytest.approx(subwords.means([t], table, settings)[0])
        at, share = subwords.bags([t], settings)[0]
        assert whole[i] == pytest.approx(share @ table[at] if len(at) else np.zeros(2), rel=1e-5)


# --- language model


def brute_base(rows, train):
    counts = Counter()
    words = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    for (i, *_), w in zip(rows, words, strict=True):
        if train(i):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    return [(len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for w in words]


@pytest.mark.parametrize("memory", [2, 1000])
def test_counts_and_base_match_brute_force(spark, memory):
    rng = random.Random(8)
    rows = [r for r in ODD if r[0] != 8] + [(30 + i, " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(40))), None, None, 0) for i in range(60)]
    from pyspark.sql import functions as F

    train = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2
    from tidemark.llm.common import fold

    found = lm.score(docs(spark, rows), fold(F.col("doc_id"), 7) != 2, size=2, in_memory=memory).collect()
    wanted = brute_base(rows, train)
    as_row = lambda i, held, n, k, t, b: (str(i), held, n, k, t, round(b, 6))
    assert sorted(as_row(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found) == sorted(
        as_row(r[0], not train(r[0]), *w) for r, w in zip(rows, wanted, strict=True)
    )
    assert all(r.score < 0 for r in found)


def test_model_on_an_empty_table_and_without_training_rows(spark):
    from pyspark.sql import functions as F

    assert lm.score(docs(spark, []), F.lit(True)).count() == 0
    rows = lm.score(docs(spark, [(1, "a b", None, None, 0)]), F.lit(False)).collect()
    assert (rows[0].n_tokens, rows[0].n_known, rows[0].train_tokens, rows[0].base_score) == (3, 0, 0, 0.0)


def test_shares_of_the_model_add_up_to_one():
    counts = np.array([9, 7, 5, 3, 2, 2, 1, 1])
    s = gru.Settings(hidden=6, classes=3, lanes=2, window=4)
    params, borders = gru.start(counts, s)
    gru.train(params, borders, [np.array([0, 1, 2, 3, 7])] * 8, 7, s, 2)
    prefix = [2, 5]
    total = sum(math.exp(gru.score(params, borders, [np.array([*prefix, w])], 7)[0] - gru.score(params, borders, [np.array(prefix)], 7)[0]) for w in range(8))
    assert total == pytest.approx(1.0, abs=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    s = gru.Settings(hidden=4, classes=3, lanes=2, window=3)
    params, borders = gru.start(np.array([9, 5, 4, 3, 2, 1]), s)
    tokens, targets, fresh = rng.integers(0, 6, (3, 2)), rng.integers(0, 6, (3, 2)), np.array([[True, False], [False, True], [False, False]])
    before = rng.normal(0, 1, (2, 4)).astype(np.float32)
    _, grads, _ = gru.window_gradients(params, borders, tokens, targets, fresh, before)
    whole = np.zeros_like(params["gates"])
    np.add.at(whole, tokens.reshape(-1), grads["gates"])
    grads["gates"] = whole
    for name, value in params.items():
        for at in [tuple(rng.integers(0, d) for d in value.shape) for _ in range(5)]:
            kept, step = value[at], 1e-2
            losses = []
            for sign in (1, -1):
                value[at] = kept + sign * step
                losses.append(gru.window_gradients(params, borders, tokens, targets, fresh, before)[0])
            value[at] = kept
            assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(grads[name][at], abs=5e-3, rel=2e-2)


def test_lanes_and_windows_do_not_change_scores():
    rng = np.random.default_rng(2)
    params, borders = gru.start(np.sort(rng.integers(1, 90, 30))[::-1], gru.Settings(hidden=8, classes=5))
    streams = [np.r_[rng.integers(0, 29, n), 29] for n in (0, 3, 500, 40, 7, 7)]
    alone = [gru.score(params, borders, [x], 29)[0] for x in streams]
    assert gru.score(params, borders, streams, 29, lanes=3, window=5) == pytest.approx(alone, rel=1e-4)


def test_every_token_of_a_long_text_is_taught():
    known = lm.Vocabulary(["a", "b", "c"], [900, 600, 300], 1800, 4, 3, 3)

    class Held:
        value = known

    import pyarrow as pa

    texts = [" ".join("abc"[i % 3] for i in range(1000)), "a b", None, "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["__text"])
    rows = [r for b in lm._cut(Held, 3, 128, 16)([batch]) for r in b.to_pylist()]
    tokens = [np.frombuffer(r["tokens"], np.uint16) for r in rows]
    assert sum(len(t) - r["lead"] for t, r in zip(tokens, rows, strict=True)) == 1000 + 2 + 0 + 2 + len(texts)
    assert all(len(t) <= 128 + 16 and r["lead"] <= 16 for t, r in zip(tokens, rows, strict=True))
    whole = np.concatenate([t[r["lead"] :] for t, r in zip(tokens, rows, strict=True)][:8])
    assert whole.tolist() == known.tokens_of(known.ranks([w.encode() for w in texts[0].split()])).tolist()
    assert len({(r["round"], r["place"]) for r in rows}) == len(rows)  # equal texts are dealt apart


def test_training_counts_every_token_but_leads():
    s = gru.Settings(hidden=4, classes=2, lanes=4, window=3)
    seen = []

    def watched(*a):
        seen.append(int(a[6].sum()))
        return kept(*a)

    kept, gru.window_gradients = gru.window_gradients, watched
    try:
        params, borders = gru.start(np.array([5, 3, 2, 1]), s)
        gru.train(params, borders, [np.array([0, 1, 3] * 5), np.array([1, 2, 3, 0, 3])], 3, s, 1, leads=[0, 2])
    finally:
        gru.window_gradients = kept
    assert sum(seen) == 15 + 3


def test_learns_what_stands_late_in_long_texts(spark):
    rng = random.Random(4)
    early = lambda: [rng.choice("pqrs") for _ in range(300)]
    late = "u v w x".split() * 300
    rows = [(i, " ".join([*early(), *late])) for i in range(12)]
    texts = spark.createDataFrame(rows, "__id long, __text string")
    vocab = lm.vocabulary(lm.word_counts(texts.select("__text")), len(rows))
    params, borders = pickle.loads(lm.fit(texts, vocab, rows=0))
    stream = vocab.tokens_of(vocab.ranks([w.encode() for w in late[:200]]))
    assert gru.score(params, borders, [stream], vocab.end)[0] / 200 > -1.0  # the shares of these words alone give -1.6


def test_vocabulary_grows_with_the_counted_words(spark):
    counts = spark.range(6000).selectExpr("concat('w', id) AS word", "CASE WHEN id < 5000 THEN 16 + id % 7 ELSE 3 END AS n")
    assert lm.vocabulary(counts, 1).size == 5000
    assert lm.vocabulary(counts.limit(100), 1).size == 100
    assert lm.vocabulary(counts, 1, in_memory=2).size <= 2


def test_models_shuffled_follow_tokens_not_tasks(spark, monkeypatch):
    """Few tokens in many pieces and tasks are learned as one model, whole; more models where tokens are worth them."""
    from tidemark.llm import lm

    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3} and so on") for i in range(400)]
    train = spark.createDataFrame(rows, "__id long, __text string").repartition(16)
    counts = lm.word_counts(train.select("__text"))
    seen = []
    kept = lm._round
    monkeypatch.setattr(lm, "_round", lambda pieces, *rest: seen.append((pieces.rdd.getNumPartitions(), pieces.count())) or kept(pieces, *rest))
    vocab = lm.vocabulary(counts, 400)
    lm.fit(train, vocab, rows=20, rounds=2, chunk=4, lead=1)
    assert [n for n, _ in seen] == [1, 1] and sum(n for _, n in seen) == 800
    seen.clear()
    monkeypatch.setattr(lm, "MODEL_TOKENS", 700)
    lm.fit(train, vocab, rows=20, rounds=2, chunk=4, lead=1)
    assert all(1 < n <= 2 for n, _ in seen)
