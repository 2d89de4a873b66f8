"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import hand_written
from gaugewright.llm import bpe, components, html_extract, html_samples, langid, packing, quality_classifier, quality_rules, queries, sharding, simhash, staging, topk_search, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, n=120, seed=1):
    """Texts with copies, near copies, shared lines, nulls, empty and long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(21, 90))]
        lines = [" ".join(words[j : j + 12]) for j in range(0, len(words), 12)]
        if i % 3 == 0:
            lines.insert(0, "Shared Header  line of the site")
        text = "\n".join(lines)
        if i % 10 == 1:
            text = rows[-1][1]
        if i % 10 == 2 and rows[-1][1]:
            text = rows[-1][1] + " tail"
        rows.append((i, {5: None, 17: "", 29: " \n\t ", 31: "Long wörd " * 3000}.get(i, text), "en", None if i == 7 else f"s{i % 2}", len(text)))
    rows.append(rows[3])
    return spark.createDataFrame(rows, DOC)


def cluttered(df):
    """Columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("key", "ids", "fp", "piece", "k_", "t_", "score", "label", "component", "drop_", "rank", "size")})


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def pandas_rows(df):
    return [tuple(r) for r in df.collect()]


# ---- 6: byte-pair encoding


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_equals_the_library(text):
    got = np.frombuffer(bpe.Encoder(bpe.vocabulary(PATH).encode_words)([text])[0], "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinrst'.<|>ofextndéÉ \n", max_size=40))
def test_bpe_equals_the_library_on_likely_letters(text):
    got = np.frombuffer(bpe.Encoder(bpe.vocabulary(PATH).encode_words)([text])[0], "<u4").tolist()
    assert got == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_bpe_compatibility_is_exact():
    v = bpe.vocabulary(PATH)
    rng = random.Random(2)
    words = {"".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(3000)}
    proposed = {w: v.propose(w) for w in words}
    exact = dict(zip(words, v.merge_exactly(list(words)), strict=True))
    for w, p in proposed.items():
        a = np.array(p)
        valid = bool(v.whole[a].all() and (len(a) < 2 or v.compatible(a[:-1], a[1:]).all()))
        assert valid == (np.array(p, "<u4").tobytes() == exact[w])
    assert any(np.array(p, "<u4").tobytes() != exact[w] for w, p in proposed.items())


def test_long_words_merge_as_the_library_does():
    import time

    rng = random.Random(2)
    vocab = bpe.vocabulary(PATH)
    for n in (401, 1000, 5000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "aab", "etaoin"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert np.frombuffer(vocab.merge_long(word), "<u4").tolist() == TOKENIZER.encode(word, add_special_tokens=False).ids
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    start = time.perf_counter()
    got = bpe.Encoder(vocab.encode_words)([word])[0]
    assert time.perf_counter() - start < 5  # far below what rounds over the whole word take
    assert np.frombuffer(got, "<u4").tolist() == TOKENIZER.encode(word, add_special_tokens=False).ids


def test_memory_of_words_is_bounded_by_bytes():
    memory = bpe.Memory(50_000)
    for i in range(1000):
        memory.room()
        memory |= (found := {f"word{i}": b"1234", f"{i}" * 300: b"x"})
        memory.settle(found)
        assert memory.held <= 50_000 + 400 and not any(len(w) > bpe.LONGEST_KEPT for w in memory)
    encoder = bpe.Encoder(bpe.vocabulary(PATH).encode_words, cache_bytes=2_000)
    texts = [f"some words {i} here" for i in range(200)]
    for t in texts:
        assert np.frombuffer(encoder([t])[0], "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_bpe_frames(spark, docs):
    out = {r["doc_id"]: r for r in bpe.bpe_encode(cluttered(docs), PATH).collect()}
    for r in docs.collect():
        ids = TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids
        assert out[r["doc_id"]]["ids"] == ids and out[r["doc_id"]]["decoded"] == TOKENIZER.decode(ids, skip_special_tokens=False)
    again = {r["doc_id"]: r["decoded"] for r in bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()}
    assert again == {k: r["decoded"] for k, r in out.items()}
    assert bpe.bpe_encode(docs.limit(0), PATH).count() == 0


# ---- 3: packing


def test_cutting_stock_covers_the_demand():
    rng = np.random.default_rng(0)
    sizes, counts = np.unique(rng.integers(1, 65, 3000), return_counts=True)
    plan = packing.cutting_stock(sizes, counts, 64)
    assert all((p * sizes).sum() <= 64 for _, p in plan)
    assert (sum(t * p for t, p in plan) >= counts).all()
    rooms: list[int] = []  # first fit, longest first
    for size in np.repeat(sizes, counts)[::-1].tolist():
        at = next((i for i, room in enumerate(rooms) if room >= size), None)
        if at is None:
            rooms.append(64 - size)
        else:
            rooms[at] -= size
    assert (sizes * counts).sum() / 64 <= sum(t for t, _ in plan) <= len(rooms)
    assert packing.cutting_stock(np.array([], np.int64), np.array([], np.int64), 64) == []
    basis = rng.normal(size=(7, 7))
    assert np.allclose(packing.inverted(basis) @ basis, np.eye(7))


def test_knapsack_against_all_patterns():
    sizes, prices = np.array([2, 3, 5]), np.array([0.2, 0.37, 0.6])
    best = max(sum(n * p for n, p in zip(c, prices)) for c in itertools.product(range(6), repeat=3) if sum(n * s for n, s in zip(c, sizes)) <= 11)
    assert packing.best_pattern(prices, sizes, 11)[0] == pytest.approx(best)


def test_packing(spark, docs):
    capacity = 256
    out = packing.pack(cluttered(docs), PATH, capacity, 4).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = [*TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), capacity):
            part = np.array(ids[at : at + capacity], "<u4")
            want[r["doc_id"], at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter(map(tuple, out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].astype(int).to_numpy().tolist())) == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= capacity
    assert out["length"].sum() / (out["sequence_id"].nunique() * capacity) > 0.9
    assert packing.pack(docs.limit(0), PATH).count() == 0


# ---- 8: SimHash, and components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(list(nodes), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    out = pandas_rows(simhash.near_duplicates(cluttered(docs).drop("fp"), "doc_id", "text"))
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    assert {k: fp & (1 << 64) - 1 for k, fp, _ in out} == prints and len(out) == docs.count()
    groups = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {k: c for k, _, c in out} == groups
    kept = simhash.deduplicate(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values())) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_links_keep_every_component(spark, block):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(25)} | {0}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df, block=block).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in edges)
    found = set(edges) | {(b, a) for a, b in edges}
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)

    def partition(labels):
        groups = defaultdict(set)
        for k, v in labels.items():
            groups[v].add(k)
        return sorted(map(sorted, groups.values()))

    assert partition(brute_components(prints, lambda a, b: (a, b) in found)) == partition(want)


def test_similar_texts_take_the_links_of_fingerprints(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "x"]), " ".join(reversed(words)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: linked.append({(r["a"], r["b"]) for r in links(fps).collect()}) or links(fps))
    got = {r["doc_id"]: r["component"] for r in simhash.similar_texts(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    prints = [simhash.fingerprint(t, simhash.COPY_SHINGLE) for t in texts[:2]]
    assert prints[0] == prints[1] or linked[0] & {tuple(prints), tuple(prints[::-1])}


def test_parities_never_refute_similar_sets():
    rng = np.random.default_rng(3)
    for n in (1, 10, 500, 5000):
        whole = rng.integers(-(2**63), 2**63, n, np.int64)
        part, more = whole[: n - n // 9], rng.integers(-(2**63), 2**63, n // 9, np.int64)
        a, b = (simhash.parities(np.unique(x)).view(np.uint64) for x in (whole, np.concatenate([part, more])))
        assert len(a) == simhash.SIGNS and np.bitwise_count(a ^ b).sum() <= 2 * (n // 9)
    assert not simhash.parities(np.zeros(0, np.int64)).any()


def brute_similar(texts):
    """The components of all pairs with a Jaccard similarity of 0.8 or more, and the number of pairs beyond 3 bits."""
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    near = lambda a, b: not (sets[a] | sets[b]) or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    prints = {k: brute_fingerprint(t) for k, t in texts.items()}
    far = sum(near(a, b) and (prints[a] ^ prints[b]).bit_count() > 3 for a, b in itertools.combinations(texts, 2))
    return brute_components(texts, near), far


def test_similar_texts_against_all_pairs(spark, docs, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    notice = " ".join(word() for _ in range(12))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {500: "One two", 501: "one  TWO", 502: "one two three"}
    for i in range(25):
        words = [word() for _ in range(60)]
        for j in range(5):
            copy = words.copy()
            for at in rng.sample(range(60), rng.randint(0, 4)):
                copy[at] = word()
            texts[1000 + 10 * i + j] = " ".join(copy) + " " + notice
    want, far = brute_similar(texts)
    assert far > 20
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component"] for r in simhash.similar_texts(cluttered(df).drop("component")).collect()} == want
    import corpus_pipeline

    stage = corpus_pipeline.drop_near_duplicates(spark, df.withColumn("n_chars", F.length("text")), "")
    assert sorted(r["doc_id"] for r in stage.collect()) == sorted(set(want.values())) and stage.columns == ["doc_id", "text", "n_chars"]
    monkeypatch.setattr(simhash, "COMMON", 3)  # another order, the same result
    assert {r["doc_id"]: r["component"] for r in simhash.similar_texts(df).collect()} == want
    assert simhash.similar_texts(df.limit(0)).count() == 0


def test_unlike_texts_that_share_an_id_stay(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (1, a), (2, b + " tail"), (3, c), (0, c + " end"), (4, None), (4, ""), (4, c), (None, a), (5, a + " x"), (5, a + " y")]
    df = cluttered(spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, x_ string"))
    got = simhash.drop_similar(df)
    assert got.columns == df.columns
    kept = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in got.collect())
    assert kept == sorted([(1, a), (1, b), (0, c + " end"), (4, ""), (-1, a)])  # of the two without words one stays
    two = [(7, a), (7, a + " x"), (7, b)]  # near copies that share their id: one of them stays
    left = [r["text"] for r in simhash.drop_similar(spark.createDataFrame(two, "doc_id long, text string")).collect()]
    assert len(left) == 2 and b in left
    assert len(simhash.deduplicate(spark.createDataFrame([(7, a), (7, b), (7, a), (8, a)], "doc_id long, text string")).collect()) == 2
    assert simhash.drop_similar(df.limit(0)).count() == 0


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    ca, cb = simhash._segment_counts(a), simhash._segment_counts(b)
    plain = [sum(abs((int(x) >> s & 3).bit_count() - (int(y) >> s & 3).bit_count()) for s in range(0, 64, 2)) for x, y in zip(a, b)]
    assert [int(simhash._manhattan(x, np.array([y]))[0]) for x, y in zip(ca, cb)] == plain
    assert (np.array(plain) <= np.bitwise_count(a ^ b)).all()


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(20)] + [(3, 3), (None, 1)]
    got = dict(pandas_rows(components.connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    real = {frozenset(e) for e in edges if None not in e and e[0] != e[1]}
    nodes = {n for e in real for n in e}
    assert got == brute_components(nodes, lambda a, b: frozenset((a, b)) in real)
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---- 7: quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1c\xa0#é", max_size=120))
def test_base_counts(text):
    assert quality_rules.measure(text)[:5] == brute_counts(text)


def brute_rules(rows, limit):
    """From the contract: different documents per host and normalised line; lines above the limit go; depleted documents are rejected."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda line: " ".join(split(line.lower()))
    lines = [[norm(x) for x in (r["text"] or "").split("\n") if norm(x)] for r in rows]
    holders = defaultdict(set)
    for r, held in zip(rows, lines):
        for line in held:
            holders[r["source"], line].add("\n".join(held))
    bad = {k for k, texts in holders.items() if len(texts) > limit}
    out = []
    for r, held in zip(rows, lines):
        counts = brute_counts(r["text"])
        gone = sum(len(split(line)) for line in held if (r["source"], line) in bad)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        out.append((r["doc_id"], *counts, failed, not failed and 100 * (counts[0] - gone) >= 30 * counts[0]))
    return sorted(out), bad


def test_quality_rules(spark, docs):
    limit = 5
    got = quality_rules.judge(cluttered(docs), limit=limit)
    want, bad = brute_rules(docs.collect(), limit)
    assert bad and sorted(pandas_rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) == want
    cleaned = quality_rules.clean(cluttered(docs), limit=limit)
    assert cleaned.columns == cluttered(docs).columns
    texts = {r["doc_id"]: r for r in cleaned.collect()}
    kept = {w[0] for w in want if w[-1]}
    assert set(texts) == kept and cleaned.count() == sum(1 for r in docs.collect() if r["doc_id"] in kept)
    assert all("Shared Header" not in r["text"] and (r["n_chars"] == len(r["text"]) or r["text"] in {d["text"] for d in docs.collect()}) for r in texts.values())
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_copies_count_once(spark):
    text = "\n".join(" ".join(f"word{i}{j}" for j in range(9)) for i in range(6))
    copies = [(i, (text, text.upper(), text.replace(" ", "  "))[i % 3], "en", "s", 1) for i in range(90)]
    assert quality_rules.judge(spark.createDataFrame(copies, DOC)).where("not kept").count() == 0


def test_depleted_documents_are_rejected(spark):
    rng = random.Random(16)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(9))
    common = [line() for _ in range(8)]
    rows = [(i, "\n".join(common + [line() for _ in range(3)]), "en", "a", 1) for i in range(400)]
    rows += [(i, "\n".join(common[:1] + [line() for _ in range(3)]), "en", "a", 1) for i in range(400, 420)]
    df = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert {k for k, r in got.items() if r["kept"]} == set(range(400, 420))
    assert all(len(r["drop_lines"]) == 8 for k, r in got.items() if k < 400)
    assert brute_rules(df.collect(), 20)[0] == sorted((k, *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]) for k, r in got.items())


def test_all_shared_lines_of_unrelated_documents_go(spark):
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(9))
    rows, want = [], {}
    for host, (shared, own) in {"a": (2, 1), "b": (3, 1), "c": (5, 2), "d": (5, 3), "e": (8, 2)}.items():
        common = [line() for _ in range(shared)]
        for _ in range(25):
            want[len(rows)] = sorted(map(quality_rules.line_key, common))
            rows.append((len(rows), "\n".join(common + [line() for _ in range(own)]), "en", host, 1))
        copied = [line() for _ in range(shared + own)]
        for _ in range(25):  # copies, exact ones too
            want[len(rows)] = []
            rows.append((len(rows), "\n".join(copied), "en", host, 1))
    got = quality_rules.judge(spark.createDataFrame(rows, DOC)).collect()
    assert {r["doc_id"]: sorted(r["drop_lines"]) for r in got} == want


# ---- 5 and 9: classifiers


def test_quality_classifier(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "morning", "light"]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["BUY###", "$$$NOW", "%%win", "&&&"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    train = quality_classifier.training_rows(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert all(zlib.crc32(str(r["key"]).encode()) % 3 != 1 for r in train.collect())
    model = quality_classifier.fit(train, "key", "text", "label")
    out = quality_classifier.score(df, model).where(quality_classifier.held_out()).collect()
    assert out and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in out]) > 0.9
    odd = quality_classifier.score(spark.createDataFrame([(1, None), (2, ""), (3, "é" * 50_000)], "doc_id long, text string"), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd)
    none = quality_classifier.fit(train.limit(0), "key", "text", "label")
    assert quality_classifier.score(df.limit(2), none).first()["score"] == 0.5


def brute_quality(texts, model):
    import zstandard

    def size(raw, words):
        held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_AUTO)
        held.precompute_compress(level=3)
        c = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(raw[i : i + 1500])) for i in range(0, len(raw), 1500))

    out = []
    for t in texts:
        raw = (t or "").encode()
        g, b = size(raw, model.good), size(raw, model.bad)
        x = (10 * (b - g) / (b + g), min(g, b) / len(raw), 1) if raw else (0, 0.5, 1)
        out.append(1 / (1 + np.exp(-sum(a * w for a, w in zip(x, model.weights)))))
    return out


def test_quality_scores_against_plain_compression(spark, docs):
    rows = docs.where("text is not null").select("doc_id", "text", (F.col("doc_id") % 2).alias("label"), F.lit("y").alias("key"))
    model = quality_classifier.fit(quality_classifier.training_rows(rows, rows.select("doc_id", "label"), label="label"), "key", "text", "label")
    held = docs.collect()
    got = quality_classifier.score(cluttered(docs), model, into="score")
    assert got.columns == cluttered(docs).columns and got.count() == len(held)  # repeated rows stay, the clashing column is replaced
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in got.collect()) == sorted((r["doc_id"], round(s, 9)) for r, s in zip(held, brute_quality([r["text"] for r in held], model)))
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_long_labelled_texts_reach_the_fit(spark):
    from gaugewright.llm.sample import per_class

    rows = spark.createDataFrame([(i, "x" * (50_000 if i % 2 else 10), i % 2) for i in range(100)], "k long, t string, y int")
    assert len(per_class(rows, "y", 50, "k", "t")) == 100
    few = per_class(rows, "y", 50, "k", "t", most_bytes=1_000_000)
    assert 0 < sum(len(r.t) for r in few) < 2_000_000 and {r.y for r in few} == {0, 1}
    assert 10 < len(per_class(rows, "y", 50, "k", "t", most_rows=40)) < 70
    assert per_class(rows.limit(0), "y", 50, "k", "t") == []


def test_left_out_errors_against_fitting_again(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, 20)), rng.choice([-1.0, 1.0], (12, 3))
    inverse = np.linalg.inv(x @ x.T + langid.RIDGE * np.eye(12))
    quick = y - inverse @ y / np.diag(inverse)[:, None]
    for i in range(12):
        rest = np.arange(12) != i
        dual = np.linalg.solve(x[rest] @ x[rest].T + langid.RIDGE * np.eye(11), y[rest])
        assert np.allclose(quick[i], x[i] @ x[rest].T @ dual)


def test_language_of_odd_tables(spark):
    rows = [(i % 30, "alpha beta gamma" if i % 2 else "eins zwei drei", "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    out = langid.identify(cluttered(df.union(df)), model)
    assert out.count() == 120 and out.where("lang_pred <> 'und'").count() == 120
    assert langid.identify(df.limit(0), model).count() == 0
    plain = [langid.ngram_counts(t) @ model.weights for t in ("alpha beta gamma", "eins zwei drei")]
    names = [model.langs[int((np.log1p(np.exp(-4 * m * model.codes)) @ model.trust).argmin())] for m in plain]
    assert names == ["b", "a"]


def test_language_id(spark):
    rng = random.Random(3)
    words = {"a": "the and of river stone".split(), "b": "der und die fluss stein".split(), "c": "le et la rivière pierre".split(), "d": "el los río piedra y".split()}
    rows = [(i, " ".join(rng.choice(words["abcd"[i % 4]]) for _ in range(20)), "abcd"[i % 4]) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where(~quality_classifier.held_out()))
    out = {r["doc_id"]: r for r in langid.identify(cluttered(df), model).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([out[r[0]]["lang_pred"] == r[2] for r in test]) > 0.95
    odd = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the " * 30000)], "doc_id long, text string"), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and odd[4]["lang_pred"] == "a"
    assert langid.identify(df.limit(1), langid.fit(df.limit(0))).first()["lang_pred"] == "und"


@pytest.mark.parametrize("k", [2, 4, 7, 12])
def test_codewords_differ(k):
    codes = langid.codewords(k)
    least = 1 if k < 3 else codes.shape[1] // 4
    assert len(codes) == k and all((codes[i] != codes[j]).sum() >= least for i in range(k) for j in range(i))


# ---- 4: URL filters


def test_url_rules(spark):
    urls = {1: "https://x.Example.COM/en/1?q", 2: "http://example.com/en/70", 3: "http://a.net/de/9", 4: "http://example.net/de/81#x", 5: "http://b.org/es/", 6: None, 7: "no scheme", 8: "http://notcom/en/", 9: "http://x.org?/es/", 10: "HTTP://C.com/en/"}
    pages = spark.createDataFrame([(k, v, "z") for k, v in urls.items()] + [(1, urls[1], "z")], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "src string, dst string")
    out = url_filter.judge(pages, none)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {
        1: ("x.example.com", "/en/1", "com/en/", "block"), 2: ("example.com", "/en/70", "example.com/en/7", "allow"), 3: ("a.net", "/de/9", "net/de/", "allow"),
        4: ("example.net", "/de/81", "example.net/de/8", "block"), 5: ("b.org", "/es/", "org/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("notcom", "/en/", None, "allow"), 9: ("x.org", "", None, "allow"), 10: ("c.com", "/en/", "com/en/", "block"),
    }
    assert out.count() == 11


def test_aliases(spark):
    blocked, free, other, allowed = "http://a.com/en/1", "http://f.io/1", "http://g.io/2", "http://example.com/en/7"
    pages = spark.createDataFrame([(1, blocked, f'<link rel="canonical" href="{free}">'), (2, free, None), (3, other, f"<meta http-equiv='refresh' content='0;url={free}'>"), (4, "http://h.io/", f"<LINK href='{allowed}' rel=canonical>"), (5, allowed, "")], "page_id long, url string, html string")
    edges = url_filter.alias_edges(pages)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, edges).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    more = edges.union(spark.createDataFrame([(other, allowed)], edges.schema))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, more).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}


def brute_verdicts(pages, edges):
    """Plain Python: rules, then aliases over folded URLs; explicit rules first, allow before block."""
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

    def fold(u):
        m = re.match(r"(.*?://[^/?#]*)([^#]*)", u, re.S)
        return m[1].lower() + m[2] if m else u.split("#")[0]

    def own(u):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(p), v) for v, p in rules if (host == p.split("/")[0] or host.endswith("." + p.split("/")[0])) and path.startswith(p[p.index("/") :])]
        return max(fits)[1] if fits else None

    near = defaultdict(set)
    for a, b in edges:
        near[fold(a)].add(fold(b))
        near[fold(b)].add(fold(a))
    out = {}
    for key, u in pages:
        verdict = own(u)
        if verdict is None and u is not None:
            reached, todo = {fold(u)}, [fold(u)]
            while todo:
                for v in near[todo.pop()] - reached:
                    reached.add(v)
                    todo.append(v)
            found = {own(v) for v in reached}
            verdict = "allow" if "allow" in found or "block" not in found else "block"
        out[key] = verdict or "allow"
    return out


def test_alias_chains_across_hosts(spark):
    rng = random.Random(4)
    hosts = ["a.com", "B.io", "c.net", "example.com", "d.org", "e.io", "f.io", "g.io"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es'])}/{i}" for i in range(120)]
    pages, edges = [], []
    for i, u in enumerate(urls):
        html = ""
        if rng.random() < 0.6:
            v = rng.choice(urls)
            v = rng.choice([v, v.replace("http", "HTTP").replace(".io", ".IO"), v + "#part"])
            html = rng.choice(['<link rel="canonical" href="{}">', "<meta http-equiv=refresh content='0; url={}'>"]).format(v)
            edges.append((u, v))
        pages.append((i, rng.choice([u, u.replace(".io", ".Io"), u + "#x"]), html))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, url_filter.alias_edges(df)).collect()}
    assert got == brute_verdicts([p[:2] for p in pages], edges) and set(got.values()) == {"allow", "block"}
    assert url_filter.judge(df.limit(0), url_filter.alias_edges(df.limit(0))).count() == 0


def test_relative_aliases(spark):
    pages, want = [], set()
    for host, kind in (("http://a.com", "en"), ("https://b.io:8080", "de")):
        page = f"{host}/{kind}/x/1?q=2"
        tags = {
            '<meta http-equiv="refresh" content="0;url=/new">': f"{host}/new",
            "<META content='5; URL=\"../up\"' http-equiv=Refresh>": f"{host}/{kind}/up",
            '<meta http-equiv="refresh" content="0; /plain">': f"{host}/plain",
            '<link rel="alternate canonical" href="./same?a=1&#38;b=2">': f"{host}/{kind}/x/same?a=1&b=2",
            "<link href=//c.net/z rel=canonical>": f"{host.split(':')[0]}://c.net/z",
            '<link rel="not-canonical" href="/no">': None,
        }
        pages.append((len(pages), page, "".join(tags)))
        want |= {(page, t) for t in tags.values() if t}
    pages += [(8, "http://a.com/new", ""), (9, "https://b.io:8080/new", ""), (10, "https://b.io/new", None), (11, "no scheme", '<link rel=canonical href="/x">')]
    pages += [(12, "http://d.io/p/", '<base href="/q/"><link rel=canonical href="1">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = url_filter.alias_edges(df)
    assert {tuple(e) for e in edges.collect()} == want | {("http://d.io/p/", "http://d.io/q/1")}
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, edges).collect()}
    assert [k for k, v in got.items() if v == "block"] == [0, 8]


NOISE = [
    '<!-- <link rel="canonical" href="{}"> -->',
    "<script>document.write('<meta http-equiv=refresh content=\"0;url={}\">')</script>",
    '<style>/* <link rel=canonical href="{}"> */</style>',
    '<noscript><meta http-equiv="refresh" content="0;url={}"></noscript>',
    "<a title='<link rel=canonical href={}>'>x</a>",
    '<textarea><link rel="canonical" href="{}"></textarea>',
    '<TITLE><link rel="canonical" href="{}"></TITLE>',
    '<meta name="refresh" content="0;url={}">',
    '<link rel="stylesheet" title="canonical" href="{}">',
    '<template><link rel="canonical" href="{}"></template>',
]


def test_what_is_no_tag_is_no_alias(spark):
    """A page with nothing but noise declares nothing; one with noise before a true link declares that."""
    blocked, rows = "http://a.com/en/1", []
    for i, noise in enumerate(NOISE):
        tags, _ = url_filter.declared(noise.format(blocked))
        assert not any(url_filter.target_of(t, "http://f.io/1", None) for t in tags)
        rows.append((2 * i, f"http://f.io/{i}", noise.format(blocked)))
        rows.append((2 * i + 1, f"http://g.io/{i}", noise.format("http://h.io/") + f'<link title="a > b" rel=canonical href="{blocked}">'))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = url_filter.alias_edges(pages)
    assert sorted(map(tuple, edges.collect())) == sorted((f"http://g.io/{i}", blocked) for i in range(len(NOISE)))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, edges).collect()}
    assert got == {i: "block" if i % 2 else "allow" for i in range(2 * len(NOISE))}


def test_aliases_among_noise_against_brute_force(spark):
    """Chains of true tags among false ones, cut-off pages, repeated pages and clashing names."""
    rng = random.Random(12)
    urls = [f"http://{rng.choice(['a.com', 'b.io', 'c.net', 'd.org', 'e.io'])}/{rng.choice(['en', 'de', 'es'])}/{i}" for i in range(90)]
    pages, edges = [], []
    for i, u in enumerate(urls):
        parts = [rng.choice(NOISE).format(rng.choice(urls)) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.5:
            v = rng.choice(urls)
            parts.insert(rng.randint(0, len(parts)), rng.choice(['<link data-x="1>2" rel="canonical" href="{}">', "<META content='3;URL={}' http-equiv='refresh'/>"]).format(v))
            edges.append((u, v))
        pages.append((i, u, "<p>" + "".join(parts) + rng.choice(["", "<script>", "<!-- ", '<a href="']), "s", "d"))
    pages += [*pages[:5], (95, None, '<link rel="canonical" href="http://x.io/">', "s", "d"), (96, "http://y.io/", None, "s", "d"), (97, "http://z.io/", "", "s", "d")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, url_filter.alias_edges(df)).collect()}
    assert got == brute_verdicts([p[:2] for p in pages], edges)
    # the SQL of the query, which the given pages, without a link, hardly test
    con = duckdb.connect()
    con.register("pages", df.where("page_id < 95").toPandas())
    assert {r[0]: r[4] for r in con.execute(queries.OP4_SQL).fetchall()} == {k: v for k, v in got.items() if k < 95}


# ---- 2: top-k


def brute_top(rows, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(set(out))


def test_top_k_of_large_components(spark):
    rng = random.Random(5)
    data = [(i, [rng.randint(-(10**9), 10**9) for _ in range(7)]) for i in range(200)] + [(i, [rng.randint(-(10**6), 10**6) * 10**12 for _ in range(7)]) for i in range(200, 240)]
    df = spark.createDataFrame(data, "id long, v array<long>")
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = []
    for q, v in data:
        if q % 20 == 0:
            scored = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in data if i != q)
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:6], 1)]
    assert sorted(pandas_rows(topk_search.top_k(df.where("id % 20 = 0"), df, 6, shard_rows=32, query_rows=4))) == sorted(want)
    floats = spark.createDataFrame([(i, [3e38 * (-1) ** i, float(i)]) for i in range(30)], "vec_id long, embedding array<float>")
    rows = topk_search.quantised(floats, "vec_id", "embedding", 64.0)
    got = pandas_rows(topk_search.top_k(rows.where("id % 20 = 0"), rows, 3))
    top = (1 << 63) - 1
    assert sorted(got) == [(0, 1, 2, top), (0, 2, 4, top), (0, 3, 6, top), (20, 1, 0, top), (20, 2, 2, top), (20, 3, 4, top)]


def test_top_k_of_clusters_and_repeated_rows(spark):
    rng = random.Random(8)
    middles = [[rng.randint(-60, 60) for _ in range(5)] for _ in range(6)]
    data = [(i, [c + rng.randint(-3, 3) for c in middles[i % 6]]) for i in range(400)]
    data += [(20, data[20][1])] * 2 + [(777, middles[0])] * 150  # repeated queries, and a third of all rows with one id and vector
    df = spark.createDataFrame(data, "id long, v array<long>").withColumns({c: F.lit("x") for c in ("dim", "cell", "salt", "kth", "score", "far", "row")})
    want = []
    for q, v in {q: v for q, v in data if q % 20 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in data if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:7], 1)]
    got = topk_search.top_k(df.where("id % 20 = 0"), df, 7, shard_rows=40, query_rows=4)
    assert sorted(pandas_rows(got)) == sorted(want)


@pytest.mark.parametrize("big", [1, 10**15])
def test_top_k(spark, big):
    rng = random.Random(1)
    data = [(i, [rng.randint(-4, 4) * big for _ in range(6)]) for i in range(300)] + [(400, [1 * big] * 3), (401, [2 * big] * 3)]
    df = spark.createDataFrame(data, "id long, v array<long>")
    if big > 1:
        data = [(i, v[:2]) for i, v in data[:60]]
        df = spark.createDataFrame([(i, [x // 10**7 for x in v]) for i, v in data], "id long, v array<long>")
        data = [(i, [x // 10**7 for x in v]) for i, v in data]
    got = topk_search.top_k(df.where("id % 20 = 0"), df, 5, shard_rows=64, query_rows=8)
    assert sorted(pandas_rows(got)) == brute_top(data, 5)
    assert topk_search.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_quantised(spark):
    rows = [(0, [0.5, -0.01]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert pandas_rows(topk_search.quantised(df, "vec_id", "embedding", 64.0)) == [(0, [32, -1])]


# ---- 10: shards


def test_shard_store(spark, docs):
    store = sharding.ShardStore(spark, staging.new_path(spark, "store"), target=60_000, fan_in=3)
    assert store.manifest() == (0, []) and store.versions() == []
    for i in range(5):
        store.append(docs.where(F.pmod(F.col("doc_id"), F.lit(5)) == i).coalesce(2))
        store.compact()
    version, live = store.manifest()
    assert sorted(map(repr, store.read().select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert len(live) < 10 and not sharding.plan_merges(live, 60_000, 3)
    with pytest.raises(sharding.Conflict):
        store.commit(version - 1, [])
    assert store.manifest()[0] == version
    assert store.sweep() > 0 and store.read().count() == docs.count() and store.sweep() == 0
    placed = store.placed("doc_id")
    assert placed.count() == docs.count() and {r["shard"] for r in placed.collect()} <= {s.path for s in live}


def test_shard_store_of_odd_tables(spark):
    """Nulls, ties, repeated rows, clashing names, empty arrivals; and the tiers of each version against a plain planner."""
    df = spark.createDataFrame([(i % 40 or None, None if i % 7 == 0 else "t" * (i % 50), "p", i) for i in range(300)], "doc_id long, text string, part string, `arrival` int")
    df = df.withColumn("shard", F.lit("x")).union(df.withColumn("shard", F.lit("x")).limit(5))
    store = sharding.ShardStore(spark, staging.new_path(spark, "odd"), target=20_000, fan_in=3)
    arrivals = 0
    for version in store.append_parts(df.coalesce(2), F.pmod(F.col("arrival"), F.lit(4)), 4):
        arrivals += 1
        assert store.manifest()[0] == version
        store.compact()
        store.sweep(leftovers=False)
        tiers = Counter(sharding.tier_of(s.bytes) for s in store.manifest()[1] if s.bytes < 15_000)
        assert all(n < 3 for n in tiers.values())
    assert arrivals == 4
    store.append(df.limit(0))
    assert store.read().columns == df.columns
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, df.collect()))
    empty = sharding.ShardStore(spark, staging.new_path(spark, "none"))
    with pytest.raises(ValueError):
        empty.read()
    assert list(empty.append_parts(df.limit(0), F.lit(0), 2)) == [1, 2]
    assert empty.read().columns == df.columns and empty.read().count() == 0 and empty.placed("doc_id").columns == ["doc_id", "shard", "version"]


def test_sweeps_read_few_manifests(spark, monkeypatch):
    """Forty versions: each is read from sixteen files at most, old ones go, and the rows stay."""
    store = sharding.ShardStore(spark, staging.new_path(spark, "many"), target=10_000, fan_in=3)
    df = spark.range(3).select(F.col("id").alias("doc_id"))
    reads = []
    plain = sharding.ShardStore._read
    monkeypatch.setattr(sharding.ShardStore, "_read", lambda self, v: reads.append(v) or plain(self, v))
    folder = f"{store.root}/shards/a-0"
    df.coalesce(1).write.parquet(folder)
    shard = store._files("shards/a-0", 1)[0]
    version = store.commit(0, [shard], [], df.schema)
    for i in range(40):  # a shard comes and goes
        other = [sharding.Shard(f"shards/none-{i}.parquet", 10, i)] if i % 2 and i < 39 else []
        version = store.commit(version, [shard, *other])
        if i % 5 == 4:
            reads.clear()
            store.sweep(leftovers=False)
            assert len(reads) <= 2 * (sharding.WHOLE_EVERY + 5) and len(store.versions()) <= sharding.WHOLE_EVERY + 5
    assert version == 41 and min(store.versions()) == 32
    assert store.manifest()[1][0] == shard and store.read().count() == 3


def test_columns_that_come_later(spark):
    store = sharding.ShardStore(spark, staging.new_path(spark, "wider"), target=1 << 20, fan_in=2)
    store.append(spark.range(2).select(F.col("id").alias("doc_id")))
    store.append(spark.range(2).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang")))
    store.compact()
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted([(0, None), (1, None), (0, "x"), (1, "x")], key=repr)


def test_shard_store_conflicts(spark):
    root = staging.new_path(spark, "shared")
    df = spark.range(50).select(F.col("id").alias("doc_id"))
    one, two = (sharding.ShardStore(spark, root, target=10_000, fan_in=2) for _ in range(2))
    one.append(df)
    first = one.manifest
    late = [first()]  # this writer still sees the first version when it commits
    two.append(df)
    one.manifest = lambda version=None: late.pop() if late and version is None else first(version)
    assert one.append(df) == 3 and one.read().count() == 150
    late.append(first(2))
    one.manifest = lambda version=None: late.pop() if late and version is None else first(version)
    one.compact()
    assert one.read().count() == 150 and len(first()[1]) < 3


def test_tiers():
    make = lambda n, size: [sharding.Shard(f"{size}-{i}", size, i) for i in range(n)]
    assert sharding.plan_merges(make(3, 10)) == [] and len(sharding.plan_merges(make(4, 10))[0]) == 4
    assert sharding.plan_merges(make(9, sharding.TARGET_BYTES)) == []


# ---- 1: HTML


@pytest.fixture(scope="module")
def html_model():
    return html_extract.train(html_samples.labelled_pages())


def test_html_template(html_model):
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- x --><div class="ad">Buy this.</div><article><h1>Head &amp; tail</h1><p><b>One\n two<br><p>Three&nbsp;&lt;4</p><div class="notice">We use cookies</div><p>Be.</article><section class="comments"><p>I think so too, very much so indeed</p></section><footer>&copy; me</footer></body></html>'
    assert html_extract.main_text(page, html_model) == "Head & tail\n\nOne two\n\nThree <4\n\nBe."


@pytest.mark.parametrize(
    "page",
    [
        '<body><svg class="i" viewBox="0 0 1 1"/><article><h1>Head</h1><p>Some words of the text</p><svg><path/></svg></article>',
        "<html><head><meta charset=utf-8><title>T</title><article><h1>Head</h1><p>Some words of the text</p></article>",
        "<body><button class=b>Buy<article><h1>Head</h1><p>Some words of the text</p></article><button><div>Sell</div></button>",
        "<body><div><select><option>One<option>Two</div><article><h1>Head</h1><p>Some words of the text</p></article>",
        "<body><article><h1>Head</h1><p>Some words of the text<script>var x",
        "<body><article><h1>Head</h1><p>Some words of the text<style>p{",
    ],
)
def test_html_unclosed_and_cut_off(html_model, page):
    assert html_extract.main_text(page, html_model) == "Head\n\nSome words of the text"


@pytest.mark.parametrize("name", hand_written.PAGES)
def test_html_of_hand_written_layouts(html_model, name):
    source, want = hand_written.PAGES[name]
    assert html_extract.main_text(source, html_model) == want


def test_html_ties_and_repeated_rows(spark):
    """A belief of one half is no main text; repeated rows come back as often, each with its own columns."""
    level = html_extract.Model({}, (0.5, 0.5), {})
    assert html_extract.main_text("<p>even</p>", level) == ""
    rows = spark.createDataFrame([(1, "<article><h1>A title</h1><p>Some text of the page</p></article>", "x")] * 3, "page_id long, html string, text string")
    got = html_extract.extract(rows.repartition(2)).collect()
    assert [(r["page_id"], r["text"]) for r in got] == [(1, "A title\n\nSome text of the page")] * 3


def test_html_held_out_accuracy(html_model):
    right = total = 0
    for source in html_samples.labelled_pages(200, seed=77):
        page = html_extract.parse(source)
        belief = html_extract.Model.marginals(html_model, page)
        for i, _ in page.blocks:
            right += (belief[i] > 0.5) == (page.labels[i] == 1)
            total += 1
    assert right / total > 0.95


def test_html_marginals_against_enumeration(html_model):
    page = html_extract.parse("<div class=content><p>some words of text here</p><ul class=menu><li><a>x</a></li></ul></div>")
    n = len(page.tags)
    odds = [max(-9.0, min(9.0, sum(html_model.odds.get(e, 0.0) for e in seen))) for seen in html_extract.evidence(page)]
    weight = np.zeros((n, 2))
    for ys in itertools.product((0, 1), repeat=n):
        w = 1.0
        for i, y in enumerate(ys):
            p = html_model.pair.get(page.tags[i], html_model.rare)[ys[page.parents[i]] if i else 0]
            w *= (p if y else 1 - p) * np.exp(odds[i] * y)
        for i, y in enumerate(ys):
            weight[i, y] += w
    assert html_model.marginals(page) == pytest.approx((weight[:, 1] / weight.sum(axis=1)).tolist())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/p divscript!-=\"'a&;#\n", max_size=80))
def test_html_any_input(text):
    html_extract.main_text(text, html_extract.Model({}, (0.5, 0.5), {}))


def test_html_frame(spark, html_model):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<article><h1>A</h1><p>" + "word " * 20000 + "</p></article>", "t")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, html_model).collect()}
    assert got[1] == "" and got[2] == "" and got[3] == "A\n\n" + "word " * 19999 + "word"
    assert html_extract.extract(df.limit(0), html_model).count() == 0


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark, 60, 3)
    labels = docs.where("text is not null").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    sf_dir = f"file://{tmp_path}"
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, stage, sf_dir)
        assert after.columns == docs.columns
        stage = staging.written(after, "stage")
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in stage.collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len({digest(r["text"]) for r in stage.collect()}) == stage.count()
    # against brute force: rules, then compression, then all pairs
    verdicts = {r[0]: r[-1] for r in brute_rules(docs.collect(), 20)[0]}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if verdicts[r["doc_id"]]}
    model = quality_classifier.fit(quality_classifier.training_rows(docs.where(F.col("doc_id").isin(list(rows))), labels), "key", "text", "label")
    good = [k for k, s in zip(rows, brute_quality(rows.values(), model)) if s >= 0.5]
    assert {r["doc_id"] for r in stage.collect()} == set(brute_similar({k: rows[k] for k in good})[0].values())
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(f"file://{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"file://{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{sf_dir}/none").count() == 0
    clash = corpus_pipeline.filter_by_classifier(spark, docs.withColumn("score_", F.lit("kept")), sf_dir)
    assert {r["score_"] for r in clash.collect()} == {"kept"}
    assert set(queries.queries()) == {f"op{n}_{x}" for n, x in enumerate("html_extraction topk_search packing url_filters quality_classifier bpe quality_rules simhash language_id sharding phrases spelling_variants toxicity".split(), 1)}


def test_packing_takes_texts_in_parts(spark):
    """The parts' size changes the memory, not the pieces."""
    import pyarrow as pa

    from gaugewright.llm import bpe, packing
    from gaugewright.llm.queries import vocabulary_path

    texts = ["ab" * 30, None, "", "é" * 45, "c d", "x" * 200, "y"]
    parts = list(bpe.text_parts(pa.array([None, *texts]).slice(1), 100))
    assert [first for first, _ in parts] == [0, 3, 5, 6] and [t for _, part in parts for t in part] == texts
    assert list(bpe.text_parts(pa.array([], pa.string()))) == []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few = packing.cut_pieces(docs, vocabulary_path(), batch_chars=50)
    assert sorted(few.collect()) == sorted(packing.cut_pieces(docs, vocabulary_path()).collect()) and few.count() == len(texts)
