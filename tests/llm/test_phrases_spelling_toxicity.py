"""Phrases, spelling variants and toxicity against brute force, and the labelled sample on repeated rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewright.llm import langid, phrases, quality_classifier, spelling, toxicity
from gaugewright.llm.sample import per_class

DOC = "doc_id long, text string, lang string"
LOWER = {c: c + 32 for c in range(65, 91)}


def cluttered(df):
    return df.withColumns({c: F.lit("x") for c in ("key", "phrase", "k", "f", "n", "word", "score", "label", "part", "cell", "best", "sig", "lang_")})


def prose(seed, n=80, vocabulary=14):
    rng = random.Random(seed)
    words = ["Ab", "the", "river", "stone", "Éclat", "so so", "x", "über", "rivers", "stones", "a-b", "the,", "end.", "rivär"][:vocabulary]
    rows = []
    for i in range(n):
        text = rng.choice([" ", "  ", "\t", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        rows.append((i, {5: None, 6: "", 7: " \t\n.,;"}.get(i, text), rng.choice(["a", "b", "b", None])))
    return rows + rows[10:14]


# ---- 11: phrases


def brute_phrases(rows, least=30, first=2000, covered=80):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3, 4):
                count[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if not any(len(q) > len(p) and 100 * b >= covered * a and inside(q) for q, b in found.items()):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1)]
    return out


@pytest.mark.parametrize(("least", "first", "bits", "chunk"), [(30, 2000, 1 << 28, 8 << 20), (3, 7, 64, 500), (2, 2000, 1 << 28, 60)])
def test_phrases_against_brute_force(spark, monkeypatch, least, first, bits, chunk):
    """Also with so few bits that nearly all are set, and with texts cut where pieces end."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = prose(least)
    df = cluttered(spark.createDataFrame(rows, DOC).repartition(3))
    got = phrases.collocations(df, least=least, first=first, most_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, least, first)
    assert sorted(map(tuple, got.collect())) == sorted(want) and (want or least == 30)


def test_phrases_of_odd_tables(spark):
    df = spark.createDataFrame(prose(1), DOC)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.withColumn("text", F.lit(None).cast("string"))).count() == 0
    long = spark.createDataFrame([(1, "so it goes " * 40_000, None), (None, "so it", "und")], DOC)
    got = {r["phrase"]: r["a"] for r in phrases.collocations(long).collect()}
    assert got == {r[2]: r[3] for r in brute_phrases([tuple(r) for r in long.collect()])}


def test_scores_beyond_64_bits(spark):
    """A count of 10^13 times the scale passes 64 bits; the quotient does not."""
    row = spark.createDataFrame([(10**13, 10**13, 10**13 + 7)], "a long, l long, r long")
    expression = f"(CAST(a AS DECIMAL(20, 0)) * {phrases.SCALE}) div (CAST(l AS DECIMAL(20, 0)) + r)"
    assert row.selectExpr(expression).first()[0] == 2_000_000 * 10**13 // (2 * 10**13 + 7)


# ---- 12: spelling variants


def brute_counts(rows, shortest=5, least=3):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def variants_of_letters(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abÀé"[: rng.randint(1, 4)]) for _ in range(rng.choice([3, 5, 5, 6, 7, 9]))) for _ in range(rng.randint(5, 60))]
        rows.append((i, {3: None, 4: "", 5: "12 × ÷ - "}.get(i, rng.choice([" ", ", ", "\n", "ß-"]).join(words))))
    return rows + [(None, "aaaaa aaaab aaaab"), (1, "z" * 3000 + " " + "z" * 2999), (1, "z" * 3000 + " " + "z" * 2999), (1, "z" * 3000 + " " + "z" * 2999)] + rows[8:12]


@pytest.mark.parametrize(("block", "n"), [(1 << 19, 60), (1, 25)])
def test_spelling_against_all_pairs(spark, block, n):
    """Whole, and with cells so small that their ranges are halved down to one position."""
    rows = variants_of_letters(block, n)
    rows = rows if block > 1 else [r for r in rows if "zzz" not in (r[1] or "")]
    df = cluttered(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = spelling.variants(df, block=block)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_counts(rows))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert any(r[1] for r in want) and any(r[4] > 5 for r in want)


def test_spelling_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "few words here"), (3, "ÀÿÀÿÀÿ " * 5)], "doc_id long, text string")
    assert spelling.variants(df.limit(0)).count() == 0
    assert {tuple(r) for r in spelling.variants(df).collect()} == brute_variants(brute_counts([tuple(r) for r in df.collect()]))


def test_chains_of_forms(spark):
    words = ["chain" + "a" * i for i in range(9)]
    text = " ".join(" ".join([w] * 3**i) for i, w in enumerate(words, 1))
    rows = [(0, text)]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_variants(brute_counts(rows)) and ("chain" + "a") in {r[0] for r in got if r[2] == words[-1]}


@settings(max_examples=60, deadline=None)
@given(st.permutations(list(range(13))), st.tuples(*[st.integers(0, 13)] * 4))
def test_wavelet_tree_against_scan(values, box):
    left, right, low, high = box
    query, value = spelling.WaveletTree(np.array(values)).report(*[np.array([v]) for v in box])
    assert sorted(value.tolist()) == sorted(v for v in values[left:right] if low <= v < high) and not query.any()


# ---- 13: toxicity


def toxic_rows(seed=4, n=600):
    rng = random.Random(seed)
    plain = ["river", "stone", "walks", "under", "morning", "light", "über", "Éclat", "scone", "idiom", "path"]
    bad = ["scum", "idiot", "pathetic"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.15)
        for _ in range(rng.randint(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() if i % 3 == 0 else rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    train = toxicity.training_rows(cluttered(df.drop("toxic")), df.select("doc_id", "toxic"))
    assert train.count() and all(zlib.crc32(str(r["key"]).encode()) % 4 != 2 for r in train.collect())
    model = toxicity.fit(train)
    out = toxicity.score(cluttered(df), model)
    assert out.columns == cluttered(df).columns
    held = out.where(toxicity.held_out()).collect()
    right = [(r["score"] >= 0.3) == (r["toxic"] == 1) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.97
    odd = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, "river " * 200_000 + "idiot"), (4, "é")], "doc_id long, text string"), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[0]["score"] == odd[1]["score"] < 0.3
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxic_scores_against_plain_counting(spark):
    """Features, ratios and scores again, in plain Python."""
    rows = toxic_rows(8, 120)

    def grams(text):
        found = set()
        for n in toxicity.SIZES:
            s = " " + " ".join(text.lower().split()) + " "
            for i in range(len(s) - n + 1):
                if " " not in s[i + 1 : i + n - 1]:
                    h = 0
                    for c in s[i : i + n]:
                        h = (h * 1_000_003 + ord(c)) % 2**64
                    found.add((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> (64 - 18))
        return found

    df = spark.createDataFrame(rows, "key long, text string, label int")
    model = toxicity.fit(df)
    sets = [grams(t) for _, t, _ in rows]
    assert all(sorted(s) == toxicity.ngram_buckets(t).tolist() for s, (_, t, _) in zip(sets, rows))
    n1 = sum(y for *_, y in rows)
    for b, w in list(zip(model.buckets.tolist(), model.weights.tolist()))[:200]:
        one = sum(b in s for s, (*_, y) in zip(sets, rows) if y)
        zero = sum(b in s for s, (*_, y) in zip(sets, rows) if not y)
        ratio = np.log((one + 0.5) / (n1 + 1)) - np.log((zero + 0.5) / (len(rows) - n1 + 1))
        assert w * ratio >= -1e-6 or abs(w) < 0.5  # the scaled weight keeps the ratio's sign, but for small ones
    table = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    want = [1 / (1 + np.exp(-np.clip(model.bias + sum(table.get(b, 0.0) for b in s), -30, 30))) for s in sets]
    got = {r["key"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert [got[k] for k, *_ in rows] == pytest.approx(want)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i % 977}ord" for i in range(3000))
    whole = toxicity.ngram_buckets(text)
    monkeypatch.setattr(toxicity, "PART", 101)
    assert np.array_equal(whole, toxicity.ngram_buckets(text))


def test_toxicity_of_odd_labels(spark):
    rows = spark.createDataFrame([(1, "a b c", 1), (1, "a b c", 1), (2, None, 1), (None, "x", 0), (3, "y", 7)], "doc_id long, text string, toxic int")
    train = toxicity.training_rows(rows.drop("toxic"), rows.select("doc_id", "toxic"))
    assert {r["label"] for r in train.collect()} == {1}
    assert toxicity.score(rows, toxicity.fit(train)).first()["score"] == pytest.approx(0.99)
    assert toxicity.score(rows, toxicity.fit(train.limit(0))).first()["score"] == pytest.approx(0.1)


# ---- the sample that classifiers learn from


def test_repeated_rows_count_once_in_the_sample(spark):
    copies = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("le même texte").alias("text"), F.lit("fr").alias("lang"))
    others = spark.range(300).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("some other text "), "id").alias("text"), F.lit("en").alias("lang"))
    both = copies.union(others)
    for key in range(12):  # whatever its hash, the one row is there once
        rows = both.select(F.when(F.col("lang") == "fr", F.lit(key)).otherwise(F.col("doc_id")).alias("k"), F.col("text").alias("t"), F.col("lang").alias("y"))
        got = Counter(r.y for r in per_class(rows, "y", 400, "k", "t"))
        assert got == {"fr": 1, "en": 300}
    assert langid.fit(both).langs == ["en", "fr"]
    few = Counter(r.y for r in per_class(both.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.col("lang").alias("y")), "y", 100, "k", "t"))
    assert few["fr"] == 1 and 60 < few["en"] < 140


def test_repeated_rows_in_the_quality_fit(spark):
    good = spark.range(200).select((F.col("id") * 3).alias("key"), F.concat(F.lit("a calm river under the stone "), "id").alias("text"), F.lit(1).alias("label"))
    bad = spark.range(5000).select(F.lit(1).alias("key"), F.lit("$$$ NOW %% win &&& " * 3).alias("text"), F.lit(0).alias("label"))
    bad = bad.union(spark.range(5).select(F.col("id").alias("key"), F.concat(F.lit("$$$ BUY && "), "id").alias("text"), F.lit(0).alias("label")))
    model = quality_classifier.fit(good.union(bad), "key", "text", "label")
    scores = quality_classifier.score(good.union(bad).dropDuplicates(["text"]), model).groupBy("label").agg(F.avg("score").alias("s")).collect()
    assert {r["label"]: r["s"] > 0.5 for r in scores} == {0: False, 1: True}


# ---- 9: language ID, from texts to predictions in plain Python


def plain_languages(train, texts):
    """Counts by dictionaries, each left-out row by a fit of its own, decoding by loops."""

    def grams(text):
        counts = Counter()
        s = [ord(c) for c in text.lower()]
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                h = 0
                for c in s[i : i + n]:
                    h = (h * 1_000_003 + c) % 2**64
                counts[(h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 51] += 1
        size = sum(counts.values()) ** 0.5  # the roots' squares sum to the counts
        return {b: n**0.5 / size for b, n in counts.items()}

    dot = lambda a, b: sum(v * b.get(k, 0.0) for k, v in a.items())
    langs = sorted({lang for _, lang in train})
    splits = [s for s in range(1, 2 ** len(langs)) if s % 2 and s != 2 ** len(langs) - 1]
    codes = {lang: [1 if s >> i & 1 else -1 for s in splits] for i, lang in enumerate(langs)}
    rows = [grams(t) for t, _ in train]

    def margins(x, held):
        gram = np.array([[dot(rows[i], rows[j]) for j in held] for i in held]) + 0.3 * np.eye(len(held))
        dual = np.linalg.solve(gram, np.array([codes[train[i][1]] for i in held], float))
        return np.array([dot(x, rows[i]) for i in held]) @ dual

    right = np.zeros(len(splits))
    for i, (_, lang) in enumerate(train):
        out = margins(rows[i], [j for j in range(len(rows)) if j != i])
        right += np.sign(out) == codes[lang]
    trust = np.maximum(right / len(rows) - 0.5, 0.01)
    trust /= trust.sum()
    found = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            found.append(("und", 0.0))
            continue
        m = margins(grams(t), list(range(len(rows))))
        loss = {lang: sum(w * np.log1p(np.exp(-np.clip(4 * a * c, -30, 30))) for w, a, c in zip(trust, m, codes[lang])) for lang in langs}
        shares = {lang: np.exp(-(v - min(loss.values())) * len(splits)) for lang, v in loss.items()}
        best = min(langs, key=loss.get)
        found.append((best, shares[best] / sum(shares.values())))
    return found


def test_language_id_end_to_end(spark):
    rng = random.Random(6)
    words = {"a": "the and of river stone", "b": "der und die fluss stein", "c": "le et la rivière pierre"}
    rows = [(i, " ".join(rng.choice(words["abc"[i % 3]].split()) for _ in range(rng.randint(1, 8))), "abc"[i % 3]) for i in range(60)]
    rows += [(60, None, "a"), (61, "", "b"), (62, "12 !", "c"), (63, "the die le", None), rows[4]]
    df = spark.createDataFrame(rows, DOC)
    train = sorted({(str(lang), str(k), t, lang) for k, t, lang in rows if lang and t and any(c.isalpha() for c in t) and zlib.crc32(str(k).encode()) % 3 != 1})
    want = plain_languages([(t, lang) for *_, t, lang in train], [t for _, t, _ in rows])
    model = langid.fit(df.where(~quality_classifier.held_out()))
    got = langid.identify(df.coalesce(1), model).collect()
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(rows)
    for (key, *_), (lang, share) in zip(rows, want):
        assert by[key][0] == lang and by[key][1] == pytest.approx(share, rel=1e-6)
