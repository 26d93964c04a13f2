"""The training-data operators against brute-force versions, and on awkward rows."""

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from knnspark.llm import fingerprints, license_scan, line_dedup, mixing, ngram_join, piece_codec, quality_knn, quality_rules, suffix_dedup, url_filter
from knnspark.llm.common import flat, mix64, span_hashes
from knnspark.llm.components import components, roots
from knnspark.llm.queries import ALLOW, BLOCK, coded_rows, piece_model_path

SCHEMA = "doc_id bigint, text string, source string, taken string, score string, n_words string, n_lines string, licenses string, ids string, extra string"
WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def make_texts(seed=5):
    """Texts with shared passages, near and exact copies, repeated lines, odd white space and long runs."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(40), "Home | About | Contact"
    texts = []
    for k in range(60):
        text = prose(rng.randint(1, 90))
        if k % 4 == 0:
            text += " " + passage + ". " + prose(5)
        if k % 3 == 0:
            text += "\n" + (line if k % 2 else f"  {line.upper()}\t") + "\n" + prose(8)
        texts.append(text)
    near = prose(120).split()
    for k in range(12):
        copy = list(near)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[3], texts[3].upper(), texts[60], "", None, "a", "a b", "a b", "A  b", "\n\n", " \t ", "x " * 400, "日本語 \u2581 text 😀\x00 end", "word\u00a0glued\u2003here"]
    return texts


def table(spark, texts, first=0):
    rows = [(first + k, t, None if k % 7 == 0 else f"src{k % 4}", *["clash"] * 7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    """With repeated rows and null ids."""
    df = table(spark, make_texts())
    nulls = spark.createDataFrame([(None, "a b", "src1", *["clash"] * 7), (None, None, None, *["clash"] * 7), (None, make_texts()[5], "src1", *["clash"] * 7)], SCHEMA)
    return df.unionByName(df.where("doc_id in (2, 64)")).unionByName(nulls).repartition(5).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 70)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_shingle_components(spark, docs):
    got = ngram_join.join(docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, text in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(x for x in (least.get(find(k)), i) if x is not None) if i is not None or least.get(find(k)) is not None else None
    want = Counter((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))
    assert Counter(tuple(r) for r in got) == want
    assert max(Counter(c for _, n, c in want if n).values()) > 3
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for (i, _, c) in want if i == c}


def test_light_and_heavy_sets_agree(spark, docs, monkeypatch):
    want = sorted(map(str, ngram_join.join(docs).collect()))
    for light in (0, 40):
        monkeypatch.setattr(ngram_join, "boundary", lambda *_, light=light: light)
        assert sorted(map(str, ngram_join.join(docs, list_rows=3).collect())) == want


def test_boundary():
    assert ngram_join.boundary([], np.zeros(4, int), 75) == 0
    thin = ngram_join.boundary([(5, 100), (200, 100)], np.ones(1 << 10, int), 75)
    crowded = np.ones(1 << 10, int)
    crowded[:900] = np.arange(900) ** 2
    assert thin <= ngram_join.boundary([(5, 100), (200, 100)], crowded, 75) and thin < 200


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0
    tree = [(k, rng.randrange(k)) for k in range(1, 60)] + [(k, k - 1) for k in range(101, 150)]
    top = dict(tree)
    for k, _ in tree:
        while top[k] in top:
            top[k] = top[top[k]]
    assert {r["node"]: r["label"] for r in roots(spark.createDataFrame(tree, "node bigint, label bigint")).collect()} == top
    assert roots(spark.createDataFrame([], "node bigint, label bigint")).count() == 0


def test_one_id_with_two_texts(spark):
    """Rows that share an id link by their own texts."""
    texts = {"a": " ".join(f"a{k}" for k in range(40)), "b": " ".join(f"b{k}" for k in range(40))}
    rows = [(7, texts["a"]), (7, texts["b"]), (8, texts["a"] + " x"), (3, texts["b"] + " x"), (9, "other words stand here now")]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter([(7, 36, 7), (7, 36, 3), (8, 37, 7), (3, 37, 3), (9, 1, 9)])


def test_long_lists_are_dealt(spark):
    """A group of near copies far longer than list_rows, with light pairs and heavy lists."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(80):
        copy = list(base)
        copy[rng.randrange(60)] = f"other{k}"
        rows.append((k, " ".join(copy) + " " + " ".join(f"own{k % 3}" for _ in range(k % 2))))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"), list_rows=5).collect()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_quality_counts(docs, labels):
    model = quality_rules.train(docs, labels)
    got = quality_rules.apply(docs, model)
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns)
    for r in got.collect():
        text = r["text"] or ""
        w = words(text)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert 0 <= r["probability"] <= 1 and r["kept"] == (not r["base_failed"] and r["probability"] >= 0.5)


def plain_score(text, model, kind):
    """The sum over families of the mean weight of a text's n-grams, one n-gram after the other."""
    hashed = lambda w: int(span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
    mixed = lambda x: int(mix64(np.array([x % 2**64], dtype=np.uint64))[0])
    w, total = [hashed(x) for x in words(text)], 0.0
    families = []
    for n in kind.words:
        grams = []
        for k in range(len(w) - n + 1):
            h = w[k]
            for x in w[k + 1 : k + n]:
                h = mixed(h * 3 + x)
            grams.append(mixed(h + n))
        families.append(grams)
    for n in kind.chars:
        families.append([mixed(sum(ord(c) << (21 * j) for j, c in enumerate((text or "")[k : k + n])) + (n << 60)) for k in range(len(text or "") - n + 1)])
    for k, grams in enumerate(families):
        if grams:
            total += sum(float(np.float32(model.weights[k * kind.buckets + g % kind.buckets])) for g in grams) / len(grams)
    return total


def test_quality_verdict(docs, labels):
    model = quality_rules.train(docs, labels)
    for r in quality_rules.apply(docs, model).collect():
        p = 1 / (1 + math.exp(-(model.slope * (plain_score(r["text"], model, quality_rules.KIND) + model.bias) + model.shift)))
        assert r["probability"] == pytest.approx(p, abs=1e-6)
        if abs(p - 0.5) > 1e-6:
            assert r["kept"] == (not r["base_failed"] and p >= 0.5)


def test_neighbour_votes(docs, labels):
    """All neighbours sorted by similarity, equal ones in the order of the sample."""
    model = quality_knn.train(docs, labels)
    texts = [r["text"] for r in docs.collect()]
    import pyarrow as pa

    vectors = quality_knn.project(*flat(pa.array(texts, pa.string())), model)
    want = []
    for v in vectors:
        near = (model.vectors @ v).tolist()
        order = sorted(range(len(near)), key=lambda k: (-near[k], k))[: model.k]
        weight = [max(0.0, near[k]) ** model.power for k in order]
        total = sum(weight)
        want.append((sum(x * model.labels[k] for x, k in zip(weight, order, strict=True)) + 1e-6 * model.prior) / (total + 1e-6) if total > 1e-9 else model.prior)
    got = quality_knn.apply(docs, model).collect()
    assert sorted(r["score"] for r in got) == pytest.approx(sorted(want), abs=1e-4)
    two = quality_knn.Neighbours(model.projection, np.ones((4, 2), np.float32) / np.float32(2**0.5), np.array([1, 0, 0, 0], np.float32), 0.5, 2)
    assert quality_knn.vote(np.ones((1, 2), np.float32), two)[0] == pytest.approx(0.5, abs=1e-3)  # of four equal ones the first two vote


def test_quality_models_learn(spark):
    rng = random.Random(9)
    good = [" ".join(rng.choice(["the", "river", "runs", "slowly", "past", "old", "trees"]) for _ in range(80)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "click###", "now%%%"]) for _ in range(80)) for _ in range(100)] + ["spam " * 80] * 50
    rng.shuffle(bad)
    texts = [x for pair in zip(good, bad, strict=True) for x in pair]
    df = table(spark, texts)
    marks = spark.createDataFrame([(k, 1 - k % 2) for k in range(200)], "doc_id bigint, quality int")
    for got in (
        {r["doc_id"]: r["probability"] for r in quality_rules.apply(df, quality_rules.train(df, marks)).collect()},
        {r["doc_id"]: r["score"] for r in quality_knn.apply(df, quality_knn.train(df, marks)).collect()},
    ):
        assert all((p >= 0.5) == (k % 2 == 0) for k, p in got.items() if k >= 200)


def test_quality_without_labels(spark, docs, labels):
    none = labels.where("false")
    assert {r["probability"] for r in quality_rules.apply(docs, quality_rules.train(docs, none)).collect()} == {0.5}
    assert {r["score"] for r in quality_knn.apply(docs, quality_knn.train(docs, none)).collect()} == {0.5}
    got = quality_knn.apply(docs, quality_knn.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)


def test_line_dedup(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda x: x.strip(WHITE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or found[key(x)] < 10]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert any(n for (_, _, n, _) in want)
    for batches, most in ((1, 1000), (4, 1000), (4, 1), (2, 0)):
        got = line_dedup.apply(docs, batches=batches, most_keys=max(1, most)) if most else line_dedup.apply(docs.repartition(2), batches=batches, most_keys=2)
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == want


def test_line_runs_in_batches(spark):
    runs = line_dedup.LineRuns(spark, least=3, fanout=2)
    for k in range(5):
        runs.absorb(spark.createDataFrame([("seen\nonly " + str(k),), ("twice\ntwice" if k < 2 else None,)], "text string"))
        assert runs.listed().count() == (1 if k >= 2 else 0)
    assert all(len(level) < 2 for level in runs.levels)


def test_line_key_sets():
    keys = line_dedup.Keys(np.array([5, 5, 5, 9]), np.array([1, 2, 3, 4]))
    assert keys.has(np.array([5, 5, 5, 9, 1, 10]), np.array([3, 4, 1, 4, 1, 4])).tolist() == [True, False, True, True, False, False]
    none = line_dedup.Keys(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert none.has(np.array([1]), np.array([1])).tolist() == [False]


def test_mixing(spark, docs):
    got = mixing.mix(docs, bucket_rows=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), bucket_rows=8).collect()))
    size = Counter()
    for r in docs.collect():
        size[r["source"]] += len(words(r["text"]))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(size)
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= full
    source_of = {r["doc_id"]: r["source"] for r in docs.where("doc_id is not null").collect()}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1
        if r["doc_id"] is not None:
            s = source_of[r["doc_id"]]
            assert r["target"] == pytest.approx(target[s]) and r["source_size"] == size[s]
        taken[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(t - n) <= 1 for (t, _), n in taken.items())
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    train = mixing.train_order(docs, bucket_rows=8)
    assert train.columns == docs.columns
    times = Counter(r["doc_id"] for r in train.collect())
    assert all(times[r["doc_id"]] == -(-r["taken"] // r["size"]) for r in got if r["size"] and r["doc_id"] not in (None, 2, 64))


def test_train_order_of_repeated_rows(spark):
    """Each of two equal rows goes with its own takes."""
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, "a", "x"), (1, text, "a", "y"), (2, "other words", "a", "z"), (None, text, None, None), (None, text, None, None)], "doc_id bigint, text string, source string, take string")
    for share in (0.2, 0.6, 1.5, 2.0):
        got, taken = mixing.train_order(df, share=share).collect(), mixing.mix(df, share=share).collect()
        want = Counter(r["doc_id"] for r in taken for _ in range(-(-r["taken"] // r["size"])))
        assert Counter(r["doc_id"] for r in got) == want


def test_suffix_dedup(spark, docs, monkeypatch):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    first = {}
    for i, t in rows:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], 1 << 62), (1 << 61) if i is None else i)
    want = Counter()
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < ((1 << 61) if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want[i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    assert sum(n for (_, _, n, _, _) in want) > 1000
    real = suffix_dedup.text_hash
    for frequent, clash in ((2000, False), (2, False), (2000, True)):
        if clash:  # texts share names
            monkeypatch.setattr(suffix_dedup, "text_hash", lambda seed, text: F.pmod(real(seed, text), F.lit(5)) if seed < 2 else real(seed, text))
        got = suffix_dedup.dedup(docs, frequent=frequent).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    with pytest.raises(ValueError):
        suffix_dedup.dedup(docs, length=20)


def test_suffix_dedup_disk(spark, docs, monkeypatch):
    """A task's runs make one blob a part however many slices it reads, and anchors are gone once the windows are settled."""
    rng = random.Random(3)
    at = list(range(0, 1_400_000, 1000))
    texts = ["".join(rng.choices("abcdefgh ", k=1_400_050)) for _ in range(4)]
    found = spark.createDataFrame([(k, k, t, at, [10] * len(at)) for k, t in enumerate(texts)], "r bigint, id bigint, text string, a array<int>, dm array<int>").coalesce(1)
    assert max(r["count"] for r in suffix_dedup._window_rows(found, 50, 40, None).groupBy("part").count().collect()) == 1
    names = lambda: sorted(p.split("/")[-1] for _, p in made)
    made, real = [], suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: made.append((out := real(df, name), out.written_to)) or out)
    left = suffix_dedup.dedup(docs)
    gone = {p.split("/")[-1] for t, p in made if not os.path.exists(p.removeprefix("file:"))}
    assert names() == ["anchors", "per_row", "spans", "texts"] and gone == {"anchors", "per_row"}
    # Many flushes a task find what one finds.
    want = Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in left.collect())
    monkeypatch.setattr(suffix_dedup, "HOLD", 1)
    assert Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.dedup(docs).collect()) == want


@pytest.mark.parametrize("length", [32, 100, 270, 271, 400, 600])
def test_suffix_dedup_of_long_strings(spark, length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(6000)
    texts = [word(50) + passage + word(50), word(80) + passage[300:4300] + word(900) + passage[100 : 100 + length], word(3000), passage[5000 : 4999 + length]]
    df = table(spark, texts)
    first, want = {}, {}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first.setdefault(t[k : k + length], i) < i:
                gone[k : k + length] = b"\1" * length
        want[i] = (sum(gone), "".join(c for c, g in zip(t, gone, strict=True) if not g))
    assert want[1][0] >= 4000 + length and not want[3][0]
    for frequent in (2000, 2):
        got = suffix_dedup.dedup(df, length=length, frequent=frequent).collect()
        assert {r["doc_id"]: (r["n_removed"], bytes(r["kept"]).decode()) for r in got} == want
    with pytest.raises(ValueError):
        suffix_dedup.dedup(df, length=suffix_dedup.LONGEST + 1)


def test_frequent_anchor_bitmap(spark):
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    words = suffix_dedup._bitmap(spark.createDataFrame([(int(x),) for x in hashes.view(np.int64)], "r bigint"))
    assert suffix_dedup._marked(words, hashes).all()
    assert suffix_dedup._marked(words, rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 0.005
    assert suffix_dedup._bitmap(spark.createDataFrame([], "r bigint")) is None


def test_window_buckets():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 2, 3000).astype(np.uint8)
    starts = np.arange(0, 2900)
    for length in (8, 12, 16, 33, 50, 64):
        ids = suffix_dedup.window_buckets(buf, starts, length)
        named = {}
        for s, i in zip(starts.tolist(), ids.tolist(), strict=True):
            assert named.setdefault(bytes(buf[s : s + length]), i) == i
        assert len(set(named.values())) == len(named)


def test_piece_codec(docs):
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    model = piece_codec.read_model(piece_model_path())
    texts = [r["text"] or "" for r in docs.collect()]
    got = piece_codec.decode(piece_codec.encode(docs, model, cache_words=50), model).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids"] == real.encode(r["text"] or "") and r["decoded"] == real.decode(r["ids"])
    want = Counter((r["doc_id"], len(r["ids"]), hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest(), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in got)
    assert Counter(tuple(r) for r in coded_rows(docs, model).collect()) == want
    rng = random.Random(3)
    odd = ["".join(rng.choice("aeiou  ===--***\u2581\n日é12") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    ids = [np.concatenate([np.zeros(0, int), *model.merge_words(model.words_of(t))]).tolist() for t in odd]
    assert ids == real.encode(odd)


def test_url_filter(spark):
    urls = ["https://A.Example.org/es/x?q", "http://example.org/en/1", "http://example.org/en/12#t", "http://xexample.org/es/", "http://shop.com/fr/", "http://shop.com/de/1", "http://shop.com", "http://org/", "http://org", "no scheme", "", None, "ftp://x.net/a?b", "://", "http://com/fr/?x", "x://a.b://org/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id bigint, url string, verdict string")
    pages = pages.unionByName(pages)
    rules = [(h, p, "allow") for h, p in ALLOW] + [(h, p, "block") for h, p in BLOCK]
    want = {}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u[u.index("://") + 3 :]
            host = re.match(r"[^/?#]*", rest)[0].lower()
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[k] = (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")
    got = url_filter.judge(pages, ALLOW, BLOCK)
    assert got.count() == 2 * len(urls)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == want
    joined = url_filter.judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in joined.collect()} == want
    assert {r["verdict"] for r in url_filter.judge(pages, [], []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("substr(key, 2) % 7 = 0")
    c = url_filter.build(listed, universe, bits_per_key=2)
    assert len(c.levels) > 2
    assert universe.where(c.contains(F.col("key"))).exceptAll(listed).count() == 0 and universe.where(c.contains(F.col("key"))).count() == listed.count()
    few = universe.where("key in ('k1', 'k2', 'k3')")
    assert universe.where(url_filter.build(few, universe, most_keys=10, bits_per_key=1).contains(F.col("key"))).count() == 3
    with pytest.raises(ValueError):
        url_filter.build(listed, universe, most_keys=10)


def test_urls_long_and_odd(spark):
    long_host = ".".join(["a"] * 12000) + ".com"
    urls = [f"https://{long_host}/fr/x", "https://x.org/" + "p" * 100_000, "https://é.ÉX.org/ü", None, "https://x.ÉX.org/ü1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = [("com", "/fr/"), ("ÉX.org", "/ü")], [("org", "/p")]
    want = {0: ("com/fr/", "allow"), 1: ("org/p", "block"), 2: ("Éx.org/ü", "allow"), 3: (None, "allow"), 4: ("Éx.org/ü", "allow")}
    for most in (200_000, 1):  # beyond the limit by joins
        got = url_filter.judge(pages, *rules, most_keys=most)
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()} == want
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.judge_by_join(pages, none).collect()} == {"allow"}
    assert url_filter.judge_by_join(pages.where("false"), none).count() == 0


def pieces(text):
    """The paragraphs that a digest is made of."""
    out = set()
    for line in (text or "").split("\n"):
        out |= {p for p in (regex.split(fingerprints.LONG_CUT, line) if len(line) > fingerprints.LONG else [line]) if p.strip(WHITE)}
    return out


def spark_hash(raw, seed=42):
    return xxhash.xxh64(raw, seed=seed).intdigest()


def peeled(cells):
    """Signed contents of a block's cells, or None."""
    cells, m, found, one = list(cells), len(cells) // 3, set(), fingerprints.ONE
    while True:
        pure = {c for c in cells if one <= abs(c) < 2 * one and spark_hash(struct.pack("<q", (abs(c) - one) >> 17)) % (1 << 17) == abs(c) % (1 << 17)}
        if not pure:
            return None if any(cells) else found
        for c in pure:
            found.add(c)
            for t in range(3):
                cells[t * m + ((abs(c) - one) >> (17 + 13 * t)) % m] -= c


def near_of(printed_a, printed_b):
    """Likeness from two printed fingerprints alone."""
    read = lambda p: [[int(v, 16) if v else 0 for v in b.split(",")] if b else [] for b in p.split(":")[1].split(";")]
    one, m = fingerprints.ONE, fingerprints.TABLE_CELLS
    sides = [{c - one for block in read(p) if block for c in peeled(block)} for p in (printed_a, printed_b)]
    assert [len(s) for s in sides] == [int(p.split(":")[0]) for p in (printed_a, printed_b)]
    blocks = max(len(read(p)) for p in (printed_a, printed_b))
    place = lambda x: spark_hash(struct.pack("<i", 2), spark_hash(struct.pack("<q", x))) % blocks

    def cells(keys, size):
        out = [0] * (3 * size)
        for x in keys:
            for t in range(3):
                out[t * size + (x >> (17 + 13 * t)) % size] += x + one
        return out

    differ = 0
    for b in range(blocks):
        own = [{x for x in side if place(x) == b} for side in sides]
        differ += next(len(f) for f in (peeled([x - y for x, y in zip(*(cells(k, size) for k in own), strict=True)]) for size in m) if f is not None)
    n = sum(map(len, sides))
    return (n - differ) / (n + differ) if n else 1.0


def test_fingerprints(spark, docs):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(900)]
    long = "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60))) + rng.choice(".!") for _ in range(400)) + " a!! " * 300
    extra = spark.createDataFrame([(500, long, "s"), (501, long[: len(long) // 3] + "\n \t\nend", "s"), (1 << 62, "日。本。" * 90 + "x", "s"), ((1 << 63) - 1, "last\nlast", "s"), (-5, "low", "s")], "doc_id bigint, text string, source string")
    rows_df = docs.select("doc_id", "text", "source").unionByName(extra)
    signed = lambda t: (spark_hash(t.encode()) + 2**63) % 2**64 - 2**63
    rows = sorted(((r["doc_id"], r["text"] or "") for r in rows_df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1]), x[1]))
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want, printed = Counter(), {}
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        want[i, len(t), edited, round(near(pieces(t), pieces(edited)), 9), round(near(pieces(t), pieces(other)), 9)] += 1
    got = fingerprints.compare(rows_df).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    text_of = dict(rows)
    for r in got:
        assert near_of(r["fingerprint"], r["edited_fingerprint"]) == pytest.approx(r["near_edited"])
        if r["doc_id"] is not None and r["doc_id"] not in (2, 64):
            assert printed.setdefault(text_of[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    for k, (i, _) in enumerate(rows):
        if i is not None and rows[(k + 1) % len(rows)][0] is not None and i not in (2, 64) and rows[(k + 1) % len(rows)][0] not in (2, 64):
            own = next(r for r in got if r["doc_id"] == i)
            assert near_of(own["fingerprint"], printed[rows[(k + 1) % len(rows)][1]]) == pytest.approx(own["near_next"])


def test_next_rows_across_ranges(spark):
    """Many rows without an id, many with one id, others spread: each row once, in order, through ranges of 4 rows."""
    ids = [None] * 300 + [7] * 300 + list(range(-500, 4000, 9))
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = fingerprints.with_next(df, "doc_id", "text", 4)
    assert found.select("_range").distinct().count() > 150
    nxt = {r["_text"]: r["_next"] for r in found.where("NOT _halo").collect()}
    signed = lambda t: (spark_hash(t.encode()) + 2**63) % 2**64 - 2**63
    order = [t for _, t in sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), signed(x[1])))]
    assert nxt == dict(zip(order, order[1:] + order[:1], strict=True))


def test_peeling_recovers_digests(spark):
    key = lambda k: (h := random.Random(k).getrandbits(39)) * (1 << 17) + spark_hash(struct.pack("<q", h)) % (1 << 17)
    every = [key(k) for k in range(75)]
    a, b = every[:60], every[40:]
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    gap = lambda m: f"zip_with({fingerprints.cells_sql('a', m)}, {fingerprints.cells_sql('b', m)}, (x, y) -> x - y)"
    row = df.select(F.expr(fingerprints.peel_sql(gap("8"), "8")).alias("tight"), F.expr(fingerprints.peel_sql(gap("64"), "64")).alias("roomy")).head()
    one = fingerprints.ONE
    assert row["tight"] is None and set(row["roomy"]) == {k + one for k in every[:40]} | {-k - one for k in every[60:]}
    # Blocks in which the first size fails, whether of one text or of two.
    same = [x for x in (key(k) for k in range(40000)) if all((x >> (17 + 13 * t)) % 8 == 0 for t in range(3))][:3]
    blocks = f"array(array({same[0]}L, {same[1]}L))"
    made = df.select(F.expr(fingerprints.sketch_sql(blocks)).alias("s"), F.expr(fingerprints.difference_sql(f"array(array({same[0]}L))", f"array(array({same[1]}L, {same[2]}L))", f"array({fingerprints.cells_sql(f'array({same[0]}L)', '8')})", fingerprints.sketch_sql(f"array(array({same[1]}L, {same[2]}L))"))).alias("d")).head()
    assert len(same) == 3 and len(made["s"][0]) > 24 and made["d"] == 3


def test_licenses(spark, docs):
    notices = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    texts = [f"{make_texts()[k] or ''}\n{n}\nmore words here" for k, n in enumerate(notices)] + ["You need a license to drive.", "the mit version of the public work"]
    df = table(spark, texts, 1000).unionByName(docs)
    model = license_scan.train(df)
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(df, model).collect()}
    assert [got[1000 + k] for k in range(4)] == [[f] for f in notices.values()]
    assert all(not v for k, v in got.items() if k is None or k < 1000 or k > 1003)


def test_licenses_in_wrapped_and_dual_notices(spark, docs):
    gnu = "This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU {}General Public License as published by\n the Free Software Foundation, either version {} of the License, or\n (at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one."
    cases = [
        (mit, ["MIT"]), (bsd, ["BSD-3-Clause"]), (isc, ["ISC"]), (mpl, ["MPL-2.0"]), (gnu.format("", 3), ["GPL-3.0"]), (gnu.format("", 2), ["GPL-2.0"]),
        (gnu.format("Lesser ", 3), ["LGPL-3.0"]), (gnu.format("Affero ", 3), ["AGPL-3.0"]), ("/*\n * " + mit.replace("\n", "\r\n * ") + "\n */", ["MIT"]), ("// " + gnu.format("", 3).replace("\n", "\n//"), ["GPL-3.0"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
        ("Licensed under the MIT License and the\nGNU General Public License, version 2.", ["GPL-2.0", "MIT"]), (" ".join(make_texts()[k] or "" for k in range(9)).replace("\n", " ") + " " + mit.replace("\n", " ") + " " + (make_texts()[1] or ""), ["MIT"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]), ("Released\n\nunder the MIT\n\nLicense", []), ("a MIT student and an Apache pilot met under the bridge", []),
    ]
    df = table(spark, [t for t, _ in cases], 1000).unionByName(docs)
    got = {r["doc_id"]: r for r in license_scan.scan(df, license_scan.train(df)).collect()}
    assert [got[1000 + k]["licenses"] for k in range(len(cases))] == [f for _, f in cases]
    assert [got[1000 + k]["n_paragraphs"] for k in (0, 8, len(cases) - 2)] == [1, 1, 3] and got[1008]["n_notices"] == 1 and got[1010]["n_notices"] == 2
    assert all(not r["licenses"] for k, r in got.items() if k is None or k < 1000)


def test_licence_versions_and_negations(spark, docs):
    notice = "This work is licensed under the {}."
    right = {"Apache License, Version 2.0": "Apache-2.0", "Mozilla Public License 2.0": "MPL-2.0", "GNU Lesser General Public License, version 3": "LGPL-3.0", "GNU Affero General Public License version 3": "AGPL-3.0", "GPLv3": "GPL-3.0", "MIT License": "MIT", "GNU General\nPublic License version 3": "GPL-3.0"}
    wrong = ["Apache License Version 1.1", "Mozilla Public License 1.1", "GNU Lesser General Public License version 2.1", "GNU Affero General Public License version 1", "GNU General Public License version 1", "Creative Commons Attribution 3.0 International License"]
    texts = [notice.format(x) for x in right] + [notice.format(x) for x in wrong] + [f"This work is not licensed under the {x}." for x in right] + ["SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-3.0-only", None, "", " \n\t"]
    df = table(spark, texts, 1000).unionByName(docs).unionByName(table(spark, texts[:2], 1000))
    got = {}
    for r in license_scan.scan(df, license_scan.train(docs)).collect():
        assert got.setdefault(r["doc_id"], r["licenses"]) == r["licenses"] or r["doc_id"] is None
    n = len(right)
    assert [got[1000 + k] for k in range(n)] == [[f] for f in right.values()]
    assert not any(got[1000 + k] for k in range(n, 2 * n + len(wrong)))
    assert [got[1000 + k] for k in range(2 * n + len(wrong), len(texts))] == [["MIT"], ["GPL-3.0"], [], [], []]


def test_licence_confusion(spark, docs):
    """Notices in words that the model was not trained on, between other prose: a confusion matrix without off-diagonal entries."""
    frames = ["{}", "All files here are ours.\n{}\nSee the folder for more.", "# {}", "copyright 2020 the authors, all rights reserved {} and some more words", "* {}\n* thanks"]
    cases = [(f, frame.format(t)) for f, ts in license_scan.TEMPLATES.items() for t in ts for frame in frames]
    prose = [x for x in make_texts(17) if x]
    df = table(spark, [t for _, t in cases] + prose, 1000)
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(df, license_scan.train(docs)).collect()}
    matrix = Counter((f, tuple(got[1000 + k])) for k, (f, _) in enumerate(cases))
    right = sum(n for (f, g), n in matrix.items() if g == (f,))
    assert all(g in ((f,), ()) for f, g in matrix) and right >= 0.97 * len(cases), matrix
    assert not any(got[1000 + len(cases) + k] for k in range(len(prose)))


def test_empty_tables(spark, docs, labels):
    none = docs.where("false")
    rules = quality_rules.train(none, labels)
    model = piece_codec.read_model(piece_model_path())
    for df in (
        ngram_join.join(none), ngram_join.representatives(none), quality_rules.apply(none, rules), quality_knn.apply(none, quality_knn.train(none, labels)), line_dedup.apply(none), mixing.mix(none),
        mixing.train_order(none), suffix_dedup.dedup(none), coded_rows(none, model), fingerprints.compare(none), license_scan.scan(none, license_scan.train(none)),
        url_filter.judge(spark.createDataFrame([], "page_id bigint, url string"), ALLOW, BLOCK),
    ):
        assert df.count() == 0


def test_long_text(spark):
    long = "\n".join(f"line {k} of a very long text with some words." for k in range(20000))
    df = spark.createDataFrame([(1, long, "s"), (2, "short text. " + long[:300], "s")], "doc_id bigint, text string, source string")
    assert {r["component_id"] for r in ngram_join.join(df).collect()} == {1, 2}
    assert [r["n_removed"] > 0 for r in suffix_dedup.dedup(df).orderBy("doc_id").collect()] == [False, True]
    assert sorted(r["n_lines"] for r in line_dedup.apply(df).collect())[-1] == 20000
    assert mixing.mix(df).count() == 2
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    assert sorted(r["n_words"] for r in quality_rules.apply(df, quality_rules.train(df, marks)).collect())[-1] == 200000
    assert all(0 <= r["score"] <= 1 for r in quality_knn.apply(df, quality_knn.train(df, marks)).collect())
    notice = df.withColumn("text", F.concat("text", F.lit("\nReleased under the MIT License.")))
    assert [r["licenses"] for r in license_scan.scan(notice, license_scan.train(df)).collect()] == [["MIT"], ["MIT"]]
    near = {r["doc_id"]: r["near_edited"] for r in fingerprints.compare(df).collect()}
    assert 0.3 < near[1] < 1
    model = piece_codec.read_model(piece_model_path())
    back = {r["doc_id"]: r["decoded"] for r in piece_codec.transcode(df, model).collect()}
    assert back[1] == long


def test_held_out_split():
    assert sum(zlib.crc32(str(k).encode()) % 3 == 1 for k in range(3000)) in range(900, 1100)
