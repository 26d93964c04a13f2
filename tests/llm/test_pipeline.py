"""The corpus pipeline against a plain version of its stages; only the quality verdict comes from the fitted model."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from test_llm import make_texts, words

from knnspark.llm import quality_rules
from knnspark.llm.queries import piece_model_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = defaultdict(set)
    for i, text, _ in rows:
        for line in text.split("\n"):
            seen[key(line)].add(i)
    listed = {k for k, ids in seen.items() if k and len(ids) >= 10}
    return [(i, "\n".join(x for x in text.split("\n") if key(x) not in listed), s) for i, text, s in rows]


def least_of_near(rows):
    sets = []
    for _, text, _ in rows:
        w = [x.translate(LOWER) for x in words(text)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for g, (i, _, _) in zip(group, rows, strict=True):
        least[g] = min(i, least.get(g, i))
    return [r for g, r in zip(group, rows, strict=True) if r[0] == least[g]]


def takes(rows):
    by = defaultdict(list)
    for i, text, s in rows:
        by[s].append((hashlib.md5(str(i).encode()).hexdigest(), len(words(text)), i))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, _ in by[s]) for s in names}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(size.values()), set(names), {}
    while free:  # sources that reach twice their size stop there, the rest share on
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2.0 * size[s]}
        target |= {s: 2.0 * size[s] if full else level * weight[s] for s in full or free}
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    out = Counter()
    for s in names:
        start = 0
        for _, n, i in sorted(by[s]):
            out[i] = sum(min(n, int(target[s]) - k * size[s] - start) > 0 for k in (0, 1)) if n else 0
            start += n
    return out


def test_pipeline(spark, tmp_path):
    import sentencepiece

    texts = make_texts()
    rows = [(k, t, "en", None if k % 7 == 0 else f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(len(texts))], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.apply(docs, quality_rules.train(docs, labels)).collect()}

    kept = [(i, t or "", s) for i, t, _, s, _ in rows if verdict[i]]
    cut = drop_lines(kept)
    single = least_of_near(cut)
    times = takes(single)
    assert 20 < len(single) < len(cut) == len(kept) < len(rows) and cut != kept and set(times.values()) >= {1, 2}
    real = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, t, _ in single:
        ids = real.encode(t)
        want[i, len(ids), digest(",".join(map(str, ids))), digest(real.decode(ids))] = times[i]
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == +want
