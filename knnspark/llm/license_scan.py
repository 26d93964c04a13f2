"""License scans: a trained span classifier with a calibrated unknown class, confirmed by templates.

A paragraph is a run of lines up to a blank one (comment marks count as blank). Its lines and its sliding
windows of WIDTHS words go through a sparse model over hashed word n-grams (1 to 3): a logistic
regression, Platt-calibrated on rows it has not seen, tells licence notices from anything else (the
unknown class). What it lets through names every family of which a template is found: enough of
the template's word pairs, close together, among them those with its names and version numbers and all of those that
tell it from another family's, and no negation right before. A list of licence names joined by "or" or "and" names all of them.
The model is trained on the templates below with seeded edits; unknown are spans of a bounded sample of documents,
and the templates with other versions or a negation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, slices, word_spans
from .features import Linear, NGrams, calibrate, features, fit_logistic

KIND = NGrams(words=(1, 2, 3), chars=(), buckets=1 << 13)

# Usual notices of the licence families.
_GNU = "under the terms of the GNU {} License as published by the Free Software Foundation either version {}"
TEMPLATES = {
    "AGPL-3.0": ("licensed under the GNU Affero General Public License version 3", "released under the AGPL-3.0", _GNU.format("Affero General Public", 3)),
    "Apache-2.0": ("licensed under the Apache License Version 2.0", "licensed under the Apache License 2.0", "licensed under the Apache 2.0 License"),
    "BSD-2-Clause": ("released under the BSD 2-Clause License",),
    "BSD-3-Clause": ("released under the BSD 3-Clause License", "redistribution and use in source and binary forms with or without modification are permitted"),
    "CC-BY-4.0": ("licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "licensed under the Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal public domain dedication"),
    "GPL-2.0": ("licensed under the GNU General Public License version 2", _GNU.format("General Public", 2)),
    "GPL-3.0": ("licensed under the GNU General Public License version 3", _GNU.format("General Public", 3)),
    "ISC": ("released under the ISC License", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted"),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License version 3", _GNU.format("Lesser General Public", 3)),
    "MIT": ("released under the MIT License", "licensed under the MIT License", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "MPL-2.0": ("subject to the terms of the Mozilla Public License version 2.0", "subject to the terms of the Mozilla Public License v 2.0", "licensed under the Mozilla Public License 2.0"),
}
_SHORT = {"AGPL-3.0": "AGPLv3", "GPL-2.0": "GPLv2", "GPL-3.0": "GPLv3", "LGPL-3.0": "LGPLv3"}
TEMPLATES |= {f: (*TEMPLATES[f], f"licensed under the {s}", f"released under the {s}", f"distributed under the {s}", f"License {s}") for f, s in _SHORT.items()}
TEMPLATES = {f: (*ts, *(f"SPDX-License-Identifier {f}{end}" for end in (("", "-only", "-or-later") if "GPL" in f else ("",)))) for f, ts in TEMPLATES.items()}
#: Names in lists such as "under either the MIT License or the Apache License, Version 2.0".
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License version 3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "Apache-2.0": ("Apache License Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause", "BSD-3-Clause"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"),
    "GPL-2.0": ("GNU General Public License version 2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"),
    "GPL-3.0": ("GNU General Public License version 3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "ISC": ("ISC License", "ISC"),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT License", "MIT"),
    "MPL-2.0": ("Mozilla Public License version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
}
NAMES |= {f: (*NAMES[f], s, s.replace("v", " v")) for f, s in _SHORT.items()}
#: Versions that no family here has.
OTHER_VERSIONS = ("1", "1.0", "1.1", "1.2", "2.1", "2.5", "5", "9.0")
#: Words that turn a notice round, up to three words before it.
NEGATIONS = {"not", "never", "no", "nor", "neither", "isn't", "cannot", "without", "unlike"}
LISTED = {"licensed", "dual-licensed", "released", "distributed", "available", "license", "terms", "spdx-license-identifier"}
JOINED = {"or", "and", "and/or"}
#: Words of the windows, half overlapping: a template of up to half a window and one word is whole in one of them.
WIDTHS = (8, 16, 32, 64)
#: Words read on either side of what the model lets through.
AROUND = 16
FAMILIES = tuple(TEMPLATES)
OPENINGS = ("", "this work is", "this software is", "the code in this repository is", "all files are")

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[ord(c) for c in ",;:()\"'<>*#%$&!?|"]] = 32


def plain(buf: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
    """Lower case, without punctuation; a dot stays inside a word, slashes and dashes beside a letter or digit."""
    out = _PLAIN[buf]
    ends = np.ones(len(out), dtype=bool)
    ends[:-1] = (out[1:] == 32) | (out[1:] == 10) | (out[1:] == 13)
    if offsets is not None:
        ends[offsets[offsets > 0] - 1] = True
    out[(buf == 46) & ends] = 32
    ink = ((out >= 48) & (out < 58)) | ((out >= 97) & (out < 123)) | (out >= 128)
    beside = np.zeros(len(out) + 2, dtype=bool)
    beside[:-2] |= ink
    beside[2:] |= ink
    out[((buf == 45) | (buf == 47)) & ~beside[1:-1]] = 32
    return out


def _lines(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([offsets, np.flatnonzero(buf == 10) + 1]))


def paragraphs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all paragraphs of plain() bytes, and the row of each; every row of some length has one at least.

    A paragraph starts with its row, or with the first line of ink after blank ones; blank lines belong to the one before.
    """
    at = _lines(buf, offsets)
    starts = at[:-1]
    row = np.searchsorted(offsets, starts, side="right") - 1
    ink = np.concatenate([[0], np.cumsum((buf != 32) & ((buf < 9) | (buf > 13)))])
    has, head = ink[at[1:]] > ink[starts], np.concatenate([[True], row[1:] != row[:-1]])
    after = np.concatenate([[False], ~has[:-1]])
    new = head | (has & after & (ink[starts] > ink[offsets[row]]))
    return np.append(starts[new], at[-1]), row[new]


def spans(word_par: np.ndarray, word_line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of every line and of every window; all are inside one paragraph."""
    def runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        return first, np.append(first[1:], len(of))

    a, b = runs(word_line)
    firsts, lasts = [a], [b]
    a, b = runs(word_par)
    for k, width in enumerate(WIDTHS):
        wide = (b - a) > (WIDTHS[k - 1] if k else 0)
        first, end, step = a[wide], b[wide], width // 2
        n = 1 + (np.maximum(end - first - width, 0) + step - 1) // step
        which = np.repeat(np.arange(len(n)), n)
        at = first[which] + step * (np.arange(len(which)) - (np.cumsum(n) - n)[which])
        firsts.append(at)
        lasts.append(np.minimum(at + width, end[which]))
    return np.concatenate(firsts), np.concatenate(lasts)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


def _words(text: str) -> list[str]:
    return plain(np.frombuffer(text.encode(), dtype=np.uint8)).tobytes().decode(errors="replace").split()


def _pairs(text: str) -> list[tuple[str, str]]:
    words = _words(text)
    return list(zip(words[:-1], words[1:], strict=True))


_PAIRS = [(f, _pairs(t)) for f, ts in TEMPLATES.items() for t in ts]
_PAIR_AT: dict[tuple[str, str], list[tuple[int, int]]] = {}
for _t, (_, _want) in enumerate(_PAIRS):
    for _j, _p in enumerate(_want):
        _PAIR_AT.setdefault(_p, []).append((_t, _j))
#: Places of the pairs that a template of another family lacks which has three quarters of this one's pairs: none may be missing.
_OWN = [
    {j for other, have in _PAIRS if other != f and len(set(want) & set(have)) >= 0.75 * len(set(want)) for j, p in enumerate(want) if p not in have}
    for f, want in _PAIRS
]
_NAMED = {tuple(_words(n)): f for f, ns in NAMES.items() for n in ns}
_NAME_SIZES = sorted({len(n) for n in _NAMED}, reverse=True)


def _special(word: str) -> bool:
    """Whether a word has a figure or belongs to a licence's name."""
    return any(c.isdigit() for c in word) or word in _NAME_WORDS


_NAME_WORDS = {w for n in _NAMED for w in n} - {"license", "public", "general", "version", "v"}
#: Per template: groups of pairs of which one must be there, for each word of _special(); a figure's own is that with the word before it.
_MUST = []
for _, _want in _PAIRS:
    _w = [_want[0][0], *(b for _, b in _want)]
    _MUST.append([{j - 1} if j and any(c.isdigit() for c in _w[j]) else {j - 1, j} & set(range(len(_want))) for j in range(len(_w)) if _special(_w[j])])


def _denied(words: list[str], at: int) -> bool:
    return bool(NEGATIONS & set(words[max(0, at - 3) : max(0, at)]))


def _listed(words: list[str]) -> set[str]:
    """Families of names that stand in a list after a word of LISTED."""
    found, k = [], 0
    while k < len(words):
        size = next((n for n in _NAME_SIZES if tuple(words[k : k + n]) in _NAMED), 0)
        if size:
            found.append((k, k + size, _NAMED[tuple(words[k : k + size])]))
        k += size or 1
    out: set[str] = set()
    chain: list[tuple[int, int, str]] = []
    for name in [*found, None]:
        gap = words[chain[-1][1] : name[0]] if chain and name else []
        if chain and (name is None or len(gap) > 6 or "not" in gap or not JOINED & set(gap)):
            if len({f for _, _, f in chain}) > 1 and LISTED & set(before := words[max(0, chain[0][0] - 6) : chain[0][0]]) and not NEGATIONS & set(before):
                out |= {f for _, _, f in chain}
            chain = []
        if name:
            chain.append(name)
    return out


def confirmed(words: list[str], template_at: float) -> set[str]:
    """Families with a template of which the words have template_at of the pairs, in place up to a few words more or less."""
    hits: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(zip(words[:-1], words[1:], strict=True)):
        for t, j in _PAIR_AT.get(p, ()):
            hits.setdefault(t, []).append((i - j, j))
    out = _listed(words)
    for t, at in hits.items():
        family, want = _PAIRS[t]
        if family in out or len({j for _, j in at}) < template_at * len(want):
            continue
        drift = max(3, len(want) // 5)
        for low in {d for d, _ in at}:
            have = {j for d, j in at if low <= d <= low + drift}
            if len(have) >= template_at * len(want) and _OWN[t] <= have and all(have & one for one in _MUST[t]) and not _denied(words, low):
                out.add(family)
                break
    return out


@dataclass
class LicenceModel:
    known: Linear


def _rows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    buf, offsets = _joined(texts)
    found = [[] for _ in texts]
    for k, (rows, buckets) in enumerate(features(plain(buf, offsets), offsets, KIND)):
        total = np.bincount(rows, minlength=len(texts))
        cell, count = np.unique(rows * KIND.buckets + buckets, return_counts=True)
        row = cell // KIND.buckets
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        for t in range(len(texts)):
            a, b = cuts[t], cuts[t + 1]
            found[t].append((cell[a:b] % KIND.buckets + k * KIND.buckets, count[a:b] / max(1, total[t])))
    return [(np.concatenate([c for c, _ in x]), np.concatenate([v for _, v in x])) for x in found]


def train(docs: DataFrame, sample_docs: int = 300, sample_lines: int = 3000, copies: int = 24, id_column: str = "doc_id", text: str = "text") -> LicenceModel:
    """Unknown spans come from at most sample_docs documents: sample_lines of their lines and as many of their windows."""
    rng = np.random.default_rng(11)
    # Numbers alone are sorted; of the texts only the chosen ones travel.
    names = [F.xxhash64(id_column).alias("_a"), F.xxhash64(text).alias("_b")]
    few = docs.where(F.col(text).isNotNull()).select(*names).orderBy("_a", "_b").limit(sample_docs).distinct()
    found = docs.where(F.col(text).isNotNull()).select(*names, F.col(text).alias("t")).join(F.broadcast(few), ["_a", "_b"])
    # Repeated rows count once.
    buf, offsets = _joined([r["t"] for r in found.groupBy("_a", "_b").agg(F.first("t").alias("t")).orderBy("_a", "_b").collect()])
    lines, words = ["no licence here"], ["word"]
    if len(buf):
        word, starts, ends, _, _, first, end = _cut(buf, offsets)
        n_lines = len(np.unique(np.searchsorted(_lines(word, offsets), starts, side="right")))
        take = lambda low, high: low + rng.permutation(high - low)[:sample_lines]
        chosen = np.concatenate([take(0, n_lines), take(n_lines, len(first))])
        lines = [word[starts[first[k]] : ends[end[k] - 1]].tobytes().decode(errors="replace") for k in chosen] or lines
        words = [w for x in lines[:200] for w in x.split()] or words
    # A span with half a template is neither known nor unknown.
    unknown = [x for x in lines if not confirmed(x.split(), 0.5)]
    # Near misses are unknown too: parts of notices without a name.
    for t in (t for ts in TEMPLATES.values() for t in ts):
        own = t.split()
        figures = [k for k, w in enumerate(own) if any(c.isdigit() for c in w) and "-Clause" not in w]
        for other in OTHER_VERSIONS if figures else ():
            missed = list(own)
            missed[figures[-1]] = re.sub(r"\d+(\.\d+)?", other, own[figures[-1]], count=1)
            if not confirmed(_words(" ".join(missed)), 0.8):
                unknown.append(" ".join([*rng.choice(words, int(rng.integers(0, 6))), *missed, *rng.choice(words, int(rng.integers(0, 6)))]))
        unknown.append(" ".join(["is not" if len(own) % 2 else "never", *own]))
    unknown += [" ".join(rng.choice(["licensed", "under", "the", "license", "version", "released", "public", "work", "is", "terms", "of"], 6)) for _ in range(200)] + ["the driver needs a license", "public domain"]
    texts = []
    for templates in TEMPLATES.values():
        for t in templates:
            for k in range(copies):
                own = t.split()
                if k % 4 == 3 and len(own) > 8:  # long notices lose a word now and then
                    own.pop(int(rng.integers(len(own))))
                lead = OPENINGS[k % len(OPENINGS)].split() + list(rng.choice(words, int(rng.integers(0, 6)) if k % 2 else 0))
                # As in a window: up to as many words again and a few, before or after the notice.
                more = int(rng.integers(0, len(own) + 8)) if k % 3 == 0 else 0
                before = int(rng.integers(0, more + 1))
                texts.append(" ".join([*rng.choice(words, before), *lead, *own, *rng.choice(words, more - before)]))
    for k in range(4 * copies):
        a, b = (NAMES[FAMILIES[f]] for f in rng.choice(len(FAMILIES), 2, replace=False))
        lead = ("licensed under either of", "dual licensed under the", "SPDX-License-Identifier", "available under the terms of the")[k % 4]
        texts.append(f"{lead} {a[k % len(a)]} {('or', 'and', 'or the')[k % 3]} {b[k % len(b)]} " + " ".join(rng.choice(words, int(rng.integers(0, 8)))))
    rows = _rows(texts + unknown)
    y = np.array([1.0] * len(texts) + [0.0] * len(unknown))
    part = rng.integers(0, 5, len(rows))
    fit, rest = np.flatnonzero(part), np.flatnonzero(part == 0)
    known = fit_logistic([rows[k] for k in fit], y[fit], KIND.size)
    return LicenceModel(calibrate(known, np.array([(known.weights[rows[k][0]] * rows[k][1]).sum() for k in rest]), y[rest]))


def _cut(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """plain() bytes; start, end and paragraph of each word; row of each paragraph; first and end word of each span."""
    word = plain(buf, offsets)
    at, row = paragraphs(word, offsets)
    starts, ends, par = word_spans(word, at)
    first = end = np.zeros(0, dtype=np.int64)
    if len(starts):
        first, end = spans(par, np.searchsorted(_lines(word, offsets), starts, side="right"))
    return word, starts, ends, par, row, first, end


def _scores(word: np.ndarray, par: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per span the sum over families of the mean weight of its n-grams, from running sums over the words."""
    score = np.zeros(len(first))
    for k, (n, (_, buckets)) in enumerate(zip(KIND.words, features(word, at, KIND), strict=True)):
        total = np.zeros(len(par) + 1)
        if len(par) >= n:
            total[1 : len(par) - n + 2][par[: len(par) - n + 1] == par[n - 1 :]] = weights[k][buckets]
        total = np.cumsum(total)
        last = np.maximum(end - n + 1, first)
        score += (total[last] - total[first]) / np.maximum(last - first, 1)
    return score


def scan(docs: DataFrame, model: LicenceModel, known_at: float = 0.5, template_at: float = 0.8, text: str = "text") -> DataFrame:
    """All rows and columns of docs plus n_paragraphs, n_notices (families summed over the paragraphs), licenses
    (sorted distinct families, confirmed) and license_probability (of the likeliest notice; 0 without one).

    Null, empty and blank texts have one paragraph and no notice. Repeated rows get equal results; texts of any length are read
    whole. Columns of docs with these names are replaced.
    """
    names = ["n_paragraphs", "n_notices", "licenses", "license_probability"]
    rest = [c for c in docs.columns if c not in names]
    kept = docs.select(*rest)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.known
        weights = known.weights.reshape(KIND.families, KIND.buckets).astype(np.float32)
        for whole in batches:
            for batch in slices(whole, text):
                buf, offsets = flat(batch.column(batch.schema.get_field_index(text)))
                n = batch.num_rows
                found: dict[int, set[str]] = {}
                best, size = np.zeros(n), np.zeros(n, dtype=np.int64)
                row = np.zeros(0, np.int64)
                if len(buf):
                    word, starts, ends, par, row, first, end = _cut(buf, offsets)
                    size = np.bincount(row, minlength=n)
                    p = known.probability(_scores(word, par, paragraphs(word, offsets)[0], first, end, weights))
                    hits = np.flatnonzero(p >= known_at)
                    # Spans that meet or nearly so are read as one, with some words around.
                    inside = np.searchsorted(par, par[first[hits]]), np.searchsorted(par, par[first[hits]], side="right")
                    lows, highs = np.maximum(first[hits] - AROUND, inside[0]), np.minimum(end[hits] + AROUND, inside[1])
                    cover = np.cumsum(np.bincount(lows, minlength=len(par) + 1) - np.bincount(highs, minlength=len(par) + 1))[: len(par)] > 0
                    fresh = cover.copy()
                    fresh[1:] &= ~cover[:-1] | (par[1:] != par[:-1])
                    heads = np.flatnonzero(fresh)
                    group = np.searchsorted(heads, first[hits], side="right") - 1
                    likely, tails = np.zeros(len(heads)), np.zeros(len(heads), dtype=np.int64)
                    np.maximum.at(likely, group, p[hits])
                    np.maximum.at(tails, group, highs)
                    for a, b, q in zip(heads, tails, likely, strict=True):
                        families = confirmed(word[starts[a] : ends[b - 1]].tobytes().decode(errors="replace").split(), template_at)
                        if families:
                            found.setdefault(int(par[a]), set()).update(families)
                            best[row[par[a]]] = max(best[row[par[a]]], q)
                families, notices = [set() for _ in range(n)], np.zeros(n, dtype=np.int64)
                for k, f in found.items():
                    families[row[k]] |= f
                    notices[row[k]] += len(f)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.maximum(size, 1).astype(np.int64)), pa.array(notices), pa.array([sorted(f) for f in families], pa.list_(pa.string())), pa.array(best)], names=[*batch.schema.names, *names])

    from pyspark.sql.types import StructType

    return kept.mapInArrow(run, StructType([*kept.schema, *StructType.fromDDL("n_paragraphs bigint, n_notices bigint, licenses array<string>, license_probability double")]))
