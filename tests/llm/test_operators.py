"""The ten operators against brute force on small documents, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import bpe, common, fingerprint, hashing, language, licenses, minhash, mixing, personal, secrets, signatures, suffixes, vectors
from tidelog.llm.components import components

from .data import documents, empty, frame

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def closure(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def digest(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 0), (50, 30), (80, 120)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + ([(i, i + 1) for i in range(100, 130)] if m else [])
        df = spark.createDataFrame([*links, (None, 1), (3, 3)], "u long, v long")
        want = closure({x for e in links for x in e if e[0] != e[1]} if links else set(), links)
        assert {r.node: r.component for r in components(df).collect()} == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in links)}


def test_near_duplicates(spark):
    rows = documents()
    got = minhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(rows)
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and 100 * len(s & t) >= 75 * len(s | t)]
    want = closure({i for i, _ in sets}, links)
    for r in got:
        assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(s)) for i, s in sets)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_large_clusters_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", -1)
    test_near_duplicates(spark)


def test_linked_pairs_join_what_brute_force_joins():
    rng = np.random.default_rng(5)
    for n, cut_at in ((2, 1), (9, 7), (9, 2), (40, 20)):
        sets = [np.unique(rng.integers(0, 24, 20)).astype(np.uint64) for _ in range(n)]
        left = np.arange(n) < cut_at
        for within in (True, False):
            truth = []
            for a in range(n):
                for b in range(a):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if (within or left[a] != left[b]) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        truth.append((a, b))
            got = minhash.linked_pairs(sets, np.zeros(n, bool) if within else left)
            assert {(max(e), min(e)) for e in got} <= set(truth)
            assert closure(set(range(n)), got) == closure(set(range(n)), truth)


def jaccard_closure(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    return closure({i for i, _ in sets}, links)


@pytest.mark.parametrize("order", [0, 1])
def test_near_duplicates_of_one_id_with_several_texts(spark, order):
    rng = random.Random(order)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(80)) for x in "abc")
    rows = [(10, a), (10, b), (20, a + " more"), (30, b + " more"), (30, c), (40, c + " end"), (50, ""), (50, c), (60, "  "), (5, a), (10, a), (7, None), (7, b)]
    rng.shuffle(rows)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = jaccard_closure(rows)
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, _worded string, row int"), "")
    left = kept.collect()
    assert sorted(r.doc_id for r in left if (r.text or "").strip()) == sorted({want[i] for i, t in rows if (t or "").strip()} & {i for i, t in rows if (t or "").strip()})
    assert kept.columns == ["doc_id", "text", "_worded", "row"]


@pytest.mark.parametrize("leaders", [0, 2])
def test_large_cluster_with_settled_trees(spark, monkeypatch, leaders):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    monkeypatch.setattr(minhash, "LEADERS", leaders)
    rng = random.Random(leaders)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 60])) for k in range(30)]
    rows += [(100 + k, " ".join(words[:40] + [f"x{rng.randrange(9)}" for _ in range(3)] + words[40:60])) for k in range(40)]
    rows += [(200 + k, " ".join(rng.sample(words[:60], 30) + words[:30])) for k in range(10)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == jaccard_closure(rows)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "é", "x" * 40, "y" * 700]) for _ in range(n)) for n in (3, 60, 400)] + ["z" * 3000 + " a b c d e f"]
    whole = [hashing.document_sets_of(pa.array([t])) for t in texts]
    plain = [hashing.document_shingles([t]) for t in texts]
    monkeypatch.setattr(hashing, "LONG", 100)
    monkeypatch.setattr(hashing.segments, "__defaults__", (100,))
    for t, (v, n), (s, m) in zip(texts, whole, plain, strict=True):
        got = hashing.document_sets_of(pa.array([t]))
        assert got[0].tolist() == v.tolist() and got[1].tolist() == n.tolist() == [len(shingles(t))]
        got = hashing.document_shingles([t])
        assert got[0].tolist() == s.tolist() and got[1].tolist() == m.tolist()


def test_followers_of_a_head_that_link_only_among_themselves(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(12):  # a chain: neighbours are alike, the ends are not
        rows.append((k, " ".join(words[k * 4 : k * 4 + 60])))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if 100 * len(s & t) >= 75 * len(s | t)]
    assert links and got == closure({i for i, _ in sets}, links)


def test_sketch_likeness():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for n, j in ((1000, 0.75), (40, 0.5), (3, 0.5)):
        hits = []
        for t in range(40):
            p = rng.permutation(pool)
            both = round(2 * n * j / (1 + j))
            a, b = p[:n], np.concatenate([p[:both], p[n : 2 * n - both]])
            s = minhash.sketches(np.concatenate([a, b]), np.array([n, n]))
            hits.append((s[0] == s[1]).mean() - both / (2 * n - both))
        assert abs(np.mean(hits)) < 0.05


def test_fingerprints(spark):
    rows = sorted(documents(), key=lambda r: -r[0])
    got = fingerprint.fingerprint_neighbours(frame(spark)).collect()
    assert len(got) == len(rows)
    unique = [r for r in rows if sum(q[0] == r[0] for q in rows) == 1]
    by = {r.doc_id: r for r in got}
    texts = [r[1] or "" for r in rows]
    for k, r in enumerate(rows):
        if r in unique and rows[(k + 1) % len(rows)] in unique:
            t, nxt = texts[k], texts[(k + 1) % len(rows)]
            half = len(t) // 2
            e = t[: len(t) - half] + nxt[:half]
            g = by[r[0]]
            assert g.n_chars == len(t) and g.edited_sha256 == digest(e)
            assert g.fingerprint == fingerprint.fingerprint_text(t) and g.edited_fingerprint == fingerprint.fingerprint_text(e)
            a, b = shingles(t), shingles(e)
            same = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True))
            want = lambda x, y, none: float(none[0] and none[1]) if none[0] or none[1] else max(0.0, (same(x, y) / 256 - 1 / 16) / (15 / 16))
            assert g.near_edited == pytest.approx(want(g.fingerprint, g.edited_fingerprint, (not a, not b)))
            assert g.near_next == pytest.approx(want(g.fingerprint, by[rows[(k + 1) % len(rows)][0]].fingerprint, (not a, not shingles(nxt))))
            assert abs(g.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    assert fingerprint.fingerprint_neighbours(empty(spark)).count() == 0
    one = fingerprint.fingerprint_neighbours(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == digest("abab") and one.near_next == 1.0


def test_fingerprint_neighbours_of_hot_ids(spark):
    rng = random.Random(31)
    rows = [(i, f"text {i} " + "w" * rng.randrange(30)) for i in range(60)] + [(None, f"null {i}") for i in range(80)] + [(7, f"seven {i}") for i in range(70)] + [(7, "seven 0")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.fingerprint_neighbours(df).collect()
    tie = {r.text: r.t for r in df.select("text", F.xxhash64("text").alias("t")).distinct().collect()}
    line = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], tie[r[1]]), reverse=True)
    want = Counter()
    for (i, t), (_, nxt) in zip(line, line[1:] + line[:1], strict=True):
        half = len(t) // 2
        want[i, len(t), digest(t[: len(t) - half] + nxt[:half])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_bpe_matches_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    lib = Tokenizer.from_file(path)
    lib.no_padding()
    lib.no_truncation()
    rows = documents()
    want = Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(lib.decode(ids, skip_special_tokens=False))] += 1
    assert want == Counter(map(tuple, bpe.tokenize_digests(frame(spark)).collect()))
    for r in bpe.tokenize(frame(spark)).collect():
        assert r.decoded == lib.decode(r.ids, skip_special_tokens=False)
    assert bpe.tokenize_digests(empty(spark)).count() == 0


def test_bpe_stream_is_whole(monkeypatch):
    t = bpe.transducer(bpe.tokenizer_path())
    rng = random.Random(4)
    kinds = ["abcdehilnorst", " ", "-", "=-", "a", "\n ", "0123456789", "éà", "日本", "ab "]
    for step in (7, 64, 256):
        monkeypatch.setattr(bpe, "STEP", step)
        for k in range(30):
            raw = "".join(rng.choice(kinds[k % len(kinds)]) for _ in range(rng.randint(1, 3000))).encode()
            assert list(t.stream(raw[i : i + 11] for i in range(0, len(raw), 11))) == t._whole(raw)
    assert t.decode([0, 10**6]) == t.decode([0])
    assert t.decode(t.encode("日")[:1]) == "�"


def test_bpe_windows_match_library(monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    t = bpe.transducer(bpe.tokenizer_path())
    rng = random.Random(5)
    parts = ["don't", "we'll", "'re", "'", "  ", " ", "\n\n", "x" * 40, "-" * 50, " " * 70, "<|endoftext|>", "12345", "日本語", "é", "a", ".", "\t \n"]
    for window in (5, 8, 33):
        monkeypatch.setattr(bpe, "WINDOW", window)
        monkeypatch.setattr(bpe, "STEP", 16)
        for _ in range(60):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
            assert t.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_bpe_memory_is_flat():
    import tracemalloc

    t = bpe.transducer(bpe.tokenizer_path())
    peaks = []
    for n in (100_000, 800_000):
        text = "a" * n + " the cat" * (n // 8)
        tracemalloc.start()
        count = sum(len(ids) for ids in t.encode_stream(text))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count > n // 8
    assert peaks[1] < 1.5 * peaks[0] + 500_000


def test_mixing(spark):
    rows = documents()
    size = [len(words(t)) for _, t, *_ in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[3] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, active, left = {}, set(names), float(sum(size))
    while active:
        level = left / sum(weight[s] for s in active)
        over = [s for s in active if level * weight[s] > 3 * total[s]]
        for s in over or active:
            target[s] = 3 * total[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        active -= set(over)
    got = mixing.mix_sources(frame(spark).drop("size")).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(frame(spark)).collect()))
    source = {(r[0], n): r[3] for r, n in zip(rows, size, strict=True)}
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(n for n, r in zip(size, rows, strict=True) if r[3] == s)
    assert mixing.mix_sources(empty(spark)).count() == 0


def base_secrets(text):
    kinds = [
        ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 1, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 0, 16),
        ("hex", "[0-9a-f]+", 0, 0, 32),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, flag, g, n) in enumerate(kinds) for m in re.finditer(p, text, flag) if len(m[g]) >= n)


def test_secrets(spark):
    rows = documents()
    want = Counter()
    for i, t, *_ in rows:
        s = base_secrets(t or "")
        want[i, sum(x[1] == 0 for x in s), sum(x[1] == 1 for x in s), sum(x[1] == 2 for x in s), digest(",".join(f"{n}:{a}:{b}" for a, _, n, b in s))] += 1
    got = secrets.secret_report(frame(spark)).collect()
    assert want == Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got)
    every = ",".join(r.spans for r in got)
    assert all(f"{k}:" in every for k in ("key", "jwt", "url"))
    assert secrets.secret_report(empty(spark)).count() == 0


def test_secrets_of_all_kinds_and_their_owners(spark):
    rows = [(i, t, s, f"r{i % 7}") for i, t, _, s in documents()]
    shared = 'token="sharedvalue77" glpat-abcdefghij0123456789 and Bearer abc.def/ghi=jkl~mnop xoxb-1234-abcdefgh AIza' + "x" * 35
    rows += [(2000 + k, ("é " * k) + shared + (" sk_live_abcdefgh12345678" if k % 2 else ""), [f"o{k % 4}", None][k == 5], f"r{k % 5}") for k in range(9)]
    rows += [rows[-1], rows[-2]]
    texts = {}
    for i, t, owner, repo in rows:
        every = []
        for rank, (kind, pattern, group, least, _) in enumerate(secrets.KINDS):
            every += [(m.start(), rank, kind, m.end(), m[group] if kind != "key" else re.sub(secrets._BREAK, "", m[group])) for m in re.finditer(pattern.replace(r"\z", r"\Z"), t or "", re.A) if len(m[group]) >= least]
        texts.setdefault((i, t), []).append((sorted(every), owner, repo))
    owners, repos = {}, {}
    for found in texts.values():
        for every, owner, repo in found:
            for *_, value in every:
                owners.setdefault(value, set()).add(owner)
                repos.setdefault(value, set()).add(repo)
    wide = {v for v in owners if len(owners[v]) >= 3 and len(repos[v]) >= 3}
    want = Counter()
    for (i, _), found in texts.items():
        for every, *_ in found:
            copied = [x for x in every if x[4] in wide]
            live = [x for x in every if x[4] not in wide and not re.search(secrets.PLACEHOLDER, x[4])]
            want[i, ",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in every), len(live), len(every) - len(live), max((len(owners[x[4]]) for x in copied), default=0), max((len(repos[x[4]]) for x in copied), default=0)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string").repartition(4)
    got = secrets.secret_report(df, repo_col="repo").collect()
    assert Counter((r.doc_id, r.spans, r.n_live, r.n_copied, r.copied_owners, r.copied_repos) for r in got) == want
    assert max(r.copied_owners for r in got) == 5 and {s.split(":")[0] for r in got for s in r.spans.split(",") if s} >= {"forge", "bearer", "chat", "cloud", "pay", "key", "jwt", "url"}


def test_ownership_and_redaction(spark):
    rows = [(i, f"password = copiedvalue{'9' * 3} end", "en", f"s{i}") for i in range(5)] + [(9, "é token: onlyhere77 and token: onlyhere77.", "en", "s1"), (10, None, "en", None)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in secrets.secret_report(df).collect()}
    assert all(got[i].n_live == 0 and got[i].n_copied == 1 for i in range(5)) and got[9].n_live == 2
    out = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert secrets.redact(df).columns == df.columns
    assert out[0].text == rows[0][1] and out[9].text == "é [SECRET] and [SECRET]" and out[9].n_chars == len(out[9].text) and out[10].text is None


def base_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return w, [(i, label) for p, label in licenses.PHRASES for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p]


def test_licenses(spark):
    rows = documents()
    want = Counter()
    for i, t, *_ in rows:
        w, found = base_phrases(t or "")
        at = [a for a, _ in found]
        want[i, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))] += 1
    got = licenses.license_report(frame(spark)).collect()
    assert want == Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    labels = {x for r in got for x in r.labels.split(",")}
    assert {"apache-2.0", "gpl-3.0", "cc-by-nc-4.0", "reserved"} <= labels and "apache" not in labels
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert licenses.license_report(empty(spark)).count() == 0
    assert len(licenses.RULES) > 300 and len(signatures.CLAUSES) + len(signatures.NOTICES) + len(signatures.FAMILIES) > 200


def test_texts_with_many_matches(spark):
    for n in (0, 1, 255, 256, 257, 600):
        text = ("deadbeef" * 4 + " é ") * n
        got = secrets.secret_report(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
        assert got.n_hex == n and got.spans == ",".join(f"hex:{35 * i}:{35 * i + 32}" for i in range(n))


def kept_detections(text):
    """Every rule tried on the text without any gate, then suppression by all pairs."""
    every = []
    for rule, label, _, _, pattern, priority, weight, group in licenses.RULES:
        for m in re.finditer(pattern, text, re.I | re.A):
            every.append((m.start(), m.end(), rule, priority, f"{label}-{m[1]}" if group and m[1] else label))
    order = lambda d: (d[3], d[0] - d[1], d[2])
    return {(*d[:3], d[4]) for d in every if not any(e[0] <= d[0] and e[1] >= d[1] and order(e) < order(d) for e in every)}


LICENSE_TEXTS = [
    "the MIT License, all rights reserved. " * 3,
    "Licensed under the GNU General Public License v3, GPL-3.0. SPDX-License-Identifier: GPL-3.0-only",
    "license: MIT; cc by-nc-sa 4.0 https://creativecommons.org/licenses/by-nc-sa/4.0/ New BSD License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, express or implied",
    "Redistribution and use in source and binary forms, with or without\nmodification; neither the name of the University nor the names of its contributors may be used to endorse or promote products",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",
    "either version 2 of the License, or (at your option) any later version; Creative Commons Attribution-ShareAlike International 4.0 and CC0 1.0 and CC BY 4.0, cc  by\n3.0",
    "Tous droits réservés © 2020 – copyright (c) 1999-2004, 2006 Ünïcode License and ſoftware, \u212aey",
    "see LICENSE.txt for details; Change Date: 2027-01-01; OpenRAIL-M license; Llama 3.1 Community License Agreement; no license here, DMCA notice",
]


def test_licenses_are_those_of_all_rules_without_gates(spark):
    texts = [*LICENSE_TEXTS, *[t or "" for _, t, *_ in documents()]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("low", F.lower("text")).withColumn("check", F.lit(1).cast("long"))
    got = {r.doc_id: {(f.start, f.stop, f.rule, f.label) for f in r.found} for r in licenses.detections(df, spark).collect()}
    for i, text in enumerate(texts):
        assert got.get(i, set()) == kept_detections(text)
    assert len(got) >= len(LICENSE_TEXTS)


def test_count_runs(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "a", " a", "a ", "  é \t b\n", "\x0b", "a\u00a0b", "\x85 x"] + ["".join(rng.choice(" a\n-é") for _ in range(rng.randint(0, 8))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(common.count_runs(F.col("t"), common.SPACE).alias("n"), common.count_runs(F.col("t"), licenses.BETWEEN).alias("m")).collect()
    assert [r.n for r in got] == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert [r.m for r in got] == [len(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t or "")) for t in texts]


def test_long_repetitions_do_not_recurse(spark):
    years = "copyright 2001" + ", 2002" * 170_000
    texts = [years, "licensed under the " * 40_000, "cc " * 200_000, " " * 1_000_000, "license" + " " * 500_000 + ": mit", "a as-is " * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_report(df).collect()}
    assert got[0].labels == "copyright" and got[0].n_words == 170_002 and got[4].labels == "mit" and len(got) == len(texts)


def test_suppression(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "the MIT License and also the MIT License")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_report(df).collect()}
    assert got == {1: "apache-2.0", 2: "mit"}


def base_personal(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(only(s)) <= 19 and personal.luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    ]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))


def test_personal(spark):
    rows = documents()
    want = Counter()
    for i, t, *_ in rows:
        s = base_personal(t or "")
        want[(i, *(sum(x[1] == k for x in s) for k in range(4)), digest(",".join(f"{n}:{a}:{b}" for a, _, n, b in s)))] += 1
    got = personal.personal_data(frame(spark)).collect()
    assert want == Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    assert personal.personal_data(empty(spark)).count() == 0
    rng = random.Random(6)
    for _ in range(3000):
        t = "".join(rng.choice("a1.@+- 4(%") for _ in range(rng.randint(0, 30)))
        assert [(a, personal.BASE_KINDS[k], b) for a, k, b in personal.base_spans(t)] == [(a, n, b) for a, _, n, b in base_personal(t)]


def card(rng):
    """Sixteen digits that pass the check sum."""
    digits = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(digits + str(d) for d in range(10) if personal.luhn(digits + str(d)))


def personal_texts(rng, n):
    out = []
    for k in range(n):
        kinds = [f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", f"u{rng.randrange(99)}.x@mail{k % 9}.example.com", ".".join(str(rng.randrange(1, 250)) for _ in range(4)), card(rng)]
        filler = lambda: " ".join(rng.choice(["word", "licence 2.0.", "step 3.", "in 2024", "other", '"9c2f00aa41"']) for _ in range(rng.randrange(3, 20))) + " word"
        out.append(" ".join(x for e in rng.sample(kinds, rng.randrange(0, 4)) for x in (filler(), e, "and")) + " " + filler())
    return out


def trained(texts):
    samples = []
    for k, t in enumerate(texts):
        spans = personal.base_spans(t)
        for text, true in ((t, spans), personal.masked(t, spans, k)):
            nodes = personal.nodes_of(text)
            samples.append((nodes, personal.covered(nodes, true)))
    return personal.fit(samples)


def test_field_finds_masked_patterns():
    rng = random.Random(11)
    field = trained(personal_texts(rng, 400))
    found = hidden = wrong = 0
    for k, t in enumerate(personal_texts(rng, 300)):
        text, true = personal.masked(t, personal.base_spans(t), 10**6 + k)
        base, every = personal.all_spans(text, field)
        more = [s for s in every if s[1] >= 4]
        lost = [s for s in true if not any(a < s[2] and b > s[0] for a, _, b in base)]
        hidden += len(lost)
        found += sum(any(m[1] - 4 == s[1] and m[0] <= s[0] + 2 and m[2] >= s[2] - 1 for m in more) for s in lost)
        wrong += sum(not any(m[1] - 4 == s[1] and m[0] < s[2] and m[2] > s[0] for s in true) for m in more)
    assert hidden > 150 and found >= 0.85 * hidden and wrong <= 0.05 * found
    # A number of three tokens is one span.
    text = "word other 001 (212) 555-1234 word"
    assert [text[a:b] for a, _, b in personal.all_spans(text, field)[1]] == ["001 (212) 555-1234"]


def test_skip_links_carry_labels():
    rng = random.Random(12)
    k = len(personal.LABELS)
    like = personal.Field(np.zeros((personal.N_FEATURES, k)), np.zeros((k, k)), 4.0 * np.eye(k), 4.0 * np.eye(k))
    text = "+49301234567 then " + "word " * 300 + ("49301234567 " + "word " * 50) * 39 + "49301234568 and 99887766"
    base, every = personal.all_spans(text, like)
    more = [text[a:b] for a, kind, b in every if kind == 7]
    assert [text[a:b] for a, _, b in base] == ["+49301234567"]
    assert more.count("49301234567") == 39 and "49301234568" in more and "99887766" not in more
    assert rng


def test_similar_forms_are_those_one_character_apart():
    rng = random.Random(13)
    forms = sorted({"".join(rng.choice("12") for _ in range(rng.randint(5, 8))) for _ in range(60)})
    rests = [{f, *(f[:i] + f[i + 1 :] for i in range(len(f)))} for f in forms]
    links = [(a, b) for b in range(len(forms)) for a in range(b) if min(len(forms[a]), len(forms[b])) >= 6 and rests[a] & rests[b]]
    got = personal.similar_forms(forms)
    assert set(got) <= set(links) and closure(set(range(len(forms))), got) == closure(set(range(len(forms))), links)
    assert personal.similar_forms(["1" * 5000, "1" * 4999]) == []


def test_covered_takes_the_first_span():
    rng = random.Random(14)
    for _ in range(200):
        spans = sorted((a, kind, a + rng.randint(1, 6)) for kind in range(4) for a in range(kind, 60, rng.choice([7, 11, 30])))
        nodes = sorted((a, a + rng.randint(1, 5)) for a in rng.sample(range(60), 20))
        want = [next((k + 1 for a, k, b in spans if a < n[1] and b > n[0]), 0) for n in nodes]
        assert personal.covered(nodes, spans).tolist() == want


def test_repeats(spark):
    rows = documents()
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, []).append((t or "").encode())
    seen, want = set(), Counter()
    for i in sorted(by):
        own = set()
        for b in by[i]:
            gone = bytearray(len(b))
            for s in range(len(b) - 49):
                own.add(b[s : s + 50])
                if b[s : s + 50] in seen:
                    gone[s : s + 50] = b"\1" * 50
            left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
            want[i, len(b), len(b) - len(left), spans, digest(left)] += 1
        seen |= own
    assert want == Counter(map(tuple, suffixes.remove_repeats(frame(spark), digests=True).collect()))
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    kept = suffixes.remove_repeats(frame(spark)).collect()
    assert Counter(digest(bytes(r.kept)) for r in kept) == Counter(x[4] for x in want.elements())


def test_repeats_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_DOCS", 2)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 3000)
    monkeypatch.setattr(suffixes, "PART_BYTES", 10_000)
    test_repeats(spark)


def test_repeats_in_several_turns(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PASS_BYTES", 3_000)
    test_repeats(spark)


def test_contexts_are_compared_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(suffixes.Anchors, "hash_of", lambda self, start, stop: np.full(len(start), 7, np.uint64))
    rng = random.Random(21)
    shared = "".join(rng.choice("abcdef ") for _ in range(30))
    texts = [shared + "".join(rng.choice("ghijkl") for _ in range(60)) if k % 2 else "".join(rng.choice("ghijkl") for _ in range(60)) + shared + "tail" * 8 for k in range(12)]
    texts += texts[:3]
    docs = pa_table([(k, t, 0) for k, t in enumerate(texts)])
    seen, want = set(), []
    for t in texts:
        b = t.encode()
        own = {b[s : s + 50] for s in range(len(b) - 49)}
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if b[s : s + 50] in seen:
                gone[s : s + 50] = b"\1" * 50
        seen |= own
        want.append(sum(gone))
    width = 6
    sent = suffixes._anchor_hashes(1, width)(docs)
    known = list(suffixes._repeated(width)(iter([sent.select(["part", "slice", "hashes", "docs"]).to_batches()[0]])))
    cuts = suffixes._contexts(1, width)(docs, pa_from(known))
    found = list(suffixes._settle(1)(iter(cuts.sort_by("part").to_batches())))
    out = suffixes._remove(True)(docs, pa_from(found))
    assert dict(zip(out.column("doc_id").to_pylist(), out.column("n_removed").to_pylist(), strict=True)) == dict(enumerate(want)) and sum(want) > 0


def settled(rows, monkeypatch, anchors):
    """Removed bytes of each (key, document, context) by suffixes._removed, and the bytes that the sorter saw."""
    seen, sort = [0], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text: seen.append(len(text)) or sort(text))
    many = [len(raw) - 49 for _, _, raw in rows]
    columns = {"key": [r[0] for r in rows], "doc": [r[1] for r in rows], "row": range(len(rows)), "slice": [0] * len(rows), "first": [0] * len(rows), "before": [raw.find(anchors.get(key, b"")) for key, _, raw in rows], "many": many}
    out = list(suffixes._removed({c: np.array(v, np.int64) for c, v in columns.items()}, b"".join(r[2] for r in rows)))
    monkeypatch.setattr(suffixes, "suffix_array", sort)
    gone = [bytearray(len(r[2])) for r in rows]
    for batch in out:
        for blob in batch.column(1).to_pylist():
            for row, start, stop in np.frombuffer(blob, suffixes._REMOVAL).tolist():
                gone[row][start:stop] = b"\1" * (stop - start)
    return gone, sum(seen)


def owned(rows):
    """The same from every string and the smallest document that has it."""
    least = {}
    for key, doc, raw in rows:
        for s in range(len(raw) - 49):
            w = key, raw[s : s + 50]
            least[w] = min(doc, least.get(w, doc))
    gone = [bytearray(len(r[2])) for r in rows]
    for out, (key, doc, raw) in zip(gone, rows, strict=True):
        for s in range(len(raw) - 49):
            if least[key, raw[s : s + 50]] < doc:
                out[s : s + 50] = b"\1" * 50
    return gone


def test_the_sorter_sees_what_is_shared_and_that_once(monkeypatch):
    rng = random.Random(31)
    noise = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    anchor, sides = noise(20), [noise(20) for _ in range(20)]
    # Each agrees on 40 bytes with others to the left and with others to the right, and on 50 with none.
    rows = [(1, d, noise(9) + sides[d % 10] + anchor + sides[10 + d // 10] + noise(9)) for d in range(100)]
    gone, sorted_bytes = settled(rows, monkeypatch, {1: anchor})
    assert gone == owned(rows) and not any(map(any, gone)) and sorted_bytes == 0
    # One line between neighbours that all differ, and a longer cut of it.
    line = noise(60)
    rows += [(2, d, noise(9) + bytes([d]) + line + bytes([d]) + noise(9)) for d in range(120, 250)] + [(2, d, noise(30) + line[:55] + noise(9)) for d in (101, 600)]
    gone, sorted_bytes = settled(rows, monkeypatch, {1: anchor, 2: line[20:40]})
    assert gone == owned(rows) and sum(map(any, gone)) == 131 and 0 < sorted_bytes < 200


def test_settling_against_all_strings(monkeypatch):
    rng = random.Random(32)
    for turn in range(40):
        base = [bytes(rng.choices(b"xy", k=90)) for _ in range(3)]
        rows = []
        for _ in range(rng.randint(0, 40)):
            a, b = rng.choice(base), rng.choice(base)
            cut = rng.randint(0, 90)
            raw = (a[:cut] + b[cut:])[rng.choice([0, 0, 15, 30]) : rng.choice([90, 90, 85])]
            rows += [(rng.randint(1, 3), rng.randint(1, 12), raw)] * rng.choice([1, 1, 2])
            if rng.random() < 0.3:
                rows.append((rows[-1][0], rng.randint(1, 12), raw))
        if turn == 20:
            monkeypatch.setattr(suffixes, "_hash_between", lambda sums, start, stop, seed: np.zeros(len(start), np.uint64))
        monkeypatch.setattr(suffixes, "SUM_BYTES", rng.choice([1, 300, 1 << 20]))
        assert settled(rows, monkeypatch, {})[0] == owned(rows)


def pa_table(rows):
    import pyarrow as pa

    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "slice": pa.array([r[2] for r in rows], pa.int32())})


def pa_from(batches):
    import pyarrow as pa

    return pa.Table.from_batches(batches)


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 5, 200])) for _ in range(rng.randint(0, 40))]
        order = suffixes.suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for k, h in enumerate(suffixes.common_prefixes(s, order)):
            if k:
                a, b = s[order[k - 1] :], s[order[k] :]
                assert a[:h] == b[:h] and (len(a) == h or len(b) == h or a[h] != b[h])


def brute_links(rows):
    out = []
    for k, (i, v, lab) in enumerate(rows):
        for j, w, other in rows[:k]:
            if lab is None or lab != other or i is None or j is None:
                continue
            ok = lambda x: x is not None and len(x) and all(y is not None and np.isfinite(y) for y in x) and any(x)
            if ok(v) and ok(w) and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    out.append((i, j))
    return out


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(15):
            rows.append(((centre + rng.normal(size=16) * 0.06).astype(np.float32).tolist(), c % 3))
    rows += [(rows[0][0], 0)] * 5 + [([0.0] * 16, 0), (None, 0), ([float("nan")] * 16, 1), ([1.0, None], 1), ([], 1), ([1.0, 2.0], 2), ([2.0, 4.0], 2), (rows[0][0], None)]
    rows = [(i, v, lab) for i, (v, lab) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).repartition(3)
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    links = brute_links(rows)
    n = Counter(x for e in links for x in e)
    found = sum(got[i].n_links for i in got)
    assert found >= 0.97 * 2 * len(links) and all(got[i].n_links <= n[i] for i in got)
    want = closure(range(len(rows)), links)
    assert {i: r.component_id for i, r in got.items()} == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", -1)
    test_vectors(spark)


def test_language(spark):
    from .data import prose

    rng = random.Random(7)
    letters = {"en": "the and of ing tion ", "de": "der und sch ung ein ", "fr": "le que eau oi ment "}

    def text(lang, n):
        return " ".join("".join(rng.choice(letters[lang].split()) for _ in range(2)) for _ in range(n))

    docs = [(i, text(lang, 60), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    labelled = frame(spark, docs)
    held = [(i, text(lang, 30), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    pages = [(i, f"http://h{i % 4}.example.{lang}/x", f'<html lang="{lang if i % 5 else "xx"}"><script>der und</script><p>{t}</p></html>', lang) for i, t, lang in held]
    pages += [(900, None, None, None), (901, "nonsense", "<p>%% 12 34 !!</p>", None), (902, "http://h0.example.en", "<p></p>", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, truth string")
    got = {r.page_id: r for r in language.identify_pages(df, labelled).collect()}
    assert len(got) == len(pages) and sum(got[i].lang == lang for i, _, lang in held) >= 0.97 * len(held)
    assert not any(got[i].accepted for i in (900, 901, 902)) and got[902].text_lang is None
    assert language.identify_pages(df.limit(0), labelled).count() == 0
    assert not language.identify_pages(df, labelled.limit(0)).where("accepted").count()
    kept = language.accepted_documents(frame(spark, docs + [(500, "12 34", "en", "s"), (501, None, "en", "s"), (502, "A.", "en", "s")]))
    assert kept.columns == labelled.columns and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} | {502}
    assert prose(rng, 1)


def test_language_is_the_formula(spark):
    """Posteriors of every page against the same formula in plain Python, trigram by trigram."""
    import math

    rng = random.Random(17)
    letters = {"en": "the and of ing tion ", "de": "der und sch ung ein "}
    docs = [(i, " ".join(rng.choice(letters[lang].split()) for _ in range(30)), lang, "s") for i, lang in enumerate(["en", "de"] * 20)]
    labelled = frame(spark, docs)
    names, logs = language.train(labelled)
    assert names == ["de", "en"]
    pages = [(i, f"http://h{i % 3}.example.{'de' if i % 2 else 'com'}/x", f'<html lang="{["en", "de", "xx", ""][i % 4]}"><p>{" ".join(rng.choice(letters[rng.choice(["en", "de"])].split()) for _ in range(rng.randint(1, 12)))}</p></html>') for i in range(40)]
    pages += [(50, None, "<p>the und</p>"), (51, "http://h1.example.de", None), (51, "http://h1.example.de", "<p>12</p>"), (52, "mailto:x", '<html lang="de">der der</html>')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("clash")).withColumn("key", F.lit(1))
    got = Counter((r.page_id, r.lang, round(r.confidence, 5), r.text_lang, r.accepted) for r in language.identify_pages(df, labelled).collect())

    def codes(text):
        fold = [32 if not (97 <= c <= 122 or c >= 128) else c for c in text.translate(LOWER).encode()]
        return [tuple(fold[k : k + 3]) for k in range(len(fold) - 2) if fold[k : k + 2] != [32, 32] and fold[k + 1 : k + 3] != [32, 32]]

    code = lambda t: int(language.trigrams(bytes(t), np.array([0, 3]))[0][0])
    rows = []
    for page, url, body in pages:
        text = re.sub("<[^<>]*>", " ", body or "")
        found = codes(text)
        sums = [sum(logs[k][code(t)] for t in found) for k in range(2)]
        noise = len(found) >= language.ENOUGH_TRIGRAMS and all(s < -len(found) * math.log(language.BUCKETS) for s in sums) or not re.search("[a-z]", text)
        scale = min(len(found), language.MOST_EVIDENCE) / max(len(found), 1)
        ll = [s * scale - max(sums) * scale for s in sums]
        p = [0.0, 0.0] if noise else [math.exp(x) / sum(map(math.exp, ll)) for x in ll]
        m = re.match(r"[a-z]+://([^/]+)", url or "")
        told = re.search('lang="([a-z]{2})"', body or "")
        rows.append((page, m[1] if m else None, told[1] if told else None, ll, p, noise))
    total = [sum(r[4][k] for r in rows) for k in range(2)]
    prior = [(t + 1) / (sum(total) + 2) for t in total]
    known = lambda d: "?" if d is None else d if d in names else "*"
    want = Counter()
    for page, host, told, ll, p, noise in rows:
        less = lambda same: [sum(r[4][k] for r in rows if same(r)) - p[k] for k in range(2)]
        sn = less(lambda r: r[1] and r[1].split(".")[-1] == host.split(".")[-1]) if host else [0, 0]
        hn = less(lambda r: r[1] == host) if host else [0, 0]
        sp = [(sn[k] + language.SUFFIX_WEIGHT * prior[k]) / (sum(sn) + language.SUFFIX_WEIGHT) for k in range(2)]
        hp = [(hn[k] + language.HOST_WEIGHT * sp[k]) / (sum(hn) + language.HOST_WEIGHT) for k in range(2)]
        d = known(told)
        match = [1.0, 1.0] if d == "?" else [(sum(r[4][k] for r in rows if known(r[2]) == d) + language.DECLARED_WEIGHT * (0.8 if d == names[k] else 0.2 / 3)) / (total[k] + language.DECLARED_WEIGHT) for k in range(2)]
        joint = [(0 if noise else ll[k]) + math.log(match[k]) + math.log(hp[k]) for k in range(2)]
        post = [math.exp(x - max(joint)) for x in joint]
        best = max(post) / sum(post)
        want[page, names[post.index(max(post))], round(best, 5), None if noise else names[p.index(max(p))], not noise and best >= language.REJECT_BELOW] += 1
    assert got == want


def test_hidden_markup_takes_linear_time():
    import time

    page = lambda n: "<script " * n + "<!-- " * n + "<nav>a</nav>" * n
    assert language.visible_text("a<!-- b -->c<script>d</SCRIPT >e<style>f").split() == ["a", "c", "e", "f"]
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        language.without_hidden(page(n))
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


@pytest.mark.parametrize("texts", [[], [None], ["", "x"], ["a b c d e f"] * 3])
def test_sets(texts):
    import pyarrow as pa

    values, sizes = hashing.document_sets_of(pa.array(texts, pa.string()))
    assert sizes.tolist() == [len(shingles(t)) for t in texts] and len(values) == sizes.sum()
