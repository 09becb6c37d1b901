"""The operators against brute force on small tables, and their edge cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import host_rules, language, mixing, packing, pii, quality, toxicity
from gridloom.llm.common import Scratch
from gridloom.llm.components import components
from gridloom.llm.learning import sampled
from gridloom.llm.line_dedup import without_recurring
from gridloom.llm.ngram_join import link_documents, near_duplicates_removed
from gridloom.llm.packing import best_fit_decreasing, pack, vocabulary, vocabulary_of
from gridloom.llm.textnp import Texts
from gridloom.llm.vectors import link_vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, extra int, id int, node long"


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def docs(spark, rows):
    """Documents with nulls where a row is short, and columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 1, 2, 3) for r in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (None, "one two three four five six"), (6, "word " * 30000, "en", None), (7, "a b c d e f g h"), (7, "a b c d e f g h")]


def grouped(ids, linked):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_shingle_join_matches_brute_force(spark, scratch, size, percent):
    r, texts = random.Random(size), []
    words = [f"w{i}" for i in range(300)]
    for n in (12, 40, 140):
        base = [r.choice(words) for _ in range(n)]
        for _ in range(50):
            x = list(base)
            for _ in range(r.randint(0, 5)):
                x[r.randrange(len(x))] = r.choice(words)
            texts.append(" ".join(x))
    texts += ["", None, "A b", "a  B", "c"]
    df = docs(spark, list(enumerate(texts))).repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in link_documents(df, scratch, size, percent).collect()}
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    both = lambda a, b: len(sets[a] & sets[b])
    narrow = {x.doc_id: (x.n_shingles, x.component_id) for x in link_documents(df, scratch, size, percent, code_bits=8).collect()}
    assert narrow == got
    top = grouped(sets, lambda a, b: bool(sets[a]) and 100 * both(a, b) >= percent * (len(sets[a]) + len(sets[b]) - both(a, b)))
    assert got == {i: (len(sets[i]), top[i]) for i in sets}


def test_shingle_join_edges(spark, scratch):
    got = sorted((tuple(r) for r in link_documents(docs(spark, EDGES), scratch, 3, 90).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(EDGES) and by[1] == (1, 0, 1) and by[3] == (3, 0, 3) and by[5] == (5, 1, 4) and by[None][2] is None
    assert link_documents(docs(spark, EDGES).limit(0), scratch).count() == 0
    assert {r.doc_id for r in near_duplicates_removed(docs(spark, EDGES[:5]), scratch).collect()} == {1, 2, 3, 4}


def test_components(spark, scratch):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (None, 1)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 300}
    for n in (1, 30):
        assert {r.node: r.label for r in components(df.repartition(n), scratch).collect()} == want
    assert components(df.limit(0), scratch).count() == 0


def test_few_links_take_few_steps_and_tasks(spark, scratch):
    """A long chain over many partitions, as many as a cluster has for other tables."""
    nodes = random.Random(5).sample(range(10**6), 3000)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        before = scratch.n
        out = components(spark.createDataFrame(list(itertools.pairwise(nodes)), "a long, b long").repartition(64), scratch)
        assert {r.label for r in out.collect()} == {min(nodes)} and out.count() == len(nodes)
        assert scratch.n == before + 2 and len(out.inputFiles()) == 1
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_mix_meets_targets(spark, scratch):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 60), None, r.choice(["a", "b", "c", None])) for i in range(300)] + [(1000, None, None, "a"), (None, "x y", None, "b")]
    got = mixing.mix(docs(spark, rows), scratch).collect()
    again = mixing.mix(docs(spark, rows).repartition(7), scratch).collect()
    key = lambda rows: sorted((str(x.doc_id), x.size, len(x.copies)) for x in rows)
    assert key(got) == key(again) and len(got) == len(rows)
    taken, target = Counter(), {}
    for x in got:
        taken[x.source] += x.size * len(x.copies)
        target[x.source] = x.target
        assert len(x.copies) <= 3
    total = sum(x.size for x in got)
    assert abs(sum(target.values()) - total) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    assert mixing.mix(docs(spark, rows).limit(0), scratch).count() == 0


def filled(sizes, weights=(5, 2, 1)):
    """Targets by resharing what is above the bound until nothing is."""
    names = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    left, full = float(sum(sizes.values())), {}
    while True:
        open_ = [k for k in names if k not in full]
        share = {k: left * w[k] / sum(w[x] for x in open_) for k in open_} if open_ else {}
        over = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not over:
            return share | full
        for k in over:
            full[k] = 3.0 * sizes[k]
            left -= full[k]


def test_mix_targets_match_brute_force(spark, scratch):
    for seed in range(3):
        r = random.Random(seed)
        names = [None, *"abcdefg"][: r.randint(1, 8)]
        rows = [(i, "w " * r.randint(0, 40), None, k) for k in names for i in range(r.choice([1, 3, 80]))]
        got = {x.source: x.target for x in mixing.mix(docs(spark, [(j, *x[1:]) for j, x in enumerate(rows)]), scratch).collect()}
        want = filled({k: sum(len(x[1].split()) for x in rows if x[3] == k) for k in names})
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want), (got, want)


@pytest.mark.parametrize("own", [960, 2])
def test_blocks_are_dealt_once_and_evenly(spark, scratch, monkeypatch, own):
    monkeypatch.setattr(mixing, "OWN_LEAVES", own)
    monkeypatch.setattr(mixing, "SHARED_LEAVES", 2)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 30), None, r.choice("abcdef")) for i in range(600)] + [(9000, "v " * 20000, None, "a")]
    place = {}
    for x in mixing.mix(docs(spark, rows), scratch, shards=8).collect():
        assert len({c.spot for c in x.copies}) == len(x.copies)
        for c in x.copies:
            assert place.setdefault((x.source, c.block, c["pass"]), c.shard) == c.shard
    sizes = Counter(place.values())
    # blocks without a document in the mix are dealt too, so shards may differ a little more than by one
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 4


def test_shards_keep_odd_rows(spark, scratch):
    rows = [(7, "a b c", None, "s", 1, 10), (7, "a b c", None, "s", 2, 20), (None, "d e", None, "s", 3, 30), (8, None, None, None, 4, 40), (9, "x", None, None, 5, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, block int, shard int")
    mixed = mixing.mix(df, scratch)
    copies = {(x.doc_id, x.source, x.size): len(x.copies) for x in mixed.collect()}
    got = mixing.shards_of(mixed, df).collect()
    assert Counter((x.doc_id, x.source, x.block) for x in got) == Counter({(i, s, b): copies[i, s, len((t or "").split())] for i, t, _, s, b, _ in rows if copies[i, s, len((t or "").split())]})
    assert all(0 <= x.shard < 64 and x.spot is not None for x in got) and mixing.shards_of(mixed, df.limit(0)).count() == 0


def test_splitting_tree_is_exact():
    parts = mixing.split(random.Random(1), [100, 37, 5], 8)
    assert [sum(c) for c in zip(*parts, strict=True)] == [100, 37, 5] and {sum(p) for p in parts} <= {17, 18}


def test_host_rules_count_as_brute_force(spark, scratch):
    r = random.Random(3)
    rows = []
    for i in range(60):
        w = [r.choice("abcdefg") for _ in range(r.randint(0, 60))]
        rows.append((100 + i, " ".join(w + w[: r.randint(0, len(w))]) + "\nx y|#\nx y|#\n \n", None, r.choice(["s", None])))
    rows += [(i, t) for i, t in EDGES[:6] if i]
    for x in host_rules.verdicts(docs(spark, rows), scratch).collect():
        t = dict((a, b) for a, b, *_ in rows)[x.doc_id] or ""
        w = WORD.findall(t)
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [y for y in t.split("\n") if WORD.search(y)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert x.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (x.base_failed and x.kept)


def test_hosts_that_stand_out_lose_doubtful_documents(spark, scratch):
    good, bad, odd = " ".join(f"w{i}" for i in range(30)), "too short", " ".join(f"w{i}" for i in range(30)) + " #####"
    rows = [(100 * h + i, bad if i < 2 else odd if i == 2 else good, None, f"h{h}") for h in range(20) for i in range(40)]
    rows += [(5000 + i, bad if i < 30 else odd if i < 35 else good, None, "worst") for i in range(40)] + [(6000, good, None, None)]
    got = {x.doc_id: x for x in host_rules.verdicts(docs(spark, rows), scratch).collect()}
    assert {x.host_failed for i, x in got.items() if 5000 <= i < 6000} == {True} and not any(x.host_failed for i, x in got.items() if not 5000 <= i < 6000)
    assert [got[5000 + i].kept for i in (0, 32, 38)] == [False, False, True] and got[2].kept and not got[0].kept and got[6000].kept
    once = [(1, good), (1, good), (2, "word " * 40000), (3, "")]
    out = host_rules.verdicts(docs(spark, once), scratch).collect()
    assert sorted((x.doc_id, x.n_words) for x in out) == [(1, 30), (1, 30), (2, 40000), (3, 0)]
    assert host_rules.verdicts(docs(spark, once).limit(0), scratch).count() == 0


def test_best_fit_matches_brute_force():
    for seed in range(30):
        r = random.Random(seed)
        c = r.choice([10, 37, 100])
        lengths = [r.randint(1, c) for _ in range(r.randint(0, 300))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fits = [(b, i) for i, b in enumerate(bins) if b >= n]
            if fits:
                bins[min(fits)[1]] -= n
            else:
                bins.append(c - n)
        assert best_fit_decreasing(Counter(lengths), c)[1] == len(bins)


def test_tokens_are_the_library_s(spark, scratch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    r = random.Random(1)
    texts = ["", "it's DON'T 's x'r", "ǅ ŉ ß K İ", "a\x1cb", "naïve—“q” €5 日本", "<|endoftext|> x", "a <|ENDOFTEXT|><|endoftext|>", *("".join(r.choice("ab'sStdrevl m1 9.é,×\n") for _ in range(25)) for _ in range(300))]
    for text, got in zip(texts, vocabulary_of(vocabulary()).documents(pa.array(texts), 1), strict=True):
        assert got.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text


def test_packing_round_trip(spark, scratch):
    rows = [(i, t) for i, (_, t, *_) in enumerate(EDGES)]
    got = pack(docs(spark, rows), scratch, vocabulary(), capacity=64, with_ids=True).collect()
    seqs, whole = defaultdict(list), defaultdict(list)
    for x in got:
        assert zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length
        seqs[x.sequence_id].append((x.offset, x.length))
        whole[x.doc_id].append((x.start, x.ids))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    for i, t in rows:
        assert [k for _, ids in sorted(whole[i]) for k in ids] == vocabulary_of(vocabulary()).documents(pa.array([t or ""]), 1)[0].tolist()
    assert pack(docs(spark, rows).limit(0), scratch, vocabulary()).count() == 0


def test_vectors_match_brute_force(spark, scratch, monkeypatch):
    from gridloom.llm import vectors

    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "SLICE", 30)
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 8))
    x = [(base[i % 12] + 0.25 * r.normal(size=8)).tolist() for i in range(240)]
    rows = [(i, v, i % 2) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [None] * 8, 1), (903, [float("nan")] * 8, 1), (904, x[0], None), (905, [1.0], 1)]
    got = {z.vec_id: (z.n_links, z.component_id, z.kept) for z in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), scratch).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    close = (u @ u.T >= 0.93) & (np.arange(240)[:, None] % 2 == np.arange(240) % 2)
    np.fill_diagonal(close, False)
    top = grouped(range(240), lambda a, b: bool(close[a, b]))
    assert all(got[i] == (close[i].sum(), top[i], top[i] == i) for i in range(240)) and len(got) == len(rows)
    assert all(got[i] == (0, i, True) for i in range(900, 906))


def test_line_dedup(spark, scratch):
    rows = [(1, "Shared line of five words\nown words of one\n\nShort"), (2, "own words of two\nShared line of five words\nShort"), (3, None), (None, "Shared line of five words"), (4, ""), (5, "Shared line of five words")]
    got = {x.doc_id: (x.text, x.n_dropped, x.extra) for x in without_recurring(docs(spark, rows), scratch).collect()}
    assert got == {1: (rows[0][1], 0, 1), 2: ("own words of two\nShort", 1, 1), 3: (None, 0, 1), None: (rows[3][1], 0, 1), 4: ("", 0, 1), 5: ("", 1, 1)}
    variants = [(i, f"The order from {n} is on its way to the usual place today") for i, n in enumerate(["ann", "bob", "cyd", "dan", "eve", "fay"])]
    assert sum(x.n_dropped for x in without_recurring(docs(spark, variants), scratch).collect()) == 5
    assert without_recurring(docs(spark, rows).limit(0), scratch).count() == 0


def test_a_leaf_holds_several_templates(spark, scratch):
    middles = ["is now on its way over to you at", "got lost near some old bridge in town by", "waits until someone can call our shop just before"]
    families = [f"the order from {{}} {m} the usual place today" for m in middles]
    names = "ann bob cyd dan eve fay".split()
    hot = [(100 + i, "the order from zed x y z u v w r s t the usual place today") for i in range(9)]
    rows = [(10 * k + i, f.format(n)) for k, f in enumerate(families) for i, n in enumerate(names)] + hot
    assert {len(t.split()) for _, t in rows} == {17}
    got = {x.doc_id: x.n_dropped for x in without_recurring(docs(spark, rows), scratch).collect()}
    assert {i for i, n in got.items() if not n} == {0, 10, 20, 100} and sum(got.values()) == len(rows) - 4


def test_unlike_lines_of_a_leaf_cost_no_more_jobs(spark):
    tables = []
    for n in (20, 4000):
        own = Scratch(spark, "test")
        rows = [(i, f"the order from w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} x{chr(97 + i * 7 % 26)} y{chr(97 + i * 11 // 26 % 26)}{chr(97 + i // 26 % 26)} z{chr(97 + i // 50 % 26)} to the usual place") for i in range(n)]
        assert without_recurring(docs(spark, rows), own).where("n_lines = 1").count() == n
        tables.append(own.n)
    assert tables[0] == tables[1]


def by_hand(rows, variants=5, share=0.7, depth=3):
    """The lines that stay, by loops over lines and branches; all lines here are masked ones without digits."""
    places = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            places[tuple(line.split())].append((i, k))
    n_docs = {w: len({i for i, _ in at}) for w, at in places.items()}
    branch = defaultdict(set)
    for w in places:
        n = len(w)
        leaf = (n, w[:depth], w[-depth:])
        blocks, between = n - math.ceil(share * n - 1e-9) + 1, w[depth : n - depth]
        if len(between) < blocks:
            branch[leaf].add(w)
            continue
        for k in range(blocks):
            a, b = len(between) * k // blocks, len(between) * (k + 1) // blocks
            branch[leaf, k, "own", between[a:b]].add(w)
            branch[leaf, k, "rest", between[:a] + between[b:]].add(w)
    return places, n_docs, branch


def test_templates_match_brute_force(spark, scratch):
    from gridloom.llm.line_dedup import DEPTH

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdef") for _ in range(3))
    rows, i = [], 0
    for n in (7, 8, 12, 20, 41):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(r.choice([3, 6, 12])):
                w = list(base)
                for at in r.sample(range(n), r.randint(0, max(1, n // 3))):
                    w[at] = word()
                rows.append((i, " ".join(w) + "\n" + " ".join(base[:DEPTH] + [word() for _ in range(n - 2 * DEPTH)] + base[-DEPTH:])))
                i += 1
    places, n_docs, branch = by_hand(rows)
    codes = {w: Texts(pa.array([" ".join(w)])) for w in places}
    whole = {w: lines_of(codes[w]) for w in places}  # ties go by the larger hash
    seed = {}
    for members in branch.values():
        top = max(members, key=lambda w: (n_docs[w], whole[w]))
        for w in members - {top}:
            if sum(a == b for a, b in zip(w, top, strict=True)) >= 0.7 * len(w) - 1e-9:
                seed[w] = max(seed.get(w, top), top, key=lambda s: (n_docs[s], whole[s]))
    drop = set()
    for w, at in places.items():
        if n_docs[w] > 1:
            drop |= set(at) - {min(at)}
    for s in set(seed.values()):
        at = [p for w in places if w == s or seed.get(w) == s for p in places[w]]
        if len({d for d, _ in at}) >= 5:
            drop |= set(at) - {min(at)}
    assert len(drop) > 40
    got = {x.doc_id: x.text for x in without_recurring(docs(spark, rows).repartition(5), scratch).collect()}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop) for i, t in rows}


def lines_of(text):
    from gridloom.llm.line_dedup import lines

    return int(lines(text, 3, 10)[2][0])


def test_verbatim_lines_recur_whatever_their_tokens(spark, scratch):
    prices, other = (" ".join([f"{k}.5" for k in range(at, at + 31)] + ["eur"] * 29) for at in (0, 100))
    chinese, thai = "这是一个在很多文档里重复出现的句子。", "นี่คือประโยคที่ซ้ำกันหลายเอกสาร"
    rows = [(i, "\n".join([prices, chinese, thai, "Read more here", "Contact us", "短い行", f"2024-01-0{i} 10:0{i}:00"])) for i in range(3)] + [(9, other)]
    got = {x.doc_id: (x.text, x.n_dropped) for x in without_recurring(docs(spark, rows), scratch).collect()}
    assert got[0] == (rows[0][1], 0) and got[9] == (other, 0)
    assert all(got[i] == (f"短い行\n2024-01-0{i} 10:0{i}:00", 5) for i in (1, 2))


def test_pii_surrogates(spark, scratch):
    text = 'a.b@mail.example.com, +1 (317) 555-7008 38.180.236.140 4999301290682266 token = "7f3a2209dd4c2e76" Anna Schmidt, Frau Schmidt'
    rows = [(1, text), (2, "again a.b@mail.example.com"), (3, None), (4, "nothing here"), (None, "1.2.3.4")]
    got = {x.doc_id: x for x in pii.surrogates(docs(spark, rows), scratch, b"k").collect()}
    found = pii.detect(text)
    assert [k for _, _, k, _ in found] == ["email", "phone", "ip", "card", "secret", "given-latin-f", "surname", "surname"]
    assert not any(v in got[1].text for _, _, _, v in found)
    new = pii.detect(got[1].text)
    assert [x[2] for x in new][:4] == ["email", "phone", "ip", "card"] and new[0][3] in got[2].text
    assert got[1].text.count(pii.surrogate(b"k", "surname", "Schmidt")) == 2 and got[3].text is None and got[4].text == "nothing here" and got[None].n_pii == 1


def test_pii_names_mentioned_apart(spark, scratch):
    cases = {
        "Anna Schmidt came. Anna said that Schmidt left": ["given-latin-f", "surname", "given-latin-f", "surname"], "Frau Anna kam. Anna ging": ["given-latin-f", "given-latin-f"],
        "Frau Dr. Brunhilde Vogt kam. Brunhilde ging, Vogt blieb": ["surname"] * 4, "Anna Maria Weber, Maria": ["given-latin-f", "given-latin-f", "surname", "given-latin-f"],
        "Anna came, and Miss that": [], "Иван Петров ушёл. Иван": ["given-cyrillic-m", "surname", "given-cyrillic-m"],
    }
    for text, kinds in cases.items():
        assert [k for _, _, k, _ in pii.detect(text)] == kinds, text
    texts = list(cases)
    got = {x.doc_id: x.text for x in pii.surrogates(docs(spark, list(enumerate(texts))), scratch, b"k").collect()}
    assert "Anna" not in got[0] + got[1] and "Vogt" not in got[2] and "Brunhilde" not in got[2] and got[4] == texts[4]
    assert got[0].split()[0] == got[0].split()[3] == got[1].split()[1] and got[0].split()[1] == got[0].split()[6]


def test_pii_account_numbers_and_addresses(spark, scratch):
    text = "IBAN DE89 3704 0044 0532 0130 00 and DE00 3704 0044 0532 0130 00, host fe80::1ff:fe23:4567:890a or 2001:DB8::A:B:1 at 10:20:30 in std::vector, x::y"
    assert [(k, v) for _, _, k, v in pii.detect(text) if k == "ipv6"] == [("ipv6", "fe80::1ff:fe23:4567:890a"), ("ipv6", "2001:DB8::A:B:1")]
    good, bad = [v for _, _, k, v in pii.detect(text) if k == "iban"]
    one, two = (pii.surrogate(b"k", "iban", v).replace(" ", "") for v in (good, bad))
    check = lambda v: int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    assert check(one) and not check(two) and one[:2] == two[:2] == "DE" and len(pii.surrogate(b"k", "iban", good)) == len(good)
    rows = [(1, text), (1, text), (2, "word " * 40000 + text), (3, ""), (4, None)]
    got = pii.surrogates(docs(spark, rows), scratch, b"k").collect()
    assert len(got) == 5 and len({x.text for x in got if x.doc_id == 1}) == 1 and next(x.text for x in got if x.doc_id == 2).endswith(next(x.text for x in got if x.doc_id == 1))
    assert pii.surrogates(docs(spark, rows).limit(0), scratch, b"k").count() == 0


def test_vector_edges(spark, scratch):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [0.0, 1.0], 1), (4, [1.0, 0.05], 1), (4, [1.0, 0.06], 1), (5, None, 1), (5, None, 1), (None, None, None)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, name string").repartition(4)
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 1, False), (4, 1, 1, False), (4, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (5, 0, 5, True), (None, 0, None, False), (None, 0, None, False)]
    assert sorted((tuple(r) for r in link_vectors(df, scratch).collect()), key=str) == sorted(want, key=str)
    assert link_vectors(df.limit(0), scratch).count() == 0


def test_more_pivots_where_vectors_visit_few_cells(spark, scratch, monkeypatch):
    """Tight clusters get many cells, others few; what comes out is the same."""
    from gridloom.llm import vectors

    monkeypatch.setattr(vectors, "CELL", 4)
    monkeypatch.setattr(vectors, "PIVOTS", 4)
    r, reach = np.random.default_rng(9), math.sqrt(0.14)
    base = r.normal(size=(12, 32))
    tight = (np.repeat(base, 100, 0) + 0.05 * r.normal(size=(1200, 32)))[r.permutation(1200)]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(vectors.chosen(unit(tight), 1200, 64, reach)) >= 16 and len(vectors.chosen(unit(r.normal(size=(1200, 32))), 1200, 64, reach)) == 4
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(tight)], "vec_id long, embedding array<double>, label int")
    got = {z.vec_id: (z.n_links, z.component_id) for z in link_vectors(df, scratch).collect()}
    close = unit(tight) @ unit(tight).T >= 0.93
    np.fill_diagonal(close, False)
    top = grouped(range(1200), lambda a, b: bool(close[a, b]))
    assert got == {i: (close[i].sum(), top[i]) for i in range(1200)}


def test_pii_collisions_are_resolved(spark, scratch):
    rows = [(i, f"token={i:06d}") for i in range(20000)]  # some of 16**6 surrogates collide
    first = [pii.surrogate(b"k", "secret", t[6:]) for _, t in rows]
    assert len(set(first)) < len(rows)
    got = [x.text for x in pii.surrogates(docs(spark, rows), scratch, b"k").collect()]
    assert len(set(got)) == len(rows) and not set(got) & {t for _, t in rows}


def test_pii_crowded_formats_settle(spark, scratch):
    abc = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{c}@hot.com" for c in abc] + [f"{a}{b}@hot.com" for a in abc for b in abc] + [f"me@{c}.org" for c in abc] + ["password: пароль", "password: сезамы", "password: !?!?!?!"]
    got = {x.doc_id: x.text for x in pii.surrogates(docs(spark, list(enumerate(texts))), scratch, b"k").collect()}
    assert len(set(got.values())) == len(texts) and not set(got.values()) & set(texts)
    domains = {got[i].partition("@")[2] for i, t in enumerate(texts) if "@" in t}
    assert len(domains) == 27 and not domains & {t.partition("@")[2] for t in texts}
    assert len(got[len(texts) - 3]) == len(texts[-3]) and all("Ѐ" <= c <= "ӿ" for c in got[len(texts) - 3].partition(" ")[2])


def test_recurring_lines_match_brute_force(spark, scratch):
    r = random.Random(8)
    pool = [" ".join(r.choice("alpha beta gamma delta kappa omega sigma theta".split()) for _ in range(n)) for n in (4, 6, 9, 70, 120) for _ in range(12)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.5 else " ".join(f"{r.choice('xyz')}{r.random()}".replace("0.", "q").translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(5)) for _ in range(r.randint(1, 8)))) for i in range(120)]
    first = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            first.setdefault(line, []).append((i, k))
    # templates are out of the way: their demand is above the number of documents
    got = {x.doc_id: x.text for x in without_recurring(docs(spark, rows).repartition(5), scratch, variants=10**6).collect()}
    drop = {at for line, places in first.items() if len({i for i, _ in places}) > 1 for at in sorted(places)[1:]}
    assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop) for i, t in rows}


def test_likeness_counts_every_token(spark, scratch):
    """Lines of 96 tokens that agree at every third place, and so at the 32 that a sample would see, but at too few in all."""
    words = lambda seed: [f"w{chr(97 + (seed * 7 + k) % 26)}{chr(97 + (seed * 3 + k * 5) % 26)}" for k in range(96)]
    base = words(0)
    unlike = [" ".join(base[k] if k < 3 or k > 92 or k % 3 == 0 else f"u{chr(97 + n)}{chr(97 + k % 26)}" for k in range(96)) for n in range(8)]
    alike = [" ".join(base[k] if k != 50 else f"v{chr(97 + n)}" for k in range(96)) for n in range(8)]
    assert sum(x.n_dropped for x in without_recurring(docs(spark, list(enumerate(unlike))), scratch).collect()) == 0
    assert sum(x.n_dropped for x in without_recurring(docs(spark, list(enumerate(alike))), scratch).collect()) == 7


def test_line_dedup_edges(spark, scratch):
    text = "this very line stands in each of the documents\nand a line of its own " + "x" * 200000
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, "")]
    df = docs(spark, rows).withColumns({"n_lines": F.lit(-1), "n_dropped": F.lit(-1)})
    got = sorted(((x.doc_id or 0, x.n_lines, x.n_dropped) for x in without_recurring(df, scratch).collect()))
    assert got == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 2, 2), (3, 0, 0), (4, 1, 0)]


def test_samples_keep_the_smallest_hashes(spark):
    for bound in (10, 41, 100):
        rows = spark.createDataFrame([(i, "a" if i % 5 else "b") for i in range(300)] + [(None, "a"), (7, None)], "id long, c string")
        one, two = (sorted(map(tuple, sampled(rows.repartition(n), "c", "id", bound)[0].collect()), key=str) for n in (1, 9))
        assert one == two and len(one) == bound and Counter(c for _, c in one)["b"] == min(60, bound // 2)
    assert sampled(rows.limit(0), "c", "id", 5)[1] == {}


def test_votes_match_a_plain_loop():
    r = random.Random(4)
    texts = [" ".join(r.choice("red green blue black white ### !!! one two".split()) for _ in range(r.randint(1, 50))) for _ in range(400)]
    labels = [int("#" not in t) for t in texts]
    model = quality.train(texts, labels, {0: 300, 1: 100})
    some = Texts(pa.array(texts[:30]))
    q = model.latent(some).astype(float)
    for x, got in zip(q, model.score(some), strict=True):
        cos = [sum(a * b for a, b in zip(x, v, strict=True)) for v in model.vectors.astype(float).tolist()]
        near = sorted(range(len(cos)), key=lambda i: -cos[i])[: quality.NEIGHBOURS]
        w = [math.exp(12 * (cos[i] - 1)) * model.shares[i] for i in near]
        assert abs(got - sum(a * model.labels[i] for a, i in zip(w, near, strict=True)) / sum(w)) < 1e-3
    assert np.allclose(model.axes.T @ model.axes, np.eye(model.axes.shape[1]), atol=1e-3)


def test_ftrl_matches_a_plain_loop(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice(s) for _ in range(40)) for s in ("abcde ", "defgh ") for _ in range(15)]
    names = ["x"] * 15 + ["y"] * 15
    order = np.random.default_rng(1).permutation(30)
    texts, names = [texts[i] for i in order], [names[i] for i in order]
    alpha, beta, l1, l2 = 0.3, 1.0, 1e-2, 1e-3
    model = language.train(texts, names, alpha, beta, l1, l2, passes=2)
    z, n = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])

    def weight(g, k):
        return 0.0 if abs(z[g][k]) <= l1 else -(z[g][k] - math.copysign(l1, z[g][k])) / ((beta + math.sqrt(n[g][k])) / alpha + l2)

    rows = []
    for t in texts:
        _, gram, w = language.weighed(Texts(pa.array([t])), model.idf)
        rows.append([*zip(gram.tolist(), w.astype(np.float32).tolist(), strict=True), (language.GRAMS, 1.0)])
    for turn in range(2):
        for i in np.random.default_rng(turn).permutation([k for k in range(30) if k % 5 != 4]):
            v = {(g, k): weight(g, k) for g, _ in rows[i] for k in (0, 1)}
            s = [sum(v[g, k] * x for g, x in rows[i]) for k in (0, 1)]
            p = [1 / (1 + math.exp(s[1 - k] - s[k])) for k in (0, 1)]
            for g, x in rows[i]:
                for k in (0, 1):
                    grad = (p[k] - (names[i] == "xy"[k])) * x
                    sigma = (math.sqrt(n[g][k] + grad * grad) - math.sqrt(n[g][k])) / alpha
                    z[g][k] += grad - sigma * v[g, k]
                    n[g][k] += grad * grad
    want = np.array([[weight(g, k) for k in (0, 1)] for g in range(language.GRAMS)])
    assert np.allclose(model.weights, want, atol=1e-6) and np.count_nonzero(want)


def trained(spark, module, label):
    d, y = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet")
    model = module.fit(d, y, label)
    rows = module.predict(d.join(y, "doc_id").drop("quality", "toxic"), model).join(y, "doc_id").collect()
    held = [x for x in rows if zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    return model, held


def test_quality_on_held_out_rows(spark):
    model, held = trained(spark, quality, "quality")
    assert np.mean([(x.score >= 0.5) == (x.quality == 1) for x in held]) > 0.85
    out = quality.predict(docs(spark, EDGES), model).collect()
    assert len(out) == len(EDGES) and all(0 <= x.score <= 1 for x in out)
    assert quality.fit(docs(spark, EDGES), spark.createDataFrame([], "doc_id long, quality int")) is None


def test_toxicity_on_held_out_rows(spark):
    model, held = trained(spark, toxicity, "toxic")
    assert np.mean([(x.score >= 0.7) == (x.toxic == 1) for x in held]) > 0.9
    out = toxicity.predict(docs(spark, [*EDGES, (50, "é you idiot and moron")]), model, with_spans=True).collect()
    assert len(out) == len(EDGES) + 1 and [(s.start, s.end) for s in out[-1].spans][:1] == [(6, 11)]


def test_marginals_match_enumeration():
    r = np.random.default_rng(0)
    odds, move = r.normal(size=7), r.normal(size=(2, 2))
    total, on, moves = 0.0, np.zeros(7), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=7):
        s = 0.4 * tags[0] + sum(o for o, t in zip(odds, tags, strict=True) if t) + sum(move[a, b] for a, b in itertools.pairwise(tags))
        total += np.exp(s)
        on += np.exp(s) * np.array(tags)
        for a, b in itertools.pairwise(tags):
            moves[a, b] += np.exp(s)
    pairs = np.zeros((2, 2))
    assert np.allclose(toxicity.marginals(odds, np.array([0, 7]), move, 0.4, pairs), on / total) and np.allclose(pairs, moves / total)
    stay = np.zeros(7)
    toxicity.marginals(odds, np.array([0, 7]), move, 0.4, None, stay)
    assert np.isclose(np.exp(stay.sum()), np.exp(6 * move[0, 0]) / total)  # no toxic token at all
    long = r.normal(size=3000)
    cut, whole = np.zeros((2, 2)), np.zeros((2, 2))
    a = toxicity.marginals(long, np.array([0, 900, 3000]), move, 0.0, cut)
    toxicity_segment, toxicity.SEGMENT = toxicity.SEGMENT, 3000
    b = toxicity.marginals(long, np.array([0, 900, 3000]), move, 0.0, whole)
    toxicity.SEGMENT = toxicity_segment
    assert np.allclose(a, b) and np.allclose(cut, whole) and np.isclose(cut.sum(), 2998)


def test_toxic_documents_without_tags_have_a_toxic_token():
    """The gradient for documents of which only that much is known, against the difference of the log-likelihood."""
    r = np.random.default_rng(1)
    odds, move, at = r.normal(size=5) - 1, r.normal(size=(2, 2)), np.array([0, 5])

    def loss(odds):
        every = {t: np.exp(0.2 * t[0] + odds @ np.array(t) + sum(move[a, b] for a, b in itertools.pairwise(t))) for t in itertools.product((0, 1), repeat=5)}
        return np.log(1 - every[0, 0, 0, 0, 0] / sum(every.values()))

    stay = np.zeros(5)
    p = toxicity.marginals(odds, at, move, 0.2, None, stay)
    none = np.exp(stay.sum())
    numeric = [(loss(odds + 1e-5 * np.eye(5)[k]) - loss(odds - 1e-5 * np.eye(5)[k])) / 2e-5 for k in range(5)]
    assert np.allclose(p * none / (1 - none), numeric, atol=1e-6)


def test_evidence_of_seeds_matches_a_loop():
    r = np.random.default_rng(2)
    n_bad, n_good = np.array([7, 12, 0]), np.array([30, 15, 9])
    bad, good = (np.stack([r.integers(0, n + 1, 20) for n in x]) for x in (n_bad, n_good))
    over, odds = toxicity.evidence(bad, good, n_bad, n_good)
    for k in range(20):
        above = spread = up = down = 0.0
        for i in range(3):
            n, m = n_bad[i] + n_good[i], bad[i, k] + good[i, k]
            above += bad[i, k] - m * n_bad[i] / n
            spread += n_bad[i] * n_good[i] * m * (n - m) / (n * n * (n - 1))
            up += bad[i, k] * (n_good[i] - good[i, k]) / n
            down += good[i, k] * (n_bad[i] - bad[i, k]) / n
        assert np.isclose(over[k], above / math.sqrt(spread + 0.1)) and np.isclose(odds[k], (up + 0.05) / (down + 0.05))


def test_toxic_documents_are_found_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.predict(texts, toxicity.fit(texts, labels)).join(texts.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").select("lang", "toxic", (F.col("score") >= 0.7).alias("hit")).collect()
    recall = lambda rows: sum(r.hit for r in rows) / len(rows)
    toxic = [r for r in scored if r.toxic == 1]
    assert recall(toxic) >= 0.85 and all(recall([r for r in toxic if r.lang == x]) >= 0.7 for x in ("de", "en", "es", "fr"))
    assert sum(r.toxic for r in scored if r.hit) / sum(r.hit for r in scored) > 0.9


def test_grams_are_of_characters():
    texts = ["Ünï 中文 ab!C", "", "ПриВЕТ", "..", "e\u0301 x"]
    doc, _, count = language.grams(Texts(pa.array(texts)))
    for i, t in enumerate(texts):
        folded = "".join(c if language.letters()[ord(c)] else " " for c in t.lower())
        want = Counter(folded[k : k + n] for n in language.LENGTHS for k in range(len(folded) - n + 1) if folded[k : k + n].strip())
        assert sorted(count[doc == i].tolist()) == sorted(want.values()), t


def test_language_on_held_out_rows(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = language.fit(d)
    rows = language.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [x for x in rows if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert np.mean([x.lang == x.lang_pred for x in held]) > 0.95
    out = {x.doc_id: x for x in language.predict(docs(spark, [*EDGES, (60, "123 !?")]), model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[60].lang_pred == "und" and out[60].score == 0
    assert language.fit(docs(spark, EDGES).limit(0)) is None


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline

    some = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").limit(150).collect()
    rows = [tuple(x) for x in some]
    long = max(rows, key=lambda x: len(x[1] or ""))[1].split("\n")[0]
    words = (long * 3).split()[:200]
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (20, 90, 150)]
    rows += [(10**6 + i, t, "en", "planted", len(t)) for i, t in enumerate(near)]
    rows += [(None, near[0], "en", None, 5), (2 * 10**6, None, None, "planted", None), (2 * 10**6 + 1, "", "en", None, 0), (2 * 10**6 + 2, "123 456", "en", None, 7), rows[0], rows[0]]
    rows += [(3 * 10**6 + i, f"a line that both of them have, word for word\nline of {x} alone, which is the only one of its kind here", "en", "lines", 1) for i, x in enumerate(("ann", "bob"))]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    scratch, stage = Scratch(spark, "stages"), dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out, kept = {}, docs
    for name, f in corpus_pipeline.STAGES:
        kept = scratch.keep(f(spark, kept, d))
        out[name] = kept.collect()
    assert len(stage) == 5 and all(set(out[n][0].asDict()) == set(corpus_pipeline.COLUMNS) for n in list(stage)[:4])

    told = {(x.doc_id, x.text): x for x in language.predict(docs, language.fit(docs, folds=None)).join(docs.select("doc_id", "text"), "doc_id").collect()}
    want = Counter((i, t) for i, t, *_ in rows if i is not None and told[i, t].lang_pred != "und" and told[i, t].score >= 0.4)
    assert Counter((x.doc_id, x.text) for x in out["language_id"] if x.doc_id is not None) == want and not any(x.text in (None, "", "123 456") for x in out["language_id"])
    assert sum(x.doc_id is None for x in out["language_id"]) == 1

    text = {x.doc_id: x.text for x in out["line_dedup"]}
    assert "both of them" in text[3 * 10**6] and "both of them" not in text[3 * 10**6 + 1] and "alone" in text[3 * 10**6 + 1]

    sets = {}
    for x in out["line_dedup"]:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x.text))
        if x.doc_id is not None:
            sets[x.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    both = lambda a, b: len(sets[a] & sets[b])
    top = grouped(sets, lambda a, b: bool(sets[a]) and 100 * both(a, b) >= 80 * (len(sets[a]) + len(sets[b]) - both(a, b)))
    assert Counter(x.doc_id for x in out["ngram_jaccard_join"]) == Counter(x.doc_id for x in out["line_dedup"] if x.doc_id is None or top[x.doc_id] == x.doc_id)
    assert top[10**6 + 2] == 10**6

    mixed = mixing.mix(scratch.keep(spark.createDataFrame(out["ngram_jaccard_join"], "doc_id long, text string, lang string, source string, n_chars long")), scratch)
    want = Counter()
    for x in mixed.collect():
        want[x.doc_id] += len(x.copies)
    assert Counter(x.doc_id for x in out["mixing"]) == +want

    ids = [vocabulary_of(vocabulary()).documents(pa.array([x.text]), 1)[0] for x in out["mixing"]]
    assert sum(len(x) for x in ids) == sum(x.length for x in out["best_fit_packing"])
    final = corpus_pipeline.run(spark, d).collect()
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32) for x in final) == Counter((x.doc_id, x.start, x.length, x.ids_crc32) for x in out["best_fit_packing"])
    used = defaultdict(int)
    for x in final:
        used[x.sequence_id] += x.length
    assert max(used.values()) <= 4096


def test_pipeline_takes_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_are_cut_between_documents():
    t = Texts(pa.array(["ab", "", "cd e", None]))
    starts, ends = t.words()
    assert [t.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"ab", b"cd", b"e"] and t.counts(starts).tolist() == [0, 1, 1, 3, 3]
    assert packing.byte_signs()[32] == "Ġ"
