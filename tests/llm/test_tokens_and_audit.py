"""Tokenizer alignment and byte-pair encoding against the libraries, the filter audit against a loop over orders."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import alignment, audit, bpe
from gridloom.llm.common import Scratch
from gridloom.llm.packing import byte_signs, vocabulary

FILES = alignment.Tokenizers(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, a int, ids int, part int"
ODD = [
    None, "", " ", "\n", "a", "A b", "  two  spaces ", "tabs\t\tand\r\nlines\n\n\n end ", "don't WE'LL it's 'S 'Re x'", "1234567 3.14 ½ ²", "Straße ÉCOLE naïve İstanbul ΣΊΣΥΦΟΣ", "é combining  nbsp em　ideographic", "中文字符 没有空格", "日本語 тест עברית العربية हिन्दी ไทย",
    "emoji 😀👩‍👩‍👧 ok", "<|startoftext|>x<|endoftext|> <|ENDOFTEXT|> <|endoftext|><s> </s> <unk> <0x41>", "a▁b ▁ c", "\x00null\x01\x1c\x85\x0b\x0c", "ﬁ ligature № ™ Ⅷ", "x" * 5000, "ab" * 3000 + " " + "9" * 300, " " * 3000 + "x" + "\n" * 600, "word " * 20000, "!!!??? --- ... #$%&*|", "﻿bom", "ʼn ŉ ß ẞ ǅ", "K Ω \U00010400",
]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def rows_of(spark, texts):
    """Texts under their numbers, one with a null id and one repeated, beside columns whose names clash with inner ones."""
    rows = [(i, t, None, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "null id", None, 1, 2, 3), (5, texts[5], None, 1, 2, 3)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def naive_merges(merges, symbols):
    while True:
        ranked = [(merges.rank[a * merges.base + b], i) for i, (a, b) in enumerate(itertools.pairwise(symbols)) if a * merges.base + b in merges.rank]
        if not ranked:
            return symbols
        rank, i = min(ranked)
        symbols = [*symbols[:i], merges.into[rank], *symbols[i + 2 :]]


def test_merges_match_a_search_for_the_lowest_rank():
    merges, r = bpe.Merges(vocabulary()), random.Random(1)
    for n in [1, 2, 3, *[r.randint(2, 60) for _ in range(400)]]:
        piece = "".join(r.choice("aabcdehinorstt") for _ in range(n))
        assert merges.merged(merges.symbols(piece)) == naive_merges(merges, merges.symbols(piece))
    assert merges.merged([]) == [] and merges.symbols("") == []


def test_encoding_and_decoding_match_the_library(spark):
    library = Tokenizer.from_file(vocabulary())
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = bpe.decode(bpe.encode(rows_of(spark, texts).withColumnRenamed("ids", "more"), vocabulary(), keep=("doc_id", "text", "part")), vocabulary(), keep=("doc_id", "text", "ids")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False), r.text
    assert bpe.encode(rows_of(spark, texts).limit(0), vocabulary(), keep=("doc_id",)).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [49407])], "doc_id long, ids array<int>"), vocabulary()).collect() == [(1, ""), (2, ""), (3, "<|endoftext|>")]
    with pytest.raises(ValueError):
        bpe.encode(rows_of(spark, texts), vocabulary(), keep=("ids",))


def test_byte_level_decoding_returns_the_text():
    path, texts = vocabulary("byte_bpe_50k.json"), [t for t in ODD if t]
    library, decoder = Tokenizer.from_file(path), bpe.Decoder(path)
    for t in texts:
        assert decoder.decoded(library.encode(t, add_special_tokens=False).ids) == t


def aligned_by_hand(texts):
    a_of, b_of = Tokenizer.from_file(FILES.a), sentencepiece.SentencePieceProcessor(model_file=FILES.b)
    a_of.encode_special_tokens = True
    signs = {s: b for b, s in byte_signs().items()}
    a_bytes = {i: bytes(signs[c] for c in x) for x, i in a_of.get_vocab().items() if x != "<|endoftext|>"}
    b_bytes = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in range(b_of.get_piece_size())]
    out = []
    for t in texts:
        a, b = (a_of.encode(" " + t, add_special_tokens=False).ids, b_of.encode(t, num_threads=1)) if t else ([], [])
        if not t or b"".join(a_bytes[i] for i in a) != (" " + t).encode() or b"".join(b_bytes[i] for i in b) != (" " + t).encode():
            out.append(([], [], []))
            continue
        groups, x, y, at_x, at_y, i, j = [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_x <= at_y and i < len(a):
                x.append(a[i])
                at_x += len(a_bytes[a[i]])
                i += 1
            else:
                y.append(b[j])
                at_y += len(b_bytes[b[j]])
                j += 1
            if at_x == at_y and x and y:
                groups.append((x, y))
                x, y = [], []
        out.append((a, b, groups))
    return out


def test_alignment_matches_a_loop_over_tokens(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = rows_of(spark, texts)
    all_texts = {i: t for i, t in enumerate(texts)} | {None: "null id"}
    want = dict(zip(all_texts, aligned_by_hand(all_texts.values()), strict=True))
    rows = Scratch(spark, "test").keep(alignment.aligned(df, FILES).withColumn("row", F.monotonically_increasing_id()))
    got = rows.collect()
    assert len(got) == len(texts) + 2 and not want[16][2] and want[17][2]
    links = Counter()
    for r in got:
        a, b, groups = want[r.doc_id]
        assert (r.n_a, r.n_b) == (len(a), len(b)), all_texts[r.doc_id]
        assert [(g.a, g.b) for g in r.groups] == groups, all_texts[r.doc_id]
        assert r.link_a == [g[0][-1] for g in groups] and r.link_b == [g[1][-1] for g in groups]
        links.update(zip(r.link_a, r.link_b, strict=True))
    for r in alignment.aligned(df, FILES, derive={"digest": alignment.group_digests}).collect():
        groups = want[r.doc_id][2]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert r.digest == (sha(text) if groups else "") and r.n_groups == len(groups)
    counts = alignment.pair_counts(rows)
    assert {(r.a, r.b): r.n for r in counts.collect()} == links
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    scored = alignment.scored(rows, counts, FILES).collect()
    assert len(scored) == len(got)
    for r in scored:
        own = [(x[-1], y[-1]) for x, y in want[r.doc_id][2]]
        assert r.count_sum == sum(links[p] for p in own) and r.n_best == sum(links[p] == most[p[1]] for p in own)
    none = alignment.aligned(df.limit(0), FILES).withColumn("row", F.lit(0))
    assert alignment.scored(none, alignment.pair_counts(none), FILES).count() == 0


def test_pairs_stay_below_their_bound(spark):
    pair = alignment.pair_of(FILES)
    assert pair.most_pairs() < 1 << 20 and alignment.Known(pair).apart
    ends = Counter()
    for i in range(len(pair.b.lengths)):
        ends[pair.b.bytes_of(pair.b.lengths[:1] * 0 + i).tobytes()] += 1
    assert max(ends.values()) == 2  # a byte and a piece of it


LETTERS = "ABCDE"


def audited_by_hand(docs, labels):
    marks = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)]
        said = [x for x in labels if x[0] is not None and x[0] == i]
        marks.append((lang or "", fails, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out, shapley = {}, Counter()
    for part in {m[0] for m in marks}:
        for order in map("".join, itertools.permutations(LETTERS)):
            left = [m[1:] for m in marks if m[0] == part]
            gone = []
            for k, x in enumerate(order):
                n = LETTERS.index(x)
                hit, stay = [m for m in left if m[0][n]], [m for m in left if not m[0][n]]
                every = [m[1:] for m in marks if m[0] == part]
                out[part, order, k + 1] = (len(stay), len(hit), sum(m[0][n] for m in gone), sum(m[0][n] and sum(m[0]) == 1 for m in every), sum(m[1] for m in hit), sum(m[2] for m in hit))
                shapley[part, x] += len(hit)
                gone, left = gone + hit, stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_matches_a_loop_over_orders(spark):
    r, words = random.Random(4), [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(r.sample(words, r.choice([20, 199, 200, 250])) + ["same"] * r.choice([0, 300]) + ["CAPITALS"] * r.choice([0, 30]) + ["#"] * r.choice([0, 1])), r.choice(["de", "en", "", None])) for i in range(60)]
    docs += [(100 + i, docs[i % 7][1], r.choice(["de", "xx"])) for i in range(40)]  # copies
    docs += [(200, None, "de"), (201, "", "en"), (3, docs[3][1], "de"), (3, docs[3][1], docs[3][2]), (3, "another text of id 3", "de"), (None, docs[3][1], "de"), (None, docs[3][1], None), (None, "alone", None), (300, "x " * 60000, "long"), (-5, docs[8][1], "en"), (301, "é  x\x1c y", "de")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, lang string, fails int, n int, bit int").repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in audit.audit(df, said).collect()}
    assert got == audited_by_hand(docs, labels) and len(got) == 5 * 600
    assert audit.audit(df.limit(0), said).count() == 0
    assert audit.audit(df, said.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    assert audit.lattice_edges(audit.failing_sets(df.where("lang = 'de'"), said), 5).count() == 80
