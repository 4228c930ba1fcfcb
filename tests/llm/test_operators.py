"""Each operator against a brute-force version, and on odd rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentspark.llm import (fingerprints, huffman, mixing, near_join, privacy, quality, rules, shards, subwords,
                             toxicity)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 --- near join

def windows(text):
    words = WORD.findall(text or "")
    n = min(5, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def brute_join(rows):
    sets = [windows(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
            links[i] += 1
            links[j] += 1
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return links, [rows[find(i)][0] for i in range(len(rows))]


def test_near_join_matches_brute_force(spark, sf, texts):
    got = by_id(near_join.op1_near_join(spark, sf))
    links, classes = brute_join(texts)
    assert len(got) == len(texts)
    for (doc, _), n, c in zip(texts, links, classes):
        assert (got[doc]["n_links"], got[doc]["class_id"]) == (n, c)


def test_near_join_large_group_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words = list(base)
        words[(i * 7) % 80] = f"edit{i}"
        words[(i * 13) % 80] = "other"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    got = by_id(near_join.near_classes(spark.createDataFrame(rows, "doc_id bigint, text string")))
    links, classes = brute_join(rows)
    assert [got[d]["n_links"] for d, _ in rows] == links
    assert [got[d]["class_id"] for d, _ in rows] == classes
    assert sum(r["stays"] for r in got.values()) == len(set(classes))


def test_near_join_odd_rows(odd, empty):
    got = near_join.near_classes(odd).collect()
    assert len(got) == odd.count()
    blank = [r for r in got if r["doc_id"] in (0, 1, 2, 3)]
    assert {r["class_id"] for r in blank} == {0} and {r["n_copies"] for r in blank} == {4}  # and the null id's
    assert near_join.near_classes(empty).count() == 0
    kept = near_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.filter("doc_id = 4").count() == 1


def test_near_join_any_integer_id(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, text), (2, text), (3, "else")], "doc_id int, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_join.near_classes(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_posterior_prunes_by_bayes():
    grid = np.linspace(0, 1, 20001)
    for m, n in ((3, 16), (12, 16), (30, 48)):
        like = grid ** m * (1 - grid) ** (n - m)
        assert near_join.posterior(m, n, 0.8) == pytest.approx(like[grid >= 0.8].sum() / like.sum(), abs=1e-3)
    assert near_join.least_matches(128) < 0.8 * 128


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)]
    got = {r[0]: r[1] for r in near_join.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


# 2 --- subwords

def test_subwords_without_dropout_are_the_models(texts):
    import sentencepiece
    pieces = subwords.Pieces.load(subwords.default_model())
    sp = sentencepiece.SentencePieceProcessor(model_file=subwords.default_model())
    some = [t for _, t in texts] + ["  two  spaces", "tab\there", "漢字 😀", "-" * 90 + "=" * 40]
    got = subwords.encode_texts(pieces, some, [0] * len(some), dropout=0.0)
    assert [x.tolist() for x in got] == sp.encode(some)


def test_subwords_lossless_varied_and_repeatable(odd, empty):
    enc = subwords.encode(odd)
    back = subwords.decode(enc).collect()
    assert all(r["decoded"] == r["text"] for r in back)
    assert enc.columns[:-1] == odd.columns
    again = {(r["doc_id"], r["text"]): r["ids"] for r in subwords.encode(odd.repartition(5)).collect()}
    assert all(again[(r["doc_id"], r["text"])] == r["ids"] for r in back)
    other = {(r["doc_id"], r["text"]): r["ids"] for r in subwords.encode(odd, seed=5).collect()}
    assert other != again
    assert subwords.encode(empty).count() == 0


def test_subwords_heap_is_the_matrix(monkeypatch):
    pieces = subwords.Pieces.load(subwords.default_model())
    some = ["internationalisation of tokenisers, forever and ever", "aaaaaaaaaaaaaaaa bbbb"]
    a = subwords.encode_texts(pieces, some, [1, 2], dropout=0.3)
    monkeypatch.setattr(subwords, "MATRIX_LENGTH", 1)
    b = subwords.encode_texts(pieces, some, [1, 2], dropout=0.3)
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_subwords_vary_by_occurrence():
    pieces = subwords.Pieces.load(subwords.default_model())
    word = "internationalisation"
    got = subwords.encode_texts(pieces, [word] * 400, list(range(400)))
    assert len({tuple(x) for x in got}) > 8  # over documents
    ids = subwords.encode_texts(pieces, [" ".join([word] * 400)], [0])[0].tolist()
    cuts = subwords.decode_ids(pieces, ids), {tuple(ids[i:i + 3]) for i in range(len(ids)) if pieces.texts[ids[i]][:1] == b" "}
    assert cuts[0] == " ".join([word] * 400) and len(cuts[1]) > 8  # and within one


def test_subwords_merged_once_is_one_by_one(monkeypatch, texts):
    pieces = subwords.Pieces.load(subwords.default_model())
    some = [t for _, t in texts[:60]] + ["-" * 90 + " " + "-" * 90, "the the the  the"]
    keys = [7 * i - 100 for i in range(len(some))]
    a = subwords.encode_texts(pieces, some, keys, dropout=0.2)
    monkeypatch.setattr(subwords, "_alike", lambda pieces, points, run, inverse, start, *_: (np.arange(len(start)),) * 2)
    b = subwords.encode_texts(pieces, some, keys, dropout=0.2)
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_subwords_pairs_are_the_models():
    pieces = subwords.Pieces.load(subwords.default_model())
    assert len(pieces.slot_key) >= 4 * len(pieces.keys)
    left, right = pieces.keys >> 32, pieces.keys & 0xFFFFFFFF
    joined, rank = pieces.pairs(left, right)
    assert (joined == pieces.joined).all() and (rank == pieces.ranks).all()
    some = np.random.default_rng(3).integers(0, 32000, (2, 200, 100))
    joined, rank = pieces.pairs(*some)
    known = dict(zip(pieces.keys.tolist(), zip(pieces.joined.tolist(), pieces.ranks.tolist())))
    want = [known.get(k, (-1, int(subwords._NONE))) for k in ((some[0] << 32) | some[1]).reshape(-1).tolist()]
    assert list(zip(joined.reshape(-1).tolist(), rank.reshape(-1).tolist())) == want


def test_subwords_matrix_is_the_heap():
    pieces = subwords.Pieces.load(subwords.default_model())
    rng = np.random.default_rng(7)
    for width in (2, 3, 9, 20):
        rows = pieces.symbol[rng.choice([ord(c) for c in " theraninos"], (300, width))]
        keys = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        for limit in (0, 1 << 21, 1 << 23):
            flat, n = subwords.agenda_matrix(pieces, rows, keys, limit)
            want = [subwords.agenda_heap(pieces, r.tolist(), int(k), limit) for r, k in zip(rows, keys)]
            assert n.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_subwords_decode_in_stretches(monkeypatch):
    pieces = subwords.Pieces.load(subwords.default_model())
    some = ["", "one", "ü ▁ é漢字 😀\x00", "word " * 50]
    ids = subwords.encode_texts(pieces, some, [0] * len(some))
    monkeypatch.setattr(subwords, "DECODED_IDS", 3)  # cuts characters in byte pieces too
    assert [subwords.decode_ids(pieces, x) for x in ids] == some


def test_subwords_long_text_in_segments(monkeypatch):
    pieces = subwords.Pieces.load(subwords.default_model())
    text = "some words  here " * 50
    whole = subwords.encode_texts(pieces, [text], [3])[0]
    assert "".join(subwords.segments(text, 100)) == text
    monkeypatch.setattr(subwords, "segments", lambda t, n=100, f=subwords.segments: f(t, n))
    assert subwords.encode_texts(pieces, [text], [3])[0].tolist() == whole.tolist()


# 3 --- privacy

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_privacy_base_spans(spark, sf, texts):
    got = by_id(privacy.op3_privacy(spark, sf))
    for doc, text in texts:
        assert got[doc]["base_sha256"] == hashlib.sha256(brute_spans(text).encode()).hexdigest()


def test_privacy_tricky_base_spans(spark):
    tricky = ["a@b.com_c@d.org..x@y", "😀 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.03.4", "4111-1111 1111-1111x378282246310005",
              "+1(212)555-1234+44 20 7946 0958 +1((((", "@@a@@b.c a@b..c é@x.y a.@-.-", "1234567890123456789012"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id int, text string")
    got = by_id(df.select("doc_id", privacy.written_out(privacy.base_spans(F.col("text"))).alias("s")))
    assert [got[i]["s"] for i in range(len(tricky))] == [brute_spans(t) for t in tricky]


def test_privacy_terms_follow_disclosure(spark):
    rows = [(i, f"zebra a{0}@ex.com often é Quagga {i}") for i in range(6)] + [(50 + i, "often other words") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = by_id(privacy.annotate(df).select("doc_id", privacy.written_out(F.col("__spans")).alias("s")))
    assert got[0]["s"] == "term:0:5,email:6:15,term:24:30"  # "often" is in other documents too
    clean = by_id(privacy.sanitise(df))
    assert clean[0]["text"] == " [EMAIL] often é  0" and clean[50]["text"] == "often other words"
    # brute force: log(N n(c,t) / (n(c) n(t))) / log(N / n(c))
    some = privacy.annotate(df, threshold=-9.0)
    assert "term:16:21" in by_id(some.select("doc_id", privacy.written_out(F.col("__spans")).alias("s")))[0]["s"]
    assert math.log(86 * 6 / (6 * 86)) / math.log(86 / 6) < privacy.DISCLOSURE


def test_privacy_terms_of_rare_values(spark):
    # each value in one or two documents; the names stand far from it, are short or hold digits
    far = "plain words that all documents have " * 10
    rows = [(0, f"Dear Li, {far}write to li@one.example K9x7 Quagga"), (1, f"an {far}call +1 212 555 1234 zebra Bo"),
            (2, f"bo zebra {far}+1 212 555 1234 or ip 10.1.2.3")]
    rows += [(10 + i, f"an or ip dear call write to {far}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    n, words = len(rows), {d: set(re.findall(r"[^\W_]{2,}", t.lower())) for d, t in rows}
    held = {"li@one.example": {0}, "+1 212 555 1234": {1, 2}, "10.1.2.3": {2}}
    want = {}
    for docs in held.values():
        for t in set.union(*(words[d] for d in docs)):
            n_t, n_ct, p = sum(t in w for w in words.values()), sum(t in words[d] for d in docs), len(docs) / n
            if math.log((n_ct + p) / (n_t + 1) / p) / -math.log(p) > privacy.DISCLOSURE:
                for d in docs:
                    want.setdefault(d, set()).add(t)
    assert want[0] >= {"li", "k9x7", "quagga"} and want[1] >= {"bo", "zebra"} and "call" not in want[1]
    got = by_id(privacy.annotate(df).select("doc_id", "text", "__base", "__spans"))
    for d, text in rows[:3]:
        base = [(s["start"], s["end"]) for s in got[d]["__base"]]
        spans = {(m.start(), m.end()) for m in re.finditer(r"[^\W_]{2,}", text) if m[0].lower() in want[d]
                 and not any(m.start() < b and a < m.end() for a, b in base)}
        assert {(s["start"], s["end"]) for s in got[d]["__spans"] if s["no"] == 4} == spans and spans
    assert not any(got[d]["__spans"] for d, _ in rows[3:])


def test_privacy_many_values_count_pairs_once(spark):
    rows = [(0, " ".join(f"u{i}@a.example" for i in range(300)) + " " + " ".join(f"name{i}" for i in range(300)))]
    df = spark.createDataFrame(rows + [(i, "other words") for i in range(1, 1200)], "doc_id int, text string")
    out = by_id(privacy.annotate(df))
    assert len([s for s in out[0]["__spans"] if s["no"] == 4]) == 300
    some = df.select(F.col("doc_id").alias("rid"), privacy.base_spans(F.col("text")).alias("spans"))
    assert privacy._entity_sets(some).count() == 1  # all 300 values are in one and the same document


def test_privacy_odd_rows(odd, empty):
    out = privacy.sanitise(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    got = {r["text"] for r in out.filter("doc_id = 11").collect()}
    assert got == {"Call [PHONE] or [EMAIL], [CARD]."}
    assert privacy.sanitise(empty).count() == 0


# 4 --- fingerprints

def test_fingerprints_against_brute_force(spark, sf, texts):
    got = by_id(fingerprints.op4_fingerprints(spark, sf))
    for i, (doc, text) in enumerate(texts):
        follow = texts[(i + 1) % len(texts)][1]
        n = len(text) // 4
        changed = text[:len(text) - n] + follow[:n]
        row = got[doc]
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and row["n_chars"] == len(text)
        assert row["fingerprint"] == fingerprints.written_out(fingerprints.fingerprint(text))
        assert row["near_edited"] == fingerprints.containment(fingerprints.fingerprint(text),
                                                              fingerprints.fingerprint(changed))


def test_gear_is_the_running_hash():
    data = bytes(np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8))
    fast, h = fingerprints.gear(np.frombuffer(data, np.uint8)), 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(fingerprints._GEAR[b])) & 0xFFFFFFFF
        assert h & 0xFFFF == int(fast[i]) & 0xFFFF


def test_chunks_resist_shifts():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefgh ij"), 6000))
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint("in front of it " + text)
    assert fingerprints.containment(a, b) > 0.95
    assert b"".join(fingerprints.chunks(text.encode())) == text.encode()
    sizes = [len(c) for c in fingerprints.chunks(text.encode())]
    assert max(sizes) <= fingerprints.MAX_SIZE and min(sizes[:-1]) >= fingerprints.MIN_SIZE


def test_fingerprints_odd_rows(odd, empty):
    got = fingerprints.with_following(odd).collect()
    assert len(got) == odd.count()
    assert {r["fingerprint"] for r in got if r["doc_id"] in (0, 1)} == {""}
    assert fingerprints.with_following(empty).count() == 0
    one = fingerprints.with_following(odd.filter("doc_id = 10")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.add_fingerprint(odd).columns == [*odd.columns, "fingerprint"]


# 5, 6 --- classifiers

def test_toxicity_learns_from_bags_and_locates():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(300)]

    def make(bad):
        lines = [" ".join(rng.choice(words, 8)) + "." for _ in range(6)]
        if bad:
            lines[int(rng.integers(6))] = "such a vileword here."
        return "\n".join(lines)

    labels = [int(i % 3 == 0) for i in range(300)]
    docs = [make(y) for y in labels]
    model = toxicity.Scorer(*toxicity.train(docs[:200], labels[:200], updates=200))
    scores = [model.score(t, 0.5) for t in docs[200:]]
    assert [int(s >= 0.7) for s, _, _ in scores] == labels[200:]
    for t, (s, n, spans) in zip(docs[200:], scores):
        assert all("vileword" in t[a:b] for a, b, _ in spans)
        assert n == 6
    assert model.score(None, 0.5) == (0.0, 0, []) and model.score("\n . ", 0.5)[0] == 0.0


def test_toxicity_query_folds(spark, sf, texts):
    got = by_id(toxicity.op5_toxicity(spark, sf))
    assert len(got) == len(texts)
    for doc, _ in texts:
        row = got[doc]
        assert row["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7)


def test_many_clean_sentences_stay_clean():
    scorer = toxicity.Scorer({toxicity.features("awful")[0]: 14.0}, -9.8)
    clean = "A plain sentence here. " * 1_000_000
    assert scorer.score(clean, 0.5) == (0.0, 1_000_000, [])
    score, n, found = scorer.score(clean[:230] + "This is awful. " + clean[:230], 0.5)
    assert score > 0.9 and n == 21 and len(found) == 1
    assert scorer.score("awful", 0.5)[0] == pytest.approx(1 / (1 + math.exp(-4.2)))


def test_quality_learns_subwords():
    rng = np.random.default_rng(4)

    def make(good):
        words = ["".join(rng.choice(list("aeioubcdlmnrst"), 6)) for _ in range(40)]
        return " ".join(words if good else [w.upper() + "!!" for w in words])

    labels = [int(i % 4 != 0) for i in range(300)]
    docs = [make(y) for y in labels]
    model = quality.Scorer(*quality.train(docs[:200], labels[:200]))
    right = sum(int(model.score(t) >= 0.5) == y for t, y in zip(docs[200:], labels[200:]))
    assert right >= 97
    assert 0 < model.score(None) < 1 and model.score("") == model.score(None)


def test_scores_of_odd_rows(odd, empty):
    tox, val = toxicity.train(["bad word", "good word"] * 5, [1, 0] * 5, updates=5), quality.train(["a b"], [1])
    for df in (odd, empty):
        assert toxicity.score_documents(df, tox).count() == df.count()
        assert quality.score_documents(df, val).columns == [*odd.columns, "quality_score"]
    assert toxicity.train([], []) == ({}, -3.0)


# 7 --- Huffman

def test_code_lengths_are_optimal_and_limited():
    import heapq
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34], np.int64)
    heap = [(int(c), i) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost, k = 0, 100
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k := k + 1))
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost
    short = huffman.code_lengths(counts, 4)
    assert short.max() <= 4 and sum(2.0 ** -n for n in short if n) <= 1


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_pack_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 500
    lengths = huffman.code_lengths(np.bincount(np.append(ids, [0, 1]), minlength=512))
    bits, points = huffman.pack(ids, huffman.canonical_codes(lengths), lengths)
    assert huffman.unpack(bits, n, points, huffman.decode_table(lengths)).tolist() == ids.tolist()


def test_huffman_files(spark, sf, texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(huffman.default_tokenizer())
    got, start = by_id(huffman.op7_huffman(spark, sf)), 0
    for doc, text in texts:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        assert tuple(got[doc]) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_are_the_tokenizers():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(huffman.default_tokenizer())
    words = huffman.Words.load(huffman.default_tokenizer())
    for t in ["Hello, world!! it's ABC's 12.5%% x…, a1?!", "<|endoftext|>. <|ENDOFTEXT|>", "a\x1cb\x85c\xa0d", "́x. 'S. É, ß!"]:
        assert np.frombuffer(words.encode([t])[0], "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_words_of_letters_share_a_call():
    """Letters that the tokenizer takes apart, among words that go to it together."""
    words = huffman.Words.load(huffman.default_tokenizer())
    texts = ["İstanbul ΣΑΣ étÉ Å don't DON'T's x's", "a<|ENDOFTEXT|>b <|endoftext|> <|startoftext|>x", "K Å ﬁ ǅ 漢字 ½ Ⅷ a1b2",
             "... !!! a.. é!! É%% ẞ e\x85f\x1cg", None, ""]
    plain = [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in words.encode(texts)] == plain


def test_words_are_looked_up_once_a_block(monkeypatch):
    words, asked = huffman.Words(huffman.default_tokenizer()), []
    monkeypatch.setattr(words, "_of", lambda ws, f=words._of: asked.append(list(ws)) or f(ws))
    some = ["the cat\x1c, THE\x0bhat.\r", None, " ", "the  hat. \u3000the\x85x"]
    got = [np.frombuffer(x, "<u2").tolist() for x in words.encode(some)]
    assert got == [words.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))


def test_frequent_words_are_kept_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(huffman, "CACHED_WORDS", 40)
    words = huffman.Words(huffman.default_tokenizer())
    for i in range(20):
        text = "the of and " + " ".join(f"word{chr(97 + i)}{chr(97 + k)}" for k in range(10))
        assert np.frombuffer(words.encode([text])[0], "<u2").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(words.ids) <= 40 and (i == 0 or {b"the", b"of", b"and"} <= words.ids.keys())


def test_small_letters_skip_only_what_leaves_them_alone(monkeypatch):
    from tokenizers import normalizers
    words = huffman.Words(huffman.default_tokenizer())
    some = ["".join(x) for x in itertools.product("aehnst", repeat=5)]
    assert words.plain is not None and words._ids(" ".join(some), True).tolist() == words._ids(" ".join(some)).tolist()
    words.tokenizer.normalizer = normalizers.Replace("th", "d")
    assert words._plain() is None
    words.tokenizer.normalizer = normalizers.Lowercase()
    assert words._plain() is not None
    words.tokenizer.add_tokens(["the"])
    assert words._plain() is None


def test_words_are_composed_before_they_are_lowered():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(huffman.default_tokenizer())
    words = huffman.Words.load(huffman.default_tokenizer())
    for pair in ["H\u0331", "T\u0308", "J\u030c", "W\u030a", "Y\u030a"]:  # only their small letters have a composed form
        for t in (f"{pair}amza", f"a {pair}amza, B{pair}", f"{pair}."):
            assert np.frombuffer(words.encode([t])[0], "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_huffman_spreads_a_hot_id(spark):
    rows = [(None, f"null {i}") for i in range(200)] + [(None, "same")] * 200 + [(i, f"text {i}") for i in range(200)]
    blocks, code = huffman.encode_files(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    most = max(len(r["doc_ids"]) for r in blocks.select("doc_ids").collect())
    assert most <= 200 and blocks.select("bucket").distinct().count() >= 6
    got = sorted(map(tuple, huffman.read_ids(blocks, code).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in rows]  # nulls first, then by id
    assert [r[1] for r in got] == list(itertools.accumulate([0, *[r[2] for r in got][:-1]]))


def test_huffman_odd_rows(odd, empty):
    got = huffman.read_ids(*huffman.encode_files(odd)).collect()
    assert len(got) == odd.count()
    assert sorted(r["start"] for r in got)[0] == 0 and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {1}
    assert huffman.read_ids(*huffman.encode_files(empty)).count() == 0


# 8 --- rules

def brute_measure(text):
    text = text or ""
    words = WORD.findall(text)
    seen = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_rules_base_counts(spark, sf, texts):
    got = by_id(rules.op8_rules(spark, sf))
    for doc, text in texts:
        row = got[doc]
        n = brute_measure(text)
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert row["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (row["base_failed"] and row["kept"])


def test_binomial_tail_and_cutoffs():
    assert rules.binomial_tail(2, 10, 0.3) == pytest.approx(
        sum(math.comb(10, i) * 0.3 ** i * 0.7 ** (10 - i) for i in range(3)))
    # 300 documents without a false rejection: (1 - alpha)^300 = 0.0498 at alpha = 0.00995
    assert rules.choose_cutoff([0, 0, 9], 300, 0.01, 0.05) == 2
    assert rules.choose_cutoff([0], 300, 0.0099, 0.05) == 0
    assert rules.choose_cutoff([], 0, 0.01, 0.05) == 0


def test_rules_reject_junk_and_keep_strata_safe(spark):
    good = [(i, "a plain text of ten or more words that differ " + " ".join(f"w{i}x{j}" for j in range(20)), "en") for i in range(2000)]
    junk = [(5000 + i, " ".join(f"v{i}y{j}***" for j in range(20)), "en") for i in range(20)]
    rare = [(9000 + i, " ".join(f"v{i}z{j}***" for j in range(20)), None) for i in range(20)]
    docs = spark.createDataFrame(good + junk + rare, "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in good] + [(None, 1), (1, None)], "doc_id int, quality int")
    got = by_id(rules.judge(docs, labels))
    assert sum(not got[d]["kept"] for d, *_ in good) <= 0.02 * len(good)
    assert not any(got[d]["kept"] for d, *_ in junk)
    assert all(got[d]["kept"] for d, *_ in rare)  # no labels in that stratum, so no cutoff


def test_rules_act_in_small_strata(spark):
    # 240 labelled good documents in each of four strata are enough, 200 are too few
    good = [(1000 * k + i, "a plain text of ten or more words that differ " + " ".join(f"w{i}x{j}" for j in range(20)), s)
            for k, s in enumerate(("a", "b", "c", None)) for i in range(240)]
    junk = [(9000 + k, " ".join(f"v{k}y{j}***" for j in range(20)), s) for k, s in enumerate(("a", "b", "c", None))]
    docs = spark.createDataFrame(good + junk, "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in good], "doc_id int, quality int")
    got = by_id(rules.judge(docs, labels))
    assert [got[d]["kept"] for d, *_ in junk] == [False] * 4 and all(got[d]["kept"] for d, *_ in good)
    few = rules.learn_cutoffs(spark.range(200).select(F.lit("z").alias("stratum"), *[F.lit(0.0).alias(r) for r in rules.RULES]),
                              delta=0.05 / 4).collect()
    assert all(few[0][r] is None for r in rules.RULES)


def test_rules_are_tested_together(spark):
    # 12 of 1,000 good documents are lost to each rule: one is below alpha, two together are not
    names, rows = list(rules.RULES), []
    for i in range(1000):
        values = dict.fromkeys(names, 0.0)
        if i < 24:
            values[names[i // 12]] = 0.5
        rows.append(("en", *values.values()))
    good = spark.createDataFrame(rows, ["stratum", *names])
    cut = rules.learn_cutoffs(good).first()
    lost = sum(any(cut[r] is not None and x > cut[r] for r, x in zip(names, values)) for _, *values in rows)
    steps, counts = {}, []
    for rule, c in rules.SEQUENCE:
        steps[rule] = c
        counts.append(sum(any(x > steps.get(r, 9) for r, x in zip(names, values)) for _, *values in rows))
    passed = rules.choose_cutoff(counts, 1000, rules.ALPHA, rules.DELTA)
    assert {r: cut[r] for r in names if cut[r] is not None} == dict(rules.SEQUENCE[:passed])
    assert lost == 12 and 0 < passed < len(rules.SEQUENCE)


def test_rules_one_procedure_at_any_size(spark):
    """Twice the documents with twice the false rejections walk at least as far."""
    names, far = list(rules.RULES), []
    for n in (700, 1400, 1500, 2800):
        rows = [("en", *[0.5 if i % 100 == 0 and r == names[0] else 0.0 for r in names]) for i in range(n)]
        cut = rules.learn_cutoffs(spark.createDataFrame(rows, ["stratum", *names])).first()
        far.append([rules.SEQUENCE.index((r, cut[r])) if cut[r] is not None else -1 for r in names])
    assert all(a <= b for one, two in zip(far, far[1:]) for a, b in zip(one, two))


def test_rules_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1)], "doc_id int, quality int")
    assert rules.judge(odd, labels).count() == odd.count()
    got = rules.judge(odd.withColumn("_n_words", F.lit("mine")), labels)
    own_columns_stay(got.withColumn("_text", F.lit("own _text")))
    assert got.filter("_n_words = 2000").count() == 1 and got.schema["_n_words"].dataType.typeName() == "long"
    assert rules.judge(empty, labels).count() == 0


# 9 --- mixing

def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_mixing_targets_and_rates(spark, sf):
    got = mixing.op9_mixing(spark, sf).collect()
    sizes, taken, rates = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        rates.setdefault(r["source"], []).append((r["size"], r["rate"]))
        assert r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        largest = max(n for n, _ in rates[s])
        assert abs(taken[s] - t) <= largest  # within one document
        assert sum(n * r for n, r in rates[s]) == pytest.approx(t, rel=1e-5)
        # an exponential tilt: log(rate) is proportional to the size where the cap doesn't hold
        slopes = [math.log(r) / n for n, r in rates[s] if n and r < 2]
        assert not slopes or max(slopes) - min(slopes) < 1e-9
    again = {(r["doc_id"], r["taken"]) for r in mixing.op9_mixing(spark, sf).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_mixing_odd_rows(odd, empty):
    sized = odd.withColumn("size", mixing.word_count(F.col("text")))
    out = mixing.mix(sized)
    assert out.count() == odd.count() and out.filter("copies is null").count() == 0
    assert mixing.mix(empty.withColumn("size", F.lit(1))).count() == 0


def test_mixing_meets_targets_with_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 64)
    rows = [(None, "abc"[i % 3], 10) for i in range(1200)] + [(7, "abc"[i % 3], 10 + i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").repartition(4)
    out = mixing.mix(df, apart=True).collect()
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in out) == collections.Counter(rows)
    taken, target = collections.Counter(), {}
    for r in out:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["copies"] <= 2
    assert all(abs(taken[s] - t) <= 13 for s, t in target.items())
    again = mixing.mix(df.repartition(7), apart=True).collect()
    key = lambda r: (r["doc_id"], r["source"], r["size"], r["copies"])
    assert collections.Counter(map(key, out)) == collections.Counter(map(key, again))
    assert mixing.mix(df.limit(0), apart=True).count() == 0


# 10 --- shards

def test_shards_against_brute_force(spark, sf, texts):
    got = by_id(shards.op10_shards(spark, sf))
    rows = [(r["source"], hashlib.md5(f"{shards.SEED}:{r['doc_id']}".encode()).hexdigest(), str(r["doc_id"]), r["doc_id"])
            for r in got.values()]
    rank, order, n = collections.Counter(), [], collections.Counter(r[0] for r in rows)
    for source, h, key, doc in sorted(rows):
        order.append(((rank[source] + 0.5) / n[source], h, key, doc))
        rank[source] += 1
    total = len(rows)
    first = [-(-i * total // 16) for i in range(17)]
    for g, (*_, doc) in enumerate(sorted(order)):
        shard = g * 16 // total
        assert (got[doc]["shard"], got[doc]["slot"]) == (shard, g - first[shard])
    for doc, text in texts:
        assert got[doc]["size"] == len(text.encode()) + 1 and got[doc]["text_crc32"] == zlib.crc32(text.encode())


def test_shards_match_the_mixture_and_odd_rows(odd, empty, spark):
    big = spark.range(1000).withColumn("source", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "b"))
    out = shards.interleave(big, "source", "id", 8)
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {125}
    hot = [r["count"] for r in out.filter("source = 'hot'").groupBy("shard").count().collect()]
    assert max(hot) - min(hot) <= 3
    got = shards.interleave(odd, "source", "doc_id", 4)
    assert got.count() == odd.count() and set(got.columns) == set(odd.columns) | {"slot"}
    for s, rows in itertools.groupby(sorted((r["shard"], r["slot"]) for r in got.collect()), lambda x: x[0]):
        slots = [x for _, x in rows]
        assert slots == list(range(len(slots)))
    assert shards.interleave(empty, "source", "doc_id").count() == 0


def test_mixing_gives_up_aloud(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 9 + 1) for i in range(60)],
                                 "doc_id int, source string, size int")
    sizes = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
    targets = mixing.source_targets(docs.select("source", "size"))
    with pytest.raises(ValueError, match="after 1 steps"):
        mixing.solve(sizes, targets, steps=1)


def test_shards_keep_places_of_null_ids(spark):
    rows = [(None if i % 2 else i % 5, f"t{i}", "a" if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, text string, source string")
    got = [sorted(map(tuple, shards.interleave(df.repartition(n), "source", "id", 4).collect()), key=repr)
           for n in (1, 5)]
    assert got[0] == got[1]


# pipeline

OWN = ("stratum", "key", "_key", "_copies", "__kid", "__key", "__rid", "__base", "__SPANS", "_text")


def own_columns_stay(df):
    assert {r[0] for c in OWN for r in df.select(F.col(c) == f"own {c}").collect()} <= {True}


def test_stages_keep_columns_of_any_name(spark, odd, empty, tmp_path):
    import corpus_pipeline as pipe
    spark.createDataFrame([(5, 0, 1), (7, 1, 0)], "doc_id bigint, toxic int, quality int").write.parquet(
        str(tmp_path / "labels.parquet"))
    for stage in (pipe.drop_near_copies, pipe.generalise_personal_data, pipe.mix_sources, pipe.drop_toxic):
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns
        own_columns_stay(out)
        none = stage(spark, empty, str(tmp_path))
        assert none.columns == odd.columns and none.count() == 0
    # one row each of the rows repeated wholly, and of the texts without words
    kept = [r["doc_id"] for r in pipe.drop_near_copies(spark, odd, "").select("doc_id").collect()]
    assert kept.count(4) == 1 and kept.count(0) == 1 and not {1, 2, 3} & set(kept)


def test_run_on_odd_tables(spark, odd, empty, tmp_path):
    import corpus_pipeline as pipe
    for name, docs in (("odd", odd), ("empty", empty)):
        at = tmp_path / name
        docs.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(5, 0, 1), (7, 1, 0)], "doc_id bigint, toxic int, quality int").write.parquet(
            str(at / "labels.parquet"))
        out = pipe.run(spark, str(at))
        assert out.columns == [*odd.columns, "ids"]
        assert subwords.decode(out).filter("not (decoded <=> text)").count() == 0
        assert (out.count() == 0) == (name == "empty")


def test_pipeline(spark, sf):
    import corpus_pipeline as pipe
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipe.drop_near_copies(spark, docs, sf)
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    _, classes = brute_join(rows)
    assert {r[0] for r in kept.select("doc_id").collect()} == set(classes) and kept.columns == docs.columns
    clean = pipe.drop_toxic(spark, docs, sf)
    gone = docs.join(clean, "doc_id", "left_anti").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert gone.filter("toxic = 0").count() <= 2 and clean.columns == docs.columns
    out = pipe.run(spark, sf)
    assert out.columns == [*docs.columns, "ids"] and out.count() > 0
    assert subwords.decode(out).filter("not (decoded <=> text)").count() == 0


def test_pipeline_mixing_of_null_and_repeated_ids(spark):
    import corpus_pipeline as pipe
    rows = []
    for i in range(600):  # a third has no id, a third shares few ids, over sources and sizes
        doc = None if i % 3 == 0 else i % 7 if i % 3 == 1 else 1000 + i
        rows.append((doc, " ".join(f"t{i}w{j}" for j in range(1 + i % 40)), "en", ("a", "b", "c", None)[i % 4], 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = pipe.mix_sources(spark, docs, "").collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(text.split())
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 40  # within one document
    copies = collections.Counter(tuple(r) for r in got)
    assert set(copies) <= set(rows) and max(copies.values()) == 2
    again = collections.Counter(tuple(r) for r in pipe.mix_sources(spark, docs.repartition(5), "").collect())
    assert again == copies
