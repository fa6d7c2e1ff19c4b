"""PII, byte BPE, tokens, packing against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from studyweave.llm import bpe, packing, pii, rans, token_store  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and double % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_base_spans_fuzzed():
    import random

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@-+ 0123459()\n") for _ in range(rng.randint(0, 40)))
        assert [(a, b, k) for a, b, k in pii.base_spans(text)] == [(a, b, k) for a, _, b, k in plain_spans(text)]


def test_pii(spark, docs, rows, empty):
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        spans = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        n = Counter(s[3] for s in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest())
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert pii.find_personal_data(empty).count() == 0


def test_disclosing_terms(spark):
    held = [(i, f"line {i}\nwrite to zaphod at zaphod.b@example.com about topic{'abcdef'[i]} today\nother words", 0) for i in range(6)]
    copies = [(50 + i, "rare word quux with copy@example.com only once", 0) for i in range(9)]
    rest = [(100 + i, "today other words about write line", 0) for i in range(40)]
    d = spark.createDataFrame(held + copies + rest + [(500, None, 0), (501, "zaphod alone", 0)], "doc_id long, text string, _terms int").withColumnRenamed("_terms", "n_chars")
    d = d.selectExpr("*", "1 as terms", "2 as terms_row", "3 as row", "4 as entity", "5 as line")
    assert {r.entity: r.terms for r in pii.disclosing_terms(d).collect()} == {"email:zaphod.b@example.com": ["zaphod"]}
    assert pii.sanitise_documents(d).columns == d.columns
    clean = {r.doc_id: r.text for r in pii.sanitise_documents(d).collect()}
    assert clean[0].split("\n")[1] == "write to [term] at [email] about topica today" and clean[501] == "zaphod alone" and clean[500] is None
    assert clean[50] == "rare word quux with [email] only once"


def test_disclosing_terms_of_whole_lines(spark):
    import math
    import random

    rng = random.Random(5)
    common = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in "abcdefghijklmnop"]
    people = {f"p{k}@example.com": f"secret{'abcdef'[k]}" for k in range(6)}
    texts = []
    for n, (mail, term) in enumerate(people.items()):
        for _ in range(4 + n):  # the term stands 40 terms from the entity
            far = " ".join(rng.choices(common, k=40))
            texts.append(f"{term} {far} {mail} then {mail} {' '.join(rng.choices(common, k=rng.randint(0, 50)))}\nplain {rng.choice(common)}")
    texts += [" ".join(rng.choices(common, k=12)) for _ in range(300)] + texts[:5]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [line for t in texts for line in t.split("\n")]
    words = {line: set(re.findall(r"[a-z]{3,}", line)) for line in lines}
    n_term = Counter(w for line in lines for w in words[line])
    expected = {}
    for mail in people:
        distinct = {line for line in lines if mail in line}
        content = -math.log2(sum(mail in line for line in lines) / len(lines))
        both = Counter(w for line in distinct for w in words[line])
        if terms := sorted(w for w, n in both.items() if n >= pii.SUPPORT and math.log2(n / len(distinct) * len(lines) / n_term[w]) >= pii.ALPHA * content):
            expected[f"email:{mail}"] = terms
    assert all(term in expected[f"email:{mail}"] for mail, term in people.items())
    assert {r.entity: r.terms for r in pii.disclosing_terms(d).collect()} == expected


def test_long_line_is_linear(spark):
    text = " ".join(f"user{i}@example.com word" for i in range(20_000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.find_personal_data(d).first().n_email == 20_000


def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (64, 16), (7, 3)])
def test_byte_bpe(spark, docs, rows, empty, chunk, overlap):
    enc, texts = library(), {i: t or "" for i, t, *_ in rows}
    small = docs.where("length(text) < 5000 or text is null") if chunk < 1000 else docs
    got = bpe.encode_documents(small, RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()
    assert len(got) == small.count()
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_tables(spark):
    """Short, empty and long texts all pass through chunks, seams and pieces; the pieces make up the texts."""
    from pyspark.sql import functions as F

    texts = {0: "", 1: "short one", 2: "words and more words " * 10, 3: "a" * 200}
    rows = spark.createDataFrame([(k, k, t) for k, t in texts.items()], "row long, doc_id long, text string")
    chunks, pieces, apart = bpe._stitched(bpe._chunked(rows, 40, 12), RANKS, public_tokenizers.PATTERN, 40, 12)
    assert {r.row: r.n for r in chunks.groupBy("row").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 1, 2: 6, 3: 5}
    assert [r.row for r in apart.collect()] == [3]
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.row, r.k)):
        got[r.row] = got.get(r.row, "") + r.piece
    assert got == {k: t for k, t in texts.items() if k != 3}


def test_byte_bpe_seams(spark):
    """Random texts of odd pre-tokens (long runs, contractions, white space at the cuts), cut everywhere."""
    import random

    rng, enc = random.Random(8), library()
    texts = ["".join(rng.choice(["'", "s", "ll", " ", "  ", "\n", "\t ", "word", "12", "!?", "é", "🙂", "a" * 30, " " * 25]) for _ in range(rng.randint(5, 120))) for _ in range(150)]
    got = bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, public_tokenizers.PATTERN, 20, 9).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(texts[r.doc_id]))).encode()).hexdigest()


def word_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(word_ids, "library"):
        word_ids.library = Tokenizer.from_file(WORD)
    return word_ids.library.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_store(spark, docs, rows, empty):
    store = token_store.write_tokens(docs, WORD, end=2)
    got = token_store.read_index(spark, store).collect()
    want = [(i, word_ids(t or "") + [2]) for i, t, *_ in rows]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(x), crc(x)) for i, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert token_store.read_index(spark, token_store.write_tokens(empty, WORD)).count() == 0


def test_rans_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for n in (0, 1, 31, 5000, 700_000):
        tokens = np.minimum(rng.geometric(0.01, n), 900).astype(np.uint16)
        table = rans.Table.of(rans.quantise(np.bincount(tokens, minlength=1 << 16)))
        raw = rans.pack(tokens, np.array([7]), np.array([False]), np.array([n]), table)
        block = rans.Block(raw, table)
        assert (block.tokens() == tokens).all()
        if block.marks:
            assert (block.piece(len(block.marks) - 1) == tokens[(len(block.marks) - 1) * rans.CHECK_STEPS * block.lanes :]).all()
        hurt = bytearray(raw)
        hurt[-1] ^= 1
        with pytest.raises(ValueError):
            rans.Block(bytes(hurt), table)


@pytest.mark.parametrize("group", [60_000, 25])
def test_packing(spark, docs, rows, empty, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    got = packing.pack(docs, WORD, end=1, capacity=64).collect()
    want = sorted(((i is not None, i or 0), k, k * 64, len(x[k * 64 : k * 64 + 64]), crc(x[k * 64 : k * 64 + 64])) for i, t, *_ in rows for x in [word_ids(t or "") + [1]] for k in range(-(-len(x) // 64)))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in got) // 64)
    assert len(bins) <= least * (1 if group > 1000 else 1.02) + 2  # tiny groups leave some room
    assert packing.pack(empty, WORD).count() == 0


def test_every_underfull_bin_is_tried():
    packed = [[70]] * 30 + [[10] * 9] + [[90]] * 9  # thirty that cannot be emptied come before the one that can
    lengths, bins = np.array([k for b in packed for k in b]), np.repeat(np.arange(len(packed)), [len(b) for b in packed])
    got = packing.local_search(lengths, bins, 100)
    assert len(set(got.tolist())) == len(packed) - 1 and np.bincount(got, lengths).max() <= 100


def test_two_for_one_tries_all_pairs():
    rng = np.random.default_rng(4)
    cases = [([50, 10, 20, 30, 35], [0, 1, 1, 1, 1])] + [(rng.integers(5, 60, 12), np.concatenate([[0], rng.integers(1, 4, 11)])) for _ in range(300)]
    for size, home in cases:
        size, home = np.array(size), np.array(home)
        fill = np.bincount(home, size, minlength=4).astype(np.int64)
        room = fill.max() + 3 - fill
        room[0], before = -1, fill.copy()
        possible = [g for a in range(1, len(size)) for b in range(1, a) for g in [size[0] - size[a] - size[b]] if home[a] == home[b] and fill[home[a]] >= fill[0] and 0 < g <= room[home[a]]]
        done = packing._two_for_one(0, 0, size, home, fill, room)
        assert done == bool(possible) and (not done or before[0] - fill[0] == max(possible))


def test_local_search_raises_squares():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 100, 300)
        first = packing.best_fit(lengths, 100)
        after = packing.local_search(lengths, first, 100)
        a, b = (np.bincount(x, lengths) for x in (first, after))
        assert b.max() <= 100 and b.sum() == a.sum() and (b**2).sum() >= (a**2).sum() and (b > 0).sum() <= (a > 0).sum()
