"""License scan, toxicity, quality, personal data, BPE, token files, packing."""

import random
import hashlib
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, messy, texts
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmith.llm import bpe, encoding, license_scan, packing, pii, quality, token_files, toxicity

LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.001"


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.tokenizer_path(name))


def library_ids(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


ODD = ["", "a", "  a", "a  b\n\nc ", "\n", "x <|endoftext|> y", "a  <|endoftext|>  b", "<|startoftext|>q", "\x1c a\x1d", "don't I'll  \t x", "İ Σς ΑΣ", "12a3 c.d... !!", "　a　 b", "a\r\nb", "aaaaaaa ababab"]
FUZZ = st.lists(st.sampled_from([*"abAB '.\n\t1é\u3000ß\U0001f600\x85\x1c", "<|endoftext|>", "n't", "'ll"]), max_size=40).map("".join)


# Encoding.
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoder(name):
    tok, enc = library(name), encoding.CachedEncoder(name, max_entries=50)
    hard = [*ODD, *(x or "" for x in texts())]
    for t in hard:
        assert enc.ids(t) == library_ids(tok, t)
    check_chunks(enc, tok, hard)
    check_chunks(enc, tok, [])
    check_chunks(enc, tok, ["", None])


def check_chunks(enc, tok, docs):
    flat, n = enc.encode(pa.array([x or "" for x in docs], pa.string()))
    want = [library_ids(tok, x) for x in docs]
    assert n.tolist() == [len(x) // 4 for x in want] and flat.astype("<u4").tobytes() == b"".join(want)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_long_texts_in_parts(name, monkeypatch):
    tok, enc = library(name), encoding.CachedEncoder(name)
    for limit in (1, 37, 1000):
        monkeypatch.setattr(encoding._chunks, "__defaults__", (limit,))
        check_chunks(enc, tok, ["a b", "x" * 50, " ".join(f"word{k},  é <|endoftext|>\nz" for k in range(60)), "", "last one"])


@settings(max_examples=60, deadline=None)
@given(FUZZ)
def test_encoders_agree(text):
    want = library_ids(_tok(), text)
    assert _enc().ids(text) == want
    check_chunks(_enc(), _tok(), [text, "a", text])
    assert bpe.coder("byte_bpe_50k.json").encode_batch([text]) == [want]


_CACHE = {}


def _tok():
    return _CACHE.setdefault("tok", library("byte_bpe_50k.json"))


def _enc():
    return _CACHE.setdefault("enc", encoding.CachedEncoder("byte_bpe_50k.json"))


def test_bpe(spark):
    tok = _tok()
    rows = bpe.encode_decode(messy(spark, clash=True)).collect()
    assert len(rows) == len(texts()) + 3
    by_id = {k: t or "" for k, t in enumerate(texts())} | {None: "no id here"}
    for r in rows:
        assert bytes(r["ids"]) == library_ids(tok, by_id[r["doc_id"]]) and r["n_tokens"] * 4 == len(r["ids"])
        assert bytes(r["decoded"]).decode() == by_id[r["doc_id"]]
    assert bpe.encode_decode(empty(spark)).count() == 0


def test_bpe_small_batches():
    coder = bpe.PairIndexBPE(encoding.tokenizer_path("byte_bpe_50k.json"), max_entries=5)
    docs = [t or "" for t in texts()[:-1]] + ODD
    assert coder.encode_batch(docs, piece_limit=3) == [library_ids(_tok(), t) for t in docs]
    assert coder.encode_words([]) == [] and [len(x) for x in coder.encode_words([b"", b"a"])] == [0, 1]


def test_bpe_query(spark):
    from corpusmith.llm.queries import QUERIES

    found = {r["doc_id"]: r for r in QUERIES["op8_bpe"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library_ids(_tok(), r["text"])
        assert found[r["doc_id"]]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert found[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


# Token files.
def test_token_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(messy(spark, clash=True), path, "byte_bpe_50k.json", 2)
    rows = sorted(token_files.token_digest(token_files.read_tokens(spark, path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted([*range(len(texts())), 4, 4, None], key=lambda x: -1 if x is None else x)
    at = 0
    by_id = {k: t or "" for k, t in enumerate(texts())} | {None: "no id here"}
    for r in rows:
        ids = library_ids(_tok(), by_id[r["doc_id"]]) + (2).to_bytes(4, "little")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next((tmp_path / "tokens").glob("part*"))).metadata.row_group(0)
    encodings = {meta.column(k).path_in_schema: meta.column(k).encodings for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["doc_id"] and any("DICTIONARY" in e for e in encodings["tokens.list.element"])
    assert all(meta.column(k).has_column_index for k in range(2))
    token_files.write_tokens(empty(spark), str(tmp_path / "none"), "byte_bpe_50k.json", 2)
    assert token_files.token_digest(token_files.read_tokens(spark, str(tmp_path / "none"))).count() == 0


def test_token_files_query(spark):
    from corpusmith.llm.queries import QUERIES

    found = {r["doc_id"]: r for r in QUERIES["op9_token_files"](spark, SF).collect()}
    at = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = library_ids(_tok(), r["text"]) + (2).to_bytes(4, "little")
        got = found.pop(r["doc_id"])
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert not found


# Packing.
def fewest(lengths, capacity, max_docs, max_cost):
    """Fewest sequences by trying all ways."""
    best = [len(lengths)]

    def put(k, seqs):
        if len(seqs) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(seqs)
            return
        x = lengths[k]
        for s in seqs:
            if len(s) < max_docs and sum(s) + x <= capacity and sum(y * y for y in s) + x * x <= max_cost:
                s.append(x)
                put(k + 1, seqs)
                s.pop()
        put(k + 1, [*seqs, [x]])

    put(0, [])
    return best[0]


def plain_best_fit(lengths, capacity, max_docs, max_cost, weights):
    """Members of each sequence by the same rule, without arrays."""
    seqs = []
    scale = [w / c**2 for w, c in zip(weights, (capacity, max_docs, max_cost), strict=True)]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        x = lengths[i]
        fits = []
        for k, s in enumerate(seqs):
            left = (capacity - sum(lengths[j] for j in s) - x, max_docs - len(s) - 1, max_cost - sum(lengths[j] ** 2 for j in s) - x * x)
            if min(left) >= 0 and 2 * x <= capacity:
                fits.append((sum(w * v * v for w, v in zip(scale, left, strict=True)), k))
        if fits:
            seqs[min(fits)[1]].append(i)
        else:
            seqs.append([i])
    return seqs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 4), st.sampled_from([200.0, 450.0, 900.0]))
def test_packing_against_all_ways(lengths, max_docs, max_cost):
    lengths = [x for x in lengths if x * x <= max_cost] or [1]
    seq, _ = packing.vector_best_fit(np.array(lengths, np.int64), 30, max_docs, max_cost)
    n = len(set(seq.tolist()))
    least = fewest(lengths, 30, max_docs, max_cost)
    assert least <= n <= 2 * least
    plain = plain_best_fit(lengths, 30, max_docs, max_cost, packing.WEIGHTS)
    assert n == len(plain)


def test_packing_query(spark):
    from corpusmith.llm.queries import QUERIES

    tok = library("word_bpe_49k.json")
    ids_of = {r["doc_id"]: library_ids(tok, r["text"]) + bytes(4) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_best_fit_packing"](spark, SF).collect()
    at, by_seq = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == at[r["doc_id"]] == 2048 * r["piece"]
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(ids_of[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: len(v) // 4 for k, v in ids_of.items()} == at
    for places in by_seq.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
        assert len(places) <= packing.MAX_DOCS
    assert len(by_seq) <= -(-sum(at.values()) // 2048) + 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(1, 5))
def test_vector_best_fit(lengths, max_docs):
    a = np.array(lengths, np.int64)
    seq, offset = packing.vector_best_fit(a, 64, max_docs, 64.0**2)
    for s in set(seq.tolist()):
        places = sorted((int(offset[i]), int(a[i])) for i in np.flatnonzero(seq == s))
        assert len(places) <= max_docs and sum(x for _, x in places) <= 64 and sum(x * x for _, x in places) <= 64**2
        assert [p for p, _ in places] == [sum(x for _, x in places[:k]) for k in range(len(places))]
    assert len(set(seq.tolist())) <= len(lengths)


def test_attention_capacity():
    seq, _ = packing.vector_best_fit(np.array([30, 30, 4]), 64, 10, 1000.0)
    assert seq[0] != seq[1]
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([40]), 64, 10, 1000.0)


def test_packing(spark):
    rows = packing.pack_documents(messy(spark, clash=True), capacity=64).collect()
    tok = library("word_bpe_49k.json")
    by_id = {k: t or "" for k, t in enumerate(texts())} | {None: "no id here"}
    copies = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert copies[4] == 3 and len(copies) == len(texts()) + 1
    ids_of = {k: library_ids(tok, t) + bytes(4) for k, t in by_id.items()}
    for r in rows:
        ids = ids_of[r["doc_id"]]
        part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["start"] == 64 * r["piece"] and zlib.crc32(part) == r["ids_crc32"] and (r["length"] == 64 or 4 * r["start"] + len(part) == len(ids))
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 64
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 64) + 3
    assert packing.pack_documents(empty(spark)).count() == 0


# Personal data.
RULES = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in rule.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(p) <= 255 for p in m[0].split(".")), k == 2 and 12 <= len(d) <= 19 and pii.luhn(d), k == 3 and 9 <= len(d) <= 15)[k]:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(["1", "22", "9", ".", "@", "a", "-", " ", "+", "(", "4111111111111111", "1.1.", "x@y.z", "é"]), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_field_adds_spans():
    crf = pii.model()
    for text, want in (
        ("call (555) 123-4567 now", [(5, 19, 3)]),
        ("card 4111.1111.1111.1111 x", [(5, 24, 2)]),
        ("I met 3 people at 5 dot", []),
        ("on 2024-01-02 at 10:30 with v1.2.3", []),
        ("we saw 12 of 300 birds at 7.5 metres", []),
    ):
        base, spans = pii.find_spans(text, crf)
        assert set(base) <= set(spans) and [s for s in spans if s not in base] == want


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 6), st.randoms(use_true_random=False))
def test_best_path(n, r):
    """Dynamic programming against all segmentations."""
    lat = {(i, j): ([], np.array([r.uniform(-3, 2) for _ in range(4)])) for i in range(n) for j in range(i + 1, min(n, i + pii.MAX_CHUNKS) + 1) if r.random() < 0.8}

    def ways(at):
        if at == n:
            yield ()
            return
        yield from ways(at + 1)
        for j in range(at + 1, n + 1):
            if (at, j) in lat:
                for rest in ways(j):
                    for k in range(4):
                        yield ((at, j, k), *rest)

    worth = lambda w: sum(lat[i, j][1][k] for i, j, k in w)
    every = list(ways(0))
    found = pii.best_path(n, lat)
    assert tuple(found) in every and abs(worth(found) - max(map(worth, every))) < 1e-9
    p = pii.SemiMarkovCRF().marginals(n, lat)
    z = sum(np.exp(worth(w)) for w in every)
    for (i, j), q in p.items():
        for k in range(4):
            assert abs(q[k] - sum(np.exp(worth(w)) for w in every if (i, j, k) in w) / z) < 1e-9


def test_hard_texts_are_quick():
    """Texts made to backtrack, or dense with spans, cost no more than their length."""
    crf = pii.model()
    for text in (
        "a@" + "dota" * 40 + "=",
        "a@" + "dota" * 20_000 + "=",
        "x at " + " dot a" * 20_000,
        "a [at] b" + " [ dot" * 20_000,
        "a@" * 20_000,
        "+1" + " (" * 50_000 + "x",
        "1.1.1.1 " * 10_000,
        "4111 1111 1111 1111, " * 3_000,
        "7" * 200_000,
        "at" + " " * 200_000 + "dot 5",
    ):
        began = time.process_time()
        pii.find_spans(text, crf)
        assert time.process_time() - began < 30


def test_field_recall():
    """Spans of held-out generated stretches: most are found, and look-alikes are left alone."""
    crf, hit, missed, false = pii.model(), 0, 0, 0
    for chunks, left, truth in pii.generated(400, seed=1234):
        text = " ".join([left, *chunks]).strip()
        got = {(a, b) for a, b, _ in pii.find_spans(text, crf)[1]}
        at = [len(left) + 1 if left else 0]
        for c in chunks:
            at.append(at[-1] + len(c) + 1)
        want = {pii._trim(text, at[i], at[j] - 1) for i, j in truth}
        touch = lambda x, ys: any(x[0] < y[1] and y[0] < x[1] for y in ys)
        hit += sum(touch(x, got) for x in want)
        missed += sum(not touch(x, got) for x in want)
        false += sum(not touch(x, want) for x in got)
    assert hit >= 0.9 * (hit + missed) and false <= 0.05 * hit


def test_personal_data(spark):
    rows = {r["doc_id"]: r for r in pii.find_personal_data(messy(spark, clash=True)).collect()}
    for k, t in enumerate(texts()):
        assert rows[k]["base"] == pii.joined_spans(plain_spans(t or ""))
    assert [rows[9][c] for c in ("n_email", "n_ip", "n_card", "n_phone")] == [1, 1, 1, 1]
    assert pii.find_personal_data(empty(spark)).count() == 0
    docs = messy(spark, clash=True)
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    r = masked.where("doc_id = 9").first()
    assert r["text"] == "write to [EMAIL] or [PHONE], card [CARD], host [IP]" and r["n_chars"] == len(r["text"])
    assert masked.where("doc_id = 0").first()["text"] is None


def test_pii_query(spark):
    from corpusmith.llm.queries import QUERIES

    found = {r["doc_id"]: r for r in QUERIES["op7_pii"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = plain_spans(r["text"])
        assert found[r["doc_id"]]["base_sha256"] == pii.digest(pii.joined_spans(base))


# Quality.
def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    w = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(w)
    hit = {j for i, x in enumerate(w) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = text.split("\n")
    full = lambda s: re.search(r"[^\x20\x09-\x0D]", s)
    dup = sum(1 for i, x in enumerate(lines) if full(x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #|\n é", max_size=60))
def test_text_counts(text):
    assert quality.text_counts(text)[:5] == plain_counts(text)


def test_rules_are_learned():
    r = np.random.default_rng(0)
    x = r.random((900, 2))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.5)
    rules = quality.learn_rules(x, bad, ["a", "b"])
    hit = np.zeros(len(x), bool)
    for rule in rules:
        c = np.ones(len(x), bool)
        for name, op, cut in rule:
            v = x[:, "ab".index(name)]
            c &= v > cut if op == ">" else v <= cut
        hit |= c
    assert (hit == bad).mean() > 0.97
    assert quality.learn_rules(x, np.zeros(900, bool), ["a", "b"]) == []
    assert quality.learn_rules(np.ones((9, 2)), np.ones(9, bool), ["a", "b"]) == []


def test_any_term_is_pruned():
    """A term that was grown first and tells nothing beside the later ones goes."""
    r = np.random.default_rng(9)
    x = r.integers(0, 20, (3000, 3)) / 20
    bad = (x[:, 1] > 0.6) & (x[:, 2] > 0.6)
    x[:, 0] = np.where(bad & (np.arange(3000) % 3 != 2), 0.9, x[:, 0])  # tells only in the rows to grow on
    for rule in quality.learn_rules(x, bad, ["a", "b", "c"])[:1]:
        assert {name for name, _, _ in rule} <= {"b", "c"} and len(rule) == 2


def test_rules_as_columns(spark):
    """Ordered conditionals against a loop over the rules."""
    r = np.random.default_rng(3)
    names = list(quality.FEATURES)
    for _ in range(3):
        rules = [[(str(r.choice(names)), str(r.choice([">", "<="])), float(r.uniform(0, 3))) for _ in range(int(r.integers(1, 4)))] for _ in range(5)]
        stats = quality.statistics(messy(spark))
        rows = stats.select(*(quality.feature(n).alias(f"f_{n}") for n in names), quality.rejects(rules).alias("rule")).collect()
        for x in rows:
            holds = lambda t: x[f"f_{t[0]}"] > t[2] if t[1] == ">" else x[f"f_{t[0]}"] <= t[2]  # noqa: E731, B023
            assert x["rule"] == next((k for k, rule in enumerate(rules, 1) if all(map(holds, rule))), 0)


def test_quality(spark):
    labels = spark.createDataFrame([], LABELS)
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(messy(spark, clash=True), labels).collect()}
    assert not rows[0]["kept"] and rows[0]["base_failed"] and rows[0]["n_words"] == 0
    assert rows[11]["kept"] and not rows[11]["base_failed"]
    assert rows[4]["base_failed"]  # its windows repeat
    assert quality.quality_verdicts(empty(spark), labels).count() == 0


def test_quality_query(spark):
    from corpusmith.llm.queries import QUERIES

    found = {r["doc_id"]: r for r in QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    marked = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        f = found[r["doc_id"]]
        want = plain_counts(r["text"])
        assert tuple(f[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert f["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (f["kept"] and f["base_failed"])
    good = [found[k] for k, q in marked.items() if q == 1 and not found[k]["base_failed"]]
    bad = [found[k] for k, q in marked.items() if q == 0]
    assert sum(f["kept"] for f in good) >= 0.98 * len(good) and sum(f["kept"] for f in bad) <= 0.1 * len(bad)


# Toxicity.
def test_toxicity_accuracy(spark):
    words = [f"plain{k}" for k in range(300)]
    r = np.random.default_rng(1)
    docs, labels = [], []
    for k in range(1500):
        sents = [" ".join(r.choice(words, 8)) for _ in range(int(r.integers(1, 30)))]
        toxic = int(r.random() < 0.2)
        if toxic:
            sents[int(r.integers(len(sents)))] += f" {r.choice(['vile', 'awful'])}{r.choice(['x', 'ly', 'er'])} thing"
        docs.append((k, ". ".join(sents) + ".", "en", "s", 0))
        labels.append((k, 1, toxic))
    from helpers import DOCS

    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    w, b = toxicity.train(d, lab)
    rows = toxicity.score(d, w, b).withColumn("held_out", toxicity.held_out()).collect()
    held = [x for x in rows if x["held_out"]]
    assert len(held) > 200 and np.mean([(x["score"] >= 0.5) == bool(labels[x["doc_id"]][2]) for x in held]) >= 0.95
    x = next(x for x in held if x["score"] >= 0.5 and labels[x["doc_id"]][2])
    text = docs[x["doc_id"]][1]
    assert re.search("vile|awful", text[x["worst_start"] : x["worst_end"]])
    kept = toxicity.keep_clean(d, w, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {x["doc_id"] for x in rows if x["score"] < 0.5}


def plain_score(text, weights, bias):
    """Noisy-or over sentences without caches or short cuts."""
    miss = 1.0
    for sentence in [x for x in re.split(r"[.!?\n]+", text) if x.strip()] or [""]:
        found = {zlib.crc32(f.encode()) % toxicity.BUCKETS for w in sentence.split() for w in [w.lower().strip(toxicity.STRIP)] for f in [w, *(w[:k] + "~" for k in toxicity.PREFIXES if len(w) > k)]}
        miss *= 1 - 1 / (1 + np.exp(-(bias + sum(weights.get(k, 0.0) for k in found))))
    return 1 - miss


def test_noisy_or(spark):
    r = np.random.default_rng(4)
    weights = {zlib.crc32(w.encode()) % toxicity.BUCKETS: float(r.normal(0, 4)) for w in ("fox", "lazy", "jum~", "quite~", "here", "thin~")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100).unionByName(messy(spark))
    by_id = {}
    for x in docs.collect():
        by_id.setdefault(x["doc_id"], set()).add(round(plain_score(x["text"] or "", weights, -3.0), 9))
    for x in toxicity.score(docs, weights, -3.0).collect():
        assert round(x["score"], 9) in by_id[x["doc_id"]]


def test_likelihood_is_fitted():
    """The fit is no worse than any small step from it."""
    r = np.random.default_rng(6)
    hits = [[sorted(r.choice(5, int(r.integers(1, 4)), replace=False).tolist()) for _ in range(int(r.integers(0, 4)))] for _ in range(80)]
    n = np.array([len(h) + int(r.integers(1, 5)) for h in hits])
    toxic = np.array([int(any(3 in s for s in h)) for h in hits])
    toxic[:5] = 1 - toxic[:5]

    def loss(w, b):
        total = 0.0
        for h, m, y in zip(hits, n, toxic, strict=True):
            z = [b + sum(w[f] for f in s) for s in h] + [b] * (m - len(h))
            score = 1 - np.prod([1 - 1 / (1 + np.exp(-x)) for x in z])
            total -= np.log(max(score if y else 1 - score, 1e-12))
        return total / len(n) + 0.5e-4 * float(np.square(w).sum())

    w, b = toxicity.fit_noisy_or(n, hits, toxic, 5, rounds=2000)
    here = loss(w, b)
    assert here < loss(np.zeros(5), toxicity.BIAS)
    for k in range(6):
        for step in (-0.05, 0.05):
            v = np.append(w, b)
            v[k] += step
            assert here <= loss(v[:5], v[5]) + 1e-4


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], LABELS)
    w, b = toxicity.train(messy(spark, clash=True), none)
    assert w == {}
    one_class = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], LABELS)
    assert toxicity.train(messy(spark), one_class)[0] == {}
    rows = toxicity.score(messy(spark, clash=True), w, b).collect()
    assert len(rows) == len(texts()) + 3 and all(0 <= r["score"] < 0.5 for r in rows)
    assert toxicity.score(empty(spark), w, b).count() == 0 and toxicity.keep_clean(empty(spark), w, b).count() == 0


# Licenses.
def test_patience():
    assert license_scan.longest_increasing([(0, 3), (1, 1), (2, 2), (3, 5)]) == [(1, 1), (2, 2), (3, 5)]
    a, b = "x the big dog ran the end".split(), "the big cat ran the end".split()
    assert license_scan.align(a, b) == [(1, 0), (2, 1), (4, 3), (5, 4), (6, 5)]


def test_scan():
    ready = license_scan.prepared(license_scan.TEMPLATES)
    noise = " ".join(f"w{k}" for k in range(500))
    mit = license_scan.TEMPLATES["MIT"]
    found = license_scan.scan(f"{noise}\n{mit.replace('free of charge', 'at no cost')}\n{noise}", ready)
    assert [f[0] for f in found] == ["MIT"] and 0.9 < found[0][1] < 1
    thin = " ".join(w + (f" zz{k}" if k % 2 else "") for k, w in enumerate(mit.split()))
    assert [f[:3] for f in license_scan.scan(thin, ready)] == [("MIT", 1.0, 0)]
    for name, t in license_scan.TEMPLATES.items():
        assert (name, 1.0) in [(f[0], f[1]) for f in license_scan.scan(f"{noise} {t} {noise}", ready)]
    began = time.process_time()
    license_scan.scan(" ".join(["permission the software to use copy notice and"] * 20_000), ready)
    license_scan.scan((" ".join(mit.split()[:40]) + " ") * 3_000, ready)
    assert time.process_time() - began < 30
    twice = "Released under the MIT License. " + noise + " released under the mit license!"
    assert [(f[0], f[1]) for f in license_scan.scan(twice, ready)] == [("MIT-statement", 1.0)] * 2
    assert license_scan.scan("the of and to a in under version work public license", ready) == []


def patience_counts(a, b):
    """Numbers of matches that patience alignment can give, whichever longest chain of anchors is taken."""
    if not a or not b:
        return {0}
    if a[0] == b[0]:
        return {1 + n for n in patience_counts(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {1 + n for n in patience_counts(a[:-1], b[:-1])}
    anchors = [(a.index(w), j) for j, w in enumerate(b) if a.count(w) == 1 and b.count(w) == 1]
    for size in range(len(anchors), 0, -1):
        chains = [c for c in combinations(anchors, size) if all(x[0] < y[0] for x, y in zip(c, c[1:], strict=False))]
        if chains:
            break
    else:
        return {0}
    out = set()
    for chain in chains:
        edges = [(-1, -1), *chain, (len(a), len(b))]
        totals = {size}
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            totals = {x + y for x in totals for y in patience_counts(a[i + 1 : k], b[j + 1 : m])}
        out |= totals
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=8))
def test_align(a, b):
    got = license_scan.align(a, b)
    assert len(got) in patience_counts(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_license_query(spark):
    from corpusmith.llm.queries import QUERIES

    found = {r["doc_id"]: r["found"] for r in QUERIES["op1_license_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        got = set(filter(None, found[r["doc_id"]].split(",")))
        assert {n for n, t in license_scan.TEMPLATES.items() if t in r["text"]} <= got
    rows = license_scan.scan_licenses(messy(spark, clash=True)).collect()
    assert len(rows) == len(texts()) + 3 and all(r["license"] is None for r in rows)
    assert license_scan.scan_licenses(empty(spark)).count() == 0
    assert license_scan.scan_licenses(messy(spark)).select(F.sum("n_found")).first()[0] == 0


def test_numbers_are_quick():
    """A table of numbers costs about a second in 100,000 characters (ten here, on a busy machine); spans of one key have the same features."""
    crf, r = pii.model(), random.Random(3)
    for text in ("1 " * 50_000, "+1 " * 33_000, " ".join(str(r.randrange(10 ** r.randrange(1, 8))) for _ in range(20_000))):
        began = time.time()
        pii.find_spans(text, crf)
        assert time.time() - began < 10
    seen = {}
    for _ in range(30_000):
        s, left = "".join(r.choices("0123456789 .-+()@a", k=r.randrange(1, 22))), r.choice(["", "tel:", "ip", "x"])
        features = pii.span_features(s, left)
        assert seen.setdefault(pii.span_key(s, left), features) == features


def test_quality_rules_do_not_depend_on_the_order_of_rows(spark):
    """A doc_id that repeats with other texts counts as its least row, in whatever task it stands."""
    r = random.Random(5)
    rows = [(k % 60, " ".join(r.choices(["good", "words", "here", "###", "x"], k=r.randrange(1, 90)))) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    stats = quality.statistics(docs)
    found = [quality.train(s, labels) for s in (stats, stats.repartition(7), stats.orderBy(F.desc("n_words")))]
    assert found[0] == found[1] == found[2]
