"""Conversation repair, source divergence and MinHash near-dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import empty, messy
from pyspark.sql import functions as F

from corpusmith.llm import common, conversation_repair, divergence, minhash_dedup

CONVERSATIONS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.01"


# Conversations.
def damage(rows):
    """The conversations, and their rows after damage."""
    out = []
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if k == 4 else said(role), "" if k == 1 else re.sub("[.!?]", "", said(text)) if k == 2 else said(text)
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return list(dict.fromkeys(r[0] for r in rows)), out


def after(state):
    return "a" if state == "u" else "u"


def all_cheapest(rows):
    """Least cost and the least of all audits of that cost: every least audit of every state is kept."""

    def merged(ways):
        out = {}
        for state, cost, audits in ways:
            if state not in out or cost < out[state][0]:
                out[state] = (cost, set(audits))
            elif cost == out[state][0]:
                out[state][1].update(audits)
        return out

    def with_insertions(layer):
        ways, now = [(s, *v) for s, v in layer.items()], layer
        for _ in range(3):
            now = merged((after(s), c + 2, {x + "I" for x in a}) for s, (c, a) in now.items())
            ways += [(s, *v) for s, v in now.items()]
        return merged(ways)

    layer = {"": (0, {""})}
    for initial, fault in rows:
        ways = []
        for s, (c, a) in with_insertions(layer).items():
            ways.append((s, c + 3, {x + "D" for x in a}))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if initial == after(s) or initial == "s" and s == "":
                ways.append((initial, c + more, {x + "K" for x in a}))
            ways.append((after(s), c + 2 + more, {x + "R" for x in a}))
        layer = merged(ways)
    last = with_insertions(layer)
    cost = min(last[s][0] for s in ("", "a") if s in last)
    return cost, min(x for s in ("", "a") if s in last and last[s][0] == cost for x in last[s][1])


def rebuilt(rows, audit):
    out, state, left = [], "", iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        state = role[:1] if edit == "K" else after(state)
        out.append((role if edit == "K" else {"u": "user", "a": "assistant"}[state], text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return "\n".join(f"{r}:{t}" for r, t in out)


def repaired(rows):
    convs, hurt = damage(rows)
    out = {}
    for conv in convs:
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in mine if r[1] is not None]
        seen, marks = set(), []
        for _, _, role, text in mine:
            body = text.strip(" \t\n\x0b\x0c\r")
            marks.append((role[:1], "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None))
            seen.add((role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
        n = Counter(f for _, f in marks)
        cost, audit = all_cheapest(marks)
        text = rebuilt([r[2:] for r in mine], audit)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def digest(found):
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return {r[0]: tuple(r)[1:] for r in found.select(*found.columns[:-1], F.sha2(lines.cast("binary"), 256)).collect()}


def test_conversation_query(spark):
    found = {r[0]: tuple(r)[1:] for r in conversation_repair.op11_conversation_repair(spark, SF).collect()}
    rows = common.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert found == repaired([tuple(r) for r in rows])


@pytest.mark.parametrize("segment", [256, 4, 1])
def test_conversations(spark, segment):
    r = random.Random(1)
    texts, roles = [None, "", "a.", "b", "c!", "A . ", " ", "é? ", "x.\n"], [None, "", "user", "assistant", "system", "tool", "user", "Unit"]
    rows = [(c or None, r.choice([None, 0, 1, 2, 3, 4, 5, 9, -3]), r.choice(roles), r.choice(texts)) for c in range(60) for _ in range(r.choice([1, 2, 5, 9, 25]))]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({"place": F.lit(1), "fault": F.lit("x"), "rows": F.lit(2)})
    assert digest(conversation_repair.repair(conversation_repair.damaged(df), segment)) == repaired(rows)


def test_long_conversation(spark):
    rows = [(1, k, ("system", "user", "user", "assistant")[k % 4 if k % 31 else 0], f"text {k % 40}" + ".?! "[k % 4]) for k in range(1500)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    assert digest(conversation_repair.repair(conversation_repair.damaged(df))) == repaired(rows)
    assert conversation_repair.repair(conversation_repair.damaged(df.limit(0))).count() == 0


# Divergence of sources.
def plain_audit(rows, min_docs, k):
    said = [tuple(x or "" for x in r) for r in rows]
    lists = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), lang, source) for t, lang, source in said]
    docs, group, whole, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for terms, lang, source in lists:
        docs[lang].update(set(terms))
        group[lang, source].update(terms)
        whole[lang].update(terms)
        sources[lang].add(source)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, names in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[t] for t in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        of = {s: p(group[lang, s]) for s in names}
        q = p(whole[lang])
        for s in names:
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in names - {s}]
            terms = [(-f(of[s][t], q[t]), t.encode(), t) for t in kept if group[lang, s][t] and of[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
                out += [(lang, s, part, item, -v, n + 1) for n, (v, _, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "k", "block"), [(2, 3, 20_000), (1, 10, 5), (99, 10, 5)])
def test_divergence(spark, monkeypatch, min_docs, k, block):
    monkeypatch.setattr(divergence, "POSTINGS_A_BLOCK", block)
    monkeypatch.setattr(divergence, "PIECE", 30)
    r = random.Random(2)
    words = ["Ab", "aB", "élan", "É", "z9z", "q-r", "中文", "x" * 40, "\x7fdel", "\x80c", *(f"w{c}" for c in "abcdefghijklmnop")]
    rows = [(" ".join(r.choices(words, k=r.choice([0, 1, 5, 40]))), r.choice(["en", "fr", None]), r.choice(["a", "b", None, "é"])) for _ in range(60)]
    rows += [(None, "de", "a"), ("", "de", "b"), ("only here", "xx", "a"), *rows[:5]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "g": F.lit(3), "p": F.lit(4)})
    assert sorted(map(tuple, divergence.audit(df, min_docs, k).collect())) == plain_audit(rows, min_docs, k)


def test_divergence_of_nothing(spark):
    assert divergence.audit(empty(spark)).count() == 0
    assert {r["part"] for r in divergence.audit(messy(spark, clash=True)).collect()} <= {"pair", "term"}


def test_divergence_query(spark):
    rows = [tuple(r) for r in common.table(spark, "/root/testdata/sf0.001", "documents").select("text", "lang", "source").collect()]
    assert sorted(map(tuple, divergence.op12_source_divergence(spark, "/root/testdata/sf0.001").collect())) == plain_audit(rows, 10, 10)


# Near copies.
def plain_set(text, size=5):
    words = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_classes(rows):
    """(doc_id, n_shingles, component_id) by all pairs that share a shingle."""
    sets, where, up = [plain_set(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x]).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                up[root(k)] = root(j)
        for x in s:
            where[x].append(k)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return sorted(((d, len(s), least.get(root(k)) if s else d) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found_classes(df):
    return sorted((tuple(r) for r in minhash_dedup.components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("block", [2048, 64])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    r = random.Random(5)
    words, texts = [f"w{k}" for k in range(3000)], []
    for n, length, rate in ((250, 60, 0.02), (100, 200, 0.02), (100, 100, 0.014), (150, 30, 0.005)):
        base = r.choices(words, k=length)
        texts += [" ".join(r.choice(words) if r.random() < rate else w for w in base) for _ in range(n)]
    texts += [None, "", " ", "a", "a", "A b", "a b", "a  b\n", " ".join(words * 3)]
    rows = [*enumerate(texts), (None, texts[0]), (None, "stands alone"), (3, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "hi", "lo", "n", "body", "rep", "_rep")})
    assert found_classes(df) == near_classes(rows)


def test_near_copies_of_nothing(spark):
    assert minhash_dedup.components(empty(spark)).count() == 0
    df = messy(spark, clash=True)
    assert found_classes(df) == near_classes([(r["doc_id"], r["text"]) for r in df.collect()])


def test_near_copies_query(spark):
    found = minhash_dedup.op13_minhash_dedup(spark, SF).collect()
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:3] for r in found), key=str) == near_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_signature_distances():
    """Places differ as often as the sets do; the chunks' ways find every pair within the distance."""
    r = np.random.default_rng(3)
    for n in (7, 40, 400):
        d = []
        for _ in range(200):
            x = r.integers(0, 1 << 62, n).astype(np.uint64)
            two = [np.delete(x, r.integers(0, n, max(1, n // 15))) for _ in range(2)]
            share = len(np.intersect1d(*two)) / len(np.union1d(*two))
            sig = minhash_dedup.signatures(np.concatenate(two), np.array([len(v) for v in two]))
            d.append((sig[0] != sig[1]).mean() - (1 - share))
        assert abs(np.mean(d)) < 0.01
    distance = minhash_dedup.least_distance()
    ways = minhash_dedup.masks(96, distance)
    for _ in range(2000):
        differ = np.zeros(96, bool)
        differ[r.choice(96, distance, replace=False)] = True
        assert any(not differ[places].any() for _, places in ways)


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_source_divergence", "op13_minhash_dedup"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    from corpusmith.llm.queries import ORACLE_SQL, QUERIES

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ran = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    found = QUERIES[name](spark, sf)
    assert set(found.columns) == set(names)
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(ran.fetchall(), key=str)


def test_sql_of_repair_on_odd_rows():
    import duckdb

    r = random.Random(9)
    texts, roles = [None, "", "a.", "b", "c!", "A . ", " "], [None, "", "user", "assistant", "system", "tool", "user"]
    rows = [(c, r.choice([None, 0, 1, 2, 3, 4, 5, 9]), r.choice(roles), r.choice(texts)) for c in range(80) for _ in range(r.choice([1, 2, 5, 9]))]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {x[0]: x[1:] for x in con.execute(conversation_repair.ORACLE_SQL).fetchall()} == repaired(rows)
