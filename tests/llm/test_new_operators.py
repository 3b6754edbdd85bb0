"""Prefix trie, language-model scores and spelling variants against brute force, and their defined edge cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pyrelake.llm import common, decontaminate, kneser_ney, ngram_join, prefix_trie, queries, spelling

SF = "/root/testdata/sf0.001"
CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, node long, n int"
DOCUMENTS = "doc_id long, text string, n long, word string, bucket int"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, "x", 7) for i, t in enumerate(texts)], DOCUMENTS).repartition(3)


def crc(x):
    return zlib.crc32(str(x).encode())


def check_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    q = con.execute(sql)
    assert [d[0] for d in q.description] == df.columns
    assert sorted(map(repr, q.fetchall())) == sorted(map(repr, map(tuple, df.collect())))


# 11


def trie_brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        base, h = c - int(math.fmod(c, 5)), crc(c) % 9
        built[c] = tuple(own.get(base, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in sorted(built.items()):
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    out = set()
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = sum(1 for p in under if not any(q[: len(p)] == p and len(q) > len(p) for q in under))
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in under)
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(path))
        out.add((convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 3, 4, 5) for r in rows], CONVERSATIONS).repartition(4)
    return prefix_trie.rebuilt_trie(df)


def test_trie_brute(spark):
    """Copies, nulls, ties, repeated rows, negative and missing ids, turnless and long conversations."""
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} of {c % 3} é" if t < 6 else None) for c in [*range(-6, 40), 61, 63] for t in range(c % 13)]
    rows += [(5, None, "system", "first"), (5, None, "system", "first"), (6, None, None, None), (None, 1, "user", "nobody"), (44, 0, "", ""), (7, 3, "b", "x"), (7, 3, "a", "y")]
    rows += [(100, t, "user", "on and on") for t in range(12)] + [(105, t, "user", "on and on") for t in range(12)] + [(200, 0, "user", "long " * 300_000)]
    got = list(map(tuple, trie(spark, rows).collect()))
    assert len(got) == len(set(got))
    assert set(got) == trie_brute(rows)
    check_sql(trie(spark, rows), prefix_trie.ORACLE_SQL, conversations=spark.createDataFrame([(*r, 3, 4, 5) for r in rows], CONVERSATIONS))


def test_trie_empty_and_blocks(spark, monkeypatch):
    assert trie(spark, []).collect() == []
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 20)
    rows = [(c, 0, "user", "same") for c in range(0, 700, 5)]  # all end in one node, but those that take no turn of their own
    assert set(map(tuple, trie(spark, rows).collect())) == trie_brute(rows)


# 12


def text_tokens(t):
    return [*((t or "").encode().lower().split()), "END"]


def kn_brute(texts, order):
    """Probability of a token after a context, straight from the definition."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        w = ["B"] * (order - 1) + text_tokens(t)
        for i in range(order - 1, len(w)):
            counts[order][tuple(w[i - order + 1 : i + 1])] += 1
    raw = {order: counts[order]}
    for k in range(order - 1, 0, -1):
        raw[k] = Counter()
        for g, c in raw[k + 1].items():
            raw[k][g[1:]] += c
        for g, n in Counter(g[1:] for g in raw[k + 1]).items():
            counts[k][g] = raw[k][g] if g[0] == "B" else n
    d = [None] + [kneser_ney.discounts([sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]) for k in range(1, order + 1)]
    vocabulary = {g[0] for g in counts[1]}
    follow = defaultdict(list)
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            follow[g[:-1]].append(c)

    def p(context, w):
        if context is None:
            return 1 / (len(vocabulary) + 1)
        k = len(context) + 1
        lower = p(context[1:] if context else None, w)
        if context not in follow:
            return lower
        c, total = counts[k][(*context, w)], sum(follow[context])
        rest = sum(d[k][min(x, 3) - 1] for x in follow[context])
        return ((c - d[k][min(c, 3) - 1]) if c else 0) / total + rest / total * lower

    return p, raw[1], vocabulary


@pytest.mark.parametrize("order", [2, 3])
def test_lm_brute(spark, order):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60").orderBy("doc_id").collect()]
    texts = [t if t is None else t[:1500] for t in texts] + [None, "", " \t\n", "Of Of of", "of\x0bof\x0c\x1cof", "é É a b", texts[3], texts[3]]
    got = {r["doc_id"]: r for r in kneser_ney.held_out_scores(docs(spark, texts), order).collect()}
    train = [t for i, t in enumerate(texts) if crc(i) % 7 != 2]
    p, raw, vocabulary = kn_brute(train, order)
    n = sum(raw.values())
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = ["B"] * (order - 1) + text_tokens(t)
        own = w[order - 1 :]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 7 == 2, len(own), sum(raw[(x,)] > 0 for x in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((raw[(x,)] + 1) / (n + len(vocabulary) + 1)) for x in own), rel=1e-9)
        want = sum(math.log10(p(tuple(w[j : j + order - 1]), w[j + order - 1])) for j in range(len(own)))
        assert r["score"] == pytest.approx(want, rel=1e-9)
    # Proper probabilities: the vocabulary and one unknown word add up to one after any context.
    for c in [("B",) * (order - 1), tuple(text_tokens(texts[0])[: order - 1]), ("never",) * (order - 1)]:
        assert sum(p(c, x) for x in [*vocabulary, "never seen"]) == pytest.approx(1)


def test_lm_edges(spark, monkeypatch):
    empty = docs(spark, ["x"]).limit(0)
    assert kneser_ney.held_out_scores(empty).collect() == []
    only = next(i for i in range(100) if crc(i) % 7 == 2)
    (row,) = kneser_ney.held_out_scores(docs(spark, ["a b"], only)).collect()  # nothing to learn
    assert (row["train_tokens"], row["n_known"], row["score"], row["base_score"]) == (0, 0, 0, 0)
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a")], "doc_id long, text string")
    assert [r["n_tokens"] for r in kneser_ney.held_out_scores(nameless).orderBy("n_tokens").collect()] == [2, 3, 3]
    # Heavy contexts over several buckets, and pieces, make no difference.
    texts = ["the a the b the c " * 30 + str(i) for i in range(40)] + ["q" * 5000 + " r" * 4000]
    plain = {r["doc_id"]: r for r in kneser_ney.held_out_scores(docs(spark, texts)).collect()}
    p, raw, _ = kn_brute([t for i, t in enumerate(texts) if crc(i) % 7 != 2], 2)
    for i, t in enumerate(texts):
        w = ["B", *text_tokens(t)]
        assert plain[i]["score"] == pytest.approx(sum(math.log10(p((a,), b)) for a, b in itertools.pairwise(w)), rel=1e-9)


def test_lm_tokens(monkeypatch):
    texts = [b"", b"a", b" A b\tc\x0bd\n\n", "Äé x".encode(), b"z" * 300 + b" y", b"a"]
    monkeypatch.setattr(kneser_ney, "PIECE", 1 << 20)
    whole, n = kneser_ney.tokens(texts)
    assert n.tolist() == [len(t.split()) + 1 for t in texts]
    monkeypatch.setattr(kneser_ney, "PIECE", 7)
    cut, m = kneser_ney.tokens(texts)
    assert (whole == cut).all() and (n == m).all()
    words = [w for t in texts for w in [*t.lower().split(), b"END OF TEXT"]]
    assert {a: h for a, h in zip(words, whole.tolist(), strict=True)} == dict(zip(words, whole.tolist(), strict=True))
    assert len(set(whole.tolist())) == len(set(words))


def test_two_deals(spark, monkeypatch):
    """Very many buckets are dealt in two steps with the same result."""
    monkeypatch.setattr(common, "PARTS", 4)
    rows = [(b, bytes([b])) for b in range(30) for _ in range(3)]
    df = common.spread_buckets(spark.createDataFrame(rows, "bucket long, data binary").repartition(3), 30, b"".join)
    got = df.withColumn("part", F.spark_partition_id()).groupBy("bucket").agg(F.countDistinct("part").alias("parts"), F.sum(F.length("data")).alias("n")).collect()
    assert {(r["bucket"], r["parts"], r["n"]) for r in got} == {(b, 1, 3) for b in range(30)}


# 13


def words_brute(texts):
    out = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc(f"{i}:{w}")
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def forms_brute(words):
    near_of = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if near(a, b):
            near_of[a].append(b)
            near_of[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near_of[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near_of[w]), words.get(form[w])))
    return out


def test_spelling_brute(spark):
    stems = ["aaaaaaaa", "abababab", "banana" * 2, "straße×÷ÿ", "Überraschung", "zzzzzzz", "letters", "mississippi"]
    texts = [f"{s} {s[:-1]} {s}x {s[1:]} {s[:3]}q{s[3:]} {s[:4]}Q{s[5:]} " * (1 + k % 3) for k, s in enumerate(stems)]
    texts += [" ".join(s for s in stems for _ in range(40))] * 4 + ["lettersx " * 300 + "lettersxy " * 25 + "lettersxyz " * 2, None, "", "no1 short", "1" * 10, "letters " * 30_000, texts[0]]
    texts += ["ſßabcdefĀ ABCDEFGŸ", "abcdefg", "Abcdefg"]
    got = list(map(tuple, spelling.spelling_variants(docs(spark, texts)).collect()))
    assert len(got) == len(set(got))
    assert set(got) == forms_brute(words_brute(texts))
    assert sum(r[4] for r in got) > 20 and any(r[1] is not None and r[2] != r[1] for r in got)
    check_sql(spelling.spelling_variants(docs(spark, texts)), spelling.ORACLE_SQL, documents=docs(spark, texts))


def test_spelling_on_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(rows)))
    got = set(map(tuple, queries.op13_spelling_variants(spark, SF).collect()))
    assert got == forms_brute(words_brute([r["text"] for r in rows]))


def test_spelling_edges(spark):
    assert spelling.spelling_variants(docs(spark, ["x"]).limit(0)).collect() == []
    assert spelling.spelling_variants(docs(spark, ["short", None])).collect() == []
    assert np.isclose(len(spelling.keys_of("abcdefg", spelling.ranks_of(spark.createDataFrame([("abcdefg", 2)], "word string, n long")))), 24)


def test_spelling_broadcasts_nothing(spark, monkeypatch):
    """Small words make large keys, and small files large tables: no plan may send either through the driver."""
    plans, save = [], common.save

    def seen(df, *base):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, *base)

    for module in (common, spelling):
        monkeypatch.setattr(module, "save", seen)
    got = spelling.variants(spark.createDataFrame([("letters", 30), ("lettersx", 3), ("lettersxx", 2)], "word string, n long")).collect()
    assert {r["word"]: r["root"] for r in got} == {"letters": "letters", "lettersx": "letters", "lettersxx": "lettersxx"}
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


# Earlier operators


@pytest.mark.parametrize("parts", [4096, 3])
def test_no_link_lost_by_folded_keys(spark, monkeypatch, parts):
    """Sets of 80 and 100 that share 80, two of which have one key: they still may link."""

    def folded_keys(ids, texts):
        """The keys that the numbers in a text stand for; 1 and 2 fold into one."""
        keys = [np.array([{b"1": (16 << 32) | 5, b"2": (32 << 32) | 5}.get(w, int(common.mix(np.array([int(w)], np.uint64))[0])) for w in t.split()], np.uint64) for t in texts]
        return np.concatenate(keys), np.repeat(np.arange(len(texts)), [len(k) for k in keys])

    monkeypatch.setattr(common, "PARTS", parts)
    df = docs(spark, [" ".join(map(str, range(1, n + 1))) for n in (80, 100)])
    shared = common.shared_keys(df, folded_keys, 16, distinct=True)
    assert {r["doc_id"]: r["n"] for r in shared.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {0: 80, 1: 80}
    probes = spark.createDataFrame([(0, 80, 0, 1), (1, 100, 1, 1)], "doc_id long, n long, label long, key long")
    assert [tuple(r) for r in ngram_join.meetings(probes, shared, 80).collect()] == [(0, 1)]


def test_decontaminate_repeated_rows(spark):
    """Repeated documents and items change neither verdict nor numbers."""
    q = "A train leaves Anton at 12 o'clock and travels 45 km to Berta in 45 minutes, how fast does the train travel on its way today?"
    items = spark.createDataFrame([(1, q)], "item_id long, text string")
    texts = [q, q.replace("45 km", "70 km").replace("45 minutes", "80 minutes").replace("12", "9"), q.replace("45", "46"), "Nothing. " + q]
    once = sorted(map(tuple, decontaminate.decontaminate(docs(spark, texts), items).collect()))
    twice = docs(spark, texts).union(docs(spark, texts))
    assert once and sorted(map(tuple, decontaminate.decontaminate(twice, items).collect())) == once
    assert sorted(map(tuple, decontaminate.decontaminate(docs(spark, texts), items.union(items)).collect())) == once
