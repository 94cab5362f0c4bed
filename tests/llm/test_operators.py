"""Every operator against plain loops on small tables, and the cases its docstring defines."""

import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftpanel.llm import contamination, jaccard_join, language, licenses, line_dedup, personal_data, piece_sampling, quality, suffix_tree, token_files
from driftpanel.llm import textscan as ts
from driftpanel.llm.bitmap import bitmap, large_bitmap, may_hold
from driftpanel.llm.common import prepared
from driftpanel.llm.lookup import Lookup

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RANDOM = random.Random(7)
VOCABULARY = [f"w{i}" for i in range(60)] + ["der", "été", "Ünïque", "K", "naïve"]


def lowered(text):
    return (text or "").encode().translate(bytes(ts.LOWER))


def sentence(n):
    return " ".join(RANDOM.choice(VOCABULARY) for _ in range(n))


def mutated(text):
    words = text.split(" ")
    k = RANDOM.randrange(len(words))
    return " ".join(RANDOM.choice([words[:k] + ["changed"] + words[k + 1 :], words[:k] + words[k + 1 :], words[:k] + ["new"] + words[k:], words]))


def corpus():
    texts = [sentence(RANDOM.choice([1, 2, 5, 9, 12, 20, 40, 120])) for _ in range(60)]
    texts += [mutated(RANDOM.choice(texts)) for _ in range(120)]
    texts += ["\n".join(RANDOM.choice(texts) for _ in range(RANDOM.randrange(1, 6))) for _ in range(40)]
    texts += ["", None, "   \n\n ", "Foo", "foo", "a\nb\na\n", "x " * 3000, "▁ mark▁", "emoji 😀 text 😀", sentence(2500)]
    return texts


TEXTS = corpus()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, `Key` int"


@pytest.fixture(scope="module")
def docs(spark):
    """Ids tie, rows repeat, ids are null, further columns carry the operators' own names."""
    prepared(spark)
    rows = [(i, t, "en" if i % 3 else None, f"http://h{i % 4}.example.com/a", None, "x", None, i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (7, TEXTS[9], "en", None, 1, None, None, None), (None, TEXTS[3], None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_word_kernel_on_every_class():
    for table, pattern in ((ts.SPACED, SPACED), (ts.ALNUM, ALNUM)):
        found = ts.words(*ts.utf8(pa.array(TEXTS, pa.string())), table)
        expected = [pattern.findall(lowered(t)) for t in TEXTS]
        assert found.counts.tolist() == [len(x) for x in expected]
        seen = {}
        for h, w in zip(found.hashes.tolist(), [w for x in expected for w in x], strict=True):
            assert seen.setdefault(h, w) == w
        assert len(set(seen.values())) == len(seen)


def test_slices_keep_all_rows_and_bound_them():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], ["text"])
    parts = list(ts.slices(iter([batch]), "text", 500))
    assert sum((p.column("text").to_pylist() for p in parts), []) == TEXTS and len(parts) > 20


def test_sequence_hashes():
    hashes = ts.mix(np.arange(1, 30, dtype=np.uint64))
    x = ts.Sequence(hashes)
    at = lambda *v: np.array(v)
    for k in range(3, 20):
        rest = ts.Sequence(np.delete(hashes, k))
        assert x.without(at(2), at(25), at(k))[0] == rest.of(at(2), at(24))[0]


def opposites(order, a, b):
    """Two sequences whose difference as a polynomial is a product of 1 - x^(2^k)."""
    x = [bin(i).count("1") % 2 for i in range(1 << order)]
    return [b if k else a for k in x], [a if k else b for k in x]


def test_long_words_and_lines_that_only_look_alike():
    for order in range(5, 14):
        for letters in (opposites(order, "a", "b"), opposites(order, "\u00e9", "z")):
            found = ts.words(*ts.utf8(pa.array(["".join(x) for x in letters])), ts.SPACED)
            assert found.hashes[0] != found.hashes[1]
        found = ts.words(*ts.utf8(pa.array([" ".join(x) for x in opposites(order, "one", "two")])), ts.SPACED)
        whole = ts.Sequence(found.hashes).of(found.first[:-1], found.first[1:])
        assert whole[0] != whole[1]
    same = ts.words(*ts.utf8(pa.array(["x" + "é" * 500 + " y", "p q\nx" + "é" * 500])), ts.SPACED)
    assert same.hashes[0] == same.hashes[4] and len(set(same.hashes.tolist())) == 4


def test_operators_tell_look_alikes_apart(spark):
    """1,024 letters or words that a polynomial modulo 2^64 can't tell apart."""
    one, two = ("".join(x) for x in opposites(10, "a", "b"))
    three, four = (" ".join(x) for x in opposites(10, "one", "two"))
    texts = [one, two, three, four, three, f"{one}\n{two}\n{one}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["id"]: r["text"] for r in line_dedup.dedup_lines(docs, equal_from=1).collect()}
    assert [kept[i] for i in range(6)] == [one, two, three, four, "", ""]
    rows = {r["doc_id"]: r for r in quality.repetition_coverage(docs).collect()}
    assert rows[5]["n_dup_lines"] == 1
    groups = {r["id"]: r["group_id"] for r in jaccard_join.jaccard_groups(docs.filter("doc_id in (0, 1)"), n=3, percent=90).collect()}
    assert groups == {0: 0, 1: 1}
    items = spark.createDataFrame([(1, one), (2, "unrelated")], "item_id long, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in contamination.decontaminate(docs, items).collect()}
    assert [hits[i] for i in range(6)] == [1, 0, 0, 0, 0, 2]
    known = {r["doc_id"]: r["n_known"] for r in suffix_tree.suffix_tree_scores(docs.filter("doc_id in (0, 1)")).collect()}
    held = [i for i in (0, 1) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert all(known[i] == (1 if i in held else 2) for i in (0, 1))


def test_bitmap_never_loses_a_key(spark):
    keys = ts.mix(np.arange(5000, dtype=np.uint64))
    bits = bitmap(spark.createDataFrame(pd.DataFrame({"k": ts.signed(keys)})), "k")
    assert may_hold(bits, keys).all()
    assert may_hold(bits, ts.mix(np.arange(10**6, 10**6 + 20000, dtype=np.uint64))).mean() < 0.01


def test_large_bitmap_is_the_same(spark):
    keys = ts.mix(np.arange(30_000, dtype=np.uint64))
    rows = spark.createDataFrame(pd.DataFrame({"k": ts.signed(np.concatenate([keys, keys[:100]]))})).repartition(3)
    assert (large_bitmap(rows, "k", 23) == bitmap(rows, "k", 23)).all()
    assert not large_bitmap(rows.limit(0), "k", 23).any()


def test_lookup_finds_each_key_and_no_other():
    keys = np.concatenate([np.arange(40, dtype=np.uint64), ts.mix(np.arange(40, 5000, dtype=np.uint64))])
    found = Lookup(keys)
    assert (found(keys) == np.arange(len(keys))).all()
    assert (found(np.concatenate([np.arange(40, 90, dtype=np.uint64), ts.mix(np.arange(5000, 9000, dtype=np.uint64))])) == -1).all()
    assert (Lookup(keys[:0])(keys) == -1).all()


# 1: language


def test_language_of_held_out_texts(spark):
    words = {"en": "the of and was with there house water".split(), "de": "der und nicht haus wasser schön für über".split(),
             "fr": "le la maison été eau très où être".split()}
    rows = []
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        text = " ".join(RANDOM.choice(words[lang]) for _ in range(30))
        rows.append((i, text, None if i % 5 == 0 else lang, f"https://{lang}.site{i % 2}.{lang}/p"))
    rows += [(1000, "привет мир это другой язык совсем", None, None), (1001, "12 34", "en", None), (1002, None, "en", None), (1003, "", None, None)]
    found = {r["id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i]["language"] == ("en", "de", "fr")[i % 3] and found[i]["kept"] for i in range(300))
    assert not any(found[i]["kept"] for i in (1000, 1001, 1002, 1003))


def test_evidence_beside_the_text_decides_unclear_ones(spark):
    rows = [(i, "aa bb cc " * 5 + ("xx" if i % 2 else "yy"), "de" if i % 2 else "en", f"http://a.host{i % 2}.{'de' if i % 2 else 'com'}/") for i in range(200)]
    rows += [(1000, "aa bb cc", None, "http://b.host1.de/"), (1001, "aa bb cc", None, "http://b.host0.com/"), (1002, "aa bb cc", "de", None)]
    found = {r["id"]: r["language"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (found[1000], found[1001], found[1002]) == ("de", "en", "de")


def test_hosts(spark):
    df = spark.createDataFrame([("HTTPS://user@A.b.Co.uk:80/x?y",), ("src1",), (None,), ("a.b/c",)], "u string")
    assert rows_of(df.select(*language.places(F.col("u")))) == [
        ("a.b.co.uk", "co.uk", "uk"), ("src1", "src1", None), (None, None, None), ("a.b", "a.b", "b")]


def test_language_without_declarations_and_rows(spark, docs, empty):
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["kept"] for r in language.identify(plain).filter("id = 3").collect()} == {True}
    assert language.identify(empty).count() == 0
    assert language.identify(docs, carry=F.struct(*docs.columns)).count() == docs.count()


# 2: token files


def test_token_counts(docs):
    encode = token_files.encoder(token_files.RANKS)
    expected = sorted(((r["doc_id"], len(encode(r["text"] or ""))) for r in docs.collect()), key=key)
    assert sorted(rows_of(token_files.token_counts(docs)), key=key) == expected


def test_very_long_runs(spark, monkeypatch):
    encode = token_files.encoder(token_files.RANKS)
    texts = [f"{a}{white * n}{b}" for a in ("", "word", "x\n") for b in ("", "word", ".", "7", "\u00e9") for white in (" ", "\n", " \t", "\u3000")
             for n in (1, 2, 3, 5, 40)] + ["  a   b    c     ", "a" + " " * 30 + "\x1c" + " " * 30 + "b"]
    plain = [encode(t).tolist() for t in texts]
    monkeypatch.setattr(token_files, "RUNS", re.compile(f"(?<![{token_files.WHITE}])[{token_files.WHITE}]{{2,}}"))
    assert [encode(t).tolist() for t in texts] == plain
    monkeypatch.undo()
    long = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "a" * 1_000_000, "7" * 1_000_000, "." * 1_000_000, " a" * 500_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in token_files.token_counts(docs).collect()}
    assert all(found[i] == len(encode(t)) > 0 for i, t in enumerate(long))


def test_vocabularies_that_do_not_fit(tmp_path):
    for number, says in ((1 << 16, "don't fit"), (token_files.END, "can't end")):
        (tmp_path / "ranks").write_text(f"YQ== 0\nYg== {number}\n")
        with pytest.raises(ValueError, match=says):
            token_files.encoder(str(tmp_path / "ranks"))


def test_documents_across_blocks_and_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 16)
    monkeypatch.setattr(token_files, "GROUP", 3)
    expected, files = [], []
    for name, ended in (("a", True), ("b", False), ("c", True)):
        sizes = [RANDOM.choice([0, 0, 1, 3, 7, 8, 9, 40, 100]) for _ in range(60)] if name != "c" else []
        tokens = []
        for k, n in enumerate(sizes):
            expected.append((name, k, len(tokens), n, ended or k < len(sizes) - 1 or n == 0))
            tokens += [5] * n + [token_files.END]
        if name == "b":
            tokens += [9, 9, 9]
            expected = [(f, k, s, n, True) for f, k, s, n, _ in expected] + [("b", 60, len(tokens) - 3, 3, False)]
        raw = np.array(tokens, "<u2").tobytes()
        (tmp_path / name).write_bytes(raw)
        files.append((name, len(raw)))
    found = token_files.scan_token_files(spark.createDataFrame(files, "file string, size long"), str(tmp_path))
    assert sorted(rows_of(found)) == sorted((f, k, s, n, True if f != "b" or k < 60 else False) for f, k, s, n, _ in expected)


def test_token_counts_of_nothing(empty):
    assert token_files.token_counts(empty).count() == 0


# 3: lines


def test_line_dedup(docs):
    place = lambda r: r["doc_id"] if r["doc_id"] is not None else line_dedup.LAST
    data = docs.collect()
    lines = sorted({(place(r), j, tuple(lowered(x).split())) for r in data if r["text"] is not None for j, x in enumerate(r["text"].split("\n"))})
    lines = [x for x in lines if len(x[2]) >= line_dedup.LEAST_WORDS]
    first, neighbours = {}, defaultdict(set)
    for i, j, w in lines:
        first.setdefault(w, (i, j))
        first[w] = min(first[w], (i, j))
    for w in first:
        for rest in [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))]:
            neighbours[rest].add(w)
    near = {w for w in first for rest in [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))] for v in neighbours[rest]
            if line_dedup.one_edit(list(w), list(v)) and first[v] < first[w]}
    assert near
    expected = []
    for r in data:
        left, equal, close, total = [], 0, 0, 0
        for j, x in enumerate(r["text"].split("\n") if r["text"] is not None else []):
            w = tuple(lowered(x).split())
            long = len(w) >= line_dedup.LEAST_WORDS
            total += long
            if long and (place(r), j) > first[w]:
                equal += 1
            elif long and w in near:
                close += 1
            else:
                left.append(x)
        expected.append((r["doc_id"], None if r["text"] is None else "\n".join(left), total, equal, close))
    found = rows_of(line_dedup.dedup_lines(docs).drop("carry"))
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_one_edit():
    split = lambda a, b: line_dedup.one_edit(list(a), list(b))
    assert split("abc", "abc") and split("abc", "axc") and split("abc", "ac") and split("abc", "abcd") and split("aab", "ab")
    assert not split("abc", "acb") and not split("abc", "a") and not split("abcd", "axyd")


class Held:
    """As a broadcast variable."""

    def __init__(self, value):
        self.value = value


def test_only_earliest_lines_are_read_again(spark):
    texts = ["a b c d e f g h\nother words", "X\na b c d e f g h\n\na b c d e f g h", None, "été a b c d e f g"]
    row = np.array([11, -5, 42, 7])
    spots = line_dedup.place_hash(row[[0, 3]].view(np.uint64), np.zeros(2, int))
    held = bitmap(spark.createDataFrame([(int(x),) for x in ts.signed(spots)], "spot long"), "spot")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(row), pa.array(texts)], ["id", "row", "text"])
    found = [tuple(r.values()) for b in line_dedup.texts_of(Held(held))([batch]) for r in b.to_pylist()]
    assert found == [(1, 11, 0, texts[0].split("\n")[0]), (4, 7, 0, texts[3])]


def test_a_text_is_split_once_for_all_its_lines(spark):
    docs = spark.createDataFrame([(1, "\n".join([f"l{i}" for i in range(300)] + ["l7", "", "l8", "end"]))], "doc_id long, text string")
    found = line_dedup.dedup_lines(docs, equal_from=1)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    row = found.first()
    assert row["text"] == "\n".join([f"l{i}" for i in range(300)] + ["", "end"]) and (row["n_lines"], row["n_equal"]) == (303, 2)


def test_powers_of_runs_of_any_order():
    for n in (5, 1, 40, 7, 333):
        assert ts.run_powers(3, 101, n).tolist() == [pow(3, k, 101) for k in range(n)]


def test_lines_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


# 4: suffix tree


def test_scores(docs):
    data = docs.collect()
    tokens = [[*SPACED.findall(lowered(r["text"])), None] for r in data]
    out = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in data]
    counts = Counter(t for x, held in zip(tokens, out, strict=True) if not held for t in x)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((r["doc_id"], held, len(x), sum(counts[t] > 0 for t in x), n) for r, x, held in zip(data, tokens, out, strict=True)), key=key)
    found = suffix_tree.suffix_tree_scores(docs).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found), key=key) == expected
    base = sorted(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in x) for x in tokens)
    assert np.allclose(sorted(r["base_score"] for r in found), base)


def test_probabilities_of_a_state_add_up(spark):
    texts = [("a b " * 30 + "c " + "a d " * 10,), ("b a b a c",), ("c c c a b",)]
    shape = suffix_tree.Shape(least_context=1e-3, least_string=1e-6, divergence=0.0, evidence=0.0)
    docs = spark.createDataFrame(texts, "text string")
    tree, counts = suffix_tree.grown(docs, shape)
    assert sum(r["n"] for r in counts.collect()) == tree.tokens
    unseen = 1 / (tree.tokens + tree.distinct + 1)
    root = np.append((tree.counts + 1) / (tree.tokens + tree.distinct + 1), unseen)
    assert abs(root.sum() - 1) < 1e-9
    strings, p = tree.strings[0]
    for state, escape in enumerate(tree.states[0]):
        if not np.isnan(escape):
            at = strings((np.full(len(tree.counts), state, np.int64) << suffix_tree.SYMBOL_BITS) | np.arange(len(tree.counts)))
            whole = np.where(at >= 0, p[at], escape * root[:-1])
            assert abs(whole.sum() + escape * unseen - 1) < 1e-9


def test_contexts_help_on_held_out_texts(spark):
    step = {"a": "b", "b": "c", "c": "d", "d": "a"}

    def walk(n):
        out = ["a"]
        for _ in range(n):
            out.append(step[out[-1]] if RANDOM.random() < 0.9 else RANDOM.choice("abcd"))
        return " ".join(out)

    docs = spark.createDataFrame([(i, walk(60)) for i in range(200)], "doc_id long, text string")
    found = suffix_tree.suffix_tree_scores(docs).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert found[1] > 0.6 * found[0]


def tree_of_all_contexts(texts, depth, divergence, evidence):
    """Every context tested and every follower counted, in plain loops; gives log10 of a text's probability."""
    counts = [Counter() for _ in range(depth + 2)]
    for words in texts:
        for k in range(1, depth + 2):
            counts[k].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    total, distinct = sum(counts[1].values()), len(counts[1])
    n, after = {}, {}
    for k in range(2, depth + 2):
        for gram, times in counts[k].items():
            after.setdefault(gram[:-1], {})[gram[-1]] = times
    n = {c: sum(a.values()) for c, a in after.items()}
    escape = {c: len(a) / n[c] for c, a in after.items()}

    def p(context, word):
        if not context:
            return (counts[1][(word,)] + 1) / (total + distinct + 1)
        if context not in after:
            return p(context[1:], word)
        return max(after[context].get(word, 1) - 1, 0) / n[context] + escape[context] * p(context[1:], word)

    kept = set()
    for c, a in after.items():
        gain = sum(times * math.log(p(c, w) / p(c[1:], w)) for w, times in a.items())
        if gain >= evidence and gain >= divergence * n[c]:
            kept.update(c[i:] for i in range(len(c)))

    def score(words):
        out = 0.0
        for i, word in enumerate(words):
            states = [tuple(words[i - k : i]) for k in range(min(i, depth), 0, -1)]
            out += math.log10(p(next((s for s in states if s in kept), ()), word))
        return out

    return score, kept


@pytest.mark.parametrize(("depth", "evidence"), [(1, 5.0), (2, 5.0), (3, 0.1)])
def test_scores_use_every_context_however_rare(spark, depth, evidence):
    words = [f"w{i}" for i in range(300)]
    fixed = [[RANDOM.choice(words) for _ in range(5)] for _ in range(30)]
    texts = [" ".join(w for _ in range(6) for w in (RANDOM.choice(fixed) if RANDOM.random() < 0.5 else [RANDOM.choice(words)])) for _ in range(400)]
    # Far rarer than one in 10,000 tokens, but always followed alike.
    texts += ["x y z"] * 3 + ["the " * 400] * 100 + ["u v"] * 3 + ["", " "]
    held = [i % 7 == 3 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))] + [(999, "x y z unseen x y", True)] * 2,
                                 "doc_id long, text string, h boolean")
    split = lambda t: [*t.split(), None]
    wanted, kept = tree_of_all_contexts([split(t) for t, h in zip(texts, held, strict=True) if not h], depth, 0.005, evidence)
    assert ("x",) in kept and (depth < 2 or any(len(c) == depth for c in kept))
    for share in (0.0, 0.9):  # what the workers hold changes nothing
        found = suffix_tree.suffix_tree_scores(docs, held_out="h", shape=suffix_tree.Shape(depth=depth, least_string=share, evidence=evidence)).collect()
        assert len(found) == len(texts) + 2
        for row in found:
            text = texts[row["doc_id"]] if row["doc_id"] < 999 else "x y z unseen x y"
            assert abs(row["score"] - wanted(split(text))) < 1e-6


def test_what_workers_hold_and_send_is_bounded(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(RANDOM.choice(words) for _ in range(30)) for _ in range(60)] + ["u v x"] * 3 + ["", "u v x"]
    rows = [(i, t, i % 5 == 0) for i, t in enumerate(texts)] + [(None, "u v z", True)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    train = docs.filter("not h").select("text")
    counts = Counter(pair for _, t, h in rows if not h for pair in zip(t.split(), [*t.split()[1:], None]))
    # Strings leave a task as arrays, a row for each bucket, and meet as counts of those seen twice.
    sent = train.coalesce(1).mapInArrow(suffix_tree.followed(2, 7), "bucket int, context array<long>, suffix array<long>, n array<int>").collect()
    assert len(sent) == 7 and sum(sum(r["n"]) for r in sent) == sum(counts.values())
    assert sum(len(r["n"]) for r in sent) == len(counts)
    found = suffix_tree.repeated_strings(train, 2, 7, ()).collect()
    assert sorted(r["n"] for r in found) == sorted(n for n in counts.values() if n > 1)
    # However few strings are held and however many buckets there are, the scores stay.
    shape = {"evidence": 1.0, "divergence": 0.0}
    scored = lambda **more: sorted(map(tuple, suffix_tree.suffix_tree_scores(docs, held_out="h", shape=suffix_tree.Shape(**shape, **more)).collect()), key=str)
    whole = scored()
    monkeypatch.setattr(suffix_tree, "BUCKET", 50)
    tree, *_, often = suffix_tree.planted(train, suffix_tree.Shape(**shape, most_held=5))
    assert len(tree.counts) <= 5 and all(len(p) <= 5 for _, p in tree.strings) and often == sorted(often)
    few = scored(most_held=5)
    assert len(few) == len(rows) and [r[:5] for r in few] == [r[:5] for r in whole]
    assert np.allclose([r[5:] for r in few], [r[5:] for r in whole])


def test_strings_meet_texts_array_by_array():
    known = np.random.default_rng(4).integers(-(1 << 62), 1 << 62, 50_000)
    values = next(suffix_tree.adding(1)([pa.RecordBatch.from_arrays([pa.array(known), pa.array(known % 2 * 0.5), pa.array(known % 7 * 1.0)], ["key", "base", "score"])]))
    sent, wanted = [values], defaultdict(lambda: np.zeros(3))
    for k in range(100):
        rows, keys, times = np.sort(np.arange(10_000) % 20 + 15 * k), np.roll(known, 501 * k)[:10_000] ^ (k % 2), np.arange(10_000) % 3 + 1
        sent.append(suffix_tree.with_nulls(suffix_tree.bucketed(keys.astype(np.uint64), [rows, times, keys], ["row", "times", "key"], 1), suffix_tree.SENT))
        there = np.isin(keys, known)
        for row in np.unique(rows):
            n, key = times[there & (rows == row)], keys[there & (rows == row)]
            if len(n):
                wanted[int(row)] += [n[key % 2 > 0].sum(), (n * (key % 2) * 0.5).sum(), (n * (key % 7)).sum()]
    table = pa.Table.from_batches(sent)
    tracemalloc.start()
    try:
        met = suffix_tree.meeting(1)(table)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    found = defaultdict(lambda: np.zeros(3))
    for row, *sums in zip(*(suffix_tree.gathered(met, c).tolist() for c in ("row", "known", "base", "score")), strict=True):
        found[row] += sums
    assert found.keys() == wanted.keys() and all(np.allclose(found[r], wanted[r]) for r in wanted)
    # Beside the bucket itself, which is mostly the texts' strings.
    assert most < table.nbytes / 2


def test_a_task_holds_one_bucket(spark):
    texts = spark.range(400).selectExpr("concat_ws(' ', transform(sequence(1, 20), i -> hash(id, i))) as text").coalesce(1)
    found = suffix_tree.repeated_strings(texts.union(texts), 2, 40, ())
    per_task = found.groupBy(F.spark_partition_id().alias("task")).agg(F.collect_set(F.shiftrightunsigned("key", 32)).alias("top")).collect()
    assert len(per_task) == 40 and all(len({int(top) * 40 >> 32 for top in r["top"]}) == 1 for r in per_task)


def test_a_task_holds_and_sends_little():
    texts = [" ".join(map(str, row)) for row in np.random.default_rng(5).integers(0, 1 << 40, (2000, 400))]
    batches = pa.table({"text": texts}).to_batches(max_chunksize=1000)
    list(suffix_tree.followed(2, 40)(iter(batches[:1])))
    n, largest = 0, 0
    tracemalloc.start()
    try:
        for sent in suffix_tree.followed(2, 40)(iter(batches)):
            n, largest = n + len(sent["n"].flatten()), max(largest, sent.nbytes)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2000 * 400
    # 16 MB of strings: never sent at once, and held no more than five times while they are put together.
    assert largest < 5 << 20 and most < 80 << 20


def test_workers_give_memory_back_and_get_small_batches(spark):
    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "trim": [os.environ.get("MALLOC_TRIM_THRESHOLD_")]})

    arrays = spark.range(100).coalesce(1).selectExpr("array_repeat(id, 20000) as numbers")
    before = dict(spark.sparkContext.environment)
    with suffix_tree.frugal(spark):
        inside = arrays.mapInArrow(told, "rows long, trim string")
    assert dict(spark.sparkContext.environment) == before
    found = inside.collect()
    assert sum(r["rows"] for r in found) == 100 and len(found) > 2 and all(r["trim"] for r in found)
    assert not any(r["trim"] for r in arrays.mapInArrow(told, "rows long, trim string").collect())


def test_scores_without_training_and_rows(spark, empty):
    held = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, h boolean")
    row = suffix_tree.suffix_tree_scores(held, held_out="h").first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert suffix_tree.suffix_tree_scores(empty).count() == 0


# 5: pieces


def test_round_trip_and_reproducible(docs):
    found = piece_sampling.encode(docs).select("key", "pieces", "lossless").cache()
    assert {r["lossless"] for r in found.collect()} == {True}
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=key)
    assert sorted(rows_of(piece_sampling.decode(found)), key=key) == texts
    again = piece_sampling.encode(docs.repartition(7)).select("key", "pieces", "lossless")
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    other = piece_sampling.encode(docs, seed=1).select("key", "pieces", "lossless")
    assert sorted(map(str, other.collect())) != sorted(map(str, found.collect()))


def test_sampling_follows_the_weights_of_all_paths():
    pieces = piece_sampling.Pieces.load(piece_sampling.MODEL)
    spelled = {bytes(pieces.spelling[pieces.first[i] : pieces.first[i + 1]]): i for i in range(len(pieces.first) - 1) if pieces.first[i + 1] - pieces.first[i]}
    normal = set(pieces.ids[pieces.ids >= 0].tolist())
    table = {b: i for b, i in spelled.items() if i in normal}

    def paths(rest):
        return [((), 1.0)] if not rest else [((table[rest[:k]], *p), pieces.weights[table[rest[:k]]] * w)
                                             for k in range(1, len(rest) + 1) if rest[:k] in table for p, w in paths(rest[k:])]

    n = 40_000
    data, offsets = ts.utf8(pa.array([" there"] * n))
    ids, first = piece_sampling.encoded(data, offsets, np.arange(n, dtype=np.uint64), pieces, 0)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True))
    every = paths(b" there")
    total = sum(w for _, w in every)
    for path, w in every:
        share = w / total
        assert abs(seen[path] / n - share) < 5 * math.sqrt(share / n) + 1e-4
    assert set(seen) <= {p for p, _ in every}


def test_very_long_segments():
    pieces = piece_sampling.Pieces.load(piece_sampling.MODEL)
    data, offsets = ts.utf8(pa.array(["ab" * 3000, "é🦄" * 200, " " * 500 + "x"]))
    ids, first = piece_sampling.encoded(data, offsets, np.arange(3, dtype=np.uint64), pieces, 0)
    back, ends = piece_sampling.decoded(ids, first, pieces)
    assert bytes(back) == bytes(data) and ends.tolist() == offsets.tolist()


def test_pieces_of_nothing(empty):
    assert piece_sampling.encode(empty).count() == 0


# 6: repetition


def shares(words):
    chars = sum(len(w.decode()) for w in words)
    out = []
    for n in quality.GRAM_SHARE:
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        seen = Counter(grams)
        inside = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(n)}
        out.append((n, len(inside), sum(len(words[k].decode()) for k in inside) / max(chars, 1)))
    return out


def test_repetition(docs):
    expected = []
    for r in docs.collect():
        text = r["text"] or ""
        words = SPACED.findall(text.encode())
        chars = [len(w.decode()) for w in words]
        seen, dup, dup_chars = set(), 0, 0
        for x in text.split("\n"):
            if SPACED.search(x.encode()):
                if x in seen:
                    dup, dup_chars = dup + 1, dup_chars + sum(len(w.decode()) for w in SPACED.findall(x.encode()))
                seen.add(x)
        measured = shares(words)
        repeat = next(w for n, w, _ in measured if n == 8)
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        fine = all(s <= quality.GRAM_SHARE[n] for n, _, s in measured) and dup_chars / max(sum(chars), 1) <= quality.LINE_SHARE
        expected.append((r["doc_id"], len(words), sum(chars), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed, not failed and fine))
    found = rows_of(quality.repetition_coverage(docs).drop("gram_share", "line_share"))
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_repetition_of_nothing(empty):
    assert quality.repetition_coverage(empty).count() == 0


# 7: Jaccard join


def grams(text, n):
    words = SPACED.findall(lowered(text))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def groups(data, n, percent):
    sets = [grams(r["text"], n) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(data))]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_groups(docs, n, percent):
    data = docs.collect()
    sets, root = groups(data, n, percent)
    least = {}
    for r, k in zip(data, root, strict=True):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    expected = sorted(((r["doc_id"], len(s), least.get(k) if s else r["doc_id"]) for r, s, k in zip(data, sets, root, strict=True)), key=key)
    found = jaccard_join.jaccard_groups(docs, n=n, percent=percent).select("id", "n_grams", "group_id")
    assert sorted(rows_of(found), key=key) == expected


def test_one_of_each_group_stays(docs):
    data = docs.collect()
    sets, root = groups(data, 5, 80)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    with_words = {k for s, k in zip(sets, root, strict=True) if s}
    assert kept.count() == len(with_words) + sum(not s for s in sets)


def test_chains_of_near_copies_are_one_group(spark):
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each near the next, the ends far apart
        rows.append((i, " ".join(words)))
        words[i * 5] = f"x{i}"
    found = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90)
    assert {r["group_id"] for r in found.collect()} == {0}


def test_needed_and_subsets():
    for percent in (60, 80, 90):
        for s in range(1, 30):
            for t in range(s, 40):
                can = any(100 * i >= percent * (s + t - i) for i in range(s + 1))
                assert (t in jaccard_join.partners(s, percent)) == can
                if can:
                    assert jaccard_join.needed(s, t, percent) == min(i for i in range(s + 1) if 100 * i >= percent * (s + t - i))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(300, 200), (200, 250)]
    found = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in range(100, 140)} == {100} and {found[i] for i in (200, 250, 300)} == {200}


def test_jaccard_of_nothing(empty):
    assert jaccard_join.jaccard_groups(empty).count() == 0
    assert jaccard_join.one_of_each(empty).count() == 0


# 8: contamination


def test_contamination(spark, docs, empty):
    long = [t for t in TEXTS if t and len(ALNUM.findall(lowered(t))) >= 30]
    items = [(i, " ".join(x.split()[3:25])) for i, x in enumerate(long[:8])] + [
        (20, "W1 w2"), (21, "foo"), (22, None), (23, ""), (24, "nothing of the kind at all in here or there or anywhere"), (20, "der été"), (25, long[0])]
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lowered(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    expected = []
    for r in docs.collect():
        w, hit, found = ALNUM.findall(lowered(r["text"])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        expected.append((r["doc_id"], len(w), len(hit), sorted(found)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = rows_of(contamination.decontaminate(docs, bench))
    assert sorted(found, key=key) == sorted(expected, key=key)
    kept = contamination.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not e[2] for e in expected)
    assert contamination.decontaminate(empty, bench).count() == 0
    assert contamination.clean(docs, bench.limit(0)).count() == docs.count()


def test_winnowing_keeps_one_of_every_window():
    values = ts.mix(np.array([RANDOM.randrange(20) for _ in range(300)], np.uint64))
    rows = np.repeat([0, 1, 2], [150, 4, 146])
    chosen = contamination.winnowed(rows, np.arange(300), values, 6)
    for k in range(295):
        if rows[k] == rows[k + 5]:
            least = max(j for j in range(k, k + 6) if values[j] == values[k : k + 6].min())
            assert least in chosen
    assert not set(chosen) & set(range(150, 154))


# 9: personal data


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    digits = re.sub(r"\D", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_personal_data(spark, empty):
    alphabet = ["a", "b.c", "@", "@x.org", ".", "1", "22", "1.2.3.4", "256", " ", "-", "+1", "(", ")", "4111 1111 1111 1111", "5500-0000-0000-0004", "😀", "é", "_", "%", "\n"]
    texts = ["".join(RANDOM.choice(alphabet) for _ in range(RANDOM.randrange(1, 40))) for _ in range(400)]
    texts += [None, "", "1.2.3.4 " * 700, "0001.2.3.4", "9" * 5000, "+" * 300 + "1 (", "a@b.c_d@e.f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in personal_data.digest(personal_data.find_personal_data(docs)).collect()}
    for i, text in enumerate(texts):
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(name, m.group()))
        written = ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)
        assert found[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), text
        assert [found[i][f"n_{name}"] for name in PLAIN] == [sum(s[2] == name for s in spans) for name in PLAIN]
        assert set(filter(None, written.split(","))) <= set(found[i]["spans"].split(","))
    assert personal_data.find_personal_data(empty).count() == 0


def test_checksums_and_context(spark):
    texts = ["bank DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 01", "SSN 123-45-6789", "123-45-6789", "ssn 666-45-6789", "GB82WEST12345698765432"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.find_personal_data(docs)).collect()}
    assert found == {0: "iban:5:32", 1: "", 2: "national_id:4:15", 3: "", 4: "", 5: "iban:0:22"}


def test_context_on_both_sides_and_across_spans(spark):
    texts = ["SSN: 123-45-6789, 987-65-4321", "123-45-6789 (SSN)", "ssn 666-45-6789 123-45-6789", "123-45-6789" + " " * 48 + "ssn", "ssn" + " " * 46 + "123-45-6789",
             "social 123-45-6789 security"]
    texts += ["".join(RANDOM.choice(["123-45-6789", "666-45-6789", "ssn", " ", "  ", " tax id ", " é " * 8, "😀 ", " " * 30, ", "]) for _ in range(RANDOM.randrange(1, 25)))
              for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in personal_data.digest(personal_data.find_personal_data(docs)).collect()}
    near = re.compile(r"\b(?:ssn|social security|national id|tax id)", re.ASCII)
    for i, text in enumerate(texts):
        spans = [m.span() for m in re.finditer(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", text, re.ASCII) if not m.group().startswith("666")
                 and (near.search(text[max(0, m.start() - 48) : m.start()].lower()) or near.search(text[m.end() : m.end() + 48].lower()))]
        assert [x for x in found[i].split(",") if x.startswith("national_id")] == [f"national_id:{a}:{b}" for a, b in spans], text
    assert found[0] == "national_id:5:16,national_id:18:29" and found[1] == "national_id:0:11" and found[3] == found[5] == ""


def test_context_on_both_sides_by_sql(spark):
    """The SQL states the same rule: NEAR characters before and after, across other matches."""
    duckdb = pytest.importorskip("duckdb")
    from driftpanel.llm import oracles

    near = personal_data.NEAR
    texts = ["SSN: 123-45-6789, 987-65-4321", "123-45-6789 (SSN)", "123-45-6789" + " " * (near - 4) + "ssn", "123-45-6789" + " " * (near - 2) + "ssn",
             "ssn" + "." * (near - 3) + "123-45-6789", "ssn" + "." * (near - 2) + "123-45-6789", "é" * 60 + " tax id 123-45-6789 é", "essn 123-45-6789", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = personal_data.digest(personal_data.find_personal_data(docs)).toPandas()
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(enumerate(texts), columns=["doc_id", "text"]))
        stated = db.sql(oracles.private()).df()
    spans = lambda df: dict(zip(df["doc_id"], df["spans"], strict=True))
    assert spans(found) == spans(stated) and spans(found)[0].count("national_id") == 2 and spans(found)[1] != "" and spans(found)[3] == ""


def test_very_long_texts_take_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1.2.3" * 60_000, "+1" + "(" * 300_000, "a@b " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert personal_data.find_personal_data(docs).count() == len(texts)


# 10: licences


def test_licences(spark, empty):
    mit, isc = licenses.TEXTS[0][1], licenses.TEXTS[1][1]
    texts = ["Released UNDER the MIT License.", "cc-by-nc cc by nc cc-by-nc", "Apache License, Version 2.0", f"# {mit.title()} #", mit.replace("hereby", "surely"),
             f"{isc}\n{mit}", "nothing", "", None, "license " * 2000, "mit der hand", "under the mit", *[f"filler text number {i}" for i in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.digest(licenses.scan_licenses(docs)).collect()}
    for i, text in enumerate(texts):
        words = [w.decode() for w in ALNUM.findall(lowered(text))]
        at = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert found[3]["labels"] == "mit-text" and found[4]["labels"] == "" and found[5]["labels"] == "isc-text,mit-text"
    assert found[9]["labels"] == "" and found[6]["score"] == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_licences_that_most_files_hold(spark):
    mit = licenses.TEXTS[0][1]
    docs = spark.createDataFrame([(i, f"{mit} file {i}" if i % 4 else "nothing") for i in range(12)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.digest(licenses.scan_licenses(docs)).collect()}
    assert all(found[i]["labels"] == ("mit-text" if i % 4 else "") for i in range(12))
    # What stands beside a file doesn't change its labels.
    assert licenses.digest(licenses.scan_licenses(docs.filter("doc_id = 1"))).first()["labels"] == "mit-text"


def test_all_licences_of_a_file(spark):
    notices = "\n\n".join(text for _, text, _ in licenses.TEXTS)
    texts = [notices, *["released under the mit license"] * 30, *[f"filler text number {i}" for i in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.digest(licenses.scan_licenses(docs)).collect()}
    labels = sorted({label for label, _, _ in licenses.TEXTS} | {"mit", "apache-2"})
    assert found[0]["labels"] == ",".join(labels)
    assert found[1]["labels"] == "mit,mit-notice" and found[40]["labels"] == ""


def test_places_reject_texts_whose_phrases_stand(spark):
    """Against SQL without an index: whole, edited, cut and shuffled licence texts."""
    duckdb = pytest.importorskip("duckdb")
    from driftpanel.llm import oracles

    rng = np.random.default_rng(5)
    mit = licenses.TEXTS[0][1]
    a, b = licenses.TEXTS[0][2]
    picnic = f"{b} said the invitation to our picnic and {a} the lemonade will be served until the bottles are empty"
    texts = [picnic, f"{a} {b}", mit, f"x {mit} y", "", None, "MİT " + mit, "é " + mit.upper(), "license the software " * 3000]
    for _, text, _ in licenses.TEXTS:
        words = text.split()
        texts.append(" ".join(words))
        for _ in range(6):
            edited = list(words)
            for _ in range(rng.integers(1, 6)):
                at = int(rng.integers(0, len(edited)))
                match rng.integers(0, 3):
                    case 0:
                        edited[at] = "other"
                    case 1:
                        edited.insert(at, "more")
                    case _:
                        del edited[at]
            texts.append(" ".join(edited))
        texts.append(" ".join(words[: len(words) // 2]))
        texts.append(" ".join(rng.permutation(words)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = licenses.digest(licenses.scan_licenses(docs)).toPandas().sort_values("doc_id")
    with duckdb.connect() as db:
        db.register("documents", pd.DataFrame(enumerate(texts), columns=["doc_id", "text"]))
        stated = db.sql(oracles.license_texts()).df().sort_values("doc_id")
    for column in stated.columns:
        assert list(found[column].fillna(-1)) == list(stated[column].fillna(-1)), column
    labels = list(found["labels"])
    assert labels[:4] == ["", "", "mit-text", "mit-text"] and labels[6:9] == ["mit-text", "mit-text", ""]


def test_indexed_words_are_enough():
    """However common a word is: any `needed` places of a text hold VOTES indexed ones."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        index = licenses.index_of({w: int(rng.integers(0, 9)) for w in licenses.VOCABULARY})
        for t, (_, text, _) in enumerate(licenses.TEXTS):
            places = {p for postings in index.values() for u, p in postings if u == t}
            assert licenses.needed(text) - (len(text.split()) - len(places)) >= licenses.VOTES


def test_rare_languages_and_tags(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 200)
    fi = "talossa asuu vanha mies joka kertoo lapsille tarinoita"
    en = "the old man of the house tells a story to the children number"
    rows = [(i, f"{en} {i}", ("en", "EN", "en-US", " en_GB ")[i % 4], "https://a.example.com") for i in range(4000)]
    rows += [(9000 + i, f"{fi} {i} kertaa", "fi", f"https://{i}.lehti.fi/x") for i in range(3)]
    rows += [(9100, fi, None, "https://uusi.fi"), (9101, "zzqx vvkj qqwz", "no idea", None), (9102, f"{en} x", "not-a-tag-of-anything", None)]
    found = {r["id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i]["language"] == "en" and found[i]["kept"] and found[i]["declared"] == rows[i][2] for i in range(4000))
    assert [found[i]["language"] for i in (9000, 9001, 9002, 9100)] == ["fi"] * 4 and found[9100]["kept"]
    assert not found[9101]["kept"] and found[9102]["language"] == "en"


def test_tags(spark):
    said = ["en", "EN-us", " pt_BR", "zh-Hant-TW", "deu", "english", "", "e", "12", None, "no idea", "x-klingon"]
    df = spark.createDataFrame([(x,) for x in said], "x string")
    assert [r[0] for r in df.select(language.tag_of(F.col("x"))).collect()] == ["en", "en", "pt", "zh", "deu", *[None] * 7]


def test_posterior_by_plain_loops(spark):
    words = {"en": "the house and of story children tells man", "de": "das haus und von kinder erzaehlt mann alte", "nl": "het huis en van kinderen vertelt man oude"}
    rng = random.Random(3)
    rows = []
    for i in range(90):
        name = rng.choice(["en", "en", "de", "nl"])
        text = " ".join(rng.choice(words[name].split() + ["man", "story"]) for _ in range(rng.randint(1, 6)))
        said = rng.choice([name, name, None, "en", "xx1"])
        place = rng.choice([f"https://{rng.choice('ab')}.site.{name}/p", f"http://user@shop.site.{name}:80?q", "books", None])
        rows.append((i, rng.choice([text, text, text.upper(), "", None]), said, place))
    found = {r["id"]: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}

    def grams(text):
        raw = [b if 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in (text or "").encode()]
        return [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16 for a, b, c in zip(raw, raw[1:], raw[2:]) if b != 32 and (a != 32 or c != 32)]

    tag = {i: said if said in words else None for i, _, said, _ in rows}
    langs = sorted({t for t in tag.values() if t})
    counts = {k: Counter(g for x in rows if tag[x[0]] == k for g in grams(x[1])) for k in langs}
    every = Counter()
    for c in counts.values():
        every.update(c)
    total = sum(every.values()) + 0.05 * 65536

    def likelihood(text):
        found = grams(text)
        return [sum(math.log(0.9 * counts[k][g] / max(1, sum(counts[k].values())) + 0.1 * (every[g] + 0.05) / total) for g in found)
                * min(1, 200 / max(1, len(found))) for k in langs]

    def normal(logs):
        p = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(p) for x in p]

    def split(place):
        host = {"https": "", "http:": ""}.get((place or "")[:5]) is not None and place.split("//")[1].split("/")[0].split("?")[0].split("@")[-1].split(":")[0] or place
        return (host, ".".join(host.split(".")[-2:]), host.split(".")[-1] if "." in host else None) if host else (None, None, None)

    soft = {i: normal(likelihood(text)) if grams(text) else [0.0] * len(langs) for i, text, _, _ in rows}
    where = {i: split(place) for i, _, _, place in rows}
    add = lambda ids: [sum(soft[i][k] for i in ids) for k in range(len(langs))]
    top = [x + 1 for x in add(soft)]
    top = [x / sum(top) for x in top]
    toward = lambda n, above: [(x + 20 * q) / (sum(n) + 20) for x, q in zip(n, above)]
    said = {t: [x + 0.5 for x in add([i for i in tag if tag[i] == t])] for t in langs}
    for i, text, _, _ in rows:
        logs = likelihood(text)
        host, domain, suffix = where[i]
        if host is None:
            logs = [x + math.log(q) for x, q in zip(logs, top)]
        else:
            of = lambda k, v: add([j for j in where if where[j][k] == v])
            by_host = toward(of(0, host), toward(of(1, domain), top))
            by_suffix = toward(of(2, suffix), top) if suffix else top
            logs = [x + math.log(h) + math.log(s / q) for x, h, s, q in zip(logs, by_host, by_suffix, top)]
        if tag[i]:
            logs = [x + math.log(said[tag[i]][k] / sum(said[t][k] for t in langs)) for k, x in enumerate(logs)]
        p = normal(logs)
        assert found[i]["posterior"] == pytest.approx(max(p), abs=1e-6), rows[i]
        assert found[i]["language"] == langs[p.index(max(p))] and found[i]["kept"] == (bool(grams(text)) and max(p) >= 0.5 and sum(
            every[g] > 0 for g in grams(text)) >= 0.5 * len(grams(text)))
