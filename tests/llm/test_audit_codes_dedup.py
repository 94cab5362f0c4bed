"""Source audit, vector codes and exact deduplication against plain loops, and the cases their docstrings define."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftpanel.llm import exact_dedup, piece_sampling, source_audit, vector_codes
from driftpanel.llm.queries import ORACLES, QUERIES

RANDOM = random.Random(11)
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def test_terms():
    for text in ("", "  ", "Été K9x-Ünïq_ue\tA\x00b\x7fc", "日本 語A", "x" * 100_000, " a"):
        raw = text.encode()
        assert source_audit.terms_of(raw) == TERM.findall(raw.translate(LETTERS))


def audit(rows, least, ranks=50):
    rows = [tuple("" if v is None else v for v in row) for row in rows]
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(t.decode() for t in TERM.findall(text.encode().translate(LETTERS)))
        counts[lang, source] += found
        documents[lang].update(found.keys())
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = sorted({r[1] for r in rows if r[0] == lang}, key=str.encode)

        def shares(of):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def audit_rows():
    words = [f"Term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["été", "Été", "日本"]
    rows = []
    for i in range(300):
        source = RANDOM.choice(["a", "b", "c", "é", None, "big", "big", "big"])
        text = " ".join(RANDOM.choice(words[: 20 + 10 * len(source or "")]) for _ in range(RANDOM.randrange(0, 60)))
        rows.append((RANDOM.choice(["en", "en", "de", None]), source, text))
    rows += [rows[0]] * 40 + [("en", "only nulls", None), ("xx", "alone", "once"), ("yy", "a", "rare"), ("yy", "b", None), ("", "a", "1 2 3")]
    return rows + [("en", "long", "word " * 300_000 + "x" * 1_000_000)]


SCHEMA = "lang string, source string, text string, term string, `no` int, value string, `rank` int"


@pytest.mark.parametrize("blocks", [(128, 1024), (2, 8)])
def test_audit(spark, monkeypatch, blocks):
    rows = audit_rows()
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", blocks[0])
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", blocks[1])
    docs = spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], SCHEMA).repartition(3)
    found = sorted(tuple(r) for r in source_audit.audit_sources(docs, least_documents=12).collect())
    assert found == audit(rows, 12)
    assert any(r[2] == "term" for r in found)


def test_audit_moves_its_sums_once(spark):
    counts = spark.createDataFrame(
        [("en", "a", "x", 2, 1), ("en", "a", "x", 1, 1), ("en", "b", "x", 4, 2), ("en", "b", "y", 9, 3), ("de", "a", "x", 1, 3)],
        "lang string, source string, term string, n long, documents long")
    kept = source_audit.kept_counts(counts, 4)
    assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in kept.collect()) == [("en", "a", "x", 3, 7, True), ("en", "b", "x", 4, 7, False)]


def test_audit_without_kept_terms_or_rows(spark):
    docs = spark.createDataFrame([("en", "a", "one"), ("en", "b", "two")], "lang string, source string, text string")
    found = sorted(tuple(r) for r in source_audit.audit_sources(docs).collect())
    assert found == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert source_audit.audit_sources(docs.limit(0)).isEmpty()


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 3)
    monkeypatch.setattr(source_audit, "SENT", 2)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["a", "a", "b", "a"], "text": ["x y z x", "x w", "x", ""]})
    sums = Counter()
    for part in source_audit.count_terms(iter([batch])):
        assert part.num_rows <= 2
        for r in part.to_pylist():
            sums[r["source"], r["term"], "n"] += r["n"]
            sums[r["source"], r["term"], "documents"] += r["documents"]
    assert sums["a", "x", "n"] == 3 and sums["a", "x", "documents"] == 2 and sums["b", "x", "n"] == 1


def nearest(book, vector):
    return min((sum((int(a) - int(b)) ** 2 for a, b in zip(entry, vector, strict=True)), k) for k, entry in enumerate(book))


def quantised(rows, parts, entries, rounds, scale=256):
    """Codes and codebooks by comparing everything with everything."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(order[0][1]) // parts
    cut = [[[int(np.floor(scale * np.float64(x))) for x in r[1][p * width : (p + 1) * width]] for p in range(parts)] for r in order]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(books[p], c[p])[1]].append(c[p])
            books[p] = [[sum(column) // len(members[k]) for column in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    found = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    return [(r[0], r[2], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(order, found, strict=True)], books


VECTORS = "vec_id long, embedding array<float>, label int, id string, code string"


def vector_rows(n, length, spread=1.0):
    numbers = np.random.default_rng(5)
    values = numbers.normal(0, spread, (n, length)).astype(np.float32)
    values[n // 2 : n // 2 + 20] = values[0]  # repeated vectors, so entries tie
    values[:, 0] = np.round(values[:, 0])
    return [(i if i % 50 else i // 2, tuple(float(x) for x in v), None if i % 7 == 0 else i % 3) for i, v in enumerate(values)]


@pytest.mark.parametrize(("spread", "entries"), [(0.2, 64), (0.01, 16), (1e12, 8)])
def test_codes(spark, spread, entries):
    rows = vector_rows(400, 32, spread)
    rows += [(None, rows[3][1], 1), rows[9], rows[9]]
    broken = [(-1, None, 1), (-2, (), 1), (-3, (float("nan"), *rows[0][1][1:]), 1), (-4, (float("inf"), *rows[0][1][1:]), 1), (10**6, rows[0][1][:16], 1), (10**6, rows[0][1][:31], 1)]
    data = [(*r, "x", None) for r in rows + broken] + [(-5, [None, *rows[0][1][1:]], 2, "x", None)]
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    codes, books = vector_codes.compress(df, entries=entries)
    wanted, wanted_books = quantised(rows, 16, entries, 2)
    assert [[list(map(int, e)) for e in part] for part in books] == wanted_books
    found = [tuple(r) for r in codes.select("id", "label", "code", "error").collect()]
    limit = vector_codes.LONG
    assert sorted(found, key=repr) == sorted([(*w[:3], min(w[3], limit)) for w in wanted], key=repr)


def test_search_is_exact():
    numbers = np.random.default_rng(3)
    for size, width, spread in ((1, 2, 5), (2, 1, 3), (64, 4, 4), (64, 4, 90), (200, 3, 6)):
        books = numbers.integers(-spread, spread + 1, (3, size, width))
        queries = numbers.integers(-spread, spread + 1, (500, 3, width))
        code, gap = vector_codes.Orchard(books)(queries)
        for q, c, g in zip(queries, code, gap, strict=True):
            assert [nearest(books[p], q[p]) for p in range(3)] == list(zip(g, c, strict=True))


def test_search_skips_most_entries(monkeypatch):
    numbers = np.random.default_rng(3)
    books = numbers.integers(-5000, 5000, (1, 64, 2))
    search = vector_codes.Orchard(books)
    compared = []
    count = np.ndarray.sum
    queries = numbers.integers(-5000, 5000, (1000, 1, 2))
    seen = np.zeros
    monkeypatch.setattr(vector_codes.np, "zeros", lambda *a, **k: compared.append(seen(*a, **k)) or compared[-1])
    search(queries)
    marks = next(x for x in compared if x.dtype == bool)
    assert count(marks) < 0.35 * marks.size


def test_codes_of_few_or_no_vectors(spark):
    rows = [(i, tuple(float(x) for x in range(i, i + 16)), i) for i in range(3)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], VECTORS)
    found = {r["id"]: r for r in vector_codes.coded(df).collect()}
    assert [found[i]["code"] for i in range(3)] == [f"{i:02x}" * 16 for i in range(3)]
    assert {(r["error"], r["label_error"]) for r in found.values()} == {(0, 0)}
    assert vector_codes.coded(df.limit(0)).columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.coded(df.filter("vec_id < 0")).isEmpty()
    with pytest.raises(ValueError, match="257"):
        vector_codes.compress(df, entries=257)


def test_label_errors_match_sql(spark, tmp_path):
    rows = vector_rows(300, 64, 0.2)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    wanted = con.execute(ORACLES["op12_vector_codes"])
    names = [c[0] for c in wanted.description]
    found = QUERIES["op12_vector_codes"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(wanted.fetchall())


def duplicates(rows):
    """Per (place, id, text): what stays and how many, places in order."""
    groups = defaultdict(list)
    for place, (key, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((key is None, key or 0, place))
    return {
        place: (None if min(group)[0] else min(group)[1], len(group), place == min(group)[2], hashlib.sha256(text.encode()).hexdigest())
        for text, group in groups.items() for _, _, place in group}


def dedup_rows():
    texts = [f"text {i} " + "word " * (i % 9) for i in range(60)] + ["", None, " ", "\n\t ", "a b", "a\tb", "a  b", "a b", "A b", "x" * 1_000_000, "x" * 1_000_000 + "y", "日本"]
    rows = [(RANDOM.randrange(100), RANDOM.choice(texts)) for _ in range(300)] + [(500 + i, "hot  copy") for i in range(200)]
    return rows + [(7, "same id"), (7, "same id"), (None, "no id"), (None, "no id"), (None, "a b"), (None, None)]


DOCS = "doc_id long, text string, place int, digest string, keep_id string, n int, path string, `_metadata` string"


def write(spark, rows, path, start=0, mode="errorifexists"):
    data = [(*r, start + k, "x", "y", 1, "z", "m") for k, r in enumerate(rows)]
    spark.createDataFrame(data, DOCS).coalesce(1).sortWithinPartitions("place").write.mode(mode).parquet(str(path))


def verdicts(spark, path, found):
    places = spark.read.parquet(str(path))
    where = places.metadataColumn("_metadata")
    places = places.select("place", where["file_path"].alias("path"), where["row_index"].alias("at"))
    joined = found.join(places, ["path", "at"])
    return {r["place"]: (r["keep_id"], r["n"], r["kept"], r["digest"]) for r in joined.collect()}


def test_exact_dedup(spark, tmp_path):
    rows = dedup_rows()
    write(spark, rows, tmp_path / "docs")
    found = exact_dedup.deduplicate(spark, str(tmp_path / "docs"))
    assert found.count() == len(rows)
    assert verdicts(spark, tmp_path / "docs", found) == duplicates(rows)


def test_equal_digests_of_different_texts(spark, tmp_path):
    rows = dedup_rows()
    write(spark, rows, tmp_path / "docs")
    weak = lambda content: F.substr(F.sha2(content, 256), F.lit(1), F.lit(1))
    found = verdicts(spark, tmp_path / "docs", exact_dedup.deduplicate(spark, str(tmp_path / "docs"), digest=weak))
    assert {k: v[:3] for k, v in found.items()} == {k: v[:3] for k, v in duplicates(rows).items()}


def test_state_goes_on(spark, tmp_path):
    """New files meet the state of earlier ones; files in it are not read again."""
    rows = dedup_rows()
    path, state = tmp_path / "docs", str(tmp_path / "state")
    write(spark, rows[:250], path)
    exact_dedup.remember(spark, str(path), state)
    before = {r["digest"]: r for r in exact_dedup.remembered(spark, state).collect()}
    write(spark, rows[250:], path, 250, "append")
    found = exact_dedup.deduplicate(spark, str(path), state, files_per_batch=1)
    after = {r["digest"]: r for r in exact_dedup.remembered(spark, state).collect()}
    assert set(before) < set(after) and sum(r["n"] for r in after.values()) == len(rows)
    got, wanted = verdicts(spark, path, found), duplicates(rows)
    # Of equal identifiers the first by file stays; file names are random here.
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in wanted.items()}
    assert sum(v[2] for v in got.values()) == sum(v[2] for v in wanted.values())
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", None) is None


def test_dedup_of_nothing(spark, tmp_path):
    write(spark, [], tmp_path / "docs")
    found = exact_dedup.deduplicate(spark, str(tmp_path / "docs"))
    assert found.isEmpty() and found.columns == ["id", "path", "at", "digest", "keep_id", "keep_path", "keep_at", "n", "kept"]


def test_dedup_runs_no_python(spark):
    plan = QUERIES["op13_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
    rows = exact_dedup.located(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id", "text", exact_dedup.sha256)
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_pieces_beside_documents(spark):
    """As `encode` gives them; other columns, whatever their names, stay as they are."""
    texts = ["one two", "", None, "日本語 text\n\nmore", "x" * 5000, "one two"]
    docs = spark.createDataFrame([(k if k else None, t, "kept", [k]) for k, t in enumerate(texts)], "doc_id long, text string, `key` string, carry array<int>")
    found = piece_sampling.with_pieces(docs)
    assert found.columns == ["doc_id", "text", "key", "carry", "pieces", "n_pieces", "lossless"]
    rows = sorted((r["doc_id"] or 0, r["pieces"], r["lossless"]) for r in found.collect())
    assert rows == sorted((r["key"] or 0, r["pieces"], r["lossless"]) for r in piece_sampling.encode(docs).collect())
    assert all(r[2] for r in rows) and rows[1][1] == [] and rows[0][1] != []
    assert piece_sampling.with_pieces(docs.limit(0)).isEmpty()
