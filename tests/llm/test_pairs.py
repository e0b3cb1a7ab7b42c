"""Near-duplicates and repeated substrings against brute force."""

import hashlib

import numpy as np
import pyarrow.compute
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.llm import simhash, suffix_array, suffix_dedup, vector_dedup

SF = "/root/testdata/sf0.001"


def _components(nodes, linked):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


# ---- SimHash


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \n\t", "one", "One TWO", "a b c", "a b c", "a  b\tc", "É é x y", "the quick brown fox jumps over the lazy dog", "w " * 70_000]


def test_fingerprints(spark):
    for t in TEXTS:
        assert simhash.fingerprint(t).hex() == f"{_fingerprint(t):016x}"


def test_native_thermometer(spark):
    values = [0, -1, 1, 0x0123456789ABCDEF, -(1 << 63)]
    got = {r["fp"]: r["t"] for r in spark.createDataFrame([(v,) for v in values], "fp long").select("fp", simhash._thermometer(F.col("fp")).alias("t")).collect()}
    for v in values:
        want = sum(((1 << bin((v >> 2 * k) & 3).count("1")) - 1) << 2 * k for k in range(32))
        assert got[v] & (2**64 - 1) == want


def _signed(v):
    return v - 2**64 if v >= 2**63 else v


def _bits(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


@pytest.mark.parametrize("distance", [2, 3])
def test_kinds_of_cells(distance):
    """Whatever bits differ, some cell holds both, at every split; the last ones are small."""
    rng = np.random.default_rng(distance)
    for count in (10, 10**7, 10**10):
        kinds = simhash.layout(count, distance)
        assert all(agree ^ left == 2**64 - 1 and agree & left == 0 for agree, left in kinds)
        assert count <= 16 * 2 ** (0.75 * min(agree.bit_count() for agree, _ in kinds) + 2)
        for _ in range(4):
            for _ in range(60):
                flips = sum(1 << int(b) for b in rng.choice(64, distance, replace=False))
                assert any(flips & agree == 0 for agree, _ in kinds)
            if all(left.bit_count() <= simhash.LAST_BITS for _, left in kinds):
                break
            kind = kinds[int(rng.integers(len(kinds)))]
            kinds = simhash.split(kind, distance)
            for _ in range(60):  # flips in what the kind leaves out
                flips = sum(1 << int(b) for b in rng.choice([b for b in range(64) if kind[1] >> b & 1], distance, replace=False))
                assert any(flips & agree == 0 for agree, _ in kinds)
            break


@pytest.mark.parametrize("distance, dense", [(2, 4096), (2, 12), (3, 20)])
def test_links_connect_what_is_near(spark, distance, dense):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = set(base)
    for b in base[:12]:
        v = b
        for _ in range(8):  # chains and dense groups
            for bit in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                v ^= 1 << int(bit)
            fps.add(v)
    for k in range(300):  # one crowded cell: every value of some bits
        fps.add(base[0] ^ (k & 15) << 1 ^ (k >> 4) << 9)
    signed = [_signed(v) for v in fps]
    near = [(a, b) for a in signed for b in signed if a < b and _bits(a, b) <= distance]
    rows = spark.createDataFrame([(v, k) for k, v in enumerate(signed)], "fp long, doc_id long")
    nodes = rows.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "fp").where("k = 0 or fp % 2 = 0")
    found = [tuple(r) for r in simhash.links(nodes, distance, dense).collect()]
    assert len(found) == len(set(found)) and all(a > b and _bits(a, b) <= distance for _, a, b in found)
    even = [v for v in signed if v % 2 == 0]
    assert _components(signed, [f[1:] for f in found if f[0] == 0]) == _components(signed, near)
    assert _components(even, [f[1:] for f in found if f[0] == 1]) == _components(even, [p for p in near if p[0] % 2 == 0 and p[1] % 2 == 0])
    if (distance, dense) == (2, 4096):
        low = _components(signed, near)
        first = {}
        for k, v in enumerate(signed):
            first[low[v]] = min(first.get(low[v], 10**9), k)
        assert dict(tuple(r) for r in simhash.components(rows).collect()) == {v: first[low[v]] for v in signed}


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 255), min_size=1, max_size=60), st.integers(1, 3))
def test_spanning_links(values, distance):
    fps = np.array(sorted(values), np.uint64) * np.uint64(0x0101000000000101)
    out = simhash.spanning(fps, distance)
    near = [(a, b) for a in range(len(fps)) for b in range(a) if _bits(int(fps[a]), int(fps[b])) <= distance]
    assert all(_bits(int(fps[a]), int(fps[b])) <= distance for a, b in out) and len(out) < len(fps)
    assert _components(range(len(fps)), out) == _components(range(len(fps)), near)


def test_near_duplicates_edge_cases(spark):
    rows = spark.createDataFrame([(5, None, 1), (3, "", 1), (9, "a b c d e f", 1), (9, "a b c d e f", 1), (4, "A b c d e f", 1)], "doc_id long, text string, fp int")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(rows).collect())
    assert got == [(3, 3), (4, 4), (5, 3), (9, 4), (9, 4)]
    kept = simhash.filter_documents(rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4] and kept.columns == rows.columns
    clash = rows.withColumnsRenamed({"fp": "sig"}).withColumns({"fingerprint": F.lit("x"), "component_id": F.lit(0), "k": F.lit(1), "rank": F.lit(2)})
    assert simhash.filter_documents(clash).columns == clash.columns and simhash.near_duplicates(clash).count() == 5
    assert simhash.near_duplicates(rows.limit(0)).count() == 0 and simhash.filter_documents(rows.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "p q r s t"), (None, "p q r s t"), (7, "u v w x y z")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.filter_documents(nameless).collect()) == ["7", "None"]
    twice = simhash.filter_documents(rows.where("doc_id = 9"))
    assert twice.count() == 1


def test_simhash_query_equals_brute_force(spark):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.query(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fp = {d: _fingerprint(t) for d, t in docs.items()}
    near = [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2]
    low = _components(list(fp), near)
    assert got == {d: (f"{fp[d]:016x}", low[d]) for d in docs}


# ---- similar wording


def _sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _mix(h):
    full = 2**64 - 1
    h = ((h ^ h >> 33) * 0xFF51AFD7ED558CCD) & full
    h = ((h ^ h >> 33) * 0xC2B2AE3D27D4EB4F) & full
    return h ^ h >> 33


def _word_prints(text):
    words = (text or "").encode().lower().split()
    out = []
    for k in range(1, simhash.PRINTS + 1):
        total = [0] * 64
        for w in sorted(set(words)):
            h = _mix((xxhash.xxh64(w, seed=42).intdigest() + k * 0x9E3779B97F4A7C15) % 2**64)
            for b in range(64):
                total[b] += round(8 + 8 * np.log2(words.count(w))) * (1 if h >> b & 1 else -1)
        out.append(sum(1 << b for b in range(64) if total[b] > 0))
    return out


def test_word_prints():
    for t in [*TEXTS[:-1], "a a a b", "x " * 5 + "y z " * 3]:
        assert [int(v) & (2**64 - 1) for v in simhash.word_prints(t)] == _word_prints(t)
    assert (simhash.word_prints("w " * 70_000) == simhash.word_prints("w")).all()
    many = " ".join(f"w{k}" for k in range(40_000))  # more words than are remembered
    assert (simhash.word_prints(many) == simhash.word_prints(" ".join(reversed(many.split())))).all()


def _edited():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(900)]
    rows = []
    for _ in range(30):
        base = list(rng.choice(vocabulary, int(rng.integers(3, 150))))
        for _ in range(8):  # none to a few edited words, on both sides of the similarity
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = "new" + str(rng.integers(50))
            rows.append((len(rows), " ".join(words)))
    return [*rows, (900, None), (901, ""), (902, "one Two"), (903, "ONE two"), (903, "ONE two"), (None, rows[0][1] + " z")]


def test_similar_wording_by_brute_force(spark):
    """No group is made up, and few links of the exact similarity are missed."""
    import corpus_pipeline

    rows = _edited()
    held, prints = {k: _sets(t) for k, (_, t) in enumerate(rows)}, {k: _word_prints(t) for k, (_, t) in enumerate(rows)}
    alike = [(a, b) for a in held for b in held if a < b and (held[a] == held[b] or held[a] and 9 * len(held[a] & held[b]) >= 4 * (len(held[a]) + len(held[b])))]
    hit = [(a, b) for a, b in alike if held[a] == held[b] or min(_bits(x, y) for x, y in zip(prints[a], prints[b])) <= simhash.WIDE]
    assert len(hit) >= 0.9 * len(alike) > 150
    low, full = _components(list(held), hit), _components(list(held), alike)
    name = {k: str(r[0]) for k, r in enumerate(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for dense in (4096, 9):
        kept = sorted(str(r["doc_id"]) for r in simhash.filter_documents(df, dense=dense).collect())
        assert len(kept) == len(set(kept)) and {name[k] for k in set(full.values())} <= set(kept)
        assert len(kept) <= 1.02 * len(set(low.values())) and len(kept) <= 1.06 * len(set(full.values()))
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()) == sorted(str(r["doc_id"]) for r in simhash.filter_documents(df).collect())
    assert simhash.filter_documents(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = []
    for k in range(600):
        words = list(base)
        for _ in range(2):
            words[int(rng.integers(len(words)))] = f"n{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"x{i}" for i in rng.integers(0, 5000, 200))) for k in range(50)]
    kept = {r["doc_id"] for r in simhash.filter_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, *range(1000, 1050)}


def test_no_table_holds_the_pairs_of_a_group(spark, monkeypatch):
    """What near copies make on the way grows with their number, not with its square."""
    from skyloom.llm import shingles
    from skyloom.operators import components
    from skyloom.plans.shared import materialize

    written = {}

    def spy(df, label="t"):
        out = materialize(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    for module in (simhash, shingles, components):
        monkeypatch.setattr(module, "materialize", spy)
    words = [f"w{i}" for i in range(120)]
    n = 500
    rows = [(k, " ".join([*words[: k % 100], f"n{k}", *words[k % 100 :]])) for k in range(n)]
    assert [r["doc_id"] for r in simhash.filter_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    most = max(written.items(), key=lambda x: x[1])
    cells = simhash.PRINTS * len(simhash.layout(n, simhash.WIDE))
    assert written["similar"] < n and most[1] <= n * cells, most
    assert all(rows <= n * simhash.PRINTS * 2 for label, rows in written.items() if label != "cells"), written


@pytest.mark.parametrize("block", [1 << 18, 3000])
def test_groups_are_compared_as_a_whole(spark, block):
    """As brute force over all pairs of what near fingerprints connect, in one block or dealt to many."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    rows = [*_edited()[:120]]
    for k in range(90):  # one group of wide similarity, its sizes on both sides of the ratio
        words = list(base[: 150 - k // 3])
        for _ in range(k % 8):
            words[int(rng.integers(len(words)))] = f"n{k % 20}"
        rows.append((1000 + k, " ".join(words)))
    held, prints = [_sets(t) for _, t in rows], [_word_prints(t) for _, t in rows]
    every = range(len(rows))
    near = [(a, b) for a in every for b in range(a) if held[a] == held[b] or min(_bits(x, y) for x, y in zip(prints[a], prints[b])) <= simhash.WIDE]
    group = _components(list(every), near)
    alike = [(a, b) for a in every for b in range(a) if group[a] == group[b] and 9 * len(held[a] & held[b]) >= 4 * (len(held[a]) + len(held[b]))]
    want = sorted(rows[k][0] for k in set(_components(list(every), alike).values()))
    assert len(set(alike) - set(near)) > 10 and 20 < len(want) < 180
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.filter_documents(df, block=block).collect()) == want


# ---- suffixes


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffix_array.PERIOD for a in suffix_array.COVER for b in suffix_array.COVER} == set(range(suffix_array.PERIOD))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(b"ab"), max_size=300), st.integers(1, 4), st.integers(1, 50))
def test_suffix_order(symbols, repeat, bucket):
    text = np.array(symbols * repeat, dtype=np.uint8)
    raw = text.tobytes()
    got = suffix_array.sort_suffixes(text, np.arange(len(text)), bucket=bucket)
    assert got.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def _removed(rows, length=50):
    first = {}
    key = lambda i: 1 << 70 if i is None else i
    for i, t in rows:
        for p in range(len(t) - length + 1):
            first[t[p : p + length]] = min(first.get(t[p : p + length], 1 << 71), key(i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < key(i):
                gone[p : p + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = sorted((tuple(r) for r in suffix_dedup.deduplicate(df, **kw).collect()), key=str)
    assert got == _removed([(i, (t or "").encode()) for i, t in rows])


def test_substrings_planted(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeé ß"), 9)) for _ in range(400)]
    passage = " ".join(words[:20])
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(30)]
    rows += [(100 + i, " ".join(rng.choice(words, 10)) + passage + " ".join(rng.choice(words, 10))) for i in range(6)]
    rows += [(200, passage[:49]), (201, passage[:50]), (202, None), (203, ""), (204, "x" * 500), (205, "x" * 70), (206, "ab" * 200), (207, "b" + "ab" * 100)]
    rows += [(rows[0][0] + 300, rows[0][1]), (rows[0][0] + 300, rows[0][1]), (None, rows[1][1]), (None, "q" * 60)]
    _check(spark, rows)
    _check(spark, rows, batch_bytes=700, part_anchors=40)


def _by_hand(rows, batches, parts, length=50, gram=20):
    """The three passes without Spark; what the parts answer is counted."""
    import pyarrow as pa

    sd = suffix_dedup
    tables = [pa.table({"batch": pa.array([k] * len(x), pa.int32()), "doc_id": pa.array([i for i, _ in x], pa.int64()), "text": pa.array([t for _, t in x], pa.string())}) for k, x in enumerate(batches(rows))]
    by = lambda t, c, k: t.filter(pa.compute.equal(t.column(c), k))
    key = lambda k: (pa.scalar(k, pa.int32()),)
    anchors = pa.concat_tables([sd._anchor_rows(parts, length, gram)(key(k), t) for k, t in enumerate(tables)])
    bits = pa.concat_tables([sd._answer_anchors(key(p), t) for p in range(parts) if len(t := by(anchors, "part", p))])
    sent = pa.concat_tables([sd._context_rows(parts, length, gram)(key(k), t, by(bits, "batch", k)) for k, t in enumerate(tables)])
    masks = [sd._answer_contexts(length, gram)(key(p), t) for p in range(parts) if len(t := by(sent, "part", p))]
    answers = pa.concat_tables([bits, *masks])
    done = [r for k, t in enumerate(tables) for r in sd._results(parts, length, gram)(key(k), t, by(answers, "batch", k)).to_pylist()]
    return sorted((tuple(r.values()) for r in done), key=str), masks


def _repetitive():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcé "), 7)) for _ in range(60)]
    passage = " ".join(words[:14])
    return [(int(i), " ".join(rng.choice(words, 25)) + passage * int(i % 3 == 0) + " ".join(rng.choice(words, 9))) for i in rng.permutation(60)]


@pytest.mark.parametrize("collide", [False, True])
def test_bytes_tell_what_hashes_bring_together(monkeypatch, collide):
    """With one hash for all contexts the result is the same."""
    if collide:
        monkeypatch.setattr(suffix_dedup, "_hash_rows", lambda rows: np.zeros(len(rows), np.uint64))
    rows = _repetitive()
    got, _ = _by_hand(rows, lambda r: (r[:20], r[20:45], r[45:]), 3)
    assert got == _removed([(i, t.encode()) for i, t in rows]) and sum(r[2] for r in got) > 1000


def test_nothing_is_removed_but_by_the_sort(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "classes", lambda rows, *a: np.full((len(rows), 31), suffix_dedup._LAST))
    for batches in (lambda r: (r,), lambda r: (r[:30], r[30:])):
        got, _ = _by_hand(_repetitive(), batches, 2)
        assert sum(r[2] for r in got) == 0


def test_substrings_of_null_ids_and_clashing_names(spark):
    text = "0123456789" * 9
    rows = [(None, f"{k} {text}") for k in range(40)] + [(7, text), (7, "x" + text)]
    df = spark.createDataFrame([(i, t, 1, "z", 2) for i, t in rows], "doc_id long, text string, batch int, part string, n_bytes int")
    got = sorted((tuple(r) for r in suffix_dedup.deduplicate(df, batch_bytes=300).collect()), key=str)
    assert got == _removed([(i, t.encode()) for i, t in rows])
    with pytest.raises(ValueError):
        suffix_dedup.deduplicate(df, length=200)


def test_substrings_empty_table_and_spans(spark):
    df = spark.createDataFrame([(1, "z" * 10 + "0123456789" * 6), (2, "0123456789" * 6)], "doc_id long, text string")
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0
    rows = {r["doc_id"]: r for r in suffix_dedup.deduplicate(df, texts=True).collect()}
    assert bytes(rows[2]["kept"]) == b"" and rows[2]["spans"] == [[0, 60]] and rows[1]["spans"] == []


def test_substring_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in suffix_dedup.query(spark, SF).collect()), key=str) == _removed(docs)


# ---- vectors


def _brute(rows, threshold=0.98):
    ok = {}
    for k, (i, e, label) in enumerate(rows):
        if i is None or e is None or label is None or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        ok[k] = np.array(e, np.float64)
    pairs = [(a, b) for a in ok for b in ok if a != b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= threshold]
    ids = [r[0] for r in rows]
    low = _components([i for i in ids if i is not None], [(ids[a], ids[b]) for a, b in pairs])
    n = [sum(1 for a, _ in pairs if a == k) for k in range(len(rows))]
    return sorted((i, n[k], low.get(i)) for k, i in enumerate(ids))


def test_vectors_edge_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=8) * 0.03], int(i % 2)) for i in range(150)]
    rows += [(500, None, 1), (501, [0.0] * 8, 1), (502, [float("nan")] * 8, 1), (503, [1.0, None] + [0.0] * 6, 1), (504, rows[0][1], None), (505, rows[0][1], 0), (506, rows[0][1], 0), (507, [1.0, 0.0], 0), (508, [2.0, 0.0], 0), (509, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r[0], r[1], r[2]) for r in df.collect()]
    for size in (8192, 20):
        got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df, shard_rows=size, most_rows=size).collect())
        assert got == _brute(rows)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [2.0, 0.01], 0), (3, [0.01, 3.0], 0), (4, [0.0, 4.0], 0), (5, [1.0, 1.0], 0), (5, None, 0), (5, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "n": F.lit(2), "own": F.lit("x")})
    got = sorted(tuple(r) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (5, 0, 5, True), (5, 0, 5, True)]


def _blobs(rng, n, dim=64):
    """Vectors of which a tenth has near copies, in groups of two to forty, and one dense group."""
    v = rng.normal(size=(n, dim))
    at = n // 2
    while at < n - 40:
        k = int(rng.integers(1, 40))
        v[at : at + k] = v[int(rng.integers(n // 4))] + rng.normal(size=(k, dim)) * rng.choice([0.08, 0.14, 0.2])
        at += k * 10
    v[:150] = v[0] + rng.normal(size=(150, dim)) * 0.08
    return v.astype(np.float32)


@pytest.mark.parametrize("n, shard_rows", [(4000, 4096), (10_000, 4096), (3000, 128)])
def test_graphs_against_brute_force(spark, n, shard_rows):
    """One graph that is walked, several that query each other, and blocks of many small ones."""
    v = _blobs(np.random.default_rng(n), n)
    df = spark.createDataFrame([(i, v[i].tolist(), 1) for i in range(n)], "vec_id long, embedding array<float>, label int")
    out, audits = vector_dedup.search(df, shard_rows=shard_rows, most_rows=shard_rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = [np.flatnonzero(row >= 0.98) for a in range(0, n, 1000) for row in u[a : a + 1000] @ u.T]
    links = [(a, int(b)) for a in range(n) for b in hits[a] if a != b]
    assert len(links) > 2000
    found = sum(min(got[i][0], len(hits[i]) - 1) for i in range(n))
    assert found >= 0.99 * len(links) and all(got[i][0] <= len(hits[i]) - 1 for i in range(n))
    low = _components(range(n), links)
    assert sum(got[i][1] == low[i] for i in range(n)) >= 0.999 * n
    shards = max(1, -(-n // shard_rows))
    rows = audits.collect()
    assert len(rows) == shards * shards and all(r["audited"] >= 32 and r["links"] >= 0.999 and r["nearest"] >= 0.9 for r in rows)


def test_graph_recall(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = vector_dedup.Graph(v)
    nodes, _ = graph.near(v[:300], 64)
    truth = np.argsort(-(v[:300] @ v.T), 1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(nodes.tolist(), truth.tolist())])
    assert recall >= 0.9
