import numpy as np
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing


def check_plan(counts, capacity):
    groups = packing.plan(counts, capacity, classes=min(64, capacity))
    used = np.zeros_like(counts)
    for items, repeats in groups:
        assert sum(length * n for length, n in items) <= capacity and repeats > 0
        for length, n in items:
            used[length] += n * repeats
    assert (used[1:] == counts[1:]).all()
    return sum(r for _, r in groups)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_hold_every_item_once(lengths):
    counts = np.bincount(lengths, minlength=65).astype(np.int64) if lengths else np.zeros(65, dtype=np.int64)
    n = check_plan(counts, 64)
    total = sum(lengths)
    assert n <= max(1, 2 * -(-total // 64)) if lengths else n == 0


def test_plan_is_close_to_the_lower_bound():
    r = np.random.default_rng(1)
    lengths = np.clip(r.lognormal(5, 1.1, 20_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049).astype(np.int64)
    assert check_plan(counts, 2048) <= 1.01 * -(-int(lengths.sum()) // 2048)
    assert check_plan(counts * 10**6, 2048) <= 1.01 * -(-int(lengths.sum()) * 10**6 // 2048)


def test_nnls_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(20):
        a, b = r.random((6, 4)), r.random(6) - 0.2
        best = np.inf
        for mask in range(16):
            on = [i for i in range(4) if mask >> i & 1]
            x = np.zeros(4)
            if on:
                x[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (x >= 0).all():
                best = min(best, np.linalg.norm(a @ x - b))
        assert np.linalg.norm(a @ packing.nnls(a, b) - b) <= best + 1e-8


def test_patterns_fill_the_container():
    assert all(sum(p) == 64 and len(p) <= 4 for p in packing.patterns()) and len(set(packing.patterns())) == len(packing.patterns())


def test_documents_are_packed_whole_unless_too_long(spark):
    texts = [(i, "word " * (i * 7 % 400)) for i in range(200)] + [(500, None), (501, ""), (502, " word" * 5000), (503, " word" * 2048)]
    df = spark.createDataFrame([(i, x, 0) for i, x in texts], "doc_id long, text string, container_id long").repartition(7)
    packed = packing.pack(packing.token_pieces(df)).collect()
    by_doc, by_container = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_container.setdefault(r["container_id"], []).append(r)
    assert set(by_doc) == {i for i, _ in texts}
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert len(pieces) == 1 or doc == 502
        assert [p["start"] for p in pieces] == [2048 * k for k in range(len(pieces))]
    assert sum(p["n_tokens"] for p in by_doc[502]) == 5000 and by_doc[503][0]["n_tokens"] == 2048
    for pieces in by_container.values():
        real = sorted((p["offset"], p["n_tokens"]) for p in pieces if p["n_tokens"])
        assert sum(n for _, n in real) <= 2048
        assert all(a + n <= b for (a, n), (b, _) in zip(real, real[1:]))
    one = packing.utilisation(packing.pack(packing.token_pieces(df))).first()
    assert one["n_containers"] == len(by_container) and one["filled"] > 0.95


def test_only_empty_texts_and_no_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows(packing.pack(packing.token_pieces(df)), "doc_id", "n_tokens", "container_id") == [(1, 0, 0), (2, 0, 0)]
    assert packing.pack(packing.token_pieces(df.limit(0))).count() == 0
    assert packing.utilisation(packing.pack(packing.token_pieces(df.limit(0)))).first()["n_containers"] == 0
