import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from corpora import corpus, documents, edited, empty, words
from pyspark.sql import functions as F

from gridstone.llm import common, differences, line_dedup, near_dup
from gridstone.llm.components import connected_components

LOWER = {c: c + 32 for c in range(65, 91)}


def roots(n, links):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def shingle_set(text, size):
    parts = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not parts:
        return set()
    size = min(size, len(parts))
    return {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)}


def similar(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    texts = corpus(size)
    sets = [shingle_set(t, size) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    want = roots(len(texts), links)
    rows = near_dup.near_duplicates(documents(spark, texts), near_dup.NearDup(shingle=size)).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert len(rows) == len(texts)
    assert got == {i: (len(s), w, w == i) for i, (s, w) in enumerate(zip(sets, want))}


@pytest.mark.parametrize("block", [1_000, 40])
def test_near_duplicates_large_family_without_its_original(spark, block):
    rng = random.Random(1)
    base = words(rng, 100)
    texts = [edited(rng, base, rng.randrange(2, 5)) for _ in range(600)]
    sets = [shingle_set(t, 2) for t in texts]
    want = roots(600, [(i, j) for i in range(600) for j in range(i) if similar(sets[i], sets[j])])
    rows = near_dup.near_duplicates(documents(spark, texts), near_dup.NearDup(shingle=2, block=block)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want))


@pytest.mark.parametrize("broadcast_ids", [1_000_000, 0])
def test_near_duplicates_of_shared_blocks(spark, broadcast_ids, monkeypatch):
    """Ten of thirty blocks make a document: lists are long, and any two documents share some text."""
    rng = random.Random(5)
    blocks = [words(rng, 20, 5000) for _ in range(30)]
    texts = []
    for _ in range(400):
        base = "\n".join(rng.sample(blocks, 10))
        texts += [base, edited(rng, base, 8)]
    sets = [shingle_set(t, 5) for t in texts]
    want = roots(800, [(i, j) for i in range(800) for j in range(i) if similar(sets[i], sets[j])])
    monkeypatch.setattr(differences, "BROADCAST_LISTS", broadcast_ids)
    p = near_dup.NearDup(broadcast_ids=broadcast_ids)
    rows = near_dup.near_duplicates(documents(spark, texts), p).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want))


def test_near_duplicates_of_small_sets(spark):
    """Sets of 1 to 80 shingles, each with copies that lack or have a few more: the bound on small sets is exact."""
    rng = random.Random(6)
    texts = []
    for n in range(2, 82, 1):
        base = [f"s{n}w{i}" for i in range(n)]
        texts.append(" ".join(base))
        for _ in range(3):
            part = [w for w in base if rng.random() > 0.05]
            texts.append(" ".join([*part, f"s{n}x{rng.randrange(9)}"][: n + rng.randrange(2)]))
    sets = [shingle_set(t, 1) for t in texts]
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])])
    rows = near_dup.near_duplicates(documents(spark, texts), near_dup.NearDup(shingle=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(want))


def test_near_duplicates_awkward_rows(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "A b  c"), (None, None)], "doc_id long, text string")
    got = sorted(near_dup.near_duplicates(df).collect(), key=str)
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (-1, -1, True), (3, 3, True), (7, 3, False), (7, 3, False)]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    n = 300
    order = list(range(n))
    rng.shuffle(order)
    links = {"path": list(zip(order, order[1:])), "star": [(order[0], i) for i in order[1:]], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(250)], "none": []}[shape]
    want = roots(n, links)
    df = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {i: want[i] for a, b in links for i in (a, b) if a != b}


def shingles8(line):
    raw = line.encode("utf-16be")
    return {raw[i : i + 16] for i in range(0, max(1, len(raw) - 15), 2)}


def model_drops(texts):
    """Positions to drop by comparing all lines."""
    lines = [(d, p, line) for d, t in enumerate(texts) if t is not None for p, line in enumerate(t.split("\n")) if line.strip(" ")]
    distinct = sorted({line for *_, line in lines})
    sets = [shingles8(line) for line in distinct]
    links = [(i, j) for i in range(len(distinct)) for j in range(i) if similar(sets[i], sets[j])]
    of = dict(zip(distinct, roots(len(distinct), links)))
    seen, drops = set(), defaultdict(list)
    for d, p, line in sorted(lines):
        if of[line] in seen:
            drops[d].append(p)
        seen.add(of[line])
    return dict(drops)


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    long = [words(rng, rng.randrange(15, 60)) for _ in range(60)]
    texts = []
    for _ in range(120):
        some = [rng.choice(long) if rng.random() < 0.5 else words(rng, 20) for _ in range(rng.randrange(1, 5))]
        texts.append("\n".join(edited(rng, s, 1) if rng.random() < 0.3 else s for s in some))
    texts += [None, "", "\n\n", "short\nshort\nSHORT", "é" * 30 + "\n" + "é" * 30, "tail\r\ntail\r"]
    want = model_drops(texts)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_drops(documents(spark, texts)).collect()}
    wrong = {d for d in {*want, *got} if want.get(d) != got.get(d)}
    # banding finds a pair at the threshold with probability 0.997
    assert len(wrong) <= 2, {d: (want.get(d), got.get(d)) for d in wrong}
    assert all(got[d] == want[d] for d in range(120, len(texts)) if d in want)


@pytest.mark.parametrize("block", [1_000, 40])
def test_large_family_of_lines_without_its_original(spark, block):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz "
    base = [rng.choice(letters) for _ in range(400)]
    lines = []
    for _ in range(600):
        line = list(base)
        for _ in range(rng.randrange(2, 5)):
            line[rng.randrange(400)] = rng.choice("0123456789")
        lines.append("".join(line))
    want = model_drops(lines)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_drops(documents(spark, lines), line_dedup.LineDedup(block=block)).collect()}
    assert got == want


def test_lines_of_one_family_have_few_references(spark, monkeypatch):
    """Most pairs of this family are just below the threshold; they are not verified pair by pair, and no link is lost."""
    rng, lines, verified = random.Random(2), [], []
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)]
    for _ in range(250):
        line = list(base)
        for _ in range(rng.randrange(2, 8)):
            line[rng.randrange(400)] = rng.choice("0123456789")
        lines.append("".join(line))
    rest = line_dedup._rest
    monkeypatch.setattr(line_dedup, "_rest", lambda *args: verified.append(out := rest(*args).localCheckpoint()) or out)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_drops(documents(spark, lines)).collect()}
    assert got == model_drops(lines)
    assert verified[0].count() <= 2 * len(lines)


def test_links_to_a_reference_that_no_round_compared(spark, tmp_path):
    """A reference of a reference need not have been held against a line: that link comes from their differences."""
    p = line_dedup.LineDedup()
    base = "".join(random.Random(5).choices("abcdefghijklmnop", k=200))
    texts = [base, base + "xy", base[:100] + "ZZ" + base[102:], base[:60]]
    bodies = spark.createDataFrame([(i, x.encode("utf-16be")) for i, x in enumerate(texts)], "id long, body binary")
    state = spark.createDataFrame([(i, i, 0) for i in range(4)], "id long, root long, ref long")
    links = [(r["a"], r["b"]) for r in line_dedup._within(state, bodies, p).collect()]
    assert roots(4, links) == roots(4, [(1, 0), (2, 0)])
    assert all(similar(shingles8(texts[a]), shingles8(texts[b])) for a, b in links)


def test_shingle_sets_of_long_lines_take_linear_time(spark):
    """A line is not copied for each of its shingles: 400,000 characters took minutes so."""
    text = "".join(random.Random(3).choices("abcdefgh \u00e9\U0001f600", k=400_000))
    row = spark.createDataFrame([(text,), ("ab",)], "line string").select(F.encode("line", "utf-16be").alias("body"))
    start = time.monotonic()
    sizes = [r[0] for r in row.select(F.size(line_dedup._set("body", line_dedup.LineDedup()))).collect()]
    units = text.encode("utf-16be")
    assert sizes == [len({units[i : i + 16] for i in range(0, len(units) - 14, 2)}), 1]
    assert time.monotonic() - start < 20


@pytest.mark.parametrize("union", [10, 25, 100, 1000])
def test_recall_of_signatures_at_the_threshold(union):
    """Pairs with similarity 0.8 exactly share a band and agree on enough minima in 99 of 100 cases."""
    p = line_dedup.LineDedup()
    words, minima = line_dedup.family(p)
    rng, trials, found = np.random.default_rng(union), 2000, 0
    common, own = union * 4 // 5, union // 10
    for _ in range(trials):
        h = rng.integers(-(1 << 63), 1 << 63, (len(words), union))  # words of a random hash are random
        values = np.stack([((h[w] << s) >> 32) ^ m for w, s, m in minima])
        x, y = values[:, : common + own].min(axis=1), np.r_["1", values[:, :common], values[:, common + own :]].min(axis=1)
        same = (x == y).reshape(p.bands, p.rows)
        found += same.all(axis=1).any() and same.sum() >= line_dedup._bound(p)
    assert found >= 0.99 * trials, found / trials


@pytest.mark.parametrize("block", [1_000, 40])
def test_links_within_a_family_that_shares_edits(spark, tmp_path, block):
    """Every member shares the reference's own edits: lengths let pairs go before lists are intersected, and no link is lost."""
    rng, m, rows = np.random.default_rng(4), 100, []
    own = list(range(12))  # elements of the reference that no member has
    for node in range(1, 401):
        kind = int(rng.integers(0, 40))
        extra = [1000 * (kind + 1) + i for i in range(11)] + [10**6 + 50 * node + i for i in range(int(rng.integers(0, 12)))]
        rows.append((node, node, m - len(own) + len(extra), 0, m, [*own, *extra]))
    path = f"{tmp_path}/found"
    spark.createDataFrame(rows, "node long, root long, n long, ref long, m long, d array<long>").write.parquet(path)
    sets = {node: {i for i in range(-m, 0)} - {-1 - i for i in own} | set(d[len(own) :]) for node, _, _, _, _, d in rows}
    assert all(len(sets[node]) == n for node, _, n, *_ in rows)
    want = roots(401, [(a, b) for a in sets for b in sets if b < a and similar(sets[a], sets[b])])
    out = differences.links_within(spark.read.parquet(path), 80, block, "test")
    joins = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "array_intersect" in x]
    assert joins and all(0 < x.find("least(size(") < x.find("array_intersect") for x in joins)
    links = [(r["a"], r["b"]) for r in out.collect()]
    assert roots(401, links) == want
    assert len(set(want[1:])) < 400


def test_sets_of_a_pair_are_made_once(spark):
    p = line_dedup.LineDedup()
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    bodies = spark.createDataFrame([(1, "a line of some length".encode("utf-16be")), (2, "a line of some lengths".encode("utf-16be"))], "id long, body binary")
    out = line_dedup._similar(pairs, bodies, p)
    assert [tuple(r) for r in out.collect()] == [(1, 2)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 2


def test_lines_of_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "same line", 1, "a"), (3, "same line\nsame line\nown", 2, "b"), (3, "same line\nsame line\nown", 3, "c"), (5, "same line", 4, "d"), (7, "", 5, "e"), (9, None, 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _line0 int, id string")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r["_line0"]: r["text"] for r in out.collect()} == {1: "same line", 2: "same line\nown", 3: "same line\nown", 4: "", 5: "", 6: None}
    assert {r["_line0"] for r in line_dedup.dedup_lines(docs, drop_emptied=True).collect()} == {1, 2, 3, 5, 6}


def test_lines_in_texts(spark):
    docs = documents(spark, ["a line that stays here\nfoo", "a line that stays here\nbar\n\nfoo", None])
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {0: "a line that stays here\nfoo", 1: "bar\n", 2: None}
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_no_python_in_line_dedup(spark):
    plan = line_dedup.dedup_lines(documents(spark, ["a b\nc d"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_freed_native_memory_of_the_driver_goes_back(spark, monkeypatch):
    assert "rim native heap" in common.trim(spark)
    calls = []
    monkeypatch.setattr(common, "trim", lambda session: calls.append(session))
    common.durable(spark.range(3), "trimmed")
    common.tidy(spark)
    assert calls == [spark, spark]


def test_rounds_read_only_documents_that_share_lists(spark, monkeypatch):
    rng, read = random.Random(8), []
    base = words(rng, 80, 5000)
    texts = [*(words(rng, 80, 5000) for _ in range(40)), base, edited(rng, base, 1)]
    verified = near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda pairs, sketches, docs, p: read.append((sketches.count(), docs.count())) or verified(pairs, sketches, docs, p))
    rows = near_dup.near_duplicates(documents(spark, texts), near_dup.NearDup(shingle=2)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: min(i, 40) for i in range(42)}
    assert read and set(read) == {(2, 2)}
