"""Operators 1, 8, 9 and 10 against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import _text, decontaminate, linededup, minhash, substring_dedup

pa = pytest.importorskip("pyarrow")


def _words(text):
    return (text or "").encode().split()


def _ids(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_words_are_those_of_bytes_split():
    texts = ["", None, "a", " a  b\n", "é ü\tx\x0bx\x0cy", " a b", "x" * 5000, "a\x00b c"]
    col = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    got = [[bytes(w.data[s:e]) for s, e in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]])] for lo, hi, w in _text.read(col, target=4) for d in range(hi - lo)]
    assert got == [_words(t) for t in texts]
    hashes = {}
    for _, _, w in _text.read(col):
        for s, e, h in zip(w.starts, w.ends, w.hashes()):
            assert hashes.setdefault(bytes(w.data[s:e]), h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_window_hashes_depend_on_words_only():
    h = _text.mix(np.arange(1, 50, dtype=np.uint64))
    twice = np.concatenate([h, h])
    assert (_text.windows(twice, np.arange(40), 9) == _text.windows(twice, np.arange(49, 89), 9)).all()


def test_cover():
    assert substring_dedup.is_cover(7, (0, 1, 3)) and not substring_dedup.is_cover(7, (0, 1, 2))
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(None, period=7, cover=(0, 1, 2))


def _repeats(rows, window):
    first = {}
    for r in _ids(rows):
        w = _words(r[1])
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), r[0])
    out = Counter()
    for r in rows:
        w = _words(r[1])
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            f = first[tuple(w[j : j + window])]
            if f is not None and (r[0] is None or f < r[0]):
                gone[j : j + window] = [True] * window
        out[(r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("window,period,cover,chunk,bucket", [(13, 7, (0, 1, 3), 8 << 20, 4 << 20), (13, 7, (0, 1, 3), 4000, 2000), (8, 3, (0, 1), 3000, 1000)])
def test_substrings(docs, rows, window, period, cover, chunk, bucket):
    got = substring_dedup.remove_repeats(docs, window, period, cover, chunk, bucket).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text.encode()) for r in got) == _repeats(rows, window)
    assert sum(s.end - s.start for r in got for s in r.spans) == sum(r.n_removed for r in got)


def test_substrings_of_many_rows_without_an_id(spark, rows):
    """A third of the rows without an id, and one id with many texts: their chunks are as small as any."""
    more = [(r[0], r[1]) for r in rows] + [(None, f"lead {i} {r[1]}") for i, r in enumerate(rows)] + [(500, f"{r[1]} tail {i}") for i, r in enumerate(rows)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(more, "doc_id long, text string").repartition(5), chunk_bytes=20_000, bucket_bytes=5_000).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text.encode()) for r in got) == _repeats(more, 13)


def test_substrings_of_nothing(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def _shingles(text):
    w = _words(text)
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def _classes(rows):
    sets = [(_shingles(r[1]), r[0]) for r in rows]
    label = list(range(len(sets)))
    for i, (a, _) in enumerate(sets):
        for j in range(i):
            b = sets[j][0]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = defaultdict(list)
    for (s, i), x in zip(sets, label):
        if i is not None:
            least[x].append(i)
    return Counter((i, min(least[x]) if s and least[x] else i) for (s, i), x in zip(sets, label))


def test_near_duplicates(docs, rows):
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
    assert got == _classes(rows)
    kept = [r.doc_id for r in minhash.keep_first(docs).collect()]
    assert Counter(kept) == Counter({i for i, c in got if i == c})
    assert minhash.keep_first(docs).columns == docs.columns


def test_large_groups_are_joined_through_pivots(spark):
    """A star: every copy is near the base only, more of them than a bucket compares in full."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        near = list(base)
        for at in rng.choice(60, 4, replace=False):
            near[at * 5] = f"x{i}_{at}"
        rows.append((i, " ".join(near)))
    a, b = _shingles(rows[1][1]), _shingles(rows[2][1])
    assert len(a & b) < 0.8 * len(a | b)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_large_groups_without_a_base_lose_no_link(spark):
    """Pairs that meet in large buckets only: all they share is in most others too, and no text is near all."""
    rng = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(60):
        slots = rng.choice(79, 8, replace=False) * 5 + 2
        for twin in range(2):
            near = list(base)
            for at in slots:
                near[at] = f"x{i}_{twin}_{at}"
            rows.append((2 * i + twin, " ".join(near)))
    want = _classes(rows)
    assert len({c for _, c in want}) == 60
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == want


def _mixed_family(rng, members):
    """A group of mixed similarities: a random tree in which each text changes some words of an earlier one."""
    texts = [[f"w{i}" for i in range(120)]]
    for i in range(1, members):
        near = list(texts[rng.integers(max(0, i - 40), i)])
        for at in rng.choice(24, rng.integers(1, 5), replace=False):
            near[at * 5] = f"x{i}_{at}"
        texts.append(near)
    return [" ".join(t) for t in texts]


def test_a_large_group_of_mixed_similarities_loses_no_link(spark):
    """1200 texts whose links are of every similarity, and copies of one of them, against all pairs."""
    rng = np.random.default_rng(12)
    texts = _mixed_family(rng, 1200)
    rows = list(enumerate(texts)) + [(5000 + i, texts[7]) for i in range(900)]
    sets = [_shingles(t) for t in texts]
    number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(number)), np.float32)
    for i, x in enumerate(sets):
        m[i, [number[y] for y in x]] = 1
    common, n = m @ m.T, m.sum(axis=1)
    near = common >= 0.8 * (n[:, None] + n[None, :] - common) - 1e-4
    label = np.arange(len(sets))
    while True:
        new = np.where(near, label[None, :], len(sets)).min(axis=1)
        if (new == label).all():
            break
        label = new
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == {i: int(label[i if i < 5000 else 7]) for i, _ in rows}


def test_counted_shingles(spark):
    """Equal shingle sets in other numbers: one class as sets, by the weighted similarity not always."""
    part = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(part * 2)), (2, " ".join(part * 9)), (3, " ".join(part * 10)), (4, " ".join(part * 11)), (5, " ".join(part * 2))]

    def counts(t):
        w = t.split()
        return Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))

    assert {r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), counted=True).collect()}
    similar = lambda a, b: sum((counts(a) & counts(b)).values()) >= 0.8 * sum((counts(a) | counts(b)).values())
    assert similar(rows[1][1], rows[2][1]) and similar(rows[2][1], rows[3][1]) and not similar(rows[0][1], rows[1][1])
    assert got == {1: 1, 5: 1, 2: 2, 3: 2, 4: 2}


def test_one_id_with_several_texts(spark):
    """Texts of one doc_id are texts of their own: each class keeps its first; of equal rows one stays, whatever the order."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "s"), (1, b, "t"), (2, a, "u"), (1, b, "v"), (3, c, "w"), (3, c, "x"), (None, c, "y"), (4, "", "z"), (4, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = minhash.keep_first(df)
    assert got.columns == df.columns
    want = Counter([(1, a), (1, b), (3, c), (None, c), (4, ""), (4, None)])
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert sorted(map(str, got.collect())) == sorted(map(str, minhash.keep_first(df.repartition(5, "th")).collect()))


def test_columns_of_other_kinds_are_kept(spark, tmp_path):
    """Maps, dotted names and names that the operators use themselves."""
    from tessera.llm import curriculum, reshard

    rows = [(i, f"some words of text {i % 3} that are repeated", "s", {"k": i}, i, i) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string, int>, `a.b` int, hash int")
    assert Counter(r.doc_id for r in minhash.keep_first(df).collect()) == Counter([0, 1, 2]) and minhash.keep_first(df).columns == df.columns
    assert curriculum.mixed(df).columns == df.columns and curriculum.mixed(df).count() > 0
    back = reshard.reshard(df, str(tmp_path / "shards"))
    assert {(r.doc_id, r["a.b"], r.hash, r.m["k"]) for r in back.collect()} == {(i, i, i, i) for i in range(9)}


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    a = rng.random(200) * 3 + 0.01
    b = np.where(rng.random(200) < 0.7, a, rng.random(200) * 3 + 0.01)
    s = minhash.darts(np.concatenate([keys, keys]), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    one = minhash.darts(keys[:1], np.ones(1), np.zeros(1, int), 2, 16)
    assert (one[0] != np.iinfo(np.uint64).max).all() and (one[1] == np.iinfo(np.uint64).max).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (11, 11), (5, 6), (20, 19)]
    got = {r.node: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 7, 19: 19, 20: 19}


_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def _alnum(text):
    return (text or "").encode().translate(_TABLE).split(b" ")


def _hits(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = [x for x in _alnum(t) if x]
        for j in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[j : j + 10])].add(i)
    out = Counter()
    for r in rows:
        w = [x for x in _alnum(r[1]) if x]
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit[j : j + n] = [True] * n
                    found |= windows[k]
        out[(r[0], len(w), sum(hit), tuple(sorted(str(i) for i in found if i is not None)))] += 1
    return out


@pytest.mark.parametrize("shard,part", [(1 << 20, 1 << 25), (50, 1 << 25), (200, 60)])
def test_passages(docs, rows, benchmark, shard, part):
    got = decontaminate.find_passages(docs, benchmark, shard_words=shard, max_part_bytes=part).collect()
    items = [tuple(r) for r in benchmark.collect()]
    assert Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got) == _hits(rows, items)
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_a_window_that_many_items_share(spark):
    """3000 items with one boilerplate window, in a document that repeats it 2000 times, and items without an id in several parts."""
    plate = "fill in the blank with one of the words below"
    items = [(i, f"{plate} number {i}") for i in range(3000)] + [(None, f"{plate} without {i}") for i in range(50)]
    rows = [(1, f"{plate} . " * 2000), (2, "nothing of the sort"), (None, f"x {plate} number 7 y")]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    for part in (1 << 25, 40_000):
        got = decontaminate.find_passages(df, bench, max_part_bytes=part).collect()
        assert Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got) == _hits(rows, items)


def test_benchmark_windows_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    text = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 200)).encode()) for i in range(1000)]
    size = sum(len(t) for _, t in text)
    decontaminate.Passages(text[:1], 10)  # what is made once for all
    tracemalloc.start()
    passages = decontaminate.Passages(text, 10)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 16 * size and sum(len(p) for p, _, _ in passages.groups) > 100_000


def test_clean_documents_stay(docs, rows, benchmark):
    clean = Counter(i for (i, _, n, _), c in _hits(rows, [tuple(r) for r in benchmark.collect()]).items() for _ in range(c) if not n)
    kept = decontaminate.keep_clean(docs, benchmark, shard_words=100)
    assert Counter(r.doc_id for r in kept.collect()) == clean and kept.columns == docs.columns


def test_passages_of_nothing(docs, empty, benchmark):
    assert decontaminate.find_passages(empty, benchmark).count() == 0
    assert decontaminate.find_passages(docs, benchmark.limit(0)).where("size(spans) > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    for _ in range(40):
        text = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0)
        index = decontaminate.FMIndex(text, 4)
        patterns = rng.integers(1, 4, (20, rng.integers(1, 4)))
        lo, hi = index.search(patterns)
        for p, a, z in zip(patterns, lo, hi):
            want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, z))) == want


def test_patience():
    rng = np.random.default_rng(4)
    for _ in range(500):
        a = rng.integers(0, 8, rng.integers(0, 14)).tolist()
        b = [x for x in a if rng.random() > 0.2] + rng.integers(0, 12, rng.integers(0, 4)).tolist()
        i = j = 0
        for x, y, n in linededup.patience(a, b):
            assert n > 0 and x >= i and y >= j and a[x : x + n] == b[y : y + n]
            i, j = x + n, y + n
    assert linededup.patience([1, 2, 3, 4, 5], [9, 1, 2, 3, 7, 4, 5]) == [(0, 1, 3), (3, 5, 2)]
    assert linededup.patience([1, 1, 2], [1, 1, 2]) == [(0, 0, 3)]


def test_patience_without_unique_lines():
    assert linededup.patience([1, 2, 1, 2], [1, 2, 1, 2]) == [(0, 0, 4)]
    assert linededup.patience([1, 2, 3], [1, 2, 3, 9, 1, 2, 3]) == [(0, 0, 3)]
    assert linededup.patience([7, 7, 1, 2, 1, 2, 8, 8], [5, 1, 2, 1, 2, 5]) == [(2, 1, 4)]
    assert linededup.patience([1, 1, 2, 2], [3, 3]) == []


def test_shortest_runs():
    rng = np.random.default_rng(9)
    for _ in range(300):
        sizes = [None if rng.random() < 0.2 else int(rng.integers(1, 9)) for _ in range(rng.integers(0, 12))]
        want = []
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes) + 1):
                if None in sizes[i:j]:
                    break
                if sum(sizes[i:j]) >= 10:
                    want.append((i, j))
                    break
        assert list(linededup._shortest(sizes, 10)) == want


def _block_lines(rows, least):
    """By definition: lines in a run of `least` bytes or more that a text with a smaller id has, and empty lines between such."""
    texts = {(i, t): [x for x in t.encode().split(b"\n") if x] for i, t, *_ in rows if i is not None and t is not None}
    first = {}
    for (i, _), ls in sorted(texts.items()):
        for a in range(len(ls)):
            size = 0
            for b in range(a + 1, len(ls) + 1):
                size += len(ls[b - 1])
                if size >= least:
                    first.setdefault(tuple(ls[a:b]), i)
    out = Counter()
    for i, t, *_ in rows:
        raw = t.encode().split(b"\n") if t is not None else []
        full = [n for n, x in enumerate(raw) if x]
        gone = [False] * len(raw)
        for a in range(len(full)) if i is not None else ():
            size = 0
            for b in range(a + 1, len(full) + 1):
                size += len(raw[full[b - 1]])
                if size >= least and first[tuple(raw[n] for n in full[a:b])] < i:
                    for n in full[a:b]:
                        gone[n] = True
        for a, b in zip(full, full[1:]):
            if gone[a] and gone[b]:
                gone[a : b + 1] = [True] * (b + 1 - a)
        out[(i, len(raw), sum(gone), None if t is None else b"\n".join(x for x, g in zip(raw, gone) if not g).decode())] += 1
    return out


def _line_result(df, *args):
    got = linededup.remove_shared_blocks(df, *args).collect()
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in got)
    return Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in got)


@pytest.mark.parametrize("rare", [2, 8])
def test_line_blocks(spark, docs, rows, rare):
    got = _line_result(docs, rare)
    assert got == _block_lines(rows, 60)
    assert sum(n * k for (_, _, n, _), k in got.items()) > 20


def test_line_blocks_of_random_texts(spark):
    """Few different lines, short and long, empty ones, in every order; ids with several texts; against the definition."""
    rng = np.random.default_rng(21)
    lines = [f"short {i}" for i in range(8)] + [f"a line of a middle length {i}" for i in range(8)] + ["", "", "x" * 61]
    rows = [(int(rng.integers(0, 60)), "\n".join(rng.choice(lines, rng.integers(0, 14)))) for _ in range(90)]
    rows += [(None, rows[0][1]), (70, None), (71, ""), (72, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = _block_lines(rows, 60)
    assert _line_result(df) == want and _line_result(df, 2, 4) == want


def test_one_line_in_every_document(spark):
    """A hot line and a hot first holder: nothing is lost where their rows are dealt to many tasks."""
    line = "the same line of more than sixty bytes in each and every one of the documents"
    rows = [(i, f"own {i}\n{line}\nalso own {i}") for i in range(3000)]
    got = _line_result(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
    assert got == Counter([(0, 3, 0, rows[0][1])] + [(i, 3, 1, f"own {i}\nalso own {i}") for i in range(1, 3000)])


def test_common_lines_whose_first_holders_have_parts(spark):
    """Two lines of 40 bytes together in 21 documents, apart in the first two; in others turned round."""
    one, two = "first line of the two" + "." * 19, "second line of the two" + "." * 18
    rows = [(0, f"{one}\nalone 0"), (1, f"{two}\nalone 1"), (2, f"{two}\nbetween\n{one}")]
    rows += [(i, f"own {i}\n{one}\n{two}\nend {i}") for i in range(10, 31)]
    want = _block_lines(rows, 60)
    removed = {i: n for i, _, n, _ in want}
    assert _line_result(spark.createDataFrame(rows, "doc_id long, text string")) == want and removed[30] == 2 and removed[10] == 0


@pytest.mark.parametrize("holders", [3, 20])
def test_blocks_of_short_lines(spark, holders):
    """Verse: no line of 16 bytes, the block of 60 and more is in all documents; a tail shorter than a block goes with it."""
    verse = "\n".join(f"verse no {i}" for i in range(9)) + "\nend"
    rows = [(i, f"own {i}\n{verse}\nlast {i}") for i in range(holders)] + [(50, verse), (51, verse[:40])]
    want = _block_lines(rows, 60)
    removed = {i: n for i, _, n, _ in want}
    assert _line_result(spark.createDataFrame(rows, "doc_id long, text string")) == want and removed[50] == 10 and removed[51] == 0


def test_line_blocks_of_nothing(empty):
    assert linededup.remove_shared_blocks(empty).count() == 0
