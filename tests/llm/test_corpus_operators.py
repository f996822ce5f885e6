"""Operators that compare documents with one another, against SQL or plain versions of them."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sondera.llm import components, linededup, mixing, neardup, ngram_lm, quality

from .conftest import FOLD, same, words


def shingles(text, k=5):
    w = words((text or "").translate(FOLD))
    if len(w) < k:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*[w[i:] for i in range(k)]))


def plain_components(sets, percent=75):
    """Least id reachable over links, from all pairs that share a shingle. sets: id -> set of sets (rows of one id)."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(set)
    for i, group in sets.items():
        for s in group:
            for g in s:
                held[g].add(i)
    for a, b in {p for ids in held.values() for p in itertools.combinations(sorted(ids), 2)}:
        if any(100 * len(x & y) >= percent * len(x | y) and x and y for x in sets[a] for y in sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def held_against_plain(docs, p=neardup.Minhash()):
    rows = docs.select(F.col("doc_id").cast("long"), "text").collect()
    sets = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            sets[r.doc_id].add(shingles(r.text))
    want = plain_components(sets)
    got = neardup.near_duplicates(docs, p).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((r.doc_id, len(shingles(r.text))) for r in rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_near_duplicates(documents, db):
    held_against_plain(documents)
    same(neardup.near_duplicates(documents).toPandas(), db.sql(neardup.oracle()).df())
    kept = neardup.keep_one(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in neardup.near_duplicates(documents).where("kept").collect()}


def test_near_duplicates_edges(edge, empty):
    held_against_plain(edge)
    kept = neardup.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 1").count() == 1
    assert neardup.near_duplicates(empty).count() == neardup.keep_one(empty).count() == 0


@pytest.mark.parametrize("small,block", [(24, 256), (2, 8)])
def test_a_large_group_of_graded_copies(spark, small, block):
    """Copies at every distance from one text: chains of links, buckets with many components, and texts that share a bucket
    but no link; small blocks make every path of the comparison run."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        copy = list(base)
        for at in rng.choice(120, k % 13, replace=False):
            copy[at] = f"z{rng.integers(1 << 30)}"
        rows.append((k * 3 + 1, " ".join(copy)))
    rows += [(1000 + k, " ".join([*base[:60], *(f"y{k}x{i}" for i in range(70))])) for k in range(40)]
    held_against_plain(spark.createDataFrame(rows, "doc_id int, text string"), neardup.Minhash(small=small, block=block))


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    held_against_plain(spark.createDataFrame([(5, a), (4, a), (4, b), (9, b), (7, "b0 b1")], "doc_id long, text string"))


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(300, 340)] + [(7, 7)] + [tuple(map(int, rng.integers(1000, 1200, 2))) for _ in range(120)]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_mixing_matches_sql(spark, documents, db):
    same(mixing.digest(mixing.plan(documents)).toPandas(), db.sql(mixing.oracle()).df())


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Water is poured by weight; sources over their bound are fixed there and the rest is poured again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, rest, out = set(order), sum(sizes.values()), {}
    while left:
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > most * sizes[s]]
        if not over:
            out |= {s: weight[s] * level for s in left}
            break
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
            left.remove(s)
    return out


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_mixing_takes_the_targets(request, table):
    docs = request.getfixturevalue(table)
    rows = docs.select("source", "text").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    want = plain_targets(dict(sizes))
    planned = mixing.plan(docs).collect()
    assert len(planned) == len(rows)
    taken = Counter()
    for r in planned:
        words_taken = sum(o.words for o in r.occurrences)
        assert 0 <= words_taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert all(0 <= o.position <= 1 for o in r.occurrences)
        taken[r.source] += words_taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_positions_follow_the_schedules(documents):
    """Up to each time a source has had the share of its words that the integral of its schedule says."""
    rows = mixing.curriculum(mixing.plan(documents)).toPandas()
    assert rows.position.is_monotonic_increasing
    ranks = {r.source: r["rank"] for r in mixing.plan(documents).select("source", "rank").distinct().collect()}
    for source, mine in rows.groupby("source"):
        pieces = mixing.integrated(mixing.SCHEDULES[ranks[source] % 3])
        for t in (0.25, 0.5, 0.9):
            share = max(a + w * (t - b) + s * (t - b) ** 2 / 2 for a, _, b, w, s in pieces if t >= b)
            had = mine.words[mine.position < t].sum() / mine.words.sum()
            assert abs(had - share) <= mine.words.max() / mine.words.sum() + 1e-9


def test_mixing_edges(edge, empty):
    out = mixing.mix_documents(edge)
    assert out.columns == edge.columns and out.where("trim(coalesce(text, '')) = ''").count() == 0
    assert mixing.digest(mixing.plan(empty)).count() == mixing.mix_documents(empty).count() == 0
    a, b = (sorted(map(str, mixing.plan(edge).collect())) for _ in range(2))
    assert a == b


def test_backoff_matches_sql(documents, db):
    same(ngram_lm.score(documents).toPandas(), db.sql(ngram_lm.oracle()).df())


def test_backoff_in_many_chunks_is_the_same(documents):
    one = ngram_lm.score(documents).orderBy("doc_id").collect()
    assert ngram_lm.score(documents, ngram_lm.Backoff(chunk=20_000)).orderBy("doc_id").collect() == one
    # and in two levels of sums
    assert ngram_lm.score(documents, ngram_lm.Backoff(chunk=20_000, one_level_bits=2)).orderBy("doc_id").collect() == one


def test_rows_of_a_chunk_do_not_follow_the_number_of_chunks():
    """In two levels a chunk of a hundred times the corpus has ten times the rows, not a hundred times."""
    text = " ".join(f"w{k * k % 9973} v{k % 613}" for k in range(60_000))
    batch = pa.record_batch({"chunk": pa.array([0]), "doc_id": pa.array([1]), "text": pa.array([text])})
    packs = pa.Table.from_batches(list(ngram_lm._pack_map([batch])))
    rows = {bits: ngram_lm._exploded(ngram_lm.Backoff(), -(-bits // 2))(packs).num_rows for bits in (8, 14, 20)}
    assert rows[8] <= 3 * 16 and rows[14] <= 3 * 128 and rows[20] <= 3 * 1024


def test_rows_of_a_part_are_read_without_copies_of_all(monkeypatch):
    """A part comes in pieces, with rows of many chunks: its columns are put together once, not for each row."""
    grams = [ngram_lm._table(ngram_lm.GRAMS, [(0, chunk, n, 2, ngram_lm._steps(np.array([chunk, 1 << 20], np.uint64)), ngram_lm.packed(np.array([1, 2], np.uint64))) for n in (1, 2)]) for chunk in range(300)]
    part, calls = pa.concat_tables(grams), []
    assert part.column("keys").num_chunks == 300
    monkeypatch.setattr(ngram_lm, "_column", lambda t, name, f=ngram_lm._column: calls.append(isinstance(t, pa.Table)) or f(t, name))
    table = ngram_lm._summed(part)
    assert [ngram_lm._keys(ngram_lm._whole(table), k).tolist() for k in range(2)] == [[1 << 20]] * 2
    joined = ngram_lm._joined(part, table)
    assert {ngram_lm.unpacked(x, 2).tolist()[1] for x in joined.column("sums").to_pylist()} == {600} and joined.num_rows == 600
    assert sum(calls) < 20


def test_the_count_table_is_that_of_the_corpus(documents, db):
    """Grams are hashes: their counts are compared, by order."""
    got = Counter(tuple(r) for r in ngram_lm.count_table(documents, ngram_lm.Backoff(chunk=30_000)).select("n", "count").collect())
    want = Counter()
    for n in (1, 2, 3):
        c = Counter()
        for (t,) in documents.select("text").collect():
            w = words((t or "").translate(FOLD))
            c.update(zip(*[w[k:] for k in range(n)]))
        want.update((n, v) for v in c.values() if v > 1)
    assert got == want


def test_backoff_of_a_row_repeated_many_times(spark):
    """Copies with one doc_id are packed as one row with its number, and scored as if they stood apart."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(30, size=40)) for _ in range(6)]
    rows = [(7, texts[0])] * 300 + [(None, texts[1])] * 200 + [(k, texts[k % 6]) for k in range(20, 40)]
    one = [(k, t) for k, (_, t) in enumerate(rows)]
    schema = "doc_id long, text string"
    plain = Counter(tuple(r)[1:] for r in ngram_lm.score(spark.createDataFrame(one, schema)).collect())
    got = ngram_lm.score(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert Counter(tuple(r)[1:] for r in got) == plain and Counter(r.doc_id for r in got)[7] == 300


def test_backoff_edges(edge, empty):
    got = ngram_lm.score(edge).collect()
    assert len(got) == edge.count() and ngram_lm.score(empty).count() == 0
    for r in got:
        assert r.n_words == r.n_order0 + r.n_order1 + r.n_order2 + r.n_order3
        assert (r.mean_log is None) == (r.n_words == 0)
    assert {r.n_words for r in got if r.doc_id in (3, 4, 5)} == {0}


def test_packing_is_lossless():
    rng = np.random.default_rng(1)
    for top in (1, 255, 256, 1 << 20, 1 << 55):
        x = rng.integers(0, top, 1000, dtype=np.uint64)
        assert (ngram_lm.unpacked(ngram_lm.packed(x), 1000) == x).all()


@pytest.mark.parametrize("min_words", [5, 10, 50])
def test_line_dedup_matches_sql(documents, db, min_words):
    same(linededup.dedup_lines(documents, min_words).toPandas(), db.sql(linededup.oracle(min_words)).df())


def plain_windows(found, least):
    """Index ranges of the shortest run from each line on with so many words."""
    for i in range(len(found)):
        words = 0
        for j in range(i, len(found)):
            words += found[j].w
            if words >= least:
                yield i, j
                break


def test_fingerprints_are_the_minima_of_windows(spark, documents):
    """One place per window, the last of the least hashes; far fewer than there are lines where lines are short."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(k, "\n".join(f"l{rng.integers(30)} x" for _ in range(200))) for k in range(5)], "doc_id long, text string").unionByName(documents.select("doc_id", "text").where("doc_id > 10"))
    found = linededup.lines(docs, 20)
    got = defaultdict(set)
    for r in linededup.fingerprints(found, 20).collect():
        got[r.doc_id].add((r.pos, r.h))
    want, n_lines = defaultdict(set), Counter()
    for r in found.collect():
        n_lines[r.doc_id] = len(r.found)
        for i, j in plain_windows(r.found, 20):
            least = min(r.found[i : j + 1], key=lambda x: (x.h, -x.pos))
            want[r.doc_id].add((least.pos, least.h))
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert all(len(got[k]) < n_lines[k] / 2 for k in range(5))


def test_only_windows_around_joined_fingerprints_are_compared(spark):
    """What the join of fingerprints does not match is not extended, so a repeat is found by its fingerprint and by nothing else."""
    passage = "\n".join(f"shared line {k} of some words" for k in range(12))
    own = lambda d: "\n".join(f"own line {k} of text {d} alone" for k in range(30))
    docs = spark.createDataFrame([(d, f"{own(d)}\n{passage}\n{own(-d)}") for d in range(1, 5)], "doc_id long, text string")
    found = linededup.lines(docs, 50).cache()
    matched = linededup.matches(linededup.fingerprints(found, 50))
    assert {p for r in matched.collect() for p in r.places} <= set(range(30, 42))
    runs = linededup.extended(found, matched, 50)
    near = runs.collect()
    # a window holds 9 lines or so of 6 words: only those that reach a place of the passage are there
    assert near and all(r.last >= 30 and r.first <= 41 for r in near)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in linededup.repeats(runs).collect()}
    assert spans == {d: [(30, 41)] for d in (2, 3, 4)}
    none = matched.where("doc_id < 0")
    assert linededup.repeats(linededup.extended(found, none, 50)).count() == 0
    found.unpersist()


def test_many_short_lines_and_overlapping_repeats(spark, db):
    """Texts that repeat a short cycle of lines: runs overlap their own first copies, and one text holds many spans."""
    rng = np.random.default_rng(8)
    rows = []
    for d in range(12):
        cycle = [f"c{rng.integers(6)} w" for _ in range(rng.integers(3, 9))]
        rows.append((d, "\n".join([*(cycle * 6), "", *(f"u{rng.integers(9)} v" for _ in range(40))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    import pandas as pd

    cycles = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by name
    for least in (4, 12):
        want = db.sql(linededup.oracle(least).replace("FROM documents", "FROM cycles")).df()
        assert want.n_deleted.sum() > 0
        same(linededup.dedup_lines(frame, least).toPandas(), want)


def test_shared_passages_go_after_the_first(spark):
    passage = "\n".join(" ".join(f"p{j}q{k}" for k in range(20)) for j in range(4))  # 80 words on four lines
    tail = "a tail of few words"
    rows = [(1, f"own one\n{passage}\n{tail}\nend one"), (2, f"own two\n\n{passage}\n{tail}\nend two"), (3, passage), (4, f"{passage.splitlines()[0]}\nother words here"), (5, f"x\n{passage}\ny\n{passage}\nz")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1]
    assert got[2].text == "own two\n\nend two" and got[2].n_deleted == 5
    assert (got[3].text, got[3].n_deleted) == ("", 4) and got[5].text == "x\ny\nz"


def test_line_dedup_edges(edge, empty):
    got = linededup.dedup_lines(edge).collect()
    assert len(got) == edge.count() and linededup.dedup_lines(empty).count() == 0
    assert {r.n_deleted for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert {r.text for r in got if r.doc_id == 1} == {edge.where("doc_id = 1").first().text}


# ---------------------------------------------------------------- the pipeline


def test_pipeline_is_its_stages_done_plainly(spark, documents, benchmark_items, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    rows = {r.doc_id: r for r in documents.collect()}
    good = {r.doc_id for r in quality.judge(documents).where("kept").collect()}
    comp = plain_components({i: {shingles(rows[i].text)} for i in good})
    single = {i for i in good if comp[i] == i}
    clean = {i for i in single if not any(b.text in rows[i].text for b in benchmark_items.collect())}
    left = documents.where(F.col("doc_id").isin(sorted(clean)))
    curriculum = sorted((o.position, r.doc_id, o.epoch) for r in mixing.plan(left).collect() for o in r.occurrences)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for _, i, _ in curriculum:
        ids = np.array([*whole.encode(rows[i].text, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_stages_keep_the_columns_of_edge_documents(spark, edge):
    import corpus_pipeline

    for table in (edge, edge.where("doc_id = -1")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, "/root/testdata/sf0.001")
            assert out.columns == table.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001").count()


def test_a_long_lookup_table_is_joined_with_salts(edge, monkeypatch):
    from sondera.llm import common

    want = sorted(map(str, mixing.plan(edge).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.plan(edge).collect())) == want
