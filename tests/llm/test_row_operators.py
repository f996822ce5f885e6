"""Operators that look at one text at a time, against plain versions of them."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from sondera.llm import decontam, licenses, pii, quality, sharding, tokens

from .conftest import FOLD, LONG, words


def base_counts(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", "".join(w))), dup, len(covered)


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_quality_counts(request, table):
    docs = request.getfixturevalue(table)
    texts = Counter(base_counts(t) for (t,) in docs.select("text").collect())
    got = quality.judge(docs).collect()
    assert Counter(tuple(r[c] for c in quality.COUNTS) for r in got) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def jsd(p, q):
    p, q = np.array(p, float) / max(sum(p), 1), np.array(q, float) / max(sum(q), 1)
    m = (p + q) / 2
    part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0, (part(p) + part(q)) / 2))


def bare_words(text):
    out = []
    for w in words(text):
        for cut in (lambda x: x[:-1] if len(x) > 1 and x[-1] in ".,;:!?'\"()-" else x, lambda x: x[1:] if len(x) > 1 and x[0] in ".,;:!?'\"()-" else x):
            w = cut(w)
        out.append(w.translate(FOLD))
    return out


def histograms(text, common):
    """common: cells of the histogram's bins."""
    chars, bins = Counter(), Counter()
    for c in "".join(words(text)):
        name = "beyond" if c > "\x7f" else "vowel" if c in "aeiou" else "consonant" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "symbol" if c in "#*$%&|<>" else "mark" if c in ".,;:!?'\"()-" else "other"
        chars[name] += 1
    for cell in quality.cells(bare_words(text)).tolist() if words(text) else []:
        bins[cell if cell in common else None] += 1
    return [chars[c] for c in quality.CLASSES], [bins[c] for c in [*sorted(common), None]]


def common_cells(rows, rules):
    """Cells of the known words, and of each language's most frequent ones among documents that pass the base rules."""
    per = {}
    for r in rows:
        n, _, _, _, rep = base_counts(r.text)
        if n >= 50 and 100 * rep <= 50 * n:
            per.setdefault(r.lang, Counter()).update(quality.cells(bare_words(r.text)).tolist())
    known = quality.cells(sorted({w for ws in quality.COMMON_WORDS.values() for w in ws})).tolist()
    return {*known, *(c for counts in per.values() for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: rules.frequent_words])}


def test_quality_verdict(documents):
    rules = quality.Rules()
    rows = documents.select("doc_id", "text", "lang").collect()
    common, refs = common_cells(rows, rules), {}
    for r in rows:
        n, _, _, _, rep = base_counts(r.text)
        if n >= 50 and 100 * rep <= 50 * n:
            c, w = histograms(r.text, common)
            old = refs.setdefault(r.lang, [np.zeros(len(c)), np.zeros(len(w))])
            old[0] += c
            old[1] += w
    got = {r.doc_id: r for r in quality.judge(documents).collect()}
    for r in rows:
        kept = not got[r.doc_id].base_failed
        for k, (hist, name) in enumerate(zip(histograms(r.text, common), ("char_distance", "word_distance"))):
            usable = {x: v[k] for x, v in refs.items() if v[k].sum() >= rules.least_reference}
            if sum(hist) < (rules.least_chars, rules.least_words)[k] or not usable:
                assert got[r.doc_id][name] is None
                continue
            d = min(jsd(hist, q) for q in ([usable[r.lang]] if r.lang in usable else usable.values()))
            if k:
                d = math.sqrt(max(0, d * d - rules.free_bins / (8 * math.log(2) * sum(hist))))
            assert abs(d - got[r.doc_id][name]) < 1e-9
            kept &= d <= (rules.most_char_distance, rules.most_word_distance)[k]
        assert got[r.doc_id].kept == kept
    stage = quality.keep_good(documents)
    assert stage.columns == documents.columns
    assert {r.doc_id for r in stage.select("doc_id").collect()} == {k for k, v in got.items() if v.kept}


def test_a_language_that_nobody_listed_is_judged(spark):
    """Prose of a made-up language passes; the same letters in words that are not its words do not."""
    rng = np.random.default_rng(21)
    common = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("n", "sa", "re", "vo")]
    rare = lambda: "".join(rng.choice(list("kalomitunsrevy"), 7))
    prose = lambda: " ".join(str(rng.choice(common)) if rng.random() < 0.6 else rare() for _ in range(300))
    rows = [(k, prose(), "zz") for k in range(60)] + [(1000 + k, " ".join(rare() for _ in range(300)), "zz") for k in range(4)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[k].kept for k in range(60)) and not any(got[1000 + k].kept for k in range(4))
    assert min(got[1000 + k].word_distance for k in range(4)) > 0.3 > max(got[k].word_distance for k in range(60))


def test_quality_edges(edge, empty):
    assert quality.keep_good(edge).columns == edge.columns
    assert quality.judge(empty).count() == quality.keep_good(empty).count() == 0


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def test_pseudonyms(spark):
    text = 'card 4111 1111 1111 1111, 4111111111111111 and 4111111111111112; ssn 219-09-9999 not 000-12-3456; on 2024-02-29 or 31/12/1999 not 2023-02-30; +44 20 7946 0958; 10.0.0.255 not 999.1.1.1; Ann.B-9@example.org; token = "0123456789abcdef0123"'
    docs = spark.createDataFrame([(1, text), (2, "again 219-09-9999 and 2024-02-29, x@y.org"), (3, "version 1.2.3, 12 apples, 5 < 6"), (4, None), (5, "")], "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    new = got[1].text
    assert len(new) == len(text) or abs(len(new) - len(text)) <= 6  # an address may change its length
    for secret in ("4111 1111 1111 1111", "4111111111111111", "219-09-9999", "2024-02-29", "31/12/1999", "20 7946 0958", "10.0.0.255", "Ann.B-9@", "0123456789abcdef0123"):
        assert secret not in new
    for kept in ("4111111111111112", "000-12-3456", "2023-02-30", "999.1.1.1", "@example.org", "+44 "):
        assert kept in new
    cards = re.findall(r"card (\d{4} \d{4} \d{4} \d{4}), (\d{16})", new)[0]
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) == 0
    ssn, day = re.findall(r"ssn (\S+)", new)[0], re.findall(r"on (\d{4}-\d\d-\d\d)", new)[0]
    assert ssn in got[2].text and day in got[2].text
    assert (got[3].text, got[3].n_replaced, got[4].text, got[4].n_replaced, got[5].text) == ("version 1.2.3, 12 apples, 5 < 6", 0, None, 0, "")
    assert got[1].kinds == "card,date,email,ipv4,phone,secret,ssn" and got[1].n_replaced == 9
    assert pii.pseudonymise(docs, "other").where("doc_id = 2").first().text != got[2].text


def test_values_side_by_side_are_all_replaced(spark):
    text = "+1 (826) 555-4081 190.137.223.204 4111111111111111 +1 (826) 555-4081 +44 20 7946 0958 10.1.2.3 a@b.org 4111111111111111 219-09-9999 2024-02-29"
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id int, text string"), "k").first()
    assert got.n_replaced == 10
    assert not any(v in got.text for v in ("555-4081", "190.137.223.204", "4111111111111111", "7946 0958", "10.1.2.3", "219-09-9999", "2024-02-29"))


def test_feistel_is_a_permutation(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"), F.col("id"))
    digits = [r.x for r in rows.select(pii.feistel_digits(F.col("d"), "k", "t").alias("x")).collect()]
    assert len(set(digits)) == 1000 and all(re.fullmatch(r"\d{3}", d) for d in digits)
    low, high = F.lit(25).cast("long"), F.lit(40).cast("long")
    numbers = [r.x for r in rows.select(pii.feistel_number(F.col("id"), low, high, "k", "t").alias("x")).collect()]
    assert sorted(numbers) == list(range(1000)) and numbers != sorted(numbers)
    letters = rows.select(F.concat(F.lit("a"), F.col("d"), F.lit("Z")).alias("t")).select(pii.feistel_text(F.col("t"), "k", "t", pii._moved).alias("x")).collect()
    assert len({r.x for r in letters}) == 1000 and all(re.fullmatch(r"[a-z]\d{3}[A-Z]", r.x) for r in letters)


#: Numbers in many layouts, and things that look like them.
PRIVATE = """+1 212 555 1234 | +12125551234 | +1-212-555-1234 | +1 (212) 555-1234 | (212) 555-1234 | 212-555-1234 | 212.555.1234 | 1-212-555-1234 | 1 (212) 555-1234
+44 20 7946 0958 | +442079460958 | +44 (0)20 7946 0958 | +49 30 1234567 | +49301234567 | +33 1 23 45 67 89 | +33123456789 | +7 495 123 45 67 | +353 1 234 5678 | +212 522 123456
12/31/2020 | 31/12/2020 | 2020-12-31 | 02/29/2024 | 02/30/2024 | 2024-02-29 | 05/06/2021 | 06/05/2021
token = "0123456789abcdef0123" | API_KEY: 0123456789ABCDEF0123 | 'secret':'0123456789abcdef0123' | password=0123456789abcdef0123 | key 0123456789abcdef0123 | sha 0123456789abcdef0123
jos\u00e9.m\u00fcller@x.org | jos\u00e8.m\u00fcller@x.org | \u6f22\u5b57.a1@x.org | Ann.B-9@example.org, ann@b.co.uk. | 999-12-3456 | 219-09-9999
123-456-7890 | 212-155-1234 | 5212-555-1234 | 212-555-12345 | 4111 1111 1111 1111 | 4111-1111-1111-1112 | 10.0.0.1 | 1.2.3 | 3.14159 | page 212-555 | 1999-2001 | +1 2"""


def test_pseudonyms_match_a_plain_version(spark, documents, edge):
    from .plain_pii import pseudonymise

    own = spark.createDataFrame([(k, t) for k, t in enumerate([PRIVATE, *PRIVATE.split("\n"), *PRIVATE.replace("\n", " | ").split(" | ")])], "doc_id long, text string")
    values = 0
    for docs in (own, documents, edge):
        rows = docs.select("doc_id", "text").collect()
        want = Counter((r.doc_id, *pseudonymise(r.text, "k")) for r in rows)
        assert Counter(map(tuple, pii.pseudonymise(docs, "k").collect())) == want
        values += sum(n * c for (_, _, n, _), c in want.items())
    assert values > 100


def test_one_value_has_one_pseudonym_in_any_layout(spark):
    lines = PRIVATE.split("\n")
    rows = [(100 * k + i, v.strip()) for k, line in enumerate(lines) for i, v in enumerate(line.split(" | "))]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    plain = lambda i: re.sub(r"\D", "", got[i].text.replace("(0)", ""))
    american = {plain(k)[-10:] for k in range(9)}
    assert len(american) == 1 and re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", american.pop()) and "2125551234" not in plain(0)
    assert len({plain(k) for k in (100, 101, 102)}) == len({plain(k) for k in (103, 104)}) == len({plain(k) for k in (105, 106)}) == 1
    for k, code in ((100, "+44"), (103, "+49"), (107, "+7 "), (108, "+353"), (109, "+212")):
        assert got[k].text.startswith(code) and got[k].text != dict(rows)[k]
    us, eu, iso = (re.findall(r"\d+", got[k].text) for k in (200, 201, 202))
    assert (us[2], us[0], us[1]) == (eu[2], eu[1], eu[0]) == tuple(iso) and got[204].n_replaced == 0 and iso != ["2020", "12", "31"]
    assert plain(203) and {got[k].n_replaced for k in (206, 207)} == {1}
    hidden = {re.findall("[0-9a-f]{20}", got[k].text.lower())[0] for k in (300, 301, 302, 303)}
    assert len(hidden) == 1 and hidden != {"0123456789abcdef0123"} and got[304].n_replaced == got[305].n_replaced == 0
    assert got[400].text != got[401].text and got[404].n_replaced == 0
    assert [got[500 + k].n_replaced for k in range(12)] == [0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 0, 0]


def test_pseudonyms_of_any_length(spark):
    rows, k = [], 0
    for n in (200, 201, 202, 300, 3000):
        rows += [(k, f"to {'ab' * (n // 2)}{'c' * (n % 2)}@example.org now"), (k + 1, f"to me@{'h.' * (n // 2)}example.org now")]
        k += 2
    for n in (127, 128, 129, 10_000):
        rows.append((k, f"token={'0123456789abcdef' * (n // 16)}{'7' * (n % 16)} end"))
        k += 1
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()}
    for k, text in rows:
        assert got[k].n_replaced == 1 and got[k].text != text and len(got[k].text) == len(text)


def test_pseudonyms_edges(edge, empty):
    got = pii.pseudonymise(edge, "k")
    assert sorted(map(str, (r.text for r in got.collect()))) == sorted(map(str, (r.text for r in edge.select("text").collect())))
    assert pii.pseudonymise(empty, "k").count() == 0


PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def plain_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    at, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_licence_phrases(request, table):
    docs = request.getfixturevalue(table)
    want = Counter(plain_phrases(t) for (t,) in docs.select("text").collect())
    got = licenses.scan(docs).collect()
    assert Counter((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_matching_statistics_are_longest_template_runs():
    scanner = licenses.Scanner(licenses.Scan(), licenses.TEMPLATES)
    sequences = [np.searchsorted(scanner.vocabulary, licenses._words_of(t)).tolist() for _, t in licenses.TEMPLATES]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, min(len(s), i + 12) + 1)}
    rng = np.random.default_rng(5)
    stream = []
    for _ in range(60):
        s = sequences[rng.integers(len(sequences))]
        a = int(rng.integers(len(s)))
        stream += s[a : a + int(rng.integers(1, 9))]
    for k, (_, length) in enumerate(scanner.automaton.stream(stream)):
        longest = next(n for n in range(min(k + 1, 12), -1, -1) if not n or tuple(stream[k + 1 - n : k + 1]) in runs)
        assert length == longest or length >= 12


def test_licence_spans(spark):
    notice = licenses.TEMPLATES[2][1]
    damaged = notice.replace("without restriction", "with no restriction").replace("files (the", "files, here the")
    docs = spark.createDataFrame([(1, "x y " + notice + " z"), (2, damaged), (3, "the rights to use, copy, modify"), (4, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[1].labels == "mit" and got[1].score == 1 and got[1].spans[0]["first"] == 2
    assert got[2].labels == "mit" and 0.8 <= got[2].score < 1
    assert (got[3].labels, got[3].score) == ("", 0) and got[4].labels == "cc-by-nc"


def plain_spans(text, p=licenses.Scan(), known=licenses.TEMPLATES):
    """(label, first, last, share) from runs found by comparing every place of the text with every place of every template."""
    file = licence_words(text)
    templates = [licence_words(t) for _, t in known]
    run = {}  # (template, place in it, place in the file) -> length of the run that ends there
    for t, words_ in enumerate(templates):
        at = {}
        for j, w in enumerate(words_):
            at.setdefault(w, []).append(j)
        for k, w in enumerate(file):
            for j in at.get(w, ()):
                run[t, j, k] = run.get((t, j - 1, k - 1), 0) + 1
    longest = Counter()
    for (_, _, k), n in run.items():
        longest[k] = max(longest[k], n)
    chains = {}
    for (t, j, k), n in sorted(run.items(), key=lambda x: (x[0][2] - x[1], x[0][1] - x[1], x[1])):
        if n != longest[k] or n < p.least_run or longest[k + 1] == n + 1:
            continue
        best = None
        for c in chains.setdefault(t, []):
            new = min(n, k - c["k"], j - c["j"])
            if new > 0 and k - n - c["k"] <= p.gap and j - n - c["j"] <= p.gap and (best is None or c["n"] > best["n"]):
                best = c
        if best is None:
            chains[t].append({"first": k - n + 1, "k": k, "j": j, "n": n})
        else:
            best["n"] += min(n, k - best["k"], j - best["j"])
            best["k"], best["j"] = k, j
    return Counter((known[t][0], c["first"], c["k"], min(1, c["n"] / len(templates[t]))) for t, cs in chains.items() for c in cs if c["n"] >= p.covered * len(templates[t]))


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def test_licence_spans_match_a_plain_version(spark, documents, edge):
    rng = np.random.default_rng(12)
    rows = []
    for k, (_, t) in enumerate(licenses.TEMPLATES * 2):
        w = t.split()
        for _ in range(int(rng.integers(0, 2 + len(w) // 12))):
            at = int(rng.integers(len(w)))
            w[at : at + int(rng.integers(0, 4))] = ["changed"] * int(rng.integers(0, 3))
        rows.append((k, "before it " + " ".join(w) + " and after " + (licenses.TEMPLATES[int(rng.integers(len(licenses.TEMPLATES)))][1] if k % 3 == 0 else "")))
    damaged = spark.createDataFrame(rows, "doc_id long, text string")
    seen = 0
    for docs in (damaged, documents, edge):
        for r, text in zip(licenses.scan(docs, templates=licenses.TEMPLATES).collect(), [x.text for x in docs.select("text").collect()]):
            want = plain_spans(text)
            assert Counter((s.label, s["first"], s.last, s.covered) for s in r.spans) == want
            found = {x[0] for x in want} | set(filter(None, r.base_labels.split(",")))
            assert r.labels == ",".join(sorted(found)) and r.score == max([x[3] for x in want] + [0.5 * (r.n_base > 0)])
            seen += len(want)
    assert seen > 80


def test_whole_licences_have_their_labels(spark):
    rows = [(k, t) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k].labels.split(",") and got[k].score == 1
    assert {label for label, _ in licenses.TEMPLATES} >= {"zlib", "boost", "epl", "gpl", "apache", "bsd", "mit", "isc"}


def test_sections_of_whole_licences(spark):
    """A licence has its label, and so has any section of it that is quoted, a little changed too; spans are those of a plain version."""
    sections = licenses.whole_licences()
    known = (*licenses.TEMPLATES, *sections)
    assert len(sections) > 200 and {label for label, _ in sections} == set(licenses.WHOLE)
    rng = np.random.default_rng(13)
    rows = []
    for k in range(0, len(sections), 9):
        w = sections[k][1].split()
        w[len(w) // 3] = "changed"
        rows.append((k, "lorem " + " ".join(w) + " ipsum"))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        assert sections[k][0] in got[k].labels.split(",") and got[k].score > 0.8
        if rng.random() < 0.15:
            assert Counter((s.label, s["first"], s.last, s.covered) for s in got[k].spans) == plain_spans(text, known=known)


def test_licence_empty(empty):
    assert licenses.scan(empty).count() == 0


def edits(a, b):
    """Least edits of a against any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_of_whole_items(documents, benchmark_items):
    items = benchmark_items.collect()
    want = {(r.doc_id, i.item_id) for r in documents.collect() for i in items if i.text in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(documents, benchmark_items).collect()}
    assert want <= got and {d for d, _ in got} == {d for d, _ in want}
    kept = decontam.keep_clean(documents, benchmark_items)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect()} - {d for d, _ in got}


def test_leaks_within_the_edit_budget_are_found(spark):
    import pyarrow as pa

    rng = np.random.default_rng(7)
    make = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    p = decontam.Search()
    items = [(k, make(int(rng.integers(60, 260)))) for k in range(12)]
    texts = []
    for k in range(60):
        item = list(items[k % 12][1])
        for _ in range(k % 9):
            at = int(rng.integers(len(item)))
            item[at : at + int(rng.integers(0, 2))] = list(make(int(rng.integers(0, 2))))
        texts.append(make(200) + ". " + "".join(item).upper() + "! " + make(150))
    index = decontam.Index(items, p)
    buf, offs = decontam.normalised(pa.array(texts))
    found = {(r, w) for r, w in zip(*decontam.search(buf, offs, index)[:2])}
    for r in range(len(texts)):
        for w in range(len(index)):
            window = index.letters[w, : index.size[w]].tobytes().decode()
            near = edits(window, buf[offs[r] : offs[r + 1]].tobytes().decode()) <= index.budget[w]
            assert near == ((r, w) in found)


def test_short_items_are_found_by_all_their_words(spark):
    items = [(1, "Two plus two?"), (2, "x"), (3, "The end."), (None, "Plus, TWO"), (4, "..."), (5, "plus two"), (6, "a short item of six words"), (7, "Two plus two?")]
    texts = [(1, "what is two - PLUS two"), (2, "two plus twofold x1 ax"), (3, "x"), (4, "the\nend, of it"), (5, "the ending bend"), (6, "...?!"), (7, None), (8, "a short item of six"), (9, "see: A short item of, six words"), (None, "the end")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    flat = lambda t: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]
    want = Counter()
    for d, t in texts:
        for i, item in items:
            w, x = flat(t), flat(item)
            want[d, i] += any(x and w[k : k + len(x)] == x for k in range(len(w)))
    got = decontam.leaks(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == +want and all((r.distance, r.n_windows, r.covered) == (0, 1, 1.0) for r in got)
    assert {r.first_char for r in got if (r.doc_id, r.item_id) == (1, 1)} == {8}
    clean = decontam.keep_clean(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts} - {d for d, _ in +want} and clean.count() == 5


def test_a_text_of_one_letter_is_searched_in_bounded_memory(spark):
    """100,000 equal letters against an item that holds 100 of them: 8.9 million pairs of places, summed lot by lot."""
    import tracemalloc

    import pyarrow as pa

    p = decontam.Search()
    index = decontam.Index([(1, "some words first " + "z" * 100 + " and some words after it")], p)
    buf, offs = decontam.normalised(pa.array(["z" * 100_000, "q" * 500]))
    small = decontam.Search(lot=1 << 16)
    tracemalloc.start()
    got = decontam.shared_grams(buf, offs, decontam.Index([(1, "some words first " + "z" * 100 + " and some words after it")], small))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    assert all((a == b).all() for a, b in zip(got, decontam.shared_grams(buf, offs, index)))
    docs = spark.createDataFrame([(1, "z" * 100_000), (2, "y" * 100_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "z" * 120), (2, "short words here")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontam.leaks(docs, bench).collect()} == {(1, 1, 0)}


def test_a_benchmark_of_many_blocks_gives_the_same(documents, edge, benchmark_items):
    one, many = decontam.Search(), decontam.Search(block=500, sieve_bits=16, lot=1 << 12)
    for docs in (documents, edge):
        assert sorted(map(str, decontam.leaks(docs, benchmark_items, many).collect())) == sorted(map(str, decontam.leaks(docs, benchmark_items, one).collect()))
        assert sorted(map(str, decontam.keep_clean(docs, benchmark_items, many).collect())) == sorted(map(str, decontam.keep_clean(docs, benchmark_items, one).collect()))
    assert decontam.leaks(documents, benchmark_items).count() > 0


def test_leaks_edges(spark, edge, empty, benchmark_items):
    odd = spark.createDataFrame([(None, "x" * 80), (1, None), (2, ""), (3, "short"), (4, LONG[300:900])], "item_id long, text string")
    assert {r.doc_id for r in decontam.leaks(edge, odd).collect()} == {6}
    assert decontam.keep_clean(edge, odd).columns == edge.columns
    assert decontam.leaks(empty, benchmark_items).count() == decontam.leaks(edge, odd.limit(0)).count() == 0


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_shards(request, table):
    docs = request.getfixturevalue(table)
    got = sharding.shard(docs).collect()
    raw = [(r.text or "").encode() for r in docs.select("text").collect()]
    assert Counter((len(t) + 16, zlib.crc32(t)) for t in raw) == Counter((r.size, r.text_crc32) for r in got)
    for s in {r.shard for r in got}:
        mine = [r.slot for r in got if r.shard == s]
        assert sorted(mine) == list(range(len(mine)))
    assert all(0 <= r.shard < 40 and r.law == "key" and r.grown_shard in (r.shard, 40) for r in got)
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)


def plain_shards(rows, owner, shards):
    """(doc_id, size, crc, shard, slot, grown shard, virtual slot) of each row, by sorting."""
    import hashlib

    grown = dict.fromkeys(sharding.grow(owner, shards), shards)
    out = []
    for r in rows:
        raw = (r.text or "").encode()
        key = hashlib.md5(f"slots|{'n' if r.doc_id is None else f'v{r.doc_id}'}".encode()).hexdigest()
        v = int(key[:12], 16) % len(owner)
        out.append((owner[v], v, r.doc_id is not None, r.doc_id or 0, zlib.crc32(raw), len(raw) + 16, grown.get(v, owner[v])))
    place, done = Counter(), []
    for shard, v, has, doc, crc, size, later in sorted(out):
        done.append((doc if has else None, size, crc, shard, place[shard], later, v))
        place[shard] += 1
    return Counter(done)


@pytest.mark.parametrize("table", ["documents", "edge"])
def test_shards_match_a_plain_version(request, table):
    docs = request.getfixturevalue(table)
    want = plain_shards(docs.select("doc_id", "text").collect(), [o for _, _, o in sharding.first_map(7)], 7)
    got = sharding.shard(docs, 7).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", "vslot").collect()
    assert Counter(map(tuple, got)) == want


def test_one_key_with_most_rows(spark):
    rows = [(7, "same text")] * 500 + [(None, "same text")] * 300 + [(k, "x" * k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = plain_shards(docs.collect(), [o for _, _, o in sharding.first_map(3)], 3)
    assert Counter(map(tuple, sharding.shard(docs, 3).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", "vslot").collect())) == want


def test_a_stored_map_is_edited_and_read_again(spark, documents, tmp_path):
    path = f"file://{tmp_path}/map"
    rows = documents.select("doc_id", "text").collect()
    get = lambda: Counter(map(tuple, sharding.shard(documents, 5, path=path).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", "vslot").collect()))
    first = get()
    version, shards, owner = sharding.load_map(spark, path)
    assert (version, shards) == (1, 5) and first == get() == plain_shards(rows, owner, 5)
    # a second run with another number still uses the stored map
    assert Counter(map(tuple, sharding.shard(documents, 9, path=path).select("doc_id", "shard").collect())) == Counter((r[0], r[3]) for r in first)
    assert sharding.add_shard(spark, path) == 2
    version, shards, grown = sharding.load_map(spark, path)
    assert shards == 6 and all(a == b or b == 5 for a, b in zip(owner, grown)) and get() == plain_shards(rows, grown, 6)
    assert {(r[0], r[5]) for r in first} == {(r[0], r[3]) for r in get()}
    assert sharding.rebalance_map(spark, path, documents, 0.01) == 3
    _, _, even = sharding.load_map(spark, path)
    assert even != grown and get() == plain_shards(rows, even, 6)
    load = lambda o: [sum(r[1] for r in plain_shards(rows, o, 6).elements() if r[3] == s) for s in range(6)]
    assert max(load(even)) < max(load(grown)) and sharding.load_map(spark, path, 1)[2] == owner
    # a version whose job did not finish does not count
    (tmp_path / "map" / "version=4").mkdir()
    assert sharding.load_map(spark, path)[0] == 3 and sharding.rebalance_map(spark, path, documents, 0.01) in (3, 4)


def test_shard_map_edits():
    for n in (1, 2, 39, 40):
        owner = [o for _, _, o in sharding.first_map(n)]
        held = Counter(owner)
        assert len(held) == n and max(held.values()) - min(held.values()) <= 1
        taken = sharding.grow(owner, n)
        assert len(taken) == sharding.SLOTS // (n + 1)
    load = {s: 1000 + 50 * (s % 97) for s in range(sharding.SLOTS)}
    load[5] = 40_000
    edits_ = sharding.rebalance(owner, load, 40)
    for s, a, b in edits_:
        assert owner[s] == a
        owner[s] = b
    sums = Counter()
    for s, o in enumerate(owner):
        sums[o] += load[s]
    assert max(sums.values()) <= 1.05 * sum(load.values()) / 40


def test_shards_empty(empty):
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("table,vocabulary", [("documents", "word_bpe_49k.json"), ("edge", "word_bpe_49k.json"), ("edge", "byte_bpe_50k.json")])
def test_token_files_round_trip(request, table, vocabulary):
    import xxhash
    from tokenizers import Tokenizer

    docs, path = request.getfixturevalue(table), public_tokenizers.path(vocabulary)
    whole = Tokenizer.from_file(path)
    place = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows = sorted(((r.doc_id is None, r.doc_id, place(r.text), r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0], x[1] or 0, x[2]))
    want, start = [], 0
    for _, doc, _, text in rows:
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokens.read_tokens(*tokens.write_tokens(docs, path)).collect()
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_token_files_of_another_store_are_read_by_ranges(spark, documents, tmp_path):
    from pyarrow import fs

    folder, parts = tokens.write_tokens(documents, public_tokenizers.path("word_bpe_49k.json"), folder=f"file://{tmp_path}/t")
    name = f"{parts.first().part:06d}"
    here = tokens.Store(folder)
    there = tokens.Store(folder)
    there.local, there.fs = False, fs.LocalFileSystem()
    for kind, dtype in (("ids", "<u2"), ("offsets", "<i8"), ("docs", "u1")):
        a, b = here.array(f"{name}.{kind}", dtype), there.array(f"{name}.{kind}", dtype)
        assert isinstance(a, np.memmap) and all((a[k : k + 7] == b[k : k + 7]).all() for k in range(0, len(a), max(1, len(a) // 50)))
    want = sorted(map(str, tokens.read_tokens(folder, parts).collect()))
    rows = [r for b in tokens._read_map(folder, 100)([pa_batch(parts)]) for r in b.to_pylist()]
    assert len(rows) == len(want) and Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows) == Counter((r.doc_id, r.start, r.ids_crc32) for r in tokens.read_tokens(folder, parts).collect())


def pa_batch(frame):
    return frame.toArrow().combine_chunks().to_batches()[0]


def test_encoder_agrees_with_the_library():
    rng = np.random.default_rng(9)
    alphabet = list("aAbBsSt \n\t.,'\"<>|-*é́Éßß½1٣漢 \u0085\x1cİΣ")
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(2000)] + ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "don't DON'T 'S we'll", ""]
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert enc.by_model
    for text, raw in zip(texts, enc.encode(texts)):
        assert np.frombuffer(raw, enc.dtype).tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_no_token_files_for_an_empty_table(empty):
    assert tokens.read_tokens(*tokens.write_tokens(empty, public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_part_numbers_beyond_five_digits(spark):
    names = ["part-99999-x.parquet", "part-100000-x.parquet", "part-00002-x.parquet", "other"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(tokens.part_number(F.col("n")).asc_nulls_last()).collect()
    assert [r.n for r in got] == [names[2], names[0], names[1], names[3]]


def test_equal_rows_share_no_file(spark, tmp_path):
    docs = spark.createDataFrame([(None, "same text")] * 4000, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder, parts = tokens.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder=f"file://{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [p.n_docs for p in parts.collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2000
    got = tokens.read_tokens(folder, parts).collect()
    assert sorted(r.start for r in got) == [k * got[0].n_tokens for k in range(4000)]


def test_columns_of_any_type_pass(spark, benchmark_items):
    """Stages that keep rows keep nested, quoted, decimal, map and binary columns too."""
    item = benchmark_items.first().text
    text = " ".join(f"the river is a stone and word{k} of the {k} garden." for k in range(40))
    docs = spark.createDataFrame([(1, text, "en", None), (2, item + " " + text, "en", None)], "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", "named_struct('a b', 1, 'c`d', array('x')) AS `odd name`", "map('k', 1.5D) AS m", "cast('1.50' AS decimal(20, 3)) AS d", "cast('z' AS binary) AS bin", "date'2020-01-01' AS day")
    assert quality.keep_good(docs).schema == docs.schema
    clean = decontam.keep_clean(docs, benchmark_items)
    assert clean.schema == docs.schema and [r.doc_id for r in clean.collect()] == [1]
    small = decontam.Search(block=200)
    clean = decontam.keep_clean(docs, benchmark_items, small)
    assert clean.dtypes == docs.dtypes and [tuple(r) for r in clean.collect()] == [tuple(r) for r in decontam.keep_clean(docs, benchmark_items).collect()]


def test_leaks_block_by_block(documents, benchmark_items):
    whole = sorted(map(tuple, decontam.leaks(documents, benchmark_items).collect()))
    assert whole and sorted(map(tuple, decontam.leaks(documents, benchmark_items, decontam.Search(block=1500)).collect())) == whole


def test_notices_without_end_take_linear_time():
    scanner = licenses.Scanner(licenses.Scan())
    notice = licenses.TEMPLATES[0][1].split()
    some = " ".join(notice[: scanner.p.least_run + 4])
    took = []
    for n in (1000, 8000):
        text = np.frombuffer("".join(f"{some} zzz{k} yyy xxx www vvv uuu ttt sss rrr qqq " for k in range(n)).encode(), np.uint8)
        start = time.time()
        scanner.scan(text, np.array([0, len(text)]))
        took.append(time.time() - start)
    assert took[1] < 24 * max(took[0], 0.05)
