"""Quality rules with a distribution-divergence verdict.

Base rules are counts over a document's words. The verdict compares two histograms of each document, its character classes
and common words, with the references of its language by Jensen-Shannon distance. Common words are those of four languages that are
known, and the most frequent ones of every language of the corpus, counted in a pass over all documents that pass the base rules.
References are sums over these documents too, so they need no outside data and junk weighs little in them. A document is only
judged on a histogram that holds enough counts (minimum-length guards), and only against a reference that does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import arrow_map
from .common import BROADCAST_ROWS, SPACE, column, gram_hashes, materialise, mix, prefix_hash, row_of, slices, span_hash, text_buffer, word_runs

# Common words of English, German, French and Spanish.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "be", "by", "on", "this", "are", "from", "or", "an", "a"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "lo"),
}
SYMBOLS = b"#*$%&|<>"
#: Character classes: lower-case vowels, other lower-case letters, upper case, digits, symbols, sentence marks, other
#: ASCII, bytes that begin a character beyond ASCII. White space is not counted.
CLASSES = ("vowel", "consonant", "upper", "digit", "symbol", "mark", "other", "beyond")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    most_repeated_percent: int = 50
    #: Largest Jensen-Shannon distance (base 2, 0 to 1) from the reference of the language.
    most_char_distance: float = 0.35
    most_word_distance: float = 0.30
    #: A short text's word histogram is far from any reference by chance: what a sample with so many free bins is
    #: expected to diverge by, free bins / (8 n ln 2), is taken off its squared distance.
    free_bins: int = 40
    #: Words of each language that are common because the corpus says so.
    frequent_words: int = 20
    #: A histogram with fewer counts than this is not judged; a reference with fewer is not used.
    least_chars: int = 200
    least_words: int = 50
    least_reference: int = 5_000


def _class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), np.int8)
    t[0x80:0xC0] = -1
    t[0xC0:] = CLASSES.index("beyond")
    for chars, name in ((b"abcdefghijklmnopqrstuvwxyz", "consonant"), (b"aeiou", "vowel"), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper"), (b"0123456789", "digit"), (b".,;:!?'\"()-", "mark"), (SYMBOLS, "symbol")):
        t[list(chars)] = CLASSES.index(name)
    t[SPACE] = -1
    return t


#: Bits of a word's hash by which words are counted: a rare word shares its cell with a common one with odds of words / 65,536.
CELL_BITS = 16


def cells(words: list[str]) -> np.ndarray:
    """The cell of each word."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    h = span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8), True), ends - np.array([len(r) for r in raw]), ends)
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Vocabulary:
    """Which cells are common: each is a bin of the word histogram, and all other words together are the last."""

    def __init__(self, frequent: list[int] = ()):
        common = sorted({*cells(sorted({w for ws in COMMON_WORDS.values() for w in ws})).tolist(), *frequent})
        self.size = len(common) + 1
        self.bin = np.full(1 << CELL_BITS, self.size - 1, np.int64)
        self.bin[common] = np.arange(len(common))


CLASS = _class_table()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _stripped(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without one trailing and one leading sentence mark, for looking words up."""
    mark = CLASS == CLASSES.index("mark")
    if len(starts) == 0:
        return starts, ends
    e = ends - (mark[buf[ends - 1]] & (ends - starts > 1))
    return starts + (mark[buf[starts]] & (e - starts > 1)), e


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, key) pairs in order: whether the pair occurs again anywhere, and whether it occurred before."""
    order = np.lexsort((np.arange(len(keys)), keys, rows)) if len(keys) else np.empty(0, np.int64)
    k, r = keys[order], rows[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    many[order], later[order] = same[1:] | same[:-1], same[:-1]
    return many, later


def counts(buf: np.ndarray, offs: np.ndarray, vocabulary: Vocabulary | None) -> dict[str, np.ndarray]:
    """The base counts of each text and its histograms: chars, and commons if there is a vocabulary, else each word's cell and row."""
    n = len(offs) - 1
    starts, ends, first = word_runs(buf, offs)
    row = row_of(first)
    classes = CLASS[buf]
    text_row = np.repeat(np.arange(n), np.diff(offs))
    out = {"n_words": np.diff(first)}
    seen = classes >= 0
    chars = np.bincount(text_row[seen] * len(CLASSES) + classes[seen], minlength=n * len(CLASSES)).reshape(n, len(CLASSES))
    out["chars"] = chars
    # white space has class -1 and so have continuation bytes: what is left is one byte per character of a word
    out["word_chars"] = chars.sum(axis=1)
    out["n_symbols"] = chars[:, CLASSES.index("symbol")]
    prefix = prefix_hash(buf, False)
    words = span_hash(prefix, starts, ends)
    # three-word windows
    many = np.zeros(len(words) + 2, bool)
    if len(words) > 2:
        whole = row[2:] == row[:-2]
        twice, _ = _repeats(gram_hashes(words, 3)[whole], row[:-2][whole])
        at = np.flatnonzero(whole)[twice]
        for k in range(3):
            many[at + k] = True
    out["n_repeat_words"] = _per_row(many[: len(words)], first)
    # lines: spans between line feeds and the rows' bounds
    feeds = np.flatnonzero(buf == 10)
    cuts = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
    stops = np.concatenate([np.sort(np.concatenate([offs[1:], feeds]), kind="stable")])
    line_row = np.searchsorted(offs, cuts, "right") - 1
    # an empty text at the same offset shares its bound with the next one; lines without a word are dropped anyway
    has_word = np.searchsorted(starts, stops) > np.searchsorted(starts, cuts)
    cuts, stops, line_row = cuts[has_word], stops[has_word], line_row[has_word]
    lines = mix(span_hash(prefix, cuts, stops) + (stops - cuts).astype(np.uint64))
    _, later = _repeats(lines, line_row)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)
    s, e = _stripped(buf, starts, ends)
    bare = span_hash(prefix_hash(buf, True), s, e)
    cell = (bare >> np.uint64(64 - CELL_BITS)).astype(np.int64)
    if vocabulary is None:
        return out | {"cell": cell, "row": row}
    out["commons"] = np.bincount(row * vocabulary.size + vocabulary.bin[cell], minlength=n * vocabulary.size).reshape(n, vocabulary.size)
    return out


def base_failed(c: dict[str, np.ndarray], rules: Rules) -> np.ndarray:
    return (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.most_repeated_percent * c["n_words"])


def _lang(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in column(batch, "lang").to_pylist()]


def _cell_map(rules: Rules):
    """Words by language and cell, of a task's documents that pass the base rules."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            buf, offs = text_buffer(column(batch, "text"))
            langs = np.array(_lang(batch), object)
            for a, b, part, po in slices(buf, offs):
                c = counts(part, po, None)
                good = ~base_failed(c, rules)
                for lang in set(langs[a:b]):
                    mine = (good & (langs[a:b] == lang))[c["row"]]
                    sums[lang] = sums.get(lang, 0) + np.bincount(c["cell"][mine], minlength=1 << CELL_BITS)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], ["lang", "cell", "n"])

    return run


def vocabulary(docs: DataFrame, rules: Rules = Rules()) -> Vocabulary:
    """The known common words and the most frequent cells of each language of the corpus; the driver sees those alone."""
    rows = arrow_map(docs.select("text", F.col("lang").cast("string").alias("lang")), _cell_map(rules), "lang string, cell int, n long")
    per = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.col("n").desc(), "cell")
    found = per.withColumn("place", F.row_number().over(most)).where(F.col("place") <= rules.frequent_words).select("cell")
    cells_ = [r.cell for r in found.distinct().limit(BROADCAST_ROWS * rules.frequent_words + 1).collect()]
    return Vocabulary(sorted(cells_))


def _histogram_map(rules: Rules, vocabulary: Vocabulary):
    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(column(batch, "text"))
            langs = _lang(batch)
            sums: dict[str, np.ndarray] = {}
            for a, b, part, po in slices(buf, offs):
                c = counts(part, po, vocabulary)
                good = ~base_failed(c, rules)
                both = np.hstack([c["chars"], c["commons"]])
                for lang in set(langs[a:b]):
                    mine = good & (np.array(langs[a:b]) == lang)
                    sums[lang] = sums.get(lang, 0) + both[mine].sum(axis=0)
            keys = [(lang, k) for lang, v in sums.items() for k in np.flatnonzero(v)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keys], pa.string()), pa.array([int(k) for _, k in keys], pa.int32()), pa.array([int(sums[x][k]) for x, k in keys], pa.int64())], ["lang", "bin", "n"])

    return run


def references(docs: DataFrame, vocabulary: Vocabulary, rules: Rules = Rules()) -> DataFrame:
    """(lang, bins): summed histograms of all documents that pass the base rules, per language ("" for null), as an array of
    (bin, n). One row per language."""
    rows = arrow_map(docs.select("text", F.col("lang").cast("string").alias("lang")), _histogram_map(rules, vocabulary), "lang string, bin int, n long")
    per = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    return per.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts p from the counts q."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = (q / max(q.sum(), 1))[None, :]
    m = (p + q) / 2

    def kl(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)

    return np.sqrt(np.clip((kl(np.broadcast_to(p, m.shape)) + kl(np.broadcast_to(q, m.shape))) / 2, 0, 1))


def verdicts(c: dict[str, np.ndarray], langs: np.ndarray, refs: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(char distance, word distance), NaN where a guard holds. A document whose language has no usable reference is
    compared with all usable ones and keeps the least distance."""
    n = len(langs)
    out = []
    for key, part, least in (("chars", slice(0, len(CLASSES)), rules.least_chars), ("commons", slice(len(CLASSES), None), rules.least_words)):
        usable = {lang: r[part] for lang, r in refs.items() if r[part].sum() >= rules.least_reference}
        d, hist = np.full(n, np.nan), c[key]
        size = hist.sum(axis=1)
        enough = size >= least
        for lang in set(langs):
            mine = enough & (langs == lang)
            if not mine.any() or not usable:
                continue
            against = [usable[lang]] if lang in usable else list(usable.values())
            d[mine] = np.min([js_distance(hist[mine], r) for r in against], axis=0)
            if key == "commons":
                d[mine] = np.sqrt(np.maximum(d[mine] ** 2 - rules.free_bins / (8 * np.log(2) * size[mine]), 0))
        out.append(d)
    return out[0], out[1]


def _verdict_map(rules: Rules, vocabulary: Vocabulary, refs: dict[str, np.ndarray], passed: list[str]):
    def run(batches):
        for batch in batches:
            buf, offs = text_buffer(column(batch, "text"))
            langs = np.array(_lang(batch), object)
            parts: dict[str, list[np.ndarray]] = {}
            for a, b, part, po in slices(buf, offs):
                c = counts(part, po, vocabulary)
                failed = base_failed(c, rules)
                chars, commons = verdicts(c, langs[a:b], refs, rules)
                with np.errstate(invalid="ignore"):
                    kept = ~failed & ~(chars > rules.most_char_distance) & ~(commons > rules.most_word_distance)
                row = {k: c[k].astype(np.int64) for k in COUNTS} | {"base_failed": failed, "kept": kept, "char_distance": chars, "word_distance": commons}
                for k, v in row.items():
                    parts.setdefault(k, []).append(v)
            if not parts:
                continue
            arrays = [column(batch, x) for x in passed] + [pa.array(np.concatenate(v), from_pandas=True) for v in parts.values()]
            yield pa.RecordBatch.from_arrays(arrays, [*passed, *[f"q_{k}" if passed != ["doc_id"] else k for k in parts]])

    return run


def collected(refs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """References on the driver: one row of counts per language. More languages than BROADCAST_ROWS are an error."""
    rows = refs.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} languages: lang must be a language code")
    out = {}
    for r in rows:
        v = np.zeros(len(CLASSES) + vocabulary.size)
        for x in r.bins:
            v[x.bin] = x.n
        out[r.lang] = v
    return out


_TYPES = ", ".join(f"{{0}}{k} long" for k in COUNTS) + ", {0}base_failed boolean, {0}kept boolean, {0}char_distance double, {0}word_distance double"


def _measured(docs: DataFrame, rules: Rules) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    common = vocabulary(docs, rules)
    return common, collected(references(docs, common, rules), common)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the two distances (null where a guard holds).

    A null text counts as empty; empty texts fail the base rules. A null language is a language of its own. Repeated rows
    are judged alike; an empty table gives no rows; columns other than doc_id, text and lang are not read. Texts of any
    length are worked on whole.
    """
    common, refs = _measured(docs, rules)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return arrow_map(rows, _verdict_map(rules, common, refs, ["doc_id"]), "doc_id long, " + _TYPES.format(""))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, in the columns of docs, whatever others they are. Null, empty and blank texts fail the base rules
    and go; very long texts are judged whole; rows that repeat, or have no doc_id, are judged each for itself. A distance on the
    bound is kept. No rows give none."""
    common, refs = _measured(docs, rules)
    names = [f"c{k}" for k in range(len(docs.columns))]
    place = {c.lower(): k for k, c in enumerate(docs.columns)}
    plain = docs.toDF(*names)
    rows = plain.withColumn("text", F.col(names[place["text"]])).withColumn("lang", F.col(names[place["lang"]]).cast("string"))
    verdict = StructType.fromDDL(_TYPES.format("q_"))
    out = arrow_map(rows, _verdict_map(rules, common, refs, names), StructType([*plain.schema.fields, *verdict.fields]))
    return out.where("q_kept").select(*names).toDF(*docs.columns)
