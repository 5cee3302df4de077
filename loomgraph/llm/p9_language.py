"""Problem 9: missing or wrong language labels, and documents in several languages.

Method: Bayesian evidence fusion. The text likelihood of each language is a naive Bayes model over character
4-grams of the folded text (no accents, so unaccented text keeps its language), counted over all documents whose declared
label names a language; any other language has all 4-grams alike. It is combined with P(declared label | language), counted over all documents by the language their text
alone gives, with a missing label as one of the outcomes, and with a host prior: language shares of the source, smoothed towards those of its origin format, smoothed towards the
overall ones, all by grouped aggregation. Where documents have an address column its country suffix is one more piece of evidence (`suffix_col`).

The same fusion decides on sentences: a sentence's prior is that it is in the document's language (itself fused) with probability `stay`, else in one of the others by the
host prior; short or ambiguous sentences thus follow their document. A document is mixed when whole sentences of a second language stand in it, and its contiguous sentences of
one language are its segments. Titles in quotation marks are left out of the evidence, unless hardly anything stands outside them: such a sentence is never a second
language, but it decides where a document has no other evidence.

Defined results: null, empty or letterless text has no text evidence; its language is null with confidence 0 in
`documents` and it makes no segment and no found row; a text in none of the six languages is `other` and no found row; labels are read by code, region code, three-letter code or
name in any case; texts are read whole; repeated rows are kept; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.folding import folded
from loomgraph.session import cut

LANGS = ("vi", "en", "fr", "de", "es", "pt")
OTHER = "other"
ALL = (*LANGS, OTHER)
#: Spellings of the six languages besides their codes (fixed values).
NAMES = {
    "vie": "vi", "vn": "vi", "vietnamese": "vi", "tiếng việt": "vi", "tieng viet": "vi", "viet": "vi", "việt": "vi", "eng": "en", "english": "en", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castilian": "es", "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
}
BUCKETS = 1 << 15
BROADCAST_ROWS = 10_000
SUFFIX_LANG = {"vn": "vi", "uk": "en", "us": "en", "au": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "br": "pt", "pt": "pt"}

_SENTENCE = re.compile(r"(?<=[.!?…。])[\s ]+|\n+")
_QUOTED = re.compile(r"“[^”\n]*”|«[^»\n]*»|\"[^\"\n]*\"|„[^“”\n]*[“”]")


def declared(c: Column) -> Column:
    """One of the six codes, or null where the label is missing, says nothing or names something else."""
    code = F.lower(F.trim(c))
    named = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[code]
    head = F.regexp_extract(code, r"^([a-z]{2,3})(?:[-_][a-z0-9]+)*$", 1)
    short = F.create_map(*[F.lit(x) for kv in (NAMES | {k: k for k in LANGS}).items() for x in kv])[head]
    return F.coalesce(named, short)


def _hashes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every 4-gram of code points, and whether it holds no digit."""
    h = (c[:-3] * np.uint32(2654435761)) ^ (c[1:-2] * np.uint32(2246822519)) ^ (c[2:-1] * np.uint32(3266489917)) ^ (c[3:] * np.uint32(668265263))
    h ^= h >> np.uint32(15)
    digit = (c >= 48) & (c <= 57)
    return h, ~(digit[:-3] | digit[1:-2] | digit[2:-1] | digit[3:])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the character 4-grams of many texts in one array pass, the text of each, and the words of each text. Digits are skipped and no 4-gram crosses a text."""
    c = folded(texts).astype(np.uint32)
    if len(c) < 4:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    end = c == 10
    owner = np.cumsum(end) - end
    starts = (c[1:] != 32) & ~end[1:] & (c[:-1] == 32)
    words = np.bincount(owner[1:][starts], minlength=len(texts))
    h, ok = _hashes(c)
    ok &= ~(end[:-3] | end[1:-2] | end[2:-1] | end[3:])
    return (h[ok] & np.uint32(BUCKETS - 1)).astype(np.int64), owner[:-3][ok], words


def sentences(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


class TextModel:
    """log P(4-gram | language), add-half smoothed; the last column is any other language, to which all 4-grams are alike."""

    def __init__(self, counts: np.ndarray):
        c = counts + 0.5
        logp = np.log(c / c.sum(1, keepdims=True)).T
        self.logp = np.hstack([logp, np.full((BUCKETS, 1), -np.log(BUCKETS))])  # bucket x language

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihoods (texts x languages), 4-grams and words of each text."""
        g, owner, words = grams(texts)
        n = np.bincount(owner, minlength=len(texts))
        ll = np.zeros((len(texts), len(ALL)))
        if len(g):
            ll[n > 0] = np.add.reduceat(self.logp[g], np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
        return ll, n, words

    def loglik(self, text: str) -> tuple[np.ndarray, int]:
        ll, n, _ = self.scores([text])
        return ll[0], int(n[0])


def train(docs: DataFrame) -> np.ndarray:
    """Counts (language x bucket) over every document with a usable label; at most languages x buckets numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LANGS) * BUCKETS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lang = np.array([LANGS.index(x) for x in part.column(0).to_pylist()])
                g, owner, _ = grams([_QUOTED.sub(" ", t) if t else "" for t in part.column(1).to_pylist()])
                total += np.bincount(lang[owner] * BUCKETS + g, minlength=len(total)) if len(g) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    rows = docs.select(declared(F.col("lang")).alias("l"), "text").where("l is not null").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(LANGS) * BUCKETS)
    counts[rows.cell.to_numpy(np.int64)] = rows.n.to_numpy()
    return counts.reshape(len(LANGS), BUCKETS)


_EVIDENCE = "s_start array<int>, s_end array<int>, s_ll array<float>, s_words array<int>, s_quoted array<boolean>, text_lang int, n_grams long"


def text_evidence(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """Sentences of each document with their log-likelihoods, beside all its columns but the text (the last one), so that no join brings them together.

    text_lang: the language (its number) that the text alone gives, -1 without text; n_grams: 4-grams outside quotations, or inside where there are no others.
    """
    kept = [c for c in docs.columns if c != "text"]
    names = [*kept, "s_start", "s_end", "s_ll", "s_words", "s_quoted", "text_lang", "n_grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = TextModel(counts)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *_sentence_rows(model, [t or "" for t in part.column(len(kept)).to_pylist()])], names=names)

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)
    return docs.select(*kept, "text").mapInArrow(run, f"{schema}, {_EVIDENCE}")


def _sentence_rows(model: TextModel, texts: list[str]) -> list[pa.Array]:
    spans = [sentences(t) for t in texts]
    whole = [t[a:b] for t, sp in zip(texts, spans) for a, b in sp]
    bare = [_QUOTED.sub(" ", x) for x in whole]
    quoted = np.array([len(x) > len(y) and sum(map(str.isalpha, y)) < 6 for x, y in zip(whole, bare)], bool)
    ll, n, words = model.scores([x if q else y for x, y, q in zip(whole, bare, quoted)])
    off = np.cumsum([0, *map(len, spans)])
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    # quotations count only in documents that have nothing else
    used = ~quoted | (np.bincount(doc, weights=n * ~quoted, minlength=len(texts))[doc] == 0) if len(doc) else quoted
    total = np.zeros((len(texts), len(ALL)))
    np.add.at(total, doc[used], ll[used])
    n_grams = np.bincount(doc[used], weights=n[used], minlength=len(texts)).astype(np.int64)
    ll = np.where(used[:, None], ll, 0) if len(doc) else ll
    lang = np.where(n_grams > 0, total.argmax(1), -1)
    lists = lambda v, t, k=1: pa.ListArray.from_arrays(pa.array(off * k, pa.int32()), pa.array(v, t))
    flat = np.array([x for sp in spans for x in sp], np.int64).reshape(-1, 2)
    return [lists(flat[:, 0], pa.int32()), lists(flat[:, 1], pa.int32()), lists(ll.astype(np.float32).ravel(), pa.float32(), len(ALL)), lists(words, pa.int32()), lists(quoted, pa.bool_()), pa.array(lang, pa.int32()), pa.array(n_grams)]


_FUSED = "doc_id long, label string, declared string, lang string, confidence double, langs array<string>, seg_start array<int>, seg_end array<int>, seg_lang array<string>, seg_conf array<double>"


def _fuse(batches: Iterator[pa.RecordBatch], temper: float, stay: float, sure: float, min_words: int) -> Iterator[pa.RecordBatch]:
    """Fuses the evidence of each document (columns: doc_id, label, declared, host prior, label and suffix log-likelihoods, sentences) and then of its sentences, all documents of a batch in one array pass."""
    names = np.array(ALL, object)
    k = len(ALL)
    for b in batches:
        n = b.num_rows
        matrix = lambda c: np.asarray(b.column(c).flatten(), np.float64).reshape(n, k)  # noqa: B023, E731
        prior, meta = matrix(3), matrix(4) + matrix(5)
        size = np.diff(np.asarray(b.column(6).offsets))
        flat = lambda c: np.asarray(b.column(c).flatten().to_numpy(zero_copy_only=False))  # noqa: B023, E731
        start, end, words, quoted = flat(6), flat(7), flat(9), flat(10).astype(bool)
        ll = flat(8).astype(np.float64).reshape(-1, k) * temper
        has = b.column(11).to_numpy() > 0
        doc = np.repeat(np.arange(n), size)
        total = np.zeros((n, k))
        np.add.at(total, doc, ll)
        post = _softmax(total + prior + meta)
        main = post.argmax(1)
        # a sentence is in the document's language, or in another one by the host prior
        own = np.arange(k) == main[:, None]
        context = np.log(np.where(own, stay, (1 - stay) * _softmax(np.where(own, -np.inf, prior))))
        p = _softmax(ll + context[doc])
        short = words < min_words
        lang = np.where((p[np.arange(len(doc)), main[doc]] < 1 - sure) & ~quoted & ~short, p.argmax(1), main[doc])
        weight = np.zeros((n, k))
        np.add.at(weight, (doc, lang), words)
        # every sentence is in another language than all of them together: the largest share counts
        lost = (weight[np.arange(n), main] == 0) & (weight.sum(1) > 0)
        if lost.any():
            main = np.where(lost, weight.argmax(1), main)
            part = np.zeros((n, k))
            mine = lang == main[doc]
            np.add.at(part, doc[mine], ll[mine])
            post = np.where(lost[:, None], _softmax(part + prior + meta), post)
        # a few words follow the sentence before them, at the start the one behind
        at = np.arange(len(doc))
        first = np.cumsum(size) - size
        before = np.maximum.accumulate(np.where(short, -1, at)) if len(at) else at
        behind = np.minimum.accumulate(np.where(short, len(at), at)[::-1])[::-1] if len(at) else at
        there, then = before >= first[doc], behind < (first + size)[doc]
        follow = np.where(there, before, np.where(then, behind, at))
        lang = np.where(short, lang[follow], lang)
        kinds: list[list[str]] = [[ALL[m]] if h else [] for m, h in zip(main, has)]
        mixed = np.unique(doc[(lang != main[doc]) & ~short & ~quoted])
        for d in mixed:  # few documents
            rows = slice(first[d], first[d] + size[d])
            kinds[d] = [ALL[x] for x in dict.fromkeys(lang[rows][~short[rows] & ~quoted[rows]].tolist())]
        edge = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        edge = edge[has[doc[edge]]]
        close = np.append(edge[1:], len(doc))
        close = np.minimum(close, (first + size)[doc[edge]])
        seg_doc, seg_lang = doc[edge], lang[edge]
        away = np.log(np.where(np.arange(k) == main[seg_doc, None], stay, (1 - stay) / (k - 1)))
        sums = np.zeros((len(edge), k))
        np.add.at(sums, np.repeat(np.arange(len(edge)), close - edge), ll[has[doc]] if len(edge) else ll[:0])
        conf = np.round(_softmax(sums + away)[np.arange(len(edge)), seg_lang], 6) if len(edge) else np.empty(0)
        off = pa.array(np.append(0, np.cumsum(np.bincount(seg_doc, minlength=n))), pa.int32())
        lists = lambda v, t: pa.ListArray.from_arrays(off, pa.array(v, t))  # noqa: B023, E731
        kind_off = pa.array(np.append(0, np.cumsum([len(x) for x in kinds])), pa.int32())
        out = [pa.array(np.where(has, names[main], None), pa.string()), pa.array(np.where(has, np.round(post[np.arange(n), main], 6), 0.0)), pa.ListArray.from_arrays(kind_off, pa.array([y for x in kinds for y in x], pa.string()))]
        out += [lists(start[edge], pa.int32()), lists(end[close - 1], pa.int32()), lists(names[seg_lang], pa.string()), lists(conf, pa.float64())]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *out], names=["doc_id", "label", "declared", "lang", "confidence", "langs", "seg_start", "seg_end", "seg_lang", "seg_conf"])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fused(docs: DataFrame, temper: float = 0.2, strength: float = 20.0, stay: float = 0.97, sure: float = 0.9, min_words: int = 4, suffix_col: str | None = None) -> DataFrame:
    """One row per document: declared label, language, confidence, languages found and segments.

    temper: weight of the text log-likelihood (its 4-grams overlap, so they are not independent evidence); strength: pseudo-count of each smoothing level of the host prior and of
    the label's table; stay: prior probability that a sentence is in its document's language; sure: posterior of another language that makes a sentence one of it;
    min_words: words a sentence needs to be a whole one.
    """
    counts = train(docs)
    host = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), r"[\s_-]+", "_"), F.lit("(none)"))
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIX_LANG.items() for x in kv])[F.regexp_extract(F.lower(F.col(suffix_col)), r"^[a-z+]*:?/*[^/:]*\.([a-z]+)(?:[:/]|$)", 1)] if suffix_col else F.lit(None).cast("string")
    meta = docs.select("doc_id", F.col("lang").alias("label"), declared(F.col("lang")).alias("declared"), host.alias("host"), F.coalesce("origin_format", F.lit("(none)")).alias("fmt"), suffix.alias("suffix"), "text")
    base = cut(text_evidence(meta, counts))
    # one table of (host, format, label, language of the text) counts; it gives the label's table and the host prior
    cube = cut(base.groupBy("host", "fmt", "declared", "text_lang").agg(F.count("*").alias("n")))
    confusion = np.zeros((len(ALL), len(LANGS) + 1))
    for r in cube.where("text_lang >= 0").groupBy("text_lang", "declared").agg(F.sum("n").alias("n")).collect():  # at most 7 x 7 rows
        confusion[r["text_lang"], LANGS.index(r["declared"]) if r["declared"] else len(LANGS)] = r["n"]
    spread = (confusion.sum(0) + 1) / (confusion.sum() + len(LANGS) + 1)
    given = np.log((confusion + strength * 0.1 * spread) / (confusion.sum(1, keepdims=True) + strength * 0.1))
    known = cube.where("declared is not null")
    share = {r["declared"]: r["n"] for r in known.groupBy("declared").agg(F.sum("n").alias("n")).collect()}
    all_n = sum(share.values()) + len(LANGS)
    overall = {lang: (share.get(lang, 0) + 1) / all_n for lang in LANGS}
    each = [F.sum(F.when(F.col("declared") == x, F.col("n")).otherwise(0)).alias(f"n_{x}") for x in LANGS]
    per_fmt = known.groupBy("fmt").agg(F.sum("n").alias("n"), *each)
    per_fmt = per_fmt.select("fmt", *[((F.col(f"n_{x}") + strength * overall[x]) / (F.col("n") + strength)).alias(f"f_{x}") for x in LANGS])
    per_host = known.groupBy("host", "fmt").agg(F.sum("n").alias("n"), *each)
    rare = F.lit(float(np.log(1e-3)))  # prior of any other language
    prior = per_host.join(per_fmt, "fmt").select("host", "fmt", F.array(*[F.log((F.col(f"n_{x}") + strength * F.col(f"f_{x}")) / (F.col("n") + strength)) for x in LANGS], rare).alias("host_prior"))
    label_ll = F.lit(None)
    for i, x in enumerate([*LANGS, None]):
        label_ll = F.when(F.col("declared").eqNullSafe(F.lit(x)), F.array(*[F.lit(float(v)) for v in given[:, i]])).otherwise(label_ll)
    tld = F.array(*[F.when(F.col("suffix").isNull(), 0.0).when(F.col("suffix") == x, float(np.log(0.7))).otherwise(float(np.log(0.05))) for x in ALL])
    flat = F.array(*[F.lit(float(np.log(overall[x]))) for x in LANGS], rare)
    prior = cut(prior)  # a row of seven numbers per source and format: broadcast while that is under a megabyte, else joined by a shuffle
    joined = base.join(F.broadcast(prior) if prior.count() <= BROADCAST_ROWS else prior, ["host", "fmt"], "left")
    ready = joined.select("doc_id", "label", "declared", F.coalesce("host_prior", flat).alias("prior"), label_ll.alias("label_ll"), tld.alias("tld"), "s_start", "s_end", "s_ll", "s_words", "s_quoted", "n_grams")
    return ready.mapInArrow(lambda batches: _fuse(batches, temper, stay, sure, min_words), _FUSED)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence, n_languages)."""
    return fused(docs).select("doc_id", "label", "lang", "confidence", F.size("langs").alias("n_languages"))


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, seg_no, start_char, end_char, lang, confidence) of the documents in several languages; characters are code points, end excluded."""
    parts = F.posexplode(F.arrays_zip("seg_start", "seg_end", "seg_lang", "seg_conf")).alias("seg_no", "s")
    return fused(docs).where(F.size("langs") > 1).select("doc_id", parts).select("doc_id", "seg_no", F.col("s.seg_start").alias("start_char"), F.col("s.seg_end").alias("end_char"), F.col("s.seg_lang").alias("lang"), F.col("s.seg_conf").alias("confidence"))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, lang): true language of documents in one language whose label is missing or wrong; every language of mixed ones."""
    f = fused(docs)
    wrong = F.col("lang").isNotNull() & ~F.col("lang").eqNullSafe(F.col("declared"))
    case = F.when(F.size("langs") > 1, F.col("langs")).when(wrong, F.array("lang")).otherwise(F.array().cast("array<string>"))
    return f.select("doc_id", F.explode(case).alias("lang")).where(F.col("lang") != OTHER)
