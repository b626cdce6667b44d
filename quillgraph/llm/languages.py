"""Problem 10: the language of texts and of their paragraphs, by string-kernel classification.

A paragraph is the set of the blended-spectrum character n-grams (all orders up to ``order``, hashed)
of its words, blanks around each word included. The kernel of two paragraphs is their n-gram
presence kernel, common n-grams over the root of the product of the set sizes. Kernel ridge
regression, one class against the rest, is solved in the Nystroem space of a bounded number of
landmark paragraphs. As the kernel is linear in the presence vector, landmarks and dual weights fold
into one weight per n-gram and class, and scoring sums the weight rows of a batch's n-grams.

The model is trained here on a bounded sample: of the documents whose label names a language, the
``sample`` of each language with the smallest hash of the text (copies count once), their paragraphs
and their code as the class "none". Running text about code is full of names that no language has, so
each paragraph is learned a second time with names from the sample's own code mixed in. Labels
are partly wrong, and a document's label is wrong for what it quotes, so each half of the sample is
judged by a fit on the other and only paragraphs whose label was confirmed are kept, twice. The
confidence is fitted on the leads in that test. Everything else is one map over all rows and whole
texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.words import WORD

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "ru")
NONE = len(LANGUAGES)

_LINE_END = re.compile(r"\r\n?")
_BREAK = re.compile(r"\n[^\S\n]*\n\s*")
_FENCE = re.compile(r"^[^\S\n]*(```|~~~).*?^[^\S\n]*\1[^\S\n]*$", re.S | re.M)
#: The line of a fence that nothing closes; what follows it is judged by itself.
_LONE_FENCE = re.compile(r"^[^\S\n]*(?:```|~~~)[^\n]*$", re.M)
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_SPAN = re.compile(r"`[^`\n]*`")
#: Blank-separated pieces that are no words of a language: paths, calls, snake case, digits.
_ODD = re.compile(r"[_/\\=<>{}\[\]@#$|~^\d]|\w\(|::")
#: Words within a piece that are none: camel case.
_CAMEL = re.compile(r"\b\w*[a-zа-яё]\w*[A-ZА-ЯЁ]\w*\b")
_IGNORED = re.compile("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe0e\ufe0f\ufeff]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PIECES: dict[str, tuple[str, ...]] = {}


def paragraphs(text: str) -> list[str]:
    """Paragraphs of a text outside fenced code, separated by empty lines of any line ending."""
    text = _LINE_END.sub("\n", _IGNORED.sub("", text))
    if "<!--" in text:
        text = _COMMENT.sub(" ", text)
    if "```" in text or "~~~" in text:
        text = _LONE_FENCE.sub("\n", _FENCE.sub("\n\n", text))
    return [p for p in _BREAK.split(text) if p.strip()]


def code_blocks(text: str) -> list[str]:
    return [m.group() for m in _FENCE.finditer(_LINE_END.sub("\n", text))]


def _plain(piece: str) -> tuple[str, ...]:
    """Lower-cased words of a blank-separated piece of running text; none of a piece of code."""
    got = _PIECES.get(piece)
    if got is None:
        if len(_PIECES) > 300_000:
            _PIECES.clear()
        if _ODD.search(piece):
            got = ()
        else:
            got = tuple(w.lower() for w in WORD.findall(_CAMEL.sub(" ", piece)))
        _PIECES[piece] = got
    return got


def prose(paragraph: str) -> list[str] | None:
    """The words a paragraph says, or None if it is code or a list of identifiers.

    Half of its blank-separated pieces at least must be plain words.
    """
    n = len(paragraph.split())
    bare = _SPAN.sub(" ", paragraph) if "`" in paragraph else paragraph
    plain = [w for piece in bare.split() for w in _plain(piece)]
    return plain if plain and len(plain) * 2 >= n else None


class Spectrum:
    """Hashed n-grams (orders 1 to ``order``) of words, remembered for words seen before."""

    def __init__(self, order: int, size: int, most: int = 200_000):
        if size & (size - 1):
            raise ValueError("the number of hash values must be a power of two")
        self.order, self.size, self.most = order, size, most
        self.known: dict[str, np.ndarray] = {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        sizes = np.array([len(w) + 2 for w in words])
        joined = "".join(f" {w} " for w in words)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters to the end of the word
        acc, grams = np.zeros(len(code), np.uint64), []
        shift = np.uint64(64 - self.size.bit_length() + 1)
        with np.errstate(over="ignore"):
            for k in range(self.order):
                acc = (acc + np.roll(code, -k) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                acc ^= acc >> np.uint64(29)
                grams.append(((acc * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int32))
        ids, ok = np.stack(grams, 1), left[:, None] > np.arange(self.order)
        flat, cuts = ids[ok], np.cumsum(np.add.reduceat(ok.sum(axis=1), np.cumsum(sizes) - sizes))
        for w, part in zip(words, np.split(flat, cuts[:-1])):
            self.known[w] = part

    def rows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(text, n-gram) of every n-gram of each text, once, sorted; texts are not empty."""
        said = [set(t) for t in texts]
        new = list({w for t in said for w in t} - self.known.keys())
        for s in range(0, len(new), 20_000):
            self._learn(new[s : s + 20_000])
        try:
            parts = [self.known[w] for t in said for w in t]
        except KeyError:  # the memory was emptied on the way
            self.known.clear()
            self._learn(list({w for t in said for w in t}))
            parts = [self.known[w] for t in said for w in t]
        base = np.repeat(np.arange(0, len(texts) * self.size, self.size), [len(t) for t in said])
        mark = np.zeros(len(texts) * self.size, bool)
        mark[np.repeat(base, np.fromiter(map(len, parts), np.int64, len(parts))) + np.concatenate(parts)] = True
        at = np.flatnonzero(mark)
        return at // self.size, at % self.size


class Presence:
    """The n-grams of texts (lists of words that aren't empty), text after text."""

    def __init__(self, spectrum: Spectrum, texts: list[list[str]]):
        grams, sizes = [np.zeros(0, np.int64)], []
        for s in range(0, len(texts), 128):
            row, gram = spectrum.rows(texts[s : s + 128])
            grams.append(gram)
            sizes.append(np.bincount(row))
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.gram, self.start = np.concatenate(grams), np.cumsum(self.size) - self.size

    def dense(self, rows: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """Presence over the square root of the text's n-grams, in the columns ``place`` gives its n-grams (-1: none)."""
        n = self.size[rows]
        at = np.repeat(self.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        col, row = place[self.gram[at]], np.repeat(np.arange(len(rows)), n)
        x = np.zeros((len(rows), width), np.float32)
        x[row[col >= 0], col[col >= 0]] = 1
        return x / np.sqrt(n)[:, None].astype(np.float32)


class KernelModel:
    """Weights per n-gram and class of the folded Nystroem ridge regression, and the slope of the confidence."""

    def __init__(self, order: int, size: int, weights: np.ndarray, slope: float = 4.0):
        self.spectrum, self.weights, self.slope = Spectrum(order, size), weights, slope

    def __getstate__(self):
        return self.spectrum.order, self.spectrum.size, self.weights, self.slope

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def fit(cls, seen: Presence, rows: np.ndarray, labels: np.ndarray, landmarks: int, order: int, size: int, ridge: float, classes: int, seed: int = 5) -> "KernelModel":
        """Fit on ``rows`` of ``seen`` with their ``labels``; only n-grams of a landmark enter a kernel value."""
        rng = np.random.default_rng(seed)
        picked = np.concatenate([rng.permutation(rows[labels == c])[: max(1, landmarks // classes)] for c in range(classes)])
        place = np.full(size, -1)
        used = np.unique(np.concatenate([seen.gram[seen.start[k] : seen.start[k] + seen.size[k]] for k in picked]))
        place[used] = np.arange(len(used))
        marks = seen.dense(picked, place, len(used))
        gram = (marks @ marks.T).astype(np.float64)
        val, vec = np.linalg.eigh(gram + 1e-6 * np.eye(len(gram)))
        half = vec / np.sqrt(np.maximum(val, 1e-6)) @ vec.T
        zz, zy = np.zeros((len(gram), len(gram))), np.zeros((len(gram), classes))
        weight = 1.0 / np.maximum(1, np.bincount(labels, minlength=classes))[labels] * len(labels) / classes
        for s in range(0, len(rows), 512):
            z = (seen.dense(rows[s : s + 512], place, len(used)) @ marks.T).astype(np.float64) @ half
            y = np.where(labels[s : s + 512, None] == np.arange(classes), 1.0, -1.0)
            zz += z.T @ (z * weight[s : s + 512, None])
            zy += z.T @ (y * weight[s : s + 512, None])
        dual = half @ np.linalg.solve(zz + ridge * np.eye(len(zz)), zy)
        weights = np.zeros((size, classes), np.float32)
        weights[used] = marks.T.astype(np.float64) @ dual
        return cls(order, size, weights)

    def score_rows(self, seen: Presence, rows: np.ndarray) -> np.ndarray:
        n = seen.size[rows]
        at = np.repeat(seen.start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.add.reduceat(self.weights[seen.gram[at]], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None].astype(np.float32) if len(rows) else np.zeros((0, self.weights.shape[1]), np.float32)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """One score per class for each list of words; a batch holds at most 128 texts at a time."""
        out = [np.zeros((0, self.weights.shape[1]), np.float32)]
        for s in range(0, len(texts), 128):
            row, gram = self.spectrum.rows(texts[s : s + 128])
            n = np.bincount(row)
            out.append(np.add.reduceat(self.weights[gram], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None].astype(np.float32))
        return np.concatenate(out)

    def margins(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(class, lead over the next class)."""
        s = self.scores(texts)
        if not len(s):
            return np.zeros(0, np.int64), np.zeros(0)
        two = np.partition(s, -2, axis=1)[:, -2:].astype(np.float64)
        return s.argmax(axis=1), two[:, 1] - two[:, 0]

    def predict(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(class, confidence): how likely the best class is right against the next one; a tie has one half."""
        c, lead = self.margins(texts)
        return c, 1 / (1 + np.exp(-self.slope * lead))

    def calibrate(self, lead: np.ndarray) -> None:
        """Slope of the logistic curve of being right, of most likelihood for the leads of the true class over the best other one.

        One more case, wrong at the mean lead, keeps the slope finite where all are right.
        """
        if not len(lead):
            return
        x = np.append(lead, -np.abs(lead).mean())
        low, high = 0.0, 1e3
        for _ in range(60):  # the likelihood is concave in the slope
            mid = (low + high) / 2
            if (x / (1 + np.exp(np.clip(mid * x, -500, 500)))).sum() > 0:
                low = mid
            else:
                high = mid
        self.slope = low


def named_language(label):
    """The language a label column names: lower-cased, cut before the first ``-`` or ``_``, if it is one of ours."""
    code = F.lower(F.regexp_extract(label, r"^([^-_]*)", 1))
    return F.when(code.isin(*LANGUAGES), code)


def _mixed(said: list[str], names: list[str], rng: np.random.Generator) -> list[str]:
    """The words with a name before about every second."""
    put = rng.random(len(said)) < 1 / 2
    pick = iter(rng.integers(0, len(names), int(put.sum())))
    return [x for w, p in zip(said, put) for x in ((names[next(pick)], w) if p else (w,))]


def sample_rows(docs: DataFrame, text_col: str, label_col: str, sample: int, longest: int) -> DataFrame:
    """(h, t, lang): of each language the ``sample`` different texts of smallest hash whose label names it; one pass over the table."""
    rows = docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t"), named_language(F.col(label_col)).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.length("t").between(40, longest))
    first = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample)
    return first.groupBy("lang", "h").agg(F.first("t").alias("t")).select("h", "t", "lang")


def train(docs: DataFrame, text_col: str, label_col: str, sample: int = 250, longest: int = 20_000, per_doc: int = 6, landmarks: int = 270, order: int = 4, size: int = 1 << 15, ridge: float = 1.0) -> KernelModel:
    """Fit on at most ``sample`` different labelled texts a language, each at most ``longest`` code points
    long, and at most ``per_doc`` paragraphs of each. Without any labelled document nothing is
    classified."""
    got = sorted(sample_rows(docs, text_col, label_col, sample, longest).collect(), key=lambda r: (r.h, r.lang))
    return fit_texts([(r.t, LANGUAGES.index(r.lang)) for r in got], per_doc, landmarks, order, size, ridge)


def fit_texts(sampled: list[tuple[str, int]], per_doc: int = 6, landmarks: int = 270, order: int = 4, size: int = 1 << 15, ridge: float = 1.0, seed: int = 7) -> KernelModel:
    """The model of labelled texts (text, class)."""
    texts, labels, doc, names = [], [], [], set()
    for k, (t, lang) in enumerate(sampled):
        said = [p for p in map(prose, paragraphs(t)) if p and len(p) >= 8][:per_doc]
        code = [WORD.findall(c) for c in code_blocks(t)]
        names.update(w.lower() for c in code for x in c for w in _PART.findall(x) if len(w) > 3)
        code = [[w.lower() for w in c] for c in code[:1] if c]
        texts += said + code
        labels += [lang] * len(said) + [NONE] * len(code)
        doc += [k] * (len(said) + len(code))
    if not texts:
        return KernelModel(order, size, np.zeros((size, NONE + 1), np.float32))
    rng, pool, n = np.random.default_rng(seed), sorted(names), len(texts)
    again = np.array([k for k in range(n) if pool and labels[k] != NONE], np.int64)
    seen = Presence(Spectrum(order, size), texts + [_mixed(texts[k], pool, rng) for k in again])
    y, who = np.array(labels + [labels[k] for k in again]), np.array(doc + [doc[k] for k in again])
    of = np.concatenate([np.arange(n), again])  # the text that a row tells, plain or mixed

    def fit(kept: np.ndarray) -> KernelModel:
        rows = np.nonzero(kept)[0]
        return KernelModel.fit(seen, rows, y[rows], landmarks, order, size, ridge, NONE + 1)

    halves = [who % 2 == k for k in (0, 1)]
    if min((h & (of == np.arange(len(of)))).sum() for h in halves) < 20:
        return fit(np.ones(len(of), bool))
    keep = np.ones(len(of), bool)
    for _ in range(2):  # each half is judged by a fit on what is kept of the other
        agree, leads = np.zeros(n, bool), []
        for own, other in (halves, halves[::-1]):
            judge = fit(other & keep if (other & keep).any() else other)
            plain = np.nonzero(own[:n])[0]
            agree[plain] = judge.score_rows(seen, plain).argmax(axis=1) == y[plain]
            held = np.nonzero(own & agree[of])[0]
            score, at = judge.score_rows(seen, held), (np.arange(len(held)), y[held])
            true = score[at].astype(np.float64)
            score[at] = -np.inf
            leads.append(true - score.max(axis=1))
        keep = agree[of]
    model = fit(keep if keep.sum() >= 20 else np.ones(len(of), bool))
    model.calibrate(np.concatenate(leads))
    return model


def label_paragraphs(docs: DataFrame, id_col: str, text_col: str, label_col: str, least_words: int = 8, least_confidence: float = 0.5, model: KernelModel | None = None, **training) -> DataFrame:
    """(id, label, paragraph, lang, n_words, confidence) of every prose paragraph of ``least_words`` words or more.

    ``model`` is one that ``train`` made; without it one is trained on ``docs``. Paragraphs count from 1 within the document's paragraphs outside fenced code. Paragraphs that the
    model takes for no language, or that it isn't sure of, are not returned. Null, empty and blank
    texts have none. Repeated rows give repeated results. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col, label_col, **training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            ids, labels, places, said, sizes = [], [], [], [], []
            for i, t, lab in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for k, p in enumerate(paragraphs(t), 1):
                    if (q := prose(p)) and (n := len(WORD.findall(p))) >= least_words:
                        ids.append(i)
                        labels.append(lab)
                        places.append(k)
                        said.append(q)
                        sizes.append(n)
            cls, conf = m.predict(said)
            ok = np.nonzero((cls != NONE) & (conf > least_confidence))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for k in ok], t) for x, t in ((ids, pa.int64()), (labels, pa.string()), (places, pa.int32()))]
                + [pa.array([LANGUAGES[cls[k]] for k in ok], pa.string()), pa.array([sizes[k] for k in ok], pa.int32()), pa.array(conf[ok])],
                ["id", "label", "paragraph", "lang", "n_words", "confidence"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    return src.where("text is not null").mapInArrow(run, "id long, label string, paragraph int, lang string, n_words int, confidence double")


def document_labels(segments: DataFrame) -> DataFrame:
    """(id, lang, confidence, n_langs): the language of most words of a document, ties by code."""
    per = segments.groupBy("id", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    return per.groupBy("id").agg(
        F.max_by("lang", F.struct("n", F.col("lang"))).alias("lang"),
        F.max_by(F.col("c") / F.col("n"), F.struct("n", F.col("lang"))).alias("confidence"),
        F.count("*").alias("n_langs"),
    )
