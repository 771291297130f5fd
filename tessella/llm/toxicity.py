"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import as_strings, drop_table, labelled_rows, materialise, mix64, split_words, text_slices, word_hashes

#: At most so many labelled rows, and rows without a label, are used to fit, those with the smallest hash of their id; the driver holds the
#: features of their documents, about 3 kB each. Of the labelled ones, one in so many only calibrates.
FIT_ROWS, FIT_UNLABELLED, CALIBRATE = 12_000, 3_000, 5
#: Dimensions of hashed features; lengths of the word beginnings that are features beside whole words.
DIMS, PREFIXES = 1 << 21, (4, 5, 6)
TRIM = ".,;:!?()[]{}<>\"'#$%&*|=+-_/\\~`"
#: Everyday words of abuse, by language and kind.
LEXICONS = {
    "english": "idiot idiots moron morons loser losers worthless pathetic clown clowns stupid dumb imbecile imbeciles jerk jerks freak creep coward cowards",
    "spanish": "idiota idiotas imbecil imbécil estúpido estúpida estúpidos asqueroso asquerosa inútil payaso cobarde",
    "french": "idiot idiote idiotes crétin crétine imbécile imbéciles minable dégoûtant dégoûtante abruti abrutie débile",
    "german": "idiot idioten dummkopf trottel wertlos ekelhaft vollidiot blödmann versager feigling",
    "profane": "bastard bastards bitch bitches asshole assholes retard retarded slut whore cabrón puta mierda connard connasse salaud salope arschloch hurensohn schlampe",
    "degrading": "scum trash garbage vermin pig pigs filth filthy disgusting basura ordure abschaum ungeziefer dreck",
    "threatening": "kill die hurt destroy hate matar muere odio tuer crève déteste töten stirb hasse",
}
WORDS = {k: frozenset(v.split()) for k, v in LEXICONS.items()}
INSULTS = frozenset().union(*(v for k, v in WORDS.items() if k != "threatening"))
SETS = {k: pa.array(sorted(v), pa.large_string()) for k, v in WORDS.items()}
DIRECTED = re.compile(r"\b(?:you|your|you're|u|tu|eres|es|du bist|ihr seid|vous êtes|tu es)\b[^.!?\n]{0,24}")
LEET = str.maketrans("013457@$", "oleastas")
#: A word with its middle struck out.
MASKED = r"^[a-zß-ÿ]+[*#$%@]{2,}[a-zß-ÿ]*$"
VOTERS = (
    "english", "spanish", "french", "german", "profane", "degrading", "threats", "insults", "repeated", "disguised", "masked", "directed",
    "learned_word", "learned_words", "beginning_4", "beginning_5", "beginning_6", "dense", "early", "short", "shouting", "exclaiming",
)
#: Voters that look at whether there is abuse; the rest looks at how a text is written.
HITS = VOTERS.index("shouting")


def table_features(table: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Hashed features of distinct words, one row per word: the word and its beginnings (-1: word too short); and the normal forms."""
    norm = pc.utf8_trim(pc.utf8_lower(table), characters=TRIM)
    size = np.asarray(pc.utf8_length(norm), dtype=np.int64)
    columns = [np.where(size > 0, (word_hashes(norm) % np.uint64(DIMS)).astype(np.int64), -1)]
    for n in PREFIXES:
        begin = pc.dictionary_encode(pc.utf8_slice_codeunits(norm, 0, n))
        salted = mix64(word_hashes(begin.dictionary) + np.uint64(n))[np.asarray(begin.indices, dtype=np.int64)]
        columns.append(np.where(size > n, (salted % np.uint64(DIMS)).astype(np.int64), -1))
    return np.stack(columns, axis=1), norm


def distinct_pairs(rows: np.ndarray, values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * span + values)
    return both // span, both % span


@dataclass
class Lexicons:
    """Hashed words and word beginnings that the labelled rows have shown to be toxic, and the features of the linear model."""

    word: np.ndarray
    beginning: np.ndarray
    features: np.ndarray


def learn_lexicons(docs: list[np.ndarray], y: np.ndarray) -> Lexicons:
    """Features whose share of toxic documents differs from the base rate beyond chance over all features tried.

    n * KL(share || base) bounds the log of the chance of such a count; words for voters must pass the bound for
    all features at 1 %, features of the linear model a looser one.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(docs) or not 0 < y.sum() < len(y):
        return Lexicons(none, none, none)
    count, hits = np.zeros(2 * DIMS, dtype=np.int32), np.zeros(2 * DIMS, dtype=np.int32)
    for d, label in zip(docs, y, strict=True):
        count[d] += 1
        if label:
            hits[d] += 1
    base, n_seen = y.mean(), int((count > 0).sum())
    ids = np.flatnonzero(count >= 3)
    n = count[ids].astype(float)
    share = np.clip(hits[ids] / n, 1e-9, 1 - 1e-9)
    gain = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    sure = gain > np.log(n_seen / 0.01)
    strong = ids[sure & (share > max(0.6, 3 * base))]
    return Lexicons(strong[strong < DIMS], strong[strong >= DIMS], ids[(gain > 7) & ((share > base) | sure)])


def words_of(texts: pa.Array):
    """Per text slice: first row, offsets, codes, feature ids per distinct word (beginnings moved up by DIMS), normal forms, raw words."""
    for at, part in text_slices(as_strings(texts)):
        offsets, codes, table = split_words(part, lower=False)
        feats, norm = table_features(table)
        feats[:, 1:] = np.where(feats[:, 1:] >= 0, feats[:, 1:] + DIMS, -1)
        yield at, part, offsets, codes, feats, norm, table


def votes(part: pa.Array, offsets, codes, feats, norm, table, lex: Lexicons) -> np.ndarray:
    """The pattern of each text: bit k is set if voter k fires.

    A lexicon votes if one of its words occurs (threats: two different ones), insults if two different ones do, repeated if one does
    twice; disguised and masked look for words with digits or signs for letters, directed for an insult soon behind a form of
    address; learned words and word beginnings of four to six letters are those that labels have shown to be toxic; dense: more than
    1 % of the words are such, early: one is among the first 30, short: one is in a text of fewer than 60; shouting: more
    than half of the words in capitals, exclaiming: more than one in ten with '!'.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    known = {k: np.asarray(pc.is_in(norm, value_set=v)) for k, v in SETS.items()}
    insult = np.any([v for k, v in known.items() if k != "threatening"], axis=0)
    hidden = np.zeros(len(norm), dtype=bool)
    for i in np.flatnonzero(np.asarray(pc.match_substring_regex(norm, "[013457@$]")) & ~insult):
        hidden[i] = norm[int(i)].as_py().translate(LEET) in INSULTS
    masked = np.asarray(pc.match_substring_regex(norm, MASKED))
    learned = np.isin(feats[:, 0], lex.word)
    begins = [np.isin(feats[:, k + 1], lex.beginning) for k in range(len(PREFIXES))]
    raw_upper = np.asarray(pc.utf8_is_upper(table)) & (np.asarray(pc.utf8_length(table)) > 2)
    loud = np.asarray(pc.match_substring(table, "!"))

    def tokens(flag):
        return np.bincount(row[flag[codes]], minlength=n)

    def distinct(flag):
        at = flag[codes]
        return np.bincount(distinct_pairs(row[at], codes[at], len(norm) + 1)[0], minlength=n)

    abuse = np.any([insult, hidden, masked, learned, *begins], axis=0)
    at = np.flatnonzero(abuse[codes])
    early = np.bincount(row[at][at - offsets[row[at]] < 30], minlength=n)
    n_insult, n_learned, n_abuse = distinct(insult), distinct(learned), tokens(abuse)
    directed = np.zeros(n, dtype=bool)
    for i in np.flatnonzero(n_insult):
        text = part[int(i)].as_py().lower()
        directed[i] = any(w.strip(TRIM) in INSULTS for m in DIRECTED.finditer(text) for w in m[0].split())
    words = np.maximum(size, 1)
    columns = [
        *(tokens(known[k]) > 0 for k in VOTERS[:6]), distinct(known["threatening"]) > 1, n_insult > 1, tokens(insult) > n_insult, tokens(hidden) > 0, tokens(masked) > 0, directed,
        n_learned > 0, n_learned > 1, *(distinct(b) > 1 for b in begins), n_abuse / words > 0.01, early > 0, (n_abuse > 0) & (size < 60), tokens(raw_upper) / words > 0.5, tokens(loud) / words > 0.1,
    ]
    return sum(c.astype(np.int64) << k for k, c in enumerate(columns))


class LabelModel:
    """Generative model of the votes given the hidden class: a tree over the voters carries their correlations.

    Each voter depends on the class and on one other voter, the parent with which it shares most information given the class
    (the maximum spanning tree); the training label is one more voter, which abstains where there is none. Fitted
    by expectation maximisation on counts of (pattern, label); patterns that occur are few, since most voters agree on most texts.
    """

    def __init__(self, patterns: np.ndarray, known: np.ndarray, counts: np.ndarray, rounds: int = 40):
        m = len(VOTERS)
        bits = (patterns[:, None] >> np.arange(m)) & 1
        w = counts.astype(float)
        hits = bits[:, :HITS].sum(axis=1)
        q = np.where(known >= 0, np.where(known == 1, 0.97, 0.03), np.array([0.03, 0.5, 0.8, 0.95])[np.minimum(hits, 3)])
        # what voters of abuse are made for, as a few rows: on texts that are not toxic they hardly fire; on toxic ones they may miss
        belief = np.full((2, m, 2), 0.5)
        belief[0, :HITS] = 3.0, 0.1
        for _ in range(rounds):
            mass = np.stack([w * (1 - q), w * q])
            self.prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
            self.label = np.array([[(mass[c][known == v].sum() + (20.0 if c == v else 0.5)) for v in (0, 1)] for c in (0, 1)])
            self.label /= self.label.sum(axis=1, keepdims=True)
            pair = np.zeros((2, m, m, 2, 2))
            for c in (0, 1):
                for a in (0, 1):
                    for b in (0, 1):
                        pair[c, :, :, a, b] = ((bits == a) * mass[c][:, None]).T @ (bits == b)
            self.parent = self._tree(pair)
            self.cond = np.zeros((2, m, 2, 2))  # class, voter, parent's vote, own vote
            for c in (0, 1):
                for k, p in enumerate(self.parent):
                    table = pair[c, p, k] if p >= 0 else np.diag(pair[c, k, k])[None, :].repeat(2, axis=0)
                    table = table + belief[c, k]
                    self.cond[c, k] = table / table.sum(axis=1, keepdims=True)
            new = self.posterior(patterns, known)
            if np.abs(new - q).max(initial=0) < 1e-6:
                break
            q = new

    @staticmethod
    def _tree(pair: np.ndarray) -> list[int]:
        """Parents in the maximum spanning tree of mutual information given the class; the root has -1."""
        m, total = pair.shape[1], pair[:, 0, 0].sum() + 1e-9
        info = np.zeros((m, m))
        for c in (0, 1):
            joint = (pair[c] + 1e-3) / (pair[c] + 1e-3).sum(axis=(2, 3), keepdims=True)
            marginal = joint.sum(axis=3, keepdims=True) * joint.sum(axis=2, keepdims=True)
            info += (joint * np.log(joint / marginal)).sum(axis=(2, 3)) * pair[c, 0, 0].sum() / total
        parent, inside = [-1] * m, [0]
        while len(inside) < m:
            best = max(((info[i, j], i, j) for i in inside for j in range(m) if j not in inside), key=lambda t: (t[0], -t[1], -t[2]))
            parent[best[2]] = best[1]
            inside.append(best[2])
        return parent

    def posterior(self, patterns: np.ndarray, known: np.ndarray) -> np.ndarray:
        bits = (np.asarray(patterns)[:, None] >> np.arange(len(VOTERS))) & 1
        log = np.log(self.prior)[None, :].repeat(len(bits), axis=0)
        for c in (0, 1):
            for k, p in enumerate(self.parent):
                log[:, c] += np.log(self.cond[c, k, bits[:, p] if p >= 0 else 0, bits[:, k]])
            log[:, c] += np.where(known >= 0, np.log(self.label[c, np.maximum(known, 0)]), 0)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def fit_linear(docs: list[np.ndarray], patterns: np.ndarray, target: np.ndarray, features: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on presence of features and on votes against soft targets, by full-batch Adam with an L2 penalty."""
    width = len(features)
    rows = [np.searchsorted(features, f) for f in (np.intersect1d(d, features, assume_unique=True) for d in docs)]
    flat, lengths = np.concatenate([np.zeros(0, dtype=np.int64), *rows]), np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(docs)), lengths)
    bits = ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    w, v, b = np.zeros(width), np.zeros(len(VOTERS)), 0.0
    theta = np.concatenate([w, v, [b]])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    n = max(len(docs), 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=theta[flat], minlength=len(docs)) + bits @ theta[width:-1] + theta[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        grad = np.concatenate([np.bincount(flat, weights=err[row], minlength=width), bits.T @ err, [err.sum()]]) / n
        grad[:-1] += 1e-4 * theta[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return theta[:width], theta[width:-1], float(theta[-1])


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of z with which its logistic is the likeliest for labels y; (1, 0) without both labels."""
    if not len(y) or not 0 < y.sum() < len(y):
        return 1.0, 0.0
    theta, design = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], axis=1)
    prior = np.array([1e-2, 1e-2])  # holds the slope where z tells all labels apart
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -500, 500)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(prior)
        step = np.linalg.solve(hess, design.T @ (y - p) - prior * (theta - [1.0, 0.0]))
        theta = theta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


@dataclass
class ToxicityModel:
    lex: Lexicons
    weights: np.ndarray
    vote_weights: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (5, 0), fit_rows: int = FIT_ROWS, unlabelled_rows: int = FIT_UNLABELLED) -> ToxicityModel:
    """Fits on docs; labels has doc_id and label (0, 1 or null). Rows of which crc32(doc_id) mod held_out[0] is held_out[1] teach nothing.

    Voters see every row of docs, so their accuracies and correlations come from the whole corpus; the driver gets one count per pattern
    of votes that occurs, and the features of the fit rows. The classifier learns the label model's posteriors of labelled rows and of rows
    without a label; one labelled row in CALIBRATE is kept from it and calibrates its scores. Without labels the voters
    alone decide. A doc_id with several texts counts once, with the one of the smallest features; null ids and ids without a document
    teach nothing; an empty table gives a model of the prior.
    """
    spark = docs.sparkSession
    train = labelled_rows(docs, labels, id_col, text_col, held_out, fit_rows, unlabelled_rows)
    id_type = dict(train.dtypes)["doc_id"]
    train = materialise(train, "fit-rows")

    def feature_rows(batches):
        for batch in batches:
            out = [np.zeros(0, dtype=np.int64)] * batch.num_rows
            for at, part, offsets, codes, feats, _, _ in words_of(batch.column(2)):
                for i in range(len(part)):
                    own = feats[np.unique(codes[offsets[i] : offsets[i + 1]])].ravel()
                    out[at + i] = np.unique(own[own >= 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype(np.int32).tobytes() for x in out], pa.binary())], names=["doc_id", "label", "features"])

    got = train.mapInArrow(feature_rows, f"doc_id {id_type}, label int, features binary").toPandas().sort_values(["doc_id", "features"]).drop_duplicates("doc_id")
    rows = [np.frombuffer(x, dtype=np.int32) for x in got["features"]]
    y = got["label"].to_numpy(dtype=float)
    lex = spark.sparkContext.broadcast(learn_lexicons([r for r, v in zip(rows, y, strict=True) if v >= 0], y[y >= 0]))
    taught = spark.sparkContext.broadcast(dict(zip(got["doc_id"].tolist(), got["label"].tolist(), strict=True)))

    def patterns_of(texts):
        return np.concatenate([np.zeros(0, dtype=np.int64), *(votes(part, *rest, lex.value) for _, part, *rest in words_of(texts))])

    def count_votes(batches):
        for batch in batches:
            known = np.fromiter((taught.value.get(i, -1) for i in batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)
            keys, n = np.unique(patterns_of(batch.column(1)) * 4 + known + 1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys // 4), pa.array(keys % 4 - 1), pa.array(n.astype(np.int64))], names=["pattern", "known", "n"])

    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = text.mapInArrow(count_votes, "pattern long, known long, n long").groupBy("pattern", "known").agg(F.sum("n").alias("n")).orderBy("pattern", "known").toPandas()
    model = LabelModel(*(seen[c].to_numpy(dtype=np.int64) for c in ("pattern", "known", "n")))

    def own_votes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns_of(batch.column(2)))], names=["doc_id", "pattern"])

    own = train.mapInArrow(own_votes, f"doc_id {id_type}, pattern long").toPandas()
    drop_table(train)
    pattern = got.merge(own.groupby("doc_id", as_index=False).min(), on="doc_id", how="left")["pattern"].to_numpy(dtype=np.int64)
    if not len(rows):
        pattern = np.arange(1 << HITS)[:: max(1, (1 << HITS) // 4096)]
        rows, y = [np.zeros(0, dtype=np.int64)] * len(pattern), np.full(len(pattern), -1.0)
    bits = (pattern[:, None] >> np.arange(len(VOTERS))) & 1
    target = model.posterior(pattern, y.astype(np.int64))
    kept = (y >= 0) & (np.cumsum(y >= 0) % CALIBRATE == 0)
    weights, vote_weights, bias = fit_linear([r for r, k in zip(rows, kept, strict=True) if not k], pattern[~kept], target[~kept], lex.value.features)
    place = [np.searchsorted(lex.value.features, np.intersect1d(d, lex.value.features)) for d in rows]
    z = np.array([weights[k].sum() for k in place]) + bits @ vote_weights + bias
    slope, offset = platt(z[kept], y[kept])
    return ToxicityModel(lex.value, weights * slope, vote_weights * slope, bias * slope + offset)


def probabilities(texts: pa.Array, m: ToxicityModel) -> np.ndarray:
    out = np.full(len(texts), m.bias)
    for at, part, offsets, codes, feats, norm, table in words_of(texts):
        n = len(part)
        pattern = votes(part, offsets, codes, feats, norm, table, m.lex)
        out[at : at + n] += ((pattern[:, None] >> np.arange(len(VOTERS))) & 1) @ m.vote_weights
        useful = np.isin(feats, m.lex.features).any(axis=1) if len(m.lex.features) else np.zeros(len(feats), dtype=bool)
        tokens = np.flatnonzero(useful[codes])
        if len(tokens):
            row = np.repeat(np.searchsorted(offsets, tokens, side="right") - 1, feats.shape[1])
            own = feats[codes[tokens]].ravel()
            row, own = distinct_pairs(row[own >= 0], own[own >= 0], 2 * DIMS)
            place = np.minimum(np.searchsorted(m.lex.features, own), len(m.lex.features) - 1)
            hit = m.lex.features[place] == own
            out[at : at + n] += np.bincount(row[hit], weights=m.weights[place[hit]], minlength=n)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= threshold) for every row; empty and null texts are scored as texts without words.

    Repeated rows get the same score; ids may be of any type; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            s = probabilities(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return text.mapInArrow(run, f"doc_id {dict(text.dtypes)['doc_id']}, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() does not predict toxic, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column(at), shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
