"""Masked pseudo-likelihood scores (operator 5).

A network predicts every token from the two tokens on either side of it; a
document's score is the sum of the log-probabilities of its tokens given their
neighbours.  Tokens are what white space separates, A-Z lower-cased.

1. Words of all documents are counted (per batch, then by Spark) into a table
   that grows with the corpus.  The ``TOP`` most frequent have an id of their
   own, all others one of ``BUCKETS`` by hash.  The probability of such a word
   is that of its bucket, by the network, times its share of the bucket's
   occurrences, by the table, so no two words are taken for each other.
2. The network starts at the frequencies of its ids.  Documents are dealt by hash
   to lots of about ``LOT_TOKENS`` tokens; in every round each lot is trained in
   numpy from the same weights, and Spark averages the lots' weights by their
   tokens, in a tree.  Each round takes documents that no round before it took,
   few in the first, and in the last the half that is left.  Rows equal in doc_id
   and text are numbered and dealt by their number too, so any number of them is
   spread.  Lots and their order follow from the documents alone, so the number of
   files or executors does not change a score.
3. Every document is scored in one map.  The shares of the ``HELD`` most frequent
   words are broadcast; the rarer ones of each document are joined with the
   table, where by their rarity no key is hot.

The output layer is a product: the id's class (of ``CLASSES``), then the id in
its class, so a token costs two small softmaxes instead of one over all ids.

What leaves a task is its word counts and one set of weights for each lot, so
what is gathered follows the input; what is broadcast is of a bounded size.
Texts are trained on in runs of ``STEP`` tokens and scored in runs of ``SCORED``.

Defined cases: null, empty and blank texts have no tokens and score 0; repeated
rows are scored alike; words of over 64 bytes count by a digest; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, in_batches, saved, table
from .mixing import numbered

TOP, BUCKETS, CLASSES = 7680, 512, 64
IDS = TOP + BUCKETS
SIZE = IDS // CLASSES
SIDE, EMBED, HIDDEN = 2, 8, 24
STEP, RATE, SEED = 16_384, 0.2, 5
#: Tokens scored at once.
SCORED = 131_072
#: Tokens whose choices are computed at once, so that they stay in the processor's cache.
CACHED = 2048
#: Logits that are no larger than this need no maximum taken off: their exponentials and sums are far from the ends of 32-bit floats.
CALM = 70
#: Share of the documents in each round, one of so many: each round takes those that follow by a hash, all of them together.
ROUNDS = (16, 16, 8, 4, 2)
SHAPES = {"embed": (IDS + 1, EMBED), "w1": (2 * SIDE * EMBED, HIDDEN), "b1": (HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "ww": (CLASSES, HIDDEN, SIZE), "bw": (CLASSES, SIZE)}
#: Bytes of text whose words a task counts at once; words whose counts are broadcast, at most; tokens of a lot.
COUNTED, HELD, LOT_TOKENS = 24 << 20, 400_000, 1_000_000
#: Weights are averaged in pieces of so many numbers, so many lots at a time.
PIECE, SPREAD = 1 << 12, 32
#: Words are sorted into so many classes of frequency to each doubling.
FINE = 8

Weights = dict[str, np.ndarray]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the place of each word among them, and where the words of each text begin and end.

    White space is \\x20 \\x09-\\x0D; a word of over 64 bytes counts by a digest.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    if not full.all():
        flat, ends = flat.filter(pa.array(full)), np.append(0, np.cumsum(full))[ends]
    coded = flat.dictionary_encode()
    names, place = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
    if len(names) and pc.max(pc.binary_length(names)).as_py() > 64:
        names = pa.array([w if len(w) <= 64 else b"\0" + hashlib.blake2b(w, digest_size=16).digest() for w in names.to_pylist()], pa.binary())
    return names, place, ends


class Vocabulary:
    """The words with an id or a share that is held, and how often each id occurs."""

    def __init__(self, words: list[bytes], counts: np.ndarray, buckets: np.ndarray):
        """``words`` by falling frequency; ``buckets``: occurrences of all words by bucket."""
        self.words, self.top = pa.array(words, pa.binary()), TOP
        own = len(words[:TOP])
        bucket = np.array([zlib.crc32(w) % BUCKETS for w in words], np.int64)
        rest = (buckets - np.bincount(bucket[:TOP], counts[:TOP], BUCKETS)).astype(float)
        self.frequency = np.zeros(IDS)
        self.frequency[:own], self.frequency[TOP : TOP + BUCKETS] = counts[:TOP], rest
        self.ids = np.concatenate([np.arange(own), TOP + bucket[TOP:], [-1]]).astype(np.int32)
        self.shares = np.concatenate([np.zeros(own), np.log(counts[TOP:] / rest[bucket[TOP:]]), [0.0]])
        self.rest = rest

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
        """Ids of the texts in a row, where those of each text begin and end, the sums of the shares that are held, the words of which none is."""
        names, place, ends = words_of(texts)
        held = pc.index_in(names, value_set=self.words).fill_null(-1).to_numpy()  # the last id and share stand for none
        ids, rare = self.ids[held].copy(), held < 0
        ids[rare] = [self.top + zlib.crc32(w) % BUCKETS for w in names.filter(pa.array(rare)).to_pylist()]
        sums = np.append(0.0, np.cumsum(self.shares[held][place]))[ends]
        others = rare[place]
        words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(others))[ends].astype(np.int32)), names.take(pa.array(place[others])))
        return ids[place], ends, np.diff(sums), words


def first_weights(frequency: np.ndarray | None = None) -> Weights:
    """Small random weights; biases that give each id its frequency."""
    rng = np.random.default_rng(SEED)
    w = {k: (np.zeros(s) if k[0] == "b" else rng.standard_normal(s) * (0.1 if k == "embed" else s[-2] ** -0.5)) for k, s in SHAPES.items()}
    if frequency is not None:
        n = (frequency + 0.5).reshape(CLASSES, SIZE)
        w["bc"], w["bw"] = np.log(n.sum(axis=1) / n.sum()), np.log(n / n.sum(axis=1, keepdims=True))
        w["wc"], w["ww"] = w["wc"] / 10, w["ww"] / 10
    return {k: v.astype(np.float32) for k, v in w.items()}


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> Weights:
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {k: p.reshape(s) for (k, s), p in zip(SHAPES.items(), np.split(x.astype(np.float32), ends[:-1]), strict=True)}


def windows(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """n x 4: the two tokens before and after each; beyond the ends of a text stands IDS."""
    at = np.arange(len(tokens), dtype=np.int32) + np.repeat(np.arange(1, len(ends), dtype=np.int32) * SIDE, np.diff(ends))
    p = np.full(len(tokens) + SIDE * len(ends), IDS, np.int32)
    p[at] = tokens
    return np.stack([p[at + i] for i in range(-SIDE, SIDE + 1) if i], axis=1)


def _joint(w: Weights) -> tuple[np.ndarray, np.ndarray, bool]:
    """Weights and biases of the classes, and of the ids in each, the bias as a last row; whether logits stay small.

    Hidden values lie between -1 and 1, so the weights bound the logits.
    """
    of_class, of_word = np.concatenate([w["wc"], w["bc"][None]]), np.concatenate([w["ww"], w["bw"][:, None]], axis=1)
    return of_class, of_word, max(np.abs(of_class).sum(axis=0).max(), np.abs(of_word).sum(axis=1).max()) <= CALM


def _hidden(w: Weights, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the network sees around each token, and the hidden values with a last row of ones."""
    x = w["embed"].take(around.ravel(), axis=0).reshape(len(around), -1)
    h = np.ones((HIDDEN + 1, len(x)), x.dtype)
    np.matmul(w["w1"].T, x.T, out=h[:-1])
    h[:-1] += w["b1"][:, None]
    np.tanh(h[:-1], out=h[:-1])
    return x, h


class Choices:
    """One of ``size`` for each token, in blocks of CACHED tokens; columns are tokens, so that numpy works along them."""

    def __init__(self, size: int, calm: bool, kind: np.dtype):
        self.calm, self.room, self.ones, self.at = calm, np.empty(size * CACHED, kind), np.ones(size, kind), np.arange(CACHED)

    def _chances(self, joint: np.ndarray, h: np.ndarray, own: np.ndarray):
        """Of each token its logit, all exponentials, where its own lies among them, and their sum."""
        n = len(own)
        x = self.room[: len(self.ones) * n].reshape(-1, n)
        np.matmul(joint.T, h, out=x)
        place = own * n + self.at[:n]
        logit = x.ravel().take(place)
        if not self.calm:
            top = x.max(axis=0)
            x -= top
            logit -= top
        np.exp(x, out=x)
        return logit, x, place, self.ones @ x

    def log_of(self, joint: np.ndarray, h: np.ndarray, chosen: np.ndarray, found: np.ndarray) -> None:
        """Adds to ``found`` the log-probability of what each token chooses."""
        for i in range(0, len(chosen), CACHED):
            logit, _, _, total = self._chances(joint, h[:, i : i + CACHED], chosen[i : i + CACHED])
            found[i : i + CACHED] += logit - np.log(total)

    def gradients_of(self, joint: np.ndarray, h: np.ndarray, chosen: np.ndarray, share: float, of_h: np.ndarray) -> np.ndarray:
        """Gradient of ``joint`` for the negative log-probability of each choice, times ``share``; adds that of the hidden values to ``of_h``."""
        of_joint = 0.0
        for i in range(0, len(chosen), CACHED):
            part = h[:, i : i + CACHED]
            _, x, place, total = self._chances(joint, part, chosen[i : i + CACHED])
            x.ravel()[place] -= total
            scale = share / total
            of_joint = of_joint + (part * scale) @ x.T
            more = joint[:-1] @ x
            more *= scale
            of_h[:, i : i + CACHED] += more
        return of_joint


def _by_class(tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by class, and each class's place in it."""
    cls = (tokens // SIZE).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    ends = np.cumsum(np.bincount(cls, minlength=CLASSES))
    return order, [(c, slice(a, b)) for c, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if a < b]


def log_probs(w: Weights, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    order, classes = _by_class(tokens)
    t = tokens[order]
    _, h = _hidden(w, around[order])
    of_class, of_word, calm = _joint(w)
    found, own = np.zeros(len(t)), t % SIZE
    Choices(CLASSES, calm, h.dtype).log_of(of_class, h, t // SIZE, found)
    words = Choices(SIZE, calm, h.dtype)
    for c, part in classes:
        words.log_of(of_word[c], h[:, part], own[part], found[part])
    out = np.empty_like(found)
    out[order] = found
    return out


def gradients(w: Weights, tokens: np.ndarray, around: np.ndarray) -> Weights:
    """Of the mean negative log-probability."""
    order, classes = _by_class(tokens)
    t, at, share = tokens[order], around[order], w["b1"].dtype.type(1 / len(tokens))
    x, h = _hidden(w, at)
    of_class, of_word, calm = _joint(w)
    dh, own = np.zeros_like(h[:-1]), t % SIZE
    joint = Choices(CLASSES, calm, h.dtype).gradients_of(of_class, h, t // SIZE, share, dh)
    g = {"wc": joint[:-1], "bc": joint[-1], "ww": np.zeros_like(w["ww"]), "bw": np.zeros_like(w["bw"])}
    words = Choices(SIZE, calm, h.dtype)
    for c, part in classes:
        joint = words.gradients_of(of_word[c], h[:, part], own[part], share, dh[:, part])
        g["ww"][c], g["bw"][c] = joint[:-1], joint[-1]
    dh *= 1 - h[:-1] * h[:-1]
    g["w1"], g["b1"] = (dh @ x).T, dh.sum(axis=1)
    dx = (w["w1"] @ dh).reshape(2 * SIDE, EMBED, -1)  # sides, numbers of an embedding, tokens
    seen = at.T.ravel().astype(np.intp)
    g["embed"] = np.stack([np.bincount(seen, dx[:, k].ravel(), IDS + 1) for k in range(EMBED)], axis=1).astype(dx.dtype)
    return g


def train(w: Weights, runs, rate: float = RATE) -> tuple[Weights, int]:
    """AdaGrad over batches of about STEP tokens; gives the weights and the number of tokens."""
    w = {k: v.copy() for k, v in w.items()}
    sums = {k: np.full_like(v, 1e-6) for k, v in w.items()}
    seen = 0
    for tokens, around in runs:
        for k, g in gradients(w, tokens, around).items():
            sums[k] += (step := g * g)
            np.sqrt(sums[k], out=step)
            np.divide(g, step, out=step)
            step *= rate
            w[k] -= step
        seen += len(tokens)
    return w, seen


def _runs(batches, vocabulary: Vocabulary):
    """Runs of STEP tokens and their windows, cut alike however the texts come in batches; windows do not cross texts."""
    held = []
    for texts in batches:
        tokens, ends, _, _ = vocabulary.tokens(texts)
        held.append((tokens, windows(tokens, ends)))
        if sum(len(t) for t, _ in held) >= STEP:
            tokens, around = map(np.concatenate, zip(*held, strict=True))
            whole = len(tokens) - len(tokens) % STEP
            yield from ((tokens[i : i + STEP], around[i : i + STEP]) for i in range(0, whole, STEP))
            held = [(tokens[whole:], around[whole:])]
    if held and (rest := tuple(map(np.concatenate, zip(*held, strict=True))))[0].size:
        yield rest


def _count(batches):
    for batch in gathered(batches, COUNTED):
        names, place, _ = words_of(batch.column(0))
        yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(place, minlength=len(names)).astype(np.int64))], ["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: every word of the corpus."""
    return in_batches(texts).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, held: int = HELD) -> Vocabulary:
    """The most frequent words, ``held`` at most unless the first class of frequency has more; few words stay behind."""
    grade = F.floor(F.log2("n") * FINE)
    grades = counts.groupBy(grade.alias("grade")).count().collect()  # some hundreds
    least, total = math.inf, 0
    for r in sorted(grades, key=lambda r: -r["grade"]):
        total += r["count"]
        if total > held and least < math.inf:
            break
        least = r["grade"]
    found = counts.where(grade >= least).select("word", "n").toArrow() if grades else pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    rows = sorted(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    buckets = np.zeros(BUCKETS)
    for r in counts.groupBy((F.crc32("word") % BUCKETS).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        buckets[r["bucket"]] = r["n"]
    return Vocabulary([w for w, _ in rows], np.array([n for _, n in rows], float), buckets)


MEANS = "piece int, part int, n long, x binary"


def _mean(group: pa.Table) -> pa.Table:
    """Mean of the weights of a group, by tokens; in the order of parts, so that sums agree between runs."""
    group = group.sort_by("part")
    n, total = 0, 0.0
    for k, x in zip(group["n"].to_pylist(), group["x"], strict=True):
        total = total + np.frombuffer(x.as_py(), np.float32).astype(float) * k
        n += k
    part = group["part"][0].as_py() // SPREAD
    return pa.table({"piece": group["piece"][:1], "part": pa.array([part], pa.int32()), "n": [n], "x": pa.array([(total / max(n, 1)).astype(np.float32).tobytes()], pa.binary())})


def _by_lot(batches):
    """Lot and texts of each stretch of a batch."""
    for batch in batches:
        lots = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(lots)]
        yield from ((int(lots[a]), batch.column(1).slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if a < b)


def told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``copy``: null for the first of rows equal in both, so hashes pass over it, and a number for each other."""
    rows = numbered(docs.select("doc_id", "text", F.lit(None).cast("string").alias("source")))
    return rows.select("doc.doc_id", "doc.text", F.nullif("again", F.lit(1)).alias("copy"))


def dealt(docs: DataFrame, lots: int) -> DataFrame:
    """lot, text, name of documents that are told apart."""
    name = F.xxhash64("doc_id", "text", "copy")
    return docs.select(F.pmod(F.xxhash64(name), F.lit(lots)).cast("int").alias("lot"), "text", name.alias("name"))


def one_round(docs: DataFrame, words, weights: Weights, lots: int) -> Weights:
    """Every lot is trained on its documents from ``weights``; the mean of what they reach."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def train_lots(batches):
        for lot, own in groupby(_by_lot(batches), key=lambda r: r[0]):
            w, n = train(held.value, _runs((texts for _, texts in own), words.value))
            if n:
                x = flat(w)
                pieces = [x[i : i + PIECE].tobytes() for i in range(0, len(x), PIECE)]
                k = len(pieces)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(range(k), pa.int32()), "part": pa.array([lot] * k, pa.int32()), "n": pa.array([n] * k, pa.int64()), "x": pa.array(pieces, pa.binary())})

    rows = in_batches(dealt(docs, lots).repartition("lot").sortWithinPartitions("lot", "name")).select("lot", "text")
    means = rows.mapInArrow(train_lots, MEANS)
    for _ in range(max(1, math.ceil(math.log(max(2, lots), SPREAD)))):
        means = means.groupBy("piece", F.floor(F.col("part") / SPREAD).alias("of")).applyInArrow(_mean, MEANS)
    rows = means.orderBy("piece").collect()  # one set of weights
    return unflat(np.concatenate([np.frombuffer(r["x"], np.float32) for r in rows])) if rows else weights


def trained(docs: DataFrame, words, rounds: tuple[int, ...] = ROUNDS) -> Weights:
    """Weights after rounds over one of so many documents each: in the order of a hash, from the start again after the last."""
    weights = first_weights(words.value.frequency)
    tokens = float(words.value.frequency.sum())
    slots, begin, docs = math.lcm(*rounds), 0, told_apart(docs)
    for share in rounds:
        some = docs.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text", "copy") - begin, F.lit(slots)) < slots // share)
        begin += slots // share
        weights = one_round(some, words, weights, max(1, round(tokens / share / LOT_TOKENS)))
    return weights


def scored(docs: DataFrame, rounds: tuple[int, ...] = ROUNDS, held_words: int = HELD) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood of each row."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    counts = saved(word_counts(docs.select("text")), "words")
    words = sc.broadcast(vocabulary(counts, held_words))
    held = sc.broadcast(trained(docs, words, rounds))

    def score(batches):
        for batch in batches:
            tokens, ends, sums, rare = words.value.tokens(batch.column(1))
            around, found = windows(tokens, ends), np.zeros(len(tokens) + 1)
            for i in range(0, len(tokens), SCORED):
                found[i + 1 : i + 1 + SCORED] = log_probs(held.value, tokens[i : i + SCORED], around[i : i + SCORED])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(sums + np.diff(np.cumsum(found)[ends])), rare], ["doc_id", "n_tokens", "part", "rare"])

    rows = in_batches(docs).mapInArrow(score, "doc_id long, n_tokens long, part double, rare array<binary>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "scored")  # written once, so the numbers stay
    rest = F.element_at(F.array(*(F.lit(float(x)) for x in words.value.rest)), (F.crc32("word") % BUCKETS + 1).cast("int"))
    rare = rows.select("row", F.explode("rare").alias("word")).join(counts, "word")
    shares = rare.groupBy("row").agg(F.sum(F.log(F.col("n") / rest)).alias("shares"))
    rows = rows.join(shares, "row", "left").select("doc_id", "n_tokens", (F.col("part") + F.coalesce("shares", F.lit(0.0))).alias("log_likelihood"))
    return rows.withColumn("mean_log_likelihood", F.col("log_likelihood") / F.nullif(F.col("n_tokens"), F.lit(0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
