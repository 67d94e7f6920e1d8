"""Language-model scores of texts: a unigram base and online logistic context mixing.

A text is lower-cased (A-Z) and read as words and one end. Word counts over all
training documents give the base. The model reads the running text: whether a
word repeats what followed before, then a path of binary decisions to one of
the commonest words, each mixed from bit predictors whose contexts reach back
across words (`coder`); words outside the tree are spelt, bit by bit, by a byte
model (`mixer`). Counters, weights and refinement are learnt online, task by
task over all training documents, and merged.

Documents are grouped into blocks of a few megabytes by a hash of id, length
and text. Each block gives its distinct words, so that even the commonest word
is one row a block; what is spelt and counted of the rarer words goes back to
the blocks that hold them, the commonest words, a fixed number, to all tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm import coder, mixer
from evidex.llm._shared import remainder, slices, written

#: Bytes of text in a block, about, and of text counted by a task into one set of tables.
BLOCK_BYTES, COUNT_BYTES = 8_000_000, 64_000_000
#: Words in the code tree, and words sent to all tasks as the commonest; none longer than LONGEST bytes.
CODED_WORDS, COMMON_WORDS, LONGEST = (1 << 15) - 1, 100_000, 64
#: Words that the byte model counts at a time, at first (doubled up to the most) and at most; words scored at a time; words of a lesson.
FIRST_WORDS, COUNT_WORDS, BATCH_WORDS, LESSON = 3_125, 50_000, 4_000, 256
#: Characters of text laid out at a time.
SPAN = 1_500_000
PARTS = "chunk bigint, content binary"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def block_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distinct words of a block with their training counts; the end is the empty word."""
    train: Counter[bytes] = Counter()
    other: set[bytes] = set()
    for text, held in zip(pdf["text"], pdf["held_out"]):
        words = words_of(text)
        if held:
            other.update(words)
        else:
            train.update(words)
            train[b""] += 1
    other.add(b"")
    rest = other.difference(train)
    words = list(train) + list(rest)
    return pd.DataFrame({"block": pdf["block"].iloc[0], "word": words, "n": list(train.values()) + [0] * len(rest)})


def merged(parts: DataFrame, size: int) -> np.ndarray:
    """Flat array of fixed size from the chunks of all tasks, summed chunk by chunk."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "content": [mixer.added(pdf["content"].tolist())]})

    total = parts.groupBy("chunk").applyInPandas(add, PARTS)
    return mixer.from_chunks([(r["chunk"], bytes(r["content"])) for r in total.collect()], size)


def fit_running(texts: DataFrame, tree: Broadcast, n_bytes: int) -> coder.Model:
    """The model of running words over all training texts: each task teaches its mixer and counts as it reads on."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learnt, tree_here = coder.Counts(), tree.value
        for pdf in batches:
            rows = pdf["text"].tolist()
            for lo, hi in slices(rows, SPAN):
                learnt.read(coder.stream_of([words_of(t) for t in rows[lo:hi]], tree_here), tree_here)
        yield pd.DataFrame(list(mixer.chunks(np.concatenate(learnt.parts()))), columns=["chunk", "content"])

    parts = texts.select("text").coalesce(max(1, -(-n_bytes // COUNT_BYTES))).mapInPandas(count, PARTS)
    sums, means = (len(x) for x in coder.Counts().parts())
    flat = merged(parts, sums + means)
    return coder.Model.of(flat[:sums], flat[sums:].astype(np.float64))


def fit_spelling(vocab: DataFrame, tree: Broadcast) -> mixer.Mixer:
    """The byte model over all training words outside the tree: each task teaches its mixer on words before it counts them."""
    shapes = (mixer.GATES, mixer.INPUTS), (257, mixer.LEVELS)
    rest = [int(np.prod(x)) for x in shapes]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, taught, most = mixer.Mixer.fresh(np.zeros((2, mixer.SLOTS), dtype=np.float32)), 1e-3, FIRST_WORDS
        for pdf in batches:
            both = [(w, c) for w, c in zip(map(bytes, pdf["word"]), pdf["c"].tolist()) if w not in tree.value.places]
            lo = 0
            while lo < len(both):
                words, n = [w for w, _ in both[lo : lo + most]], np.array([c for _, c in both[lo : lo + most]], dtype=np.float64)
                model.read(words, n, LESSON)
                taught += len(words)
                lo, most = lo + most, min(2 * most, COUNT_WORDS)
        means = np.concatenate((model.weights.ravel() * taught, model.refine.ravel() * taught, [taught]))
        yield pd.DataFrame(list(mixer.chunks(np.concatenate((model.table.ravel(), means)))), columns=["chunk", "content"])

    flat = merged(vocab.where("c > 0").mapInPandas(count, PARTS), 2 * mixer.SLOTS + sum(rest) + 1)
    model = mixer.Mixer.fresh(flat[: 2 * mixer.SLOTS].reshape(2, mixer.SLOTS))
    if flat[-1] > 0:
        weights, refine = np.split(flat[2 * mixer.SLOTS : -1].astype(np.float64) / flat[-1], rest[:1])
        model.weights, model.refine = weights.reshape(shapes[0]), refine.reshape(shapes[1])
    return model


def spelt_words(vocab: DataFrame, model: mixer.Mixer, tree: Broadcast) -> DataFrame:
    """Add `lp`, the log10 probability of spelling each distinct word; zero for words of the tree, which are not spelt."""
    sent = vocab.sparkSession.sparkContext.broadcast(model.settled())  # fixed size: SLOTS logits

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            words = [bytes(w) for w in batch]
            spelt = [i for i, w in enumerate(words) if w not in tree.value.places]
            out = np.zeros(len(words))
            for lo in range(0, len(spelt), BATCH_WORDS):
                part = spelt[lo : lo + BATCH_WORDS]
                out[part] = sent.value.log10([words[i] for i in part])
            yield pd.Series(out)

    return vocab.withColumn("lp", run.asNondeterministic()("word"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 7, held_rest: int = 2) -> DataFrame:
    """Base and model scores of every document row.

    Learns from documents whose crc32(id) modulo `held_mod` is not
    `held_rest`. A null or empty text is its end alone; a null id counts as
    empty text for the fold; repeated rows count and are scored each; texts and
    words of any length are read in full; an empty table gives no rows.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10) and bits_per_byte. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    slim = slim.withColumn("held_out", remainder("doc_id", held_mod) == held_rest)
    slim = slim.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.octet_length("text"), "text"), F.lit(blocks)))
    grouped = slim.groupBy("block")
    pairs = written(grouped.applyInPandas(lambda pdf: block_words(pdf), "block bigint, word binary, n bigint"))
    vocab = written(pairs.groupBy("word").agg(F.sum("n").alias("c")))
    totals = vocab.agg(F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("V")).first()
    n_train, denominator = int(totals["N"] or 0), float((totals["N"] or 0) + totals["V"] + 1)
    short = vocab.where(F.octet_length("word") <= LONGEST)
    coded = short.where("c > 0").orderBy(F.col("c").desc(), "word").limit(CODED_WORDS).collect()
    context = docs.sparkSession.sparkContext
    tree = context.broadcast(coder.tree_of([bytes(r["word"]) for r in coded], [r["c"] for r in coded], n_train - sum(r["c"] for r in coded)))  # CODED_WORDS
    model = context.broadcast(fit_running(slim.where("not held_out"), tree, size))  # tables of fixed size
    scored = written(spelt_words(vocab, fit_spelling(vocab, tree), tree))
    common = scored.where(F.octet_length("word") <= LONGEST).orderBy(F.col("c").desc(), "word").limit(COMMON_WORDS)
    top = common.collect()
    rest = scored.join(F.broadcast(common.select("word")), "word", "left_anti")  # COMMON_WORDS of LONGEST bytes
    lookup = pairs.select("block", "word").join(rest, "word")
    sent = context.broadcast(
        ({bytes(r["word"]): i for i, r in enumerate(top)}, np.array([r["c"] for r in top], dtype=np.float64), np.array([r["lp"] for r in top]))
    )

    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        first, common_c, common_lp = sent.value
        place = {bytes(w): i for i, w in enumerate(known["word"], len(first))}
        count = np.concatenate((common_c, known["c"].to_numpy(dtype=np.float64)))
        base, spelt = np.log10((count + 1) / denominator), np.concatenate((common_lp, known["lp"].to_numpy(dtype=np.float64)))
        rows, done = texts["text"].tolist(), []
        for lo, hi in slices(rows, SPAN):
            s = coder.stream_of([words_of(t) for t in rows[lo:hi]], tree.value)
            at = np.fromiter((first[w] if w in first else place[w] for w in s.distinct), dtype=np.int64, count=len(s.distinct))
            total = lambda x: np.bincount(s.text, weights=x, minlength=hi - lo)  # noqa: B023, E731
            every = at[s.at]
            score = model.value.log10(s, tree.value, spelt[at], hi - lo)
            done.append(pd.DataFrame({"n_tokens": np.bincount(s.text, minlength=hi - lo), "n_known": total(count[every] > 0), "base_score": total(base[every]), "score": score}))
        out = pd.concat(done, ignore_index=True)
        n_bytes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in rows])
        return pd.DataFrame(
            {
                "doc_id": texts["doc_id"].to_numpy(),
                "held_out": texts["held_out"].to_numpy(),
                "n_tokens": out["n_tokens"],
                "n_known": out["n_known"].astype(np.int64),
                "train_tokens": n_train,
                "base_score": out["base_score"],
                "score": out["score"],
                "bits_per_byte": -out["score"] * np.log2(10) / np.maximum(n_bytes, 1),
            }
        )

    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return grouped.cogroup(lookup.groupBy("block")).applyInPandas(lambda a, b: run(a, b), schema)
