"""Scoring documents by a gated recurrent language model over a count-based vocabulary."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import gru, sampling
from tidemark.llm.common import SLICE_BYTES, ready, words_of
from tidemark.session import stage

#: The model predicts words of so many occurrences in the training texts one by one, and so many of the most frequent at least and at
#: most; all others are one token, spelled by their counts.
LEAST_COUNT, VOCABULARY, LARGEST_VOCABULARY = 16, 2048, 32_768
#: Most frequent words whose counts every task holds; counts of all others are joined.
IN_MEMORY = 131_072
#: About so many training documents fit the first model; from it all training texts are then learned whole.
SAMPLE_ROWS, SAMPLE_EPOCHS = 1200, 2
#: Tokens of a piece of a long text, and tokens before a later piece that bring the state there.
CHUNK, LEAD = 4096, 64
#: Rounds in which the pieces are learned, with models averaged after each; lanes read side by side at most, the rate, and tokens laid out at once.
ROUNDS, ROUND_LANES, ROUND_WINDOW, ROUND_RATE, ROUND_TOKENS = 2, 512, 64, 0.06, 4_000_000
#: Windows that tokens laid out at once make at least, if need be by fewer lanes.
STEPS = 64
#: Bytes of text whose words are counted, or looked up, at once, and tokens scored side by side.
COUNTED_BYTES, RUN_BYTES, HELD_TOKENS = 24 << 20, 8 << 20, 4_000_000
#: Tokens of a round that are worth a model of their own, since every model learned is shuffled whole.
MODEL_TOKENS = 4_000_000
#: Pieces of the parameters when models are averaged, and models whose piece one task adds up at first.
PIECES, ADDED = 32, 64
SETTINGS = gru.Settings()


def _identity(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def _runs(batches: Iterator[pa.RecordBatch], column: int, most: int = RUN_BYTES) -> Iterator[pa.Table]:
    """The same rows in runs of whole texts of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, n = 0, batch.num_rows
        while at < n:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most - size, side="right")))
            held.append(batch.slice(at, upto - at))
            size += int(ends[upto - 1]) - before
            if size >= most or upto < n:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = upto
    if held:
        yield pa.Table.from_batches(held)


def _words(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, A-Z lower-cased, and how many each text has (null: none). Arrow's white space is that of the contracts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.combine_chunks().cast(pa.string())))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at an end of a text
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        words = words.filter(pa.array(full))
    return words, sizes


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches, 0, COUNTED_BYTES):
        found = _words(run.column(0))[0].value_counts()
        yield from pa.Table.from_arrays([found.field(0), found.field(1)], names=["word", "n"]).to_batches(max_chunksize=100_000)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over all whole texts (one column), A-Z lower-cased. Counted per task first, so that hot words cost little."""
    return texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The words in memory by rank, and the model's tokens by falling count: vocabulary words, the rest as one, and the end."""

    def __init__(self, words: list[str], counts: list[int], tokens: int, documents: int, distinct: int, size: int):
        self.words = pa.array([w.encode("utf-8", "surrogatepass") for w in words], pa.binary())
        self.counts = np.array(counts, np.int64)
        self.size = min(size, len(words))
        own = int(self.counts[: self.size].sum())
        counted = np.r_[self.counts[: self.size], tokens - own, documents].astype(np.int64)
        order = np.argsort(-counted, kind="stable")
        self.token = np.empty(len(counted), np.int32)
        self.token[order] = np.arange(len(counted), dtype=np.int32)
        self.sorted_counts = counted[order]
        self.other, self.end = int(self.token[self.size]), int(self.token[self.size + 1])
        self.documents = documents
        self.train_tokens = tokens + documents
        #: Tokens and different tokens of the base, and of the words outside the vocabulary.
        self.base = self.train_tokens + distinct + (documents > 0) + 1
        self.rest = tokens - own + distinct - self.size + 1

    def ranks(self, words: list[bytes] | pa.Array) -> np.ndarray:
        words = words.cast(pa.binary()) if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def tokens_of(self, ranks: np.ndarray, end: bool = True) -> np.ndarray:
        known = (ranks >= 0) & (ranks < self.size)
        out = np.where(known, self.token[np.where(known, ranks, 0)], np.int32(self.other)) if len(self.token) > 2 else np.full(len(ranks), self.other, np.int32)
        return np.r_[out, np.int32(self.end)].astype(np.int32) if end else out.astype(np.int32)

    def streams(self, ranks: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The tokens of each text with its end, from the ranks of the words of all texts."""
        ends = np.cumsum(sizes + 1)
        whole = np.full(int(ends[-1]) if len(ends) else 0, self.end, np.int32)
        inside = np.ones(len(whole), bool)
        inside[ends - 1] = False
        whole[inside] = self.tokens_of(ranks, end=False)
        return np.split(whole, ends[:-1])


def vocabulary(counts: DataFrame, documents: int, size: int | None = None, in_memory: int = IN_MEMORY) -> Vocabulary:
    """From counts of all training words; at most ``in_memory`` of them come to the driver.

    Unless told, the number of words that the model predicts grows with those counted ``LEAST_COUNT`` times, up to ``LARGEST_VOCABULARY``.
    Words are taken by whole levels of frequency (sixteenths of a power of two), from the top as long as they fit.
    """
    level = F.floor(F.log2("n") * 16)
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    lowest, held = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > in_memory:
            break
        lowest = row["level"]
    found = [] if lowest is None else counts.filter(level >= lowest).select("word", "n").collect()
    top = sorted(found, key=lambda r: (-r["n"], r["word"]))
    if size is None:
        size = min(LARGEST_VOCABULARY, max(VOCABULARY, sum(r["n"] >= LEAST_COUNT for r in top)))
    return Vocabulary([r["word"] for r in top], [r["n"] for r in top], tokens, documents, distinct, size)


# --- learning --------------------------------------------------------------------------------------------------


def _kind(tokens: int) -> type:
    return np.uint16 if tokens <= 1 << 16 else np.int32


PIECES_OF_TEXT = "round int, place long, lead int, tokens binary"


def _cut(vocab, rounds: int, chunk: int, lead: int):
    """All tokens of every text (with its end) in pieces of ``chunk``, each after up to ``lead`` tokens before it, dealt to rounds by a hash."""
    names, kinds = ["round", "place", "lead", "tokens"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocab.value
        kind = _kind(len(known.sorted_counts))
        rows: list[tuple] = []
        number = size = 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
            rows.clear()
            return batch

        for part in _runs(batches, 0):
            words, sizes = _words(part.column(0))
            streams = known.streams(known.ranks(words), sizes)
            for text, ids in zip(part.column(0).cast(pa.binary()).to_pylist(), streams, strict=True):
                ids = ids.astype(kind)
                number += 1  # copies of a text go to different places
                which = f"{number}/{xxhash.xxh64_hexdigest(text or b'')}"
                for at in range(0, len(ids), chunk):
                    before = min(at, lead)
                    place = xxhash.xxh64_intdigest(f"{which}/{at}")
                    rows.append((place % rounds, place >> 16, before, ids[at - before : at + chunk].tobytes()))
                    size += len(rows[-1][3])
                    if size >= SLICE_BYTES:
                        yield out()
                        size = 0
        if rows:
            yield out()

    return run


def _classes(tokens: int) -> int:
    """With borders at equal shares of square roots of counts, a class of falling counts (Zipf) costs 4 tokens / (classes ln tokens) outputs a token.

    Groups make classes cheap, so there are twice as many as would cost the least without them.
    """
    return math.isqrt(int(16 * tokens / math.log(max(3, tokens))))


def fit(
    train: DataFrame, vocab: Vocabulary, rows: int = SAMPLE_ROWS, settings: gru.Settings = SETTINGS, rounds: int = ROUNDS, chunk: int = CHUNK, lead: int = LEAD,
) -> bytes:
    """Learn from ``train`` (``__id, __text``): first a model of a bounded sample, then all tokens of all documents.

    Texts are cut into pieces of bounded size, which are shuffled evenly over tasks and dealt to ``rounds``. In a round every task (no more than the tokens are worth)
    starts from the model so far and learns all its pieces, by windows that carry the state on; the mean of all tasks' models,
    weighted by tokens, is the model of the next round. Models are averaged in pieces by Spark.
    """
    spark = ready(train.sparkSession)
    held = spark.sparkContext.broadcast(vocab)
    settings = replace(settings, classes=max(settings.classes, _classes(len(vocab.sorted_counts))))

    def learn(found: list[tuple]) -> bytes:
        known = held.value
        params, borders = gru.start(known.sorted_counts, settings)
        streams = [known.tokens_of(known.ranks(words_of(text))) for _, text in found]
        gru.train(params, borders, streams, known.end, settings, SAMPLE_EPOCHS)
        return pickle.dumps((params, borders))

    share = min(1.0, rows / max(1, vocab.documents))
    model = sampling.fit(train.filter(sampling.draw(F.col("__id")) < share), "__id", learn)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = train.select("__text").mapInArrow(_cut(held, rounds, chunk, lead), PIECES_OF_TEXT)
    pieces = stage(cut.repartition(parts, "round", "place").sortWithinPartitions("round", "place", "lead", "tokens"), "pieces")
    models = max(1, -(-vocab.train_tokens // (rounds * MODEL_TOKENS)))
    for number in range(rounds):
        model = _round(pieces.filter(F.col("round") == number).select("lead", "tokens").coalesce(models), model, vocab, settings)
    return model


def _round(pieces: DataFrame, model: bytes, vocab: Vocabulary, settings: gru.Settings) -> bytes:
    """The mean of the models that tasks learn from ``pieces``, each from ``model`` on; ``model`` where there are none."""
    start = pieces.sparkSession.sparkContext.broadcast(model)
    end, kind_of = vocab.end, _kind(len(vocab.sorted_counts))
    salts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")) // ADDED)

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, borders = pickle.loads(start.value)
        squares = gru.squares_of(params)
        streams, leads = [], []
        size = learned = 0

        def now() -> int:
            few = sum(map(len, streams)) // (STEPS * settings.window)
            window = max(settings.window, min(ROUND_WINDOW, sum(map(len, streams)) // (STEPS * ROUND_LANES)))
            wide = replace(settings, lanes=min(ROUND_LANES, max(8, few)), window=window)
            gru.train(params, borders, streams, end, wide, 1, ROUND_RATE, leads, squares)
            own = sum(map(len, streams)) - sum(leads)
            streams.clear()
            leads.clear()
            return own

        for batch in batches:
            for before, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                streams.append(np.frombuffer(tokens, kind_of).astype(np.int32))
                leads.append(before)
                size += len(streams[-1])
                if size >= ROUND_TOKENS:
                    learned += now()
                    size = 0
        if streams:
            learned += now()
        if learned:
            flat = np.concatenate([params[k].reshape(-1) for k in sorted(params)])
            weight = float(learned)
            parts = np.array_split(flat, PIECES)
            salt = TaskContext.get().partitionId() % salts  # the same if the task runs again
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), pa.array([salt] * PIECES, pa.int32()), pa.array([weight] * PIECES), pa.array([(p.astype(np.float64) * weight).astype(np.float32).tobytes() for p in parts], pa.binary())],
                names=["piece", "salt", "weight", "part"],
            )

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in rows.column("part").to_pylist())
        weight = float(sum(rows.column("weight").to_pylist()))
        return pa.table({"piece": [key[0].as_py()], "salt": [0], "weight": [weight], "part": [total.astype(np.float32).tobytes()]}, schema=pa.schema(
            [("piece", pa.int32()), ("salt", pa.int32()), ("weight", pa.float64()), ("part", pa.binary())]))

    kind = "piece int, salt int, weight double, part binary"
    taught = pieces.mapInArrow(teach, kind)
    found = taught.groupBy("piece", "salt").applyInArrow(add, kind).groupBy("piece").applyInArrow(add, kind).orderBy("piece").collect()
    if not found:
        return model
    params, borders = pickle.loads(model)
    flat = np.concatenate([np.frombuffer(r["part"], np.float32) for r in found]) / found[0]["weight"]
    at = 0
    for k in sorted(params):
        size = params[k].size
        params[k] = flat[at : at + size].reshape(params[k].shape).astype(np.float32)
        at += size
    return pickle.dumps((params, borders))


# --- scoring ---------------------------------------------------------------------------------------------------


def _score_documents(vocab, model):
    """One row per document with what is known in memory, and one per other word of it."""
    names = ["place", "id", "mark", "word", "n", "n_tokens", "n_known", "base", "score"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocab.value
        params, borders = pickle.loads(model.value)
        logs = np.log10(known.counts + 1.0)
        rest = np.log10(float(known.rest))
        end_log = np.log10(known.documents + 1.0)
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = gru.score(params, borders, [h[0] for h in held], known.end) / np.log(10)
            rows = [(*h[1:4], None, 1, *h[4:7], h[7] + float(p)) for h, p in zip(held, found, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for part in _runs(batches, 2):
            words, sizes = _words(part.column(2))
            ranks = known.ranks(words)
            owners = np.repeat(np.arange(len(sizes)), sizes)
            inside, beyond = ranks >= 0, ranks >= known.size
            total = lambda which: np.bincount(owners[which], logs[ranks[which]], len(sizes))
            base = total(inside) + end_log - (sizes + 1) * float(np.log10(known.base))
            spelled = total(beyond) - rest * np.bincount(owners[beyond], minlength=len(sizes))
            n_known = np.bincount(owners[inside], minlength=len(sizes)) + (known.documents > 0)
            marks = [int.from_bytes(xxhash.xxh64_digest(t or b""), "big", signed=True) for t in part.column(2).cast(pa.binary()).to_pylist()]
            streams = known.streams(ranks, sizes)
            places, ids = (part.column(i).to_pylist() for i in (0, 1))
            held += zip(streams, places, ids, marks, (sizes + 1).tolist(), n_known.tolist(), base.tolist(), spelled.tolist(), strict=True)
            rare = np.flatnonzero(~inside)
            # Each other word of a text once, with its number.
            others = pa.table([pa.array(owners[rare]), words.take(pa.array(rare))], names=["owner", "word"]).group_by(["owner", "word"], use_threads=False).aggregate([([], "count_all")])
            mine = others.column("owner")
            columns = [pa.chunked_array([pa.array(x, k)]).take(mine) for x, k in ((places, kinds[0]), (ids, kinds[1]), (marks, kinds[2]))]
            columns += [others.column("word"), others.column("count_all"), *[pa.nulls(len(others), k) for k in kinds[5:]]]
            yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=50_000)
            size += int(sizes.sum()) + len(sizes)
            if size >= HELD_TOKENS:
                yield out()
                size = 0
        if held:
            yield out()

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, size: int | None = None, in_memory: int = IN_MEMORY) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` tells the documents to learn from. Counts are over all words of all of those. ``base_score`` is the log10 probability
    under add-one counts; ``score`` that of the recurrent model, which gives words outside its vocabulary as one token, times
    their add-one share among such words. A word too rare to be held in memory gets its count by a join. A null text
    counts as empty (its end alone is scored), a null id as the empty text for ``train``; repeated rows stay repeated. With no
    training documents counts are zero and the model is the one it starts from.
    """
    spark = ready(docs.sparkSession)
    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    taught = rows_in.filter("train")
    counts = stage(word_counts(taught.select("text")), "counts")
    vocab = vocabulary(counts, taught.count(), size, in_memory)
    held = spark.sparkContext.broadcast(vocab)
    model = spark.sparkContext.broadcast(fit(taught.select(F.col("id").alias("__id"), F.col("text").alias("__text")), vocab, rows))
    kind = "place boolean, id long, mark long, word string, n long, n_tokens long, n_known long, base double, score double"
    told = stage(rows_in.select("train", "id", "text").mapInArrow(_score_documents(held, model), kind), "told")
    own = told.filter(F.col("word").isNull())
    rare = told.filter(F.col("word").isNotNull()).join(counts.select(F.col("word").alias("w"), F.col("n").alias("c")), F.col("word") == F.col("w"), "left")
    per_text = rare.groupBy(F.coalesce("id", F.lit(-1)).alias("i"), F.col("mark").alias("m"), F.col("id").isNull().alias("z")).agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("logs"), F.sum("n").alias("others"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("found"),
    )
    # Copies of a row under one id bring their words as often as there are copies.
    copies = own.groupBy(F.coalesce("id", F.lit(-1)).alias("i2"), F.col("mark").alias("m2"), F.col("id").isNull().alias("z2")).count()
    sums = per_text.join(copies, (F.col("i") == F.col("i2")) & (F.col("m") == F.col("m2")) & (F.col("z") == F.col("z2"))).select(
        "i", "m", "z", *[(F.col(c) / F.col("count")).alias(c) for c in ("logs", "others", "found")]
    )
    whole = own.join(sums, (F.coalesce("id", F.lit(-1)) == F.col("i")) & (F.col("mark") == F.col("m")) & (F.col("id").isNull() == F.col("z")), "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col), (~F.col("place")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0.0)).cast("long")).alias("n_known"),
        F.lit(vocab.train_tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs - F.coalesce("others", F.lit(0.0)) * F.lit(float(np.log10(vocab.rest)))).alias("score"),
    )
